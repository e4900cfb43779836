"""Text scalars: hashing and removal of tags."""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_string(value: Column) -> Column:
    """SHA-256, in hexadecimal, of the value as a string."""
    return F.sha2(value.cast("string"), 256)


#: A comment, a declaration, or a tag with its attributes, whose quoted values may hold ``>``; or a reference that
#: decoding left, with its semicolon or without.
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*>|&(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][-.a-zA-Z0-9]*)(?=[^a-zA-Z0-9]);?""", re.S)


def without_tags(text: str | None) -> str | None:
    """References decoded, then markup taken out until none is left, also such as the taking out has made. Where there
    was a ``<``, unknown references end in a semicolon."""
    text = None if text is None else unescape(text)
    while text and "<" in text and (left := MARKUP.sub(lambda m: f"&{m[1]};" if m[1] else "", text)) != text:
        text = left
    return text


def strip_tags(value: Column) -> Column:
    def run(values: pd.Series) -> pd.Series:
        return values.map(without_tags, na_action="ignore")

    return F.pandas_udf(run, "string")(value)


def strip_tags_native(value: Column) -> Column:
    """Without Python, for well-formed markup: everything from ``<`` to ``>`` goes."""
    return F.regexp_replace(value, "<[^>]*>", "")
