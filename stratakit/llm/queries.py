"""Registers the operators as queries over the tables of a folder, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import _common as C
from . import ann, chat, decontam, html, langid, lm, minhash, mixing, tokenfile, tokens


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op1(C.table(spark, sf_dir, "documents"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.op2(C.table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op3(C.table(spark, sf_dir, "conversations"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.op4(C.table(spark, sf_dir, "documents"), vocabulary())


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op5(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.op6(C.table(spark, sf_dir, "embeddings"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.op7(C.table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op8(C.table(spark, sf_dir, "documents"))


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.op9(C.table(spark, sf_dir, "documents"), vocabulary())


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.op10(C.table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_minhash_dedup, op3_chat_format, op4_token_counts, op5_decontamination, op6_neighbours, op7_lm_score, op8_mixing, op9_token_file, op10_html_text)}

#: Windows of ten words (or a whole shorter item), hit words by document, items with an occurring window.
DECONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(2, len(w) - 8))) AS s FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS t FROM iw),
sizes AS (SELECT DISTINCT n FROM windows),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n),
m AS (SELECT doc_id, s, p.n, item_id FROM p JOIN windows ON p.n = windows.n AND array_to_string(w[s:s + p.n - 1], ' ') = t),
hits AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS x FROM m) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLES = {"op5_decontamination": DECONTAMINATION_SQL, "op8_mixing": mixing.SQL.format(docs="documents")}
