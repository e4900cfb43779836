"""Language identification by word-first backoff.

A known word scores by its log frequency in each language; a word that training has not seen falls
back to its character 5-grams, then 4-grams, down to single characters: the first order with a known
gram decides. A document's language is the one with the largest sum over its words.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

LETTERS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
#: Letters of a run that are looked up at once; a longer run's grams are counted in Python, not by a row of all of them.
PIECE = 400


@dataclass
class Table:
    """Keys with one row of log frequencies, a language a column."""

    index: dict[str, int]
    rows: np.ndarray


@dataclass
class LanguageModel:
    """langs: sorted; grams: a table for each of ``orders``, the longest first."""

    langs: list[str]
    words: Table | None = None
    grams: list[Table] = field(default_factory=list)
    key: str = field(default_factory=lambda: uuid.uuid4().hex)
    orders: tuple[int, ...] = (5, 4, 3, 2, 1)

    def score_word(self, word: str) -> np.ndarray:
        if (at := self.words.index.get(word)) is not None:
            return self.words.rows[at]
        padded = f"^{word}$"
        for order, table in zip(self.orders, self.grams, strict=True):
            last, total, n = len(padded) - order + 1, 0.0, 0
            for start in range(0, last, PIECE):  # a run of letters without an end may be very long
                found = [at for i in range(start, min(start + PIECE, last)) if (at := table.index.get(padded[i : i + order])) is not None]
                total, n = total + table.rows[found].sum(axis=0, dtype=np.float64), n + len(found)
            if n:
                return (total / n).astype(np.float32)
        return np.zeros(len(self.langs), dtype=np.float32)


def _table(keys: list[str], langs: np.ndarray, n: np.ndarray, count: int) -> Table:
    """keys with the number of a language and a count, for ``count`` languages: add-half smoothed log frequencies."""
    index: dict[str, int] = {}
    at = np.fromiter((index.setdefault(k, len(index)) for k in keys), np.int64, len(keys))
    rows = np.full((len(index), count), 0.5)
    np.add.at(rows, (at, langs), n)
    totals = np.bincount(langs, n, minlength=count) + 0.5 * max(1, len(index))
    return Table(index, np.log(rows / totals).astype(np.float32))


def train(docs: DataFrame, max_docs: int = 4000) -> LanguageModel:
    """Learns from text and non-null lang of ``docs``.

    The classifier is fitted on at most about ``max_docs`` labelled documents, chosen by a hash of text and label, so that
    equal rows come in together; of these, every word and every n-gram is kept. No labelled row: no languages.
    """
    spark = docs.sparkSession
    C.batches(spark)
    labelled = C.pick(docs, text="string", lang="string").where("text is not null and lang is not null")
    sample = C.hashed_share(labelled, max_docs, "text", "lang")

    def count(frames):
        for frame in frames:
            seen: Counter = Counter()
            for lang, text in zip(frame.lang, frame.text, strict=True):
                for word, n in Counter(LETTERS.findall(text.lower())).items():
                    seen[lang, 0, word] += n
                    if len(word) > PIECE:
                        padded = f"^{word}$"
                        for order in LanguageModel.orders:
                            for i in range(len(padded) - order + 1):
                                seen[lang, order, padded[i : i + order]] += n
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["lang", "order", "key", "n"])

    found, path = C.written(C.dealt(sample).mapInPandas(count, "lang string, order int, key string, n long").groupBy("lang", "order", "key").agg(F.sum("n").alias("n")), "words")
    model = LanguageModel([])
    padded = F.concat(F.lit("^"), F.col("key"), F.lit("$"))
    orders = F.array(*map(F.lit, model.orders))
    grams = F.flatten(F.transform(orders, lambda o: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - o + 1)), lambda i: F.struct(o.alias("order"), F.substr(padded, i, o).alias("gram")))))
    exploded = found.where((F.col("order") == 0) & (F.length("key") <= PIECE)).select("lang", "n", F.explode(grams).alias("g")).where(F.length("g.gram") == F.col("g.order")).select("lang", F.col("g.order").alias("order"), F.col("g.gram").alias("key"), "n")
    counted = found.union(exploded).groupBy("order", "key", "lang").agg(F.sum("n").alias("n")).toArrow()  # bounded by the sample
    C.remove(spark, path)
    lang = counted.column("lang").combine_chunks().dictionary_encode() if counted.num_rows else None
    names = lang.dictionary.to_pylist() if lang is not None else []
    model.langs = sorted(names)
    number = np.array([model.langs.index(x) for x in names], dtype=np.int64)
    order, n = counted.column("order").to_numpy(), counted.column("n").to_numpy()
    for o in (0, *model.orders):
        mine = np.flatnonzero(order == o)
        some = number[lang.indices.to_numpy()[mine]] if len(mine) else np.zeros(0, dtype=np.int64)
        table = _table(counted.column("key").take(pa.array(mine)).to_pylist(), some, n[mine], len(names))
        if o:
            model.grams.append(table)
        else:
            model.words = table
    return model


class _Scores(dict):
    """Word to its row in ``table``; made on first sight, forgotten when there are ``most``."""

    def __init__(self, model: LanguageModel, most: int = 200_000):
        self.model, self.most, self.table = model, most, np.zeros((1024, len(model.langs)), dtype=np.float32)

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at] = self.model.score_word(word)
        self[word] = at
        return at


def classify(texts, model: LanguageModel, scores: _Scores | None = None) -> tuple[list[str], list[float]]:
    """The language and its posterior (0 to 1) of each text; ties go to the language that sorts first."""
    scores = _Scores(model) if scores is None else scores
    langs, values = [], []
    for text in texts:
        words = LETTERS.findall(text.lower()) if isinstance(text, str) else []
        if not model.langs or not any(w.isalpha() or any(c.isalpha() for c in w) for w in words):
            langs.append(UNDETERMINED)
            values.append(0.0)
            continue
        if len(scores) > scores.most:
            scores.clear()
        at = np.fromiter(map(scores.__getitem__, words), np.int64, len(words))
        total = scores.table[at].sum(axis=0, dtype=np.float64)
        best = int(np.argmax(total))
        langs.append(model.langs[best])
        values.append(float(1 / np.exp(np.maximum(total - total[best], -700)).sum()))
    return langs, values


def _annotated(docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """``keep`` of ``docs``, with lang_pred and score."""
    C.batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scores = C.held(shipped.value.key, lambda: _Scores(shipped.value))
        for batch in batches:
            langs, values = classify(batch.column("text").to_pylist(), shipped.value, scores)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(langs, pa.string()), pa.array(values, pa.float64())], names=[*keep, "lang_pred", "score"])

    return C.dealt(docs).mapInArrow(run, C.ddl(docs.select(*(f"`{k}`" for k in keep))) + ", lang_pred string, score double")


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` (any columns, of them text) with lang_pred and score.

    Null text, or one without a letter, gives ``und`` and 0.0; so does every text if no language was learned. A
    text with letters that training never saw scores alike for all languages. Repeated rows each get a row.
    Columns of those two names in ``docs`` are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    return _annotated(docs, model, docs.columns)


def op1(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the documents that aren't held out."""
    held = C.remainder("doc_id", 3) == 1
    model = train(docs.where(~held))
    rows = C.pick(docs, doc_id="long", text="string").select("doc_id", held.alias("held_out"), "text")
    return _annotated(rows, model, ["doc_id", "held_out"])


def keep_known(docs: DataFrame, min_score: float = 0.3) -> DataFrame:
    """The documents whose language is recognised, with their own columns.

    Rejected: ``und``, and those whose best language has a posterior under ``min_score`` (all words unknown).
    The model is trained on the labelled rows of ``docs`` itself; without any, every document is rejected.
    """
    model = train(docs)
    C.batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scores = C.held(shipped.value.key, lambda: _Scores(shipped.value))
        for batch in batches:
            langs, values = classify(batch.column("text").to_pylist(), shipped.value, scores)
            yield batch.filter(pa.array([a != UNDETERMINED and v >= min_score for a, v in zip(langs, values, strict=True)], pa.bool_()))

    return C.dealt(docs).mapInArrow(run, docs.schema)
