"""A training-corpus pipeline: documents in, token shards out. Each stage is one operator, written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratakit.llm import _common as C
from stratakit.llm import decontam, langid, minhash, mixing, tokenfile
from stratakit.llm.queries import vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language isn't recognised go."""
    return langid.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five words a shingle, similarity 0.8."""
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontam.clean(docs, C.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their targets: documents left out, cut at the budget's end, or repeated."""
    return mixing.apply(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids are written as shard files, and the files' index is read back."""
    return tokenfile.op9(docs, vocabulary())


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mix", mix), ("token_files", token_files)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = C.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = C.written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            C.remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained models and token ids can't be said in SQL.
ORACLE_SQL = None
