"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query

__all__ = ["R", "query", "r", "t"]


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def R(sql: str, digits: int = 6) -> str:
    return f"(round({sql}, {digits}) + 0.0)::DOUBLE"
