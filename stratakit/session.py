"""A session with the settings that the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int = 8, **conf: str) -> SparkSession:
    """Adaptive execution, UTC, Arrow; ``conf`` with dots written as double underscores."""
    builder = SparkSession.builder.appName("stratakit").config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
