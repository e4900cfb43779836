"""WAV files as tables of samples."""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F


def read_wav(spark: SparkSession, path: str, standardize: bool = True) -> DataFrame:
    """path, t, channel, value of 8, 16 or 32 bit PCM files; ``standardize``: by file and channel."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with wave.open(io.BytesIO(data)) as w:
                    kind = {1: "u1", 2: "<i2", 4: "<i4"}[w.getsampwidth()]
                    x = np.frombuffer(w.readframes(w.getnframes()), dtype=kind).reshape(-1, w.getnchannels()).astype(float)
                n, c = x.shape
                for at in range(0, n, 100_000):
                    part = x[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * part.size), pa.array(np.repeat(np.arange(at, at + len(part)), c)), pa.array(np.tile(np.arange(c, dtype=np.int32), len(part))), pa.array(part.ravel())], names=["path", "t", "channel", "value"])

    out = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, t long, channel int, value double")
    if not standardize:
        return out
    stats = out.groupBy("path", "channel").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return out.join(stats, ["path", "channel"]).select("path", "t", "channel", F.try_divide(F.col("value") - F.col("m"), F.col("s")).alias("value"))


def windows(df: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """path, channel, win_idx, samples."""
    from ..operators.signal import rolling_windows

    return rolling_windows(df, "t", "value", size, overlap, by=["path", "channel"])


__all__ = ["read_wav", "windows"]
