"""Streams: encoders that go on learning batch by batch, and windowed statistics with late data.

Fitting a pipeline merges into its state, so every micro-batch is one more fit; the state is written after each batch,
and a restarted stream goes on from it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


from ..operators.moments import clean
from ..operators.pipeline import EncoderPipeline, save_pipeline


def fit_stream(stream: DataFrame, pipeline: EncoderPipeline, checkpoint: str, state: str | None = None, **trigger) -> StreamingQuery:
    """Each micro-batch is merged into ``pipeline``; ``state``: where it is saved after each."""
    pipeline._needs()

    def merge(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        held = batch.persist()
        try:
            pipeline.fit(held)
            if state:
                save_pipeline(batch.sparkSession, pipeline, state)
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def encode_stream(stream: DataFrame, pipeline: EncoderPipeline, keep: list[str] = ()) -> DataFrame:
    """Encoding is a projection, and so applies to streams as it is."""
    return pipeline.encode(stream, list(keep))


def windowed_moments(stream: DataFrame, time: str, value: str, width: str, slide: str | None = None, late: str | None = None, by: list[str] = ()) -> DataFrame:
    """n, mean, std (population) by event-time window; rows later than ``late`` are left out of streams."""
    if late:
        stream = stream.withWatermark(time, late)
    v: Column = clean(F.col(value))
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = stream.groupBy(window, *by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n", "mean", "std")


def merge_standardize(mean: float, std: float, n: int, more_mean: float, more_std: float, more_n: int) -> tuple[float, float, int]:
    """Mean, population standard deviation and number of two sets together."""
    total = n + more_n
    if not total:
        return 0.0, 0.0, 0
    m = (n * mean + more_n * more_mean) / total
    return m, math.sqrt((n * (std**2 + (mean - m) ** 2) + more_n * (more_std**2 + (more_mean - m) ** 2)) / total), total


__all__ = ["encode_stream", "fit_stream", "merge_standardize", "windowed_moments"]
