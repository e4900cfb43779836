"""What plots show, as tidy tables that any client can draw: bounded in size by what they are asked for."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cluster_points(df: DataFrame, centres: list[list[float]]) -> DataFrame:
    """cluster, x1, x2, is_centroid: the first two features of (features, cluster) rows, and of the centres."""
    points = df.select(F.col("cluster").cast("int").alias("cluster"), F.col("features")[0].alias("x1"), F.col("features")[1].alias("x2"), F.lit(False).alias("is_centroid"))
    rows = [(i, float(c[0]), float(c[1]), True) for i, c in enumerate(centres)]
    return points.unionByName(df.sparkSession.createDataFrame(rows, "cluster int, x1 double, x2 double, is_centroid boolean"))


def heatmap(spark: SparkSession, matrix: np.ndarray) -> DataFrame:
    """r, c, v of a small matrix: a map's hits or distances."""
    return spark.createDataFrame([(int(r), int(c), float(v)) for (r, c), v in np.ndenumerate(matrix)], "r int, c int, v double")


def importance(spark: SparkSession, names: list[str], values: np.ndarray) -> DataFrame:
    """name, value, rank: the largest absolute value first, ties by name."""
    order = sorted(range(len(names)), key=lambda i: (-abs(float(values[i])), names[i]))
    return spark.createDataFrame([(names[i], float(values[i]), k + 1) for k, i in enumerate(order)], "name string, value double, rank int")


def waveform(df: DataFrame, time: str, value: str, points: int = 1000) -> DataFrame:
    """bucket, low, high: the range of a signal in ``points`` even stretches of time."""
    first, last = df.agg(F.min(time), F.max(time)).first()
    if first is None:
        return df.sparkSession.createDataFrame([], "bucket int, low double, high double")
    step = max(1, -(-(int(last) - int(first) + 1) // points))
    b = F.floor((F.col(time) - int(first)) / step).cast("int")
    return df.groupBy(b.alias("bucket")).agg(F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"))
