"""Synthetic tables from ``spark.range``: every value is a hash of its row's id, so partitions don't matter."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import activ, vec


@dataclass(frozen=True)
class GenConfig:
    num_samples: int = 1000
    num_features: int = 10
    noise: float = 0.5
    classes: int = 3
    clusters: int = 3
    ensure_label: bool = True
    onehot: bool = False
    seed: int = 42


def uniform(*keys: Column | int) -> Column:
    """In (0, 1), from a hash."""
    h = F.xxhash64(*(k if isinstance(k, Column) else F.lit(k) for k in keys))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)


def normal(*keys: Column | int) -> Column:
    return F.sqrt(-2 * F.log(uniform(*keys, 1))) * F.cos(2 * math.pi * uniform(*keys, 2))


def _vector(d: int, f) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(d - 1)), f)


def _weights(c: GenConfig, outputs: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(c.seed)
    return rng.normal(size=(c.num_features, outputs)), rng.normal(size=outputs)


def _scores(x: Column, w: np.ndarray, b: np.ndarray) -> list[Column]:
    return [vec.dot(x, F.array(*map(F.lit, w[:, k].tolist()))) + float(b[k]) for k in range(w.shape[1])]


def _rows(spark: SparkSession, c: GenConfig) -> DataFrame:
    return spark.range(c.num_samples)


def regression(spark: SparkSession, c: GenConfig) -> tuple[DataFrame, dict]:
    """x in (0, 1)^d, y = x w + b + noise."""
    w, b = _weights(c, 1)
    df = _rows(spark, c).withColumn("features", _vector(c.num_features, lambda i: uniform(F.col("id"), i, c.seed)))
    df = df.withColumn("y", _scores(F.col("features"), w, b)[0] + normal(F.col("id"), c.seed, 7) * c.noise)
    return df, {"weights": w[:, 0], "bias": float(b[0])}


def _gaussian(spark: SparkSession, c: GenConfig) -> DataFrame:
    return _rows(spark, c).withColumn("features", _vector(c.num_features, lambda i: normal(F.col("id"), i, c.seed)))


def binary(spark: SparkSession, c: GenConfig) -> tuple[DataFrame, dict]:
    w, b = _weights(c, 1)
    df = _gaussian(spark, c)
    y = (_scores(F.col("features"), w, b)[0] + normal(F.col("id"), c.seed, 7) * c.noise >= 0).cast("int")
    return df.withColumn("y", vec.to_onehot(y, 2) if c.onehot else y), {"weights": w[:, 0], "bias": float(b[0])}


def multiclass(spark: SparkSession, c: GenConfig) -> tuple[DataFrame, dict]:
    """A latent class in turn gets a margin of 0.5; the class is the largest score."""
    w, b = _weights(c, c.classes)
    s = F.array(*(v + F.when(F.col("id") % c.classes == k, 0.5).otherwise(0.0) for k, v in enumerate(_scores(F.col("features"), w, b))))
    y = vec.argmax(activ.softmax(s))
    return _gaussian(spark, c).withColumn("y", vec.to_onehot(y, c.classes) if c.onehot else y), {"weights": w, "bias": b}


def multilabel(spark: SparkSession, c: GenConfig) -> tuple[DataFrame, dict]:
    """Independent labels; a row without one gets its largest score's, if ``ensure_label``."""
    w, b = _weights(c, c.classes)
    df = _gaussian(spark, c).withColumn("__s", F.array(*_scores(F.col("features"), w, b)))
    y = F.transform("__s", lambda x: (x >= 0).cast("int"))
    if c.ensure_label:
        y = F.when(F.exists("__s", lambda x: x >= 0), y).otherwise(vec.to_onehot(vec.argmax(F.col("__s")), c.classes))
    return df.withColumn("y", y).drop("__s"), {"weights": w, "bias": b}


def clustering(spark: SparkSession, c: GenConfig) -> tuple[DataFrame, dict]:
    """Gaussian blobs of nearly equal sizes around centres in (-3, 3)^d."""
    centres = np.random.default_rng(c.seed).uniform(-3, 3, (c.clusters, c.num_features))
    table = F.array(*(F.array(*map(F.lit, row.tolist())) for row in centres))
    df = _rows(spark, c).withColumn("true_label", (F.col("id") % c.clusters).cast("int"))
    mine = F.element_at(table, F.col("true_label") + 1)
    return df.withColumn("features", F.transform(mine, lambda m, i: m + normal(F.col("id"), i, c.seed) * c.noise)), {"centres": centres}


TASKS = {"regression": regression, "binary": binary, "multiclass": multiclass, "multinomial": multiclass, "multilabel": multilabel, "clustering": clustering}


def generate(spark: SparkSession, task: str, **config) -> tuple[DataFrame, dict]:
    """The table of a task (id, features, y or true_label), and what made it."""
    if task not in TASKS:
        raise ValueError(f"unknown task {task}")
    return TASKS[task](spark, GenConfig(**config))


def phase_mix(spark: SparkSession, n: int = 128, length: int = 128, f1: float = 3, f2: float = 11, seed: int = 42) -> DataFrame:
    """id, x, y: two sines of random phases; y weighs them anew; both have mean 0."""
    p1, p2 = uniform(F.col("id"), seed, 1) * 2 * math.pi, uniform(F.col("id"), seed, 2) * 2 * math.pi

    def wave(a: float, b: float) -> Column:
        return _vector(length, lambda i: a * F.sin(2 * math.pi * f1 * i / length + p1) + b * F.sin(2 * math.pi * f2 * i / length + p2))

    df = spark.range(n).withColumn("x", wave(1.0, 1.0)).withColumn("y", wave(0.5, 1.5))
    def centred(c: str) -> Column:
        return F.transform(c, lambda v: v - vec.mean(F.col(c))).alias(c)

    return df.select("id", centred("x"), centred("y"))


def multifreq(spark: SparkSession, batch: int = 16, seq: int = 64, hidden: int = 8, noise: float = 0.1, seed: int = 42) -> DataFrame:
    """batch, seq, x, y: channel 0 a noisy sine of 2 or 10 Hz, channel 1 which (-1 or 1), others 0; y has the clean sine in channel 0."""
    df = spark.range(batch * seq).select((F.col("id") / seq).cast("int").alias("batch"), (F.col("id") % seq).cast("int").alias("seq"))
    fast = uniform(F.col("batch"), seed) >= 0.5
    clean = F.sin(2 * math.pi * F.when(fast, 10.0).otherwise(2.0) * F.col("seq") / seq)
    flag = F.when(fast, 1.0).otherwise(-1.0)
    rest = [F.lit(0.0)] * (hidden - 2)
    return df.select("batch", "seq", F.array(clean + normal(F.col("batch"), F.col("seq"), seed) * noise, flag, *rest).alias("x"), F.array(clean, flag, *rest).alias("y"))
