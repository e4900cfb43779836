"""Cluster metrics as DataFrame aggregates.

Vectors come as (id, features array<double>, cluster int). Each function returns a DataFrame of one row, or of one row
a cluster or pair of labels, so that results stay lazy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def _centres(df: DataFrame) -> DataFrame:
    """A row for each cluster and dimension."""
    return df.select("cluster", F.posexplode("features").alias("dim", "x")).groupBy("cluster", "dim").agg(F.avg("x").alias("mean"))


def centroids(df: DataFrame) -> DataFrame:
    """cluster, centre (array<double>): built from partial sums by dimension, never from gathered rows."""
    return _centres(df).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("dim", "mean"))).alias("c")).select("cluster", F.transform("c", lambda x: x["mean"]).alias("centre"))


def silhouette(df: DataFrame, singleton: float = 1.0, block: int = 4096) -> DataFrame:
    """silhouette: the mean of (b - a) / max(a, b) with Euclidean distances; 0 for fewer than two clusters.

    A cluster's only member has a = 0 and so scores ``singleton`` (0.0 by the other convention). The distances of all
    pairs are summed up in blocks of rows against blocks: a task holds two blocks, and gives one sum for each row and
    cluster.
    """
    rows = df.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("v"), F.col("cluster").cast("long").alias("k"))
    n = rows.count()
    blocks = max(1, -(-n // block))
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    left = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("side", F.lit(0))
    right = dealt.withColumn("o", F.col("b")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("side", F.lit(1))

    def sums(frame):
        import pandas as pd

        a, b = frame[frame.side == 0], frame[frame.side == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "k": [], "other": [], "s": []})
        y, ky = np.stack(b.v.to_numpy()), b.k.to_numpy()
        order = np.argsort(ky, kind="stable")
        y, ky = y[order], ky[order]
        labels, starts = np.unique(ky, return_index=True)
        out = []
        x = np.stack(a.v.to_numpy())
        for i in range(0, len(x), 256):
            d = np.sqrt(((x[i : i + 256, None, :] - y[None]) ** 2).sum(axis=2))
            out.append(np.add.reduceat(d, starts, axis=1))
        s = np.concatenate(out)
        return pd.DataFrame({"id": np.repeat(a.id.to_numpy(), len(labels)), "k": np.repeat(a.k.to_numpy(), len(labels)), "other": np.tile(labels, len(x)), "s": s.ravel()})

    pairs = left.unionByName(right).groupBy("b", "o").applyInPandas(sums, "id long, k long, other long, s double")
    summed = pairs.groupBy("id", "k", "other").agg(F.sum("s").alias("s"))
    sizes = _sizes(df).select(F.col("cluster").cast("long").alias("other"), "n")
    each = summed.join(sizes, "other")
    own = F.col("k") == F.col("other")
    score = each.groupBy("id").agg(
        F.max(F.when(own, F.when(F.col("n") > 1, F.col("s") / (F.col("n") - 1)).otherwise(0.0))).alias("a"),
        F.min(F.when(~own, F.col("s") / F.col("n"))).alias("b"),
        F.max(F.when(own, F.col("n"))).alias("n"),
    )
    top = F.greatest("a", "b")
    value = F.when(F.col("b").isNull() | (top == 0), 0.0).when(F.col("n") == 1, F.lit(float(singleton))).otherwise((F.col("b") - F.col("a")) / top)
    return score.agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("silhouette"))


def davies_bouldin(df: DataFrame) -> DataFrame:
    """davies_bouldin: mean over clusters of the largest (s_i + s_j) / d_ij, s the mean distance to the centre."""
    c = centroids(df)
    d2 = F.aggregate(F.zip_with("features", "centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    spread = df.join(c, "cluster").groupBy("cluster").agg(F.avg(F.sqrt(d2)).alias("s"))
    both = c.join(spread, "cluster")  # a row a cluster
    a, b = both.select(F.col("cluster").alias("i"), F.col("centre").alias("ci"), F.col("s").alias("si")), both.select(F.col("cluster").alias("j"), F.col("centre").alias("cj"), F.col("s").alias("sj"))
    apart = F.sqrt(F.aggregate(F.zip_with("ci", "cj", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    worst = a.join(b, F.col("i") != F.col("j")).groupBy("i").agg(F.max(F.try_divide(F.col("si") + F.col("sj"), apart)).alias("r"))
    return worst.agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame) -> DataFrame:
    """calinski_harabasz: (B / W) (n - k) / (k - 1), from sums by cluster and dimension: one pass."""
    x = df.select("cluster", F.posexplode("features").alias("dim", "x"))
    cells = x.groupBy("cluster", "dim").agg(F.count("x").alias("n"), F.avg("x").alias("m"), (F.var_pop("x") * F.count("x")).alias("w"))
    whole = cells.groupBy("dim").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"))
    joined = cells.join(whole, "dim")
    out = joined.agg(F.sum("w").alias("w"), F.sum(F.col("n") * (F.col("m") - F.col("g")) * (F.col("m") - F.col("g"))).alias("b"), F.sum(F.when(F.col("dim") == 0, F.col("n"))).alias("n"), F.count_if(F.col("dim") == 0).alias("k"))
    return out.select(F.try_divide(F.col("b") * (F.col("n") - F.col("k")), F.col("w") * (F.col("k") - 1)).alias("calinski_harabasz"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of both labels and n; pairs that don't occur are absent. Rows with a null label are left out."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("label_a"), F.col(b).alias("label_b")).agg(F.count(F.lit(1)).alias("n"))


def contingency_matrix(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row a label of a, one column a label of b."""
    return df.groupBy(a).pivot(b).count().na.fill(0)


def _joint(df: DataFrame, a: str, b: str) -> DataFrame:
    """The table with its margins; as small as the labels are few."""
    t = contingency(df, a, b)
    return t.withColumn("na", F.sum("n").over(Window.partitionBy("label_a"))).withColumn("nb", F.sum("n").over(Window.partitionBy("label_b"))).withColumn("t", F.sum("n").over(Window.partitionBy()))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """mutual_information, in nats."""
    n, t = F.col("n"), F.col("t")
    return _joint(df, a, b).agg(F.coalesce(F.sum(n / t * F.log(n * t / (F.col("na") * F.col("nb")))), F.lit(0.0)).alias("mutual_information"))


def entropy(df: DataFrame, a: str) -> DataFrame:
    """entropy of a label, in nats."""
    counts = df.where(F.col(a).isNotNull()).groupBy(a).agg(F.count(F.lit(1)).alias("n")).withColumn("t", F.sum("n").over(Window.partitionBy()))
    p = F.col("n") / F.col("t")
    return counts.agg(F.coalesce(-F.sum(p * F.log(p)), F.lit(0.0)).alias("entropy"))


def homogeneity(df: DataFrame, classes: str, clusters: str) -> DataFrame:
    """homogeneity: 1 - H(class | cluster) / H(class), 1 if there is one class."""
    j = _joint(df, classes, clusters)
    conditional = -F.sum(F.col("n") / F.col("t") * F.log(F.col("n") / F.col("nb")))
    # each class's share of entropy is dealt out over its cells
    own = -F.sum(F.col("n") / F.col("t") * F.log(F.col("na") / F.col("t")))
    return j.agg(conditional.alias("hc"), own.alias("h")).select(F.when(F.col("h") > 0, 1 - F.col("hc") / F.col("h")).otherwise(1.0).alias("homogeneity"))


def assign(df: DataFrame, centres: list[list[float]], features: str = "features", distance: str = "euclidean") -> DataFrame:
    """df with cluster (the first nearest centre) and distance (squared, for the Euclidean). Few centres are literals
    of the plan; many go through Arrow in blocks."""
    from ..functions import vec

    if not centres:
        raise ValueError("no centres")
    df = df.drop("cluster", "distance")
    if distance == "euclidean" and len(centres) * len(centres[0]) > 256:
        c = df.sparkSession.sparkContext.broadcast(np.array(centres, dtype=float))
        names = df.columns
        at = names.index(features)

        def run(batches):
            for batch in batches:
                x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), c.value.shape[1])
                # differences as in the expression for few centres, so that ties fall alike; a block of rows at a time
                step = max(1, 4_000_000 // c.value.size)
                parts = [((x[i : i + step, None] - c.value) ** 2).sum(axis=2) for i in range(0, len(x), step)]
                k = np.concatenate([p.argmin(axis=1) for p in parts]) if parts else np.zeros(0, dtype=int)
                near = np.concatenate([p.min(axis=1) for p in parts]) if parts else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k.astype(np.int32)), pa.array(near)], names=[*names, "cluster", "distance"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return df.mapInArrow(run, f"{kinds}, cluster int, distance double")
    f = vec.squared_distance if distance == "euclidean" else vec.DISTANCES[distance]
    d: Column = F.array(*(f(F.col(features), F.array(*map(F.lit, map(float, c)))) for c in centres))
    return df.withColumn("__d", d).withColumn("cluster", vec.argmin(F.col("__d"))).withColumn("distance", F.array_min("__d")).drop("__d")
