"""Parameterless self-organising maps.

Online training depends on the order of samples, so all rows are streamed through the driver, a partition at a time, in an
order by hash that each epoch has anew; assignment of all rows is distributed. ``fit_batch`` trains by whole passes of partial
sums instead, which more machines shorten.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics, moments


def build_grid(width: int, height: int) -> np.ndarray:
    """(neurons, 2): row and column, neuron number = row * width + column."""
    return np.stack(np.divmod(np.arange(width * height), width), axis=1)


def grid_to_index(row: int, column: int, width: int) -> int:
    return row * width + column


def index_to_grid(index: int, width: int) -> tuple[int, int]:
    return divmod(index, width)


def lateral_distances(grid: np.ndarray) -> np.ndarray:
    """Manhattan distances of all neurons."""
    return np.abs(grid[:, None] - grid[None]).sum(axis=2)


NUMPY_DISTANCES = {
    "euclidean": lambda x, w: np.sqrt(((w - x) ** 2).sum(axis=1)),
    "manhattan": lambda x, w: np.abs(w - x).sum(axis=1),
    "hamming": lambda x, w: (w != x).sum(axis=1).astype(float),
    "cosine": lambda x, w: 1 - (w @ x) / np.maximum(np.linalg.norm(w, axis=1) * np.linalg.norm(x), 1e-15),
}


@dataclass
class SelfOrganisingMap:
    width: int = 10
    height: int = 10
    theta_min: float = 1.0
    theta_max: float | None = None
    seed: int = 42
    distance: str = "euclidean"
    init: str = "sample"  # or kaiming, small
    weights: np.ndarray | None = None
    hits: np.ndarray | None = None
    errors: list[float] = field(default_factory=list)
    labels: np.ndarray | None = None
    mean: np.ndarray | None = None
    std: np.ndarray | None = None

    def __post_init__(self):
        self.lateral = lateral_distances(build_grid(self.width, self.height))

    def initialize_weights(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        rng, n, d = np.random.default_rng(self.seed), self.width * self.height, len(low)
        if self.init == "sample":
            return rng.uniform(low, high, (n, d))
        bound = np.sqrt(6 / d) if self.init == "kaiming" else 0.1
        return rng.uniform(-bound, bound, (n, d))

    def _standardise(self, df: DataFrame, features: str) -> None:
        size = df.select(F.size(features)).first()[0]
        g = moments.vector_gram(df, features, size)
        self.mean, std = g.mean, np.sqrt(np.maximum(np.diag(g.covariance()), 0))
        self.std = np.where(std > 0, std, 1.0)

    def fit(self, df: DataFrame, features: str = "features", epochs: int = 50) -> SelfOrganisingMap:
        """Row by row, on all rows."""
        self._standardise(df, features)
        rows = df.select("id", F.col(features).cast("array<double>").alias("v"))
        ends = rows.select(*(f(F.col("v")[i]) for f in (F.min, F.max) for i in range(len(self.mean)))).first()
        low, high = (np.array(ends, dtype=float).reshape(2, -1) - self.mean) / self.std
        w, dist = self.initialize_weights(low, high), NUMPY_DISTANCES[self.distance]
        theta = float(self.theta_max or self.width)
        self.hits = np.zeros(len(w), dtype=np.int64)
        for epoch in range(epochs):
            theta = theta * 0.98 if theta > self.theta_min else self.theta_min + 1
            worst, error, n = None, 0.0, 0
            order = F.xxhash64(F.lit(self.seed), F.lit(epoch), "id")
            for row in rows.orderBy(order, "id", "v").select("v").toLocalIterator(prefetchPartitions=True):
                x = (np.array(row[0]) - self.mean) / self.std
                d = dist(x, w)
                best = int(d.argmin())
                if worst is None:
                    worst = d[best]
                    continue
                worst = max(worst, d[best])
                eps = d[best] / worst if worst > 0 else 0.0
                reach = max(theta * eps, self.theta_min)
                w += (eps * np.exp(-(self.lateral[best] ** 2) / reach**2))[:, None] * (x - w)
                self.hits[best] += 1
                error += d[best]
                n += 1
            self.errors.append(error / max(1, n))
        self.weights = w
        return self

    def fit_batch(self, df: DataFrame, features: str = "features", epochs: int = 10) -> SelfOrganisingMap:
        """By whole passes: each neuron becomes the mean of all rows, weighed by their best neuron's neighbourhood."""
        self._standardise(df, features)
        z = self._scaled(df, features)
        w = self.initialize_weights(-np.ones(len(self.mean)), np.ones(len(self.mean)))
        theta = float(self.theta_max or self.width)
        for _ in range(epochs):
            n, s, e = self._sums(z, w)
            h = np.exp(-(self.lateral**2) / max(theta, self.theta_min) ** 2)
            weight = h @ n
            w = np.where(weight[:, None] > 1e-12, (h @ s) / np.maximum(weight, 1e-12)[:, None], w)
            theta *= 0.7
            self.hits, self.weights = n.astype(np.int64), w
            self.errors.append(float(e.sum() / max(1, n.sum())))
        return self

    def _scaled(self, df: DataFrame, features: str) -> DataFrame:
        z = F.zip_with(F.zip_with(F.col(features).cast("array<double>"), F.array(*map(F.lit, self.mean.tolist())), lambda x, y: x - y), F.array(*map(F.lit, self.std.tolist())), lambda x, y: x / y)
        return df.select(F.col("id").cast("long").alias("id"), z.alias("features"))

    def _sums(self, z: DataFrame, w: np.ndarray):
        from .centroid import CentroidNetwork

        return CentroidNetwork()._pass(z, w)

    def bmu(self, df: DataFrame, features: str = "features") -> DataFrame:
        """id, neuron, distance for every row."""
        w, mean, std, name = self.weights, self.mean, self.std, self.distance

        def run(batches):
            dist = NUMPY_DISTANCES[name]
            for batch in batches:
                x = np.array(batch.column(1).to_pylist(), dtype=float)
                d = np.array([dist(v, w) for v in (x - mean) / std]) if len(x) else np.zeros((0, len(w)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(d.min(axis=1) if len(x) else np.zeros(0))], names=["id", "neuron", "distance"])

        return df.select(F.col("id").cast("long").alias("id"), F.col(features).cast("array<double>").alias("v")).mapInArrow(run, "id long, neuron int, distance double")

    def label_neurons(self, spark, max_clusters: int = 10) -> np.ndarray:
        """Clusters of the neurons' weights."""
        from .centroid import CentroidNetwork

        frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(self.weights)], "id long, features array<double>")
        found = CentroidNetwork(max_clusters=max_clusters, seed=self.seed).fit(frame, fast_forward=False).predict(frame).orderBy("id").collect()
        self.labels = np.array([r.cluster for r in found])
        return self.labels

    def predict(self, df: DataFrame, features: str = "features", max_clusters: int = 10) -> DataFrame:
        """id, neuron, distance, cluster (of the neuron)."""
        labels = self.labels if self.labels is not None else self.label_neurons(df.sparkSession, max_clusters)
        return self.bmu(df, features).withColumn("cluster", F.element_at(F.array(*map(F.lit, labels.tolist())), F.col("neuron") + 1))

    def u_matrix(self) -> np.ndarray:
        """(2 height - 1, 2 width - 1): distances between neighbours at the odd places, neurons at the even ones 0."""
        w = self.weights.reshape(self.height, self.width, -1)
        out = np.zeros((2 * self.height - 1, 2 * self.width - 1))
        out[::2, 1::2] = np.linalg.norm(w[:, 1:] - w[:, :-1], axis=2)
        out[1::2, ::2] = np.linalg.norm(w[1:] - w[:-1], axis=2)
        return out


__all__ = ["SelfOrganisingMap", "build_grid", "grid_to_index", "index_to_grid", "lateral_distances", "metrics"]
