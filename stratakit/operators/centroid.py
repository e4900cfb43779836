"""Divisive centroid clustering: Lloyd steps, then the worst cluster is split along its principal axis.

Every step is one pass of partial sums; the driver only keeps k centres and, for the split, one covariance matrix.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics, moments


@dataclass
class CentroidNetwork:
    max_clusters: int = 10
    seed: int = 42
    epsilon: float = 2e-3
    mean: np.ndarray | None = None
    std: np.ndarray | None = None
    centres: np.ndarray | None = None
    by_k: dict[int, np.ndarray] = field(default_factory=dict)
    scores: dict[int, float] = field(default_factory=dict)
    losses: dict[int, list[float]] = field(default_factory=dict)

    def _standard(self, df: DataFrame, features: str) -> DataFrame:
        m, s = self.mean.tolist(), self.std.tolist()
        z = F.zip_with(F.zip_with(F.col(features).cast("array<double>"), F.array(*map(F.lit, m)), lambda x, y: x - y), F.array(*map(F.lit, s)), lambda x, y: x / y)
        return df.select(F.col("id").cast("long").alias("id"), z.alias("features"))

    def _pass(self, z: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, sums and squared distances by nearest centre: one row a task."""
        c = z.sparkSession.sparkContext.broadcast(centres)
        k, d = centres.shape

        def run(batches):
            n, s, e = np.zeros(k), np.zeros((k, d)), np.zeros(k)
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), d)
                if len(x):
                    d2 = ((x[:, None] - c.value) ** 2).sum(axis=2)
                    at = d2.argmin(axis=1)
                    n += np.bincount(at, minlength=k)
                    np.add.at(s, at, x)
                    e += np.bincount(at, weights=d2.min(axis=1), minlength=k)
            yield pa.RecordBatch.from_pydict({"m": [np.r_[n, s.ravel(), e].tolist()]})

        parts = z.select("features").mapInArrow(run, "m array<double>").select(F.posexplode("m").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()
        v = parts["v"].to_numpy() if len(parts) else np.zeros(k * (d + 2))
        return v[:k], v[k : k + k * d].reshape(k, d), v[k + k * d :]

    def lloyd(self, z: DataFrame, centres: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Centres after at most ``rounds`` steps (an empty cluster's stays), and the squared distances by cluster."""
        for _ in range(rounds):
            n, s, e = self._pass(z, centres)
            new = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], centres)
            if np.allclose(new, centres, rtol=0, atol=1e-12):
                return new, e
            centres = new
        return centres, self._pass(z, centres)[2]

    def local_density(self, labelled: DataFrame, cluster: int, near: int = 20) -> float:
        """Members within 1.67 times the mean of the ``near`` least squared distances, over 0.5 pi r^2."""
        d = labelled.where(F.col("cluster") == cluster).select("distance")
        least = [r[0] for r in d.orderBy("distance").limit(near).collect()]
        r = 1.67 * float(np.mean(least)) if least else 0.0
        inside = d.where(F.col("distance") <= r).count()
        return inside / (0.5 * np.pi * r**2) if r > 0 else 0.0

    def split(self, z: DataFrame, centres: np.ndarray, target: int) -> np.ndarray:
        """One centre more: on the target's principal axis, beyond its outermost member by sqrt(eigenvalue) / density."""
        labelled = metrics.assign(z, centres.tolist()).where(F.col("cluster") == target)
        g = moments.vector_gram(labelled, "features", centres.shape[1])
        if g.n < 2:
            return np.r_[centres, centres[target : target + 1] + self.epsilon]
        values, vectors = np.linalg.eigh(g.covariance(1))
        axis, size = vectors[:, -1], max(values[-1], 0.0)
        axis = axis * (np.sign(axis[np.abs(axis).argmax()]) or 1.0)
        along = F.aggregate(F.zip_with("features", F.array(*map(F.lit, axis.tolist())), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        least = labelled.agg(F.min(along)).first()[0] - float(g.mean @ axis)
        density = self.local_density(labelled, target)
        return np.r_[centres, (g.mean + axis * (least + np.sqrt(size) / (density + 1e-12) if density > 1 else least + np.sqrt(size)))[None]]

    def fit(self, df: DataFrame, features: str = "features", num_iterations: int = 25, fast_forward: bool = True, skip_standardize: bool = False) -> CentroidNetwork:
        """df: id and an array column. ``fast_forward`` leaves out the silhouette of every k."""
        size = df.select(F.size(features)).first()[0]
        g = moments.vector_gram(df, features, size)
        self.mean, std = g.mean, np.sqrt(np.maximum(np.diag(g.covariance()), 0))
        self.std = np.where(std > 0, std, 1.0)
        if skip_standardize:
            self.mean, self.std = np.zeros(size), np.ones(size)
        z = self._standard(df, features).cache()
        rng = np.random.default_rng(self.seed)
        centre = (g.mean - self.mean) / self.std
        centres = np.stack([centre + rng.uniform(-self.epsilon, self.epsilon, size) for _ in range(2)])
        while True:
            centres, sse = self.lloyd(z, centres, num_iterations)
            k = len(centres)
            self.by_k[k], self.losses[k] = centres, sse.tolist()
            if not fast_forward:
                self.scores[k] = metrics.silhouette(metrics.assign(z, centres.tolist())).first()[0]
            if k >= self.max_clusters:
                break
            centres = self.split(z, centres, int(sse.argmax()))
        z.unpersist()
        self.centres = centres
        return self

    def get_optimal(self) -> int:
        """The k with the best silhouette, or the last without scores."""
        return max(self.scores, key=lambda k: (self.scores[k], -k)) if self.scores else max(self.by_k)

    def predict(self, df: DataFrame, features: str = "features", k: int | None = None) -> DataFrame:
        """id, cluster, distance (squared, of standardised features)."""
        centres = self.by_k[k or self.get_optimal()]
        return metrics.assign(self._standard(df, features), centres.tolist()).select("id", "cluster", "distance")

    def fit_predict(self, df: DataFrame, **kw) -> DataFrame:
        return self.fit(df, **kw).predict(df, kw.get("features", "features"))

    def calculate_loss(self) -> float:
        return float(sum(self.losses[self.get_optimal()]))
