"""Principal components and correspondence analysis from one matrix of sums."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import moments
from ..functions import vec


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that the largest loading is positive."""
    at = np.abs(vectors).argmax(axis=0)
    s = np.sign(vectors[at, np.arange(vectors.shape[1])])
    return vectors * np.where(s == 0, 1.0, s)


@dataclass
class Pca:
    features: list[str]
    mean: np.ndarray
    std: np.ndarray
    components: np.ndarray  # (features, k)
    explained: np.ndarray  # all eigenvalues, falling

    def project(self) -> Column:
        """array<double> of the k components of a row."""
        z = F.array(*(moments.clean(F.col(f"`{f}`")) - float(m) if s == 0 else (moments.clean(F.col(f"`{f}`")) - float(m)) / float(s) for f, m, s in zip(self.features, self.mean, self.std, strict=True)))
        return F.array(*(vec.dot(z, F.array(*map(F.lit, map(float, w)))) for w in self.components.T))


def pca(df: DataFrame, features: list[str], top_k: int = 3) -> Pca:
    """z-scores by population std, covariance with n - 1, the ``top_k`` leading eigenvectors."""
    g = moments.gram(df, features)
    c = g.covariance()
    std = np.sqrt(np.maximum(np.diag(c), 0))
    safe = np.where(std > 0, std, 1.0)
    z = c / np.outer(safe, safe) * g.n / max(g.n - 1, 1)
    values, vectors = np.linalg.eigh(z)
    if len(z) == 2 and (std > 0).all():
        # sum and difference, also where too little correlation is left to turn the axes to them
        one, r = (z[0, 0] + z[1, 1]) / 2, z[0, 1]
        values, vectors = np.array([one + r, one - r]), np.array([[1.0, 1.0], [1.0, -1.0]]) / np.sqrt(2)
    order = np.argsort(-values, kind="stable")
    return Pca(list(features), g.mean, std, _signed(vectors[:, order[:top_k]]), values[order])


@dataclass
class Mca:
    coordinates: np.ndarray  # of the indicator columns, (columns, k)
    inertia: np.ndarray
    masses: np.ndarray


def mca(df: DataFrame, indicators: list[str], top_k: int = 3) -> Mca:
    """Correspondence analysis of 0/1 columns with equal row sums, from the matrix of their joint counts (Burt)."""
    burt = moments.gram(df, indicators).products
    n = burt.sum()
    used = np.diag(burt) > 0
    p = burt[np.ix_(used, used)] / max(n, 1)
    mass = p.sum(axis=1)
    s = (p - np.outer(mass, mass)) / np.sqrt(np.outer(mass, mass))
    values, vectors = np.linalg.eigh(s)
    order = np.argsort(values)[::-1][:top_k]
    values = np.maximum(values[order], 0)
    coordinates = np.zeros((len(indicators), len(order)))
    coordinates[used] = _signed(vectors[:, order]) / np.sqrt(mass)[:, None] * np.sqrt(values)
    # the singular values of the Burt matrix are the squares of those of the indicators
    return Mca(coordinates, values, mass)
