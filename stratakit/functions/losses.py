"""Losses as aggregate Columns, gradients as row-wise Columns.

p is a prediction, t a target: Columns of double, or of array<double> where a function says so. ``n`` in a gradient is
the number of rows, a Column or a number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import activ, vec

EPS = 1e-15
LOSSES: dict[str, Callable] = {}
GRADIENTS: dict[str, Callable] = {}


def loss(f: Callable) -> Callable:
    LOSSES[f.__name__] = f
    return f


def gradient(of: str) -> Callable:
    def add(f: Callable) -> Callable:
        GRADIENTS[of] = f
        return f

    return add


def difference(p: Column, t: Column, reduction: str = "none") -> Column:
    """Absolute difference: a row-wise Column, or its mean or sum."""
    d = F.abs(t - p)
    return {"none": d, "mean": F.avg(d), "sum": F.sum(d)}[reduction]


@loss
def mse(p: Column, t: Column, half: bool = False) -> Column:
    """Mean square; ``half`` of it for the function that is named so."""
    d = F.avg((p - t) * (p - t))
    return 0.5 * d if half else d


@loss
def rmse(p: Column, t: Column) -> Column:
    return F.sqrt(mse(p, t))


@loss
def sse(p: Column, t: Column) -> Column:
    return F.sum((p - t) * (p - t))


@loss
def mae(p: Column, t: Column) -> Column:
    return F.avg(F.abs(p - t))


@loss
def cosine(p: Column, t: Column, eps: float = 1e-8) -> Column:
    """p, t: arrays. Mean of 1 - cosine."""
    return F.avg(1 - vec.dot(p, t) / (vec.norm(p) * vec.norm(t) + eps))


def cosine_error(p: Column, t: Column, reduction: str = "none") -> Column:
    """p, t: arrays."""
    d = vec.cosine_distance(p, t)
    return {"none": d, "mean": F.avg(d), "sum": F.sum(d)}[reduction]


def cross_entropy_row(z: Column, t: Column, task: str) -> Column:
    """Of one row from logits z; for ``multinomial`` z and t are arrays, t one-hot; otherwise numbers."""
    if task == "multinomial":
        top = F.array_max(z)
        return F.log(vec.total(F.transform(z, lambda x: F.exp(x - top)))) - (vec.dot(z, t) - top)
    if task in ("binary", "multilabel"):
        return F.greatest(F.lit(0.0), z) - t * z + F.log1p(F.exp(-F.abs(z)))
    raise ValueError(f"unknown task {task}")


@loss
def cross_entropy(z: Column, t: Column, task: str = "binary") -> Column:
    return F.avg(cross_entropy_row(z, t, task))


@gradient("difference")
def difference_gradient(p: Column, t: Column) -> Column:
    return F.signum(p - t)


@gradient("mse")
def mse_gradient(p: Column, t: Column, n: Column | float) -> Column:
    return 2 * (p - t) / n


@gradient("sse")
def sse_gradient(p: Column, t: Column) -> Column:
    return 2 * (p - t)


@gradient("mae")
def mae_gradient(p: Column, t: Column, n: Column | float) -> Column:
    """0 where both agree."""
    return F.signum(p - t) / n


@gradient("rmse")
def rmse_gradient(p: Column, t: Column, n: Column | float, value: Column | float) -> Column:
    """value: the loss."""
    return (p - t) / (n * (value + EPS))


@gradient("cosine")
def cosine_gradient(p: Column, t: Column, n: Column | float, eps: float = 1e-8) -> Column:
    """By each element of p, an array."""
    np_, nt = vec.norm(p), vec.norm(t)
    c = vec.dot(p, t) / (np_ * nt + eps)
    return F.zip_with(p, t, lambda x, y: -(y / (np_ * nt + eps) - c * x / (np_ * np_ + eps)) / n)


@gradient("cross_entropy")
def cross_entropy_gradient(z: Column, t: Column, n: Column | float, task: str = "binary") -> Column:
    """(probability - target) / n."""
    if task == "multinomial":
        return F.zip_with(activ.softmax(z), t, lambda q, y: (q - y) / n)
    return (activ.sigmoid(z) - t) / n


def derivative(of: str, p: Column, t: Column, n: Column | float = 1.0) -> Column:
    """The plain derivatives by name: mse p - t, mae the sign, rmse |t - p| / sqrt(n), cross_entropy (p - t) / n."""
    return {"mse": p - t, "mae": F.signum(p - t), "rmse": F.abs(t - p) / F.sqrt(F.lit(n) if isinstance(n, (int, float)) else n), "cross_entropy": (p - t) / n}[of]


@dataclass
class MultiHeadLoss:
    """A weighted sum of losses, each over its own pair of columns."""

    losses: list[Callable[[Column, Column], Column]]
    weights: list[float] | None = None

    def __call__(self, predictions: list[Column], targets: list[Column]) -> Column:
        weights = self.weights or [1.0] * len(self.losses)
        parts = [w * f(p, t) for w, f, p, t in zip(weights, self.losses, predictions, targets, strict=True)]
        out = parts[0]
        for p in parts[1:]:
            out = out + p
        return out

    def gradients(self, gradients: list[Callable], predictions: list[Column], targets: list[Column]) -> list[Column]:
        weights = self.weights or [1.0] * len(self.losses)
        return [w * g(p, t) for w, g, p, t in zip(weights, gradients, predictions, targets, strict=True)]
