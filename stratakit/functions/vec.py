"""Array expressions: products, distances, similarities, indicator vectors. All stay in the JVM.

Arguments are Columns of array<double> unless said otherwise. Null arrays give null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it: a lambda's body is computed anew for each element."""
    return F.transform(F.array(value), f)[0]


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def mean(a: Column) -> Column:
    return bound(a, lambda v: F.try_divide(total(v), F.size(v).cast("double")))


def variance(a: Column) -> Column:
    """Population variance of the elements."""
    return bound(a, lambda v: bound(mean(v), lambda m: F.try_divide(total(F.transform(v, lambda x: (x - m) * (x - m))), F.size(v).cast("double"))))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, k: Column | float) -> Column:
    return F.transform(a, lambda x: x * k)


def manhattan_distance(a: Column, b: Column, summed: bool = True) -> Column:
    """Sum of absolute differences, or the differences themselves."""
    parts = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return total(parts) if summed else parts


def grid_manhattan_distance(r1: Column, c1: Column, r2: Column, c2: Column) -> Column:
    return F.abs(r1 - r2) + F.abs(c1 - c2)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def variance_ratio(a: Column, b: Column) -> Column:
    """Half the share of a's variance in both: not a distance between a and b."""
    return bound(variance(a), lambda v: F.try_divide(0.5 * v, v + variance(b)))


def normalized_euclidean_distance(a: Column, b: Column, compat: bool = False) -> Column:
    """Half the variance of a - b over the sum of variances; ``compat`` has the variance ratio in its place."""
    return variance_ratio(a, b) if compat else F.try_divide(0.5 * variance(subtract(a, b)), variance(a) + variance(b))


def mahalanobis_distance(a: Column, b: Column, inverse: list[list[float]]) -> Column:
    """inverse: of the covariance; see operators.moments for fitting it."""
    delta = subtract(a, b)
    rows = F.array(*(dot(F.array(*map(F.lit, map(float, row))), delta) for row in inverse))
    return F.sqrt(F.greatest(F.lit(0.0), dot(rows, delta)))


def hamming_distance(a: Column, b: Column) -> Column:
    """How many elements differ."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda x: x))


def cosine_similarity(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-15))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def jaccard_similarity(a: Column, b: Column) -> Column:
    """Of bit arrays; null if neither has a bit."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)), F.lit(0), lambda s, x: s + x.cast("int"))
    either = F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseOR(y)), F.lit(0), lambda s, x: s + x.cast("int"))
    return F.try_divide(both.cast("double"), either.cast("double"))


def argmax(a: Column) -> Column:
    """Place of the first largest element, from 0."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def argmin(a: Column) -> Column:
    return (F.array_position(a, F.array_min(a)) - 1).cast("int")


def to_onehot(code: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == code).cast("int"))


def to_khot(codes: Column, classes: int) -> Column:
    """codes: array<int>."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.array_contains(codes, i).cast("int"))


def to_int_classes(scores: Column, multilabel: bool = False) -> Column:
    """The first largest score's place; for several labels each score as 0 or 1."""
    return F.transform(scores, lambda x: F.round(x).cast("int")) if multilabel else argmax(scores)


def flatten_containers(*columns: Column) -> Column:
    """One array of the elements of all array columns."""
    return F.flatten(F.array(*columns))


DISTANCES: dict[str, Callable[[Column, Column], Column]] = {
    "euclidean": euclidean_distance,
    "manhattan": manhattan_distance,
    "hamming": hamming_distance,
    "cosine": cosine_distance,
}


def register_distance(name: str) -> Callable:
    """Adds a function of two Columns under ``name``."""

    def add_it(f: Callable[[Column, Column], Column]) -> Callable:
        DISTANCES[name] = f
        return f

    return add_it
