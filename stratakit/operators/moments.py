"""Sums of powers, Gram matrices and exact order statistics, each from a few passes with bounded results."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """As double, with NaN as null."""
    v = c.cast("double")
    return F.when(~F.isnan(v), v)


@dataclass
class Moments:
    """Number, sum and sum of squared deviations: merges exactly, so that fits can go on with more data."""

    n: float = 0
    mean: float = 0.0
    m2: float = 0.0

    @staticmethod
    def exprs(c: Column, name: str) -> list[Column]:
        v = clean(c)
        return [F.count(v).alias(f"{name}__n"), F.avg(v).alias(f"{name}__mean"), (F.var_pop(v) * F.count(v)).alias(f"{name}__m2")]

    @classmethod
    def of(cls, row: dict, name: str) -> Moments:
        return cls(row[f"{name}__n"] or 0, row[f"{name}__mean"] or 0.0, row[f"{name}__m2"] or 0.0)

    def merge(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return Moments()
        d = other.mean - self.mean
        return Moments(n, self.mean + d * other.n / n, self.m2 + other.m2 + d * d * self.n * other.n / n)

    @property
    def std(self) -> float:
        return (self.m2 / self.n) ** 0.5 if self.n else 0.0


@dataclass
class Gram:
    """Number of rows, means, and sums of products of deviations: all that covariances and least squares need."""

    n: float
    mean: np.ndarray
    centred: np.ndarray

    @classmethod
    def around(cls, n: float, shift: np.ndarray, sums: np.ndarray, products: np.ndarray) -> Gram:
        """From sums and products of x - shift."""
        d = sums / max(n, 1)
        return cls(n, shift + d, products - n * np.outer(d, d))

    @property
    def products(self) -> np.ndarray:
        """Sums of products of the values themselves."""
        return self.centred + self.n * np.outer(self.mean, self.mean)

    def covariance(self, ddof: int = 0) -> np.ndarray:
        return self.centred / max(self.n - ddof, 1)

    def correlation(self) -> np.ndarray:
        s = np.sqrt(np.maximum(np.diag(self.centred), 0))
        s[s == 0] = 1.0
        return self.centred / np.outer(s, s)


def gram(df: DataFrame, features: list[str]) -> Gram:
    """Of numeric columns; rows with a null or NaN among them are left out.

    One aggregate of the means, one of d(d + 1)/2 sums of products around them, so that large means don't cost digits.
    """
    d = len(features)
    data = df.select(*(clean(F.col(f"`{f}`")).alias(f"f{i}") for i, f in enumerate(features))).dropna()
    shift = np.array([x or 0.0 for x in data.agg(*(F.avg(f"f{i}") for i in range(d))).first()], dtype=float)
    x = [F.col(f"f{i}") - float(shift[i]) for i in range(d)]
    sums = data.agg(F.count(F.lit(1)).alias("n"), *(F.sum(x[i]).alias(f"s{i}") for i in range(d)), *(F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d))).first()
    p = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            p[i, j] = p[j, i] = sums[f"p{i}_{j}"] or 0.0
    return Gram.around(sums["n"], shift, np.array([sums[f"s{i}"] or 0.0 for i in range(d)]), p)


def vector_gram(df: DataFrame, column: str, size: int) -> Gram:
    """Of an array<double> column of ``size`` elements, by partial matrices: each task gives one row. Two passes, the
    first for the means."""
    import pyarrow as pa

    vectors = df.select(F.col(column).cast("array<double>").alias("v")).where((F.size("v") == size) & F.forall("v", lambda x: x.isNotNull()))

    def summed(shift, products):
        def run(batches):
            total = np.zeros(1 + size + size * size * products)
            for batch in batches:
                if len(batch):
                    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), size) - shift
                    total[0] += len(x)
                    total[1 : size + 1] += x.sum(axis=0)
                    if products:
                        total[size + 1 :] += (x.T @ x).ravel()
            yield pa.RecordBatch.from_pydict({"m": [total.tolist()]})

        cells = vectors.mapInArrow(run, "m array<double>").select(F.posexplode("m").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()
        out = np.zeros(1 + size + size * size * products)
        out[cells["i"].to_numpy()] = cells["v"].to_numpy()
        return out

    first = summed(np.zeros(size), False)
    shift = first[1:] / max(first[0], 1)
    m = summed(shift, True)
    return Gram.around(m[0], shift, m[1 : size + 1], m[size + 1 :].reshape(size, size))


def order_statistics(df: DataFrame, c: Column, ranks: list[int], small: int = 20_000) -> list[float]:
    """The exact values of these ranks (from 0) among the non-null, non-NaN values.

    Approximate percentiles bracket a rank, counts confirm the bracket, until what it holds can be sorted on the
    driver; no task ever holds more than its share.
    """
    values = df.select(clean(c).alias("v")).where("v is not null")
    out = []
    for rank in ranks:
        inside, below, share = values, 0, 0.001
        count = inside.count()
        if not 0 <= rank < count:
            raise ValueError(f"no rank {rank} among {count} values")
        while count > small:
            q = (rank - below + 0.5) / count
            lo, hi = inside.agg(F.percentile_approx("v", [max(0.0, q - share), min(1.0, q + share)], 100_000)).first()[0]
            under, upto = inside.agg(F.count_if(F.col("v") < lo), F.count_if(F.col("v") <= hi)).first()
            if not under <= rank - below < upto:
                share *= 4
                continue
            if lo == hi:
                break
            if upto - under == count:
                share /= 4
                if share < 1e-9:
                    break
                continue
            inside, below, count = inside.where((F.col("v") >= lo) & (F.col("v") <= hi)), below + under, upto - under
        if count > small:
            out.append(float(lo))
        else:
            out.append(float(sorted(r[0] for r in inside.collect())[rank - below]))
    return out


def midpoint_quantiles(df: DataFrame, c: Column, qs: list[float]) -> list[float | None]:
    """The mean of the two order statistics around (n - 1) q; null without values."""
    n = df.select(clean(c).alias("v")).where("v is not null").count()
    if not n:
        return [None] * len(qs)
    ranks = sorted({r for q in qs for r in (int(np.floor((n - 1) * q)), int(np.ceil((n - 1) * q)))})
    value = dict(zip(ranks, order_statistics(df, c, ranks), strict=True))
    return [(value[int(np.floor((n - 1) * q))] + value[int(np.ceil((n - 1) * q))]) / 2 for q in qs]


def iqr_bounds(df: DataFrame, c: Column, extension: float = 2.0) -> tuple[float | None, float | None]:
    """Midpoint quartiles less and plus ``extension`` interquartile ranges."""
    q1, q3 = midpoint_quantiles(df, c, [0.25, 0.75])
    return (None, None) if q1 is None else (q1 - extension * (q3 - q1), q3 + extension * (q3 - q1))


def is_outlier(c: Column, bounds: tuple[float, float]) -> Column:
    v = clean(c)
    return (v < bounds[0]) | (v > bounds[1])


def standardize(df: DataFrame, features: list[str], eps: float = 0.0) -> DataFrame:
    """(x - mean) / (population std + eps) of each column, under its own name; a constant column gives null if eps is 0."""
    row = df.agg(*(e for f in features for e in Moments.exprs(F.col(f"`{f}`"), f))).first().asDict()
    m = {f: Moments.of(row, f) for f in features}
    return df.withColumns({f: F.try_divide(clean(F.col(f"`{f}`")) - m[f].mean, F.lit(m[f].std + eps)) for f in features})
