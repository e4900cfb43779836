"""Column encoders: fitted from aggregates, applied as Columns.

An encoder names its aggregates (``stats``), takes their values (``bind``) and gives Columns (``encode``, ``inverse``).
All states merge: fitting once more goes on from what was seen, unless ``reset`` is asked for.
"""

from __future__ import annotations

import uuid
from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chrono
from ..functions.chrono import Period
from . import moments
from .moments import Moments, clean

KINDS: dict[str, type[Encoder]] = {}


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all machines share: spark.checkpoint.dir, or the warehouse where that is unset."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/{what}-{uuid.uuid4().hex}"


class Encoder(ABC):
    """One input column, at a position of the pipeline. Subclasses are found by name when pipelines are loaded."""

    kind = "numeric"
    output_type = "double"

    def __init__(self, target: str, index: int):
        self.target, self.index, self.fitted = target, index, False

    def __init_subclass__(cls, **kw):
        super().__init_subclass__(**kw)
        KINDS[cls.__name__] = cls

    @property
    def additional_targets(self) -> list[str]:
        """Further columns that fitting and encoding read."""
        return []

    @property
    def is_fitted(self) -> bool:
        return self.fitted

    @property
    def outputs(self) -> list[str]:
        return [self.target]

    def prepare(self, df: DataFrame) -> None:
        """For what an aggregate can't give."""

    @abstractmethod
    def stats(self) -> list[Column]: ...

    @abstractmethod
    def bind(self, row: dict) -> None: ...

    @abstractmethod
    def encode(self) -> list[Column]: ...

    @abstractmethod
    def inverse(self) -> list[Column]: ...

    def fit(self, df: DataFrame, reset: bool = False) -> Encoder:
        if reset:
            self.reset()
        self.prepare(df)
        exprs = self.stats()
        self.bind(df.agg(*exprs).first().asDict() if exprs else {})
        self.fitted = True
        return self

    def fit_encode(self, df: DataFrame) -> DataFrame:
        self.fit(df)
        return df.select(*self.encode())

    def reset(self) -> None:
        self.__init__(**self.params())

    @abstractmethod
    def params(self) -> dict: ...

    @abstractmethod
    def state(self) -> dict: ...

    @abstractmethod
    def restore(self, state: dict) -> None: ...

    def metadata(self) -> dict:
        return {self.target: {"idx": self.index, "output_dimension": len(self.outputs), "enc_type": self.kind, "output_type": self.output_type, "variable_names": self.outputs}}

    @property
    def info(self) -> dict:
        return {"class": type(self).__name__, "params": self.params(), "fitted": self.fitted, "state": self.state()}


class _Numeric(Encoder):
    def __init__(self, target: str, index: int, impute_method: str = "clip", impute_outliers: bool = False):
        super().__init__(target, index)
        if impute_method not in ("clip", "mean", "median"):
            raise ValueError(f"unknown method {impute_method}")
        self.impute_method, self.impute_outliers = impute_method, impute_outliers
        self.bounds: tuple[float, float] | None = None
        self.fill: float | None = None

    def prepare(self, df: DataFrame) -> None:
        if not self.impute_outliers:
            return
        c = F.col(f"`{self.target}`")
        self.bounds = moments.iqr_bounds(df, c)
        if self.bounds[0] is None:
            self.bounds = None
        elif self.impute_method == "mean":
            self.fill = df.agg(F.avg(clean(c))).first()[0]
        elif self.impute_method == "median":
            self.fill = moments.midpoint_quantiles(df, c, [0.5])[0]

    def value(self) -> Column:
        """The column as double, NaN as null, outliers replaced."""
        v = clean(F.col(f"`{self.target}`"))
        if not self.bounds:
            return v
        lo, hi = self.bounds
        if self.impute_method == "clip":
            return F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(hi)), F.lit(lo)))
        return F.when((v < lo) | (v > hi), F.lit(self.fill)).otherwise(v)

    def params(self) -> dict:
        return {"target": self.target, "index": self.index, "impute_method": self.impute_method, "impute_outliers": self.impute_outliers}

    def state(self) -> dict:
        return {"bounds": self.bounds, "fill": self.fill}

    def restore(self, state: dict) -> None:
        self.bounds, self.fill = tuple(state["bounds"]) if state["bounds"] else None, state["fill"]


class MinMaxEncoder(_Numeric):
    """Scales to ``encoding_range``. A constant column gives null."""

    def __init__(self, target: str, index: int, impute_method: str = "clip", encoding_range: tuple[float, float] = (0.0, 1.0), impute_outliers: bool = False):
        super().__init__(target, index, impute_method, impute_outliers)
        self.range = tuple(encoding_range)
        self.low = self.high = None
        self.observed: tuple | None = None

    def stats(self) -> list[Column]:
        return [F.min(self.value()).alias(f"{self.index}__lo"), F.max(self.value()).alias(f"{self.index}__hi")]

    def bind(self, row: dict) -> None:
        lo, hi = row[f"{self.index}__lo"], row[f"{self.index}__hi"]
        if lo is not None:
            self.low = lo if self.low is None else min(self.low, lo)
            self.high = hi if self.high is None else max(self.high, hi)
        self.observed = self.observed or (lo, hi)
        self.fitted = True

    def encode(self) -> list[Column]:
        a, b = self.range
        if self.low is None:
            return [F.lit(None).cast("double").alias(self.target)]
        return [(F.try_divide(self.value() - self.low, F.lit(self.high - self.low)) * (b - a) + a).alias(self.target)]

    def inverse(self) -> list[Column]:
        a, b = self.range
        return [((F.col(f"`{self.target}`") - a) * ((self.high or 0.0) - (self.low or 0.0)) / (b - a) + (self.low or 0.0)).alias(self.target)]

    def params(self) -> dict:
        return super().params() | {"encoding_range": list(self.range)}

    def state(self) -> dict:
        return super().state() | {"low": self.low, "high": self.high}

    def restore(self, state: dict) -> None:
        super().restore(state)
        self.low, self.high = state["low"], state["high"]


class StandardEncoder(_Numeric):
    """(v - mean) / (population std + eps)."""

    eps = 1e-12

    def __init__(self, target: str, index: int, impute_method: str = "clip", impute_outliers: bool = False):
        super().__init__(target, index, impute_method, impute_outliers)
        self.moments = Moments()

    def stats(self) -> list[Column]:
        return Moments.exprs(self.value(), str(self.index))

    def bind(self, row: dict) -> None:
        self.moments = self.moments.merge(Moments.of(row, str(self.index)))
        self.fitted = True

    def encode(self) -> list[Column]:
        return [((self.value() - self.moments.mean) / (self.moments.std + self.eps)).alias(self.target)]

    def inverse(self) -> list[Column]:
        return [(F.col(f"`{self.target}`") * (self.moments.std + self.eps) + self.moments.mean).alias(self.target)]

    def state(self) -> dict:
        return super().state() | {"n": self.moments.n, "mean": self.moments.mean, "m2": self.moments.m2}

    def restore(self, state: dict) -> None:
        super().restore(state)
        self.moments = Moments(state["n"], state["mean"], state["m2"])


class CategoricalEncoder(Encoder):
    """Codes by falling frequency, ties by value: 1, 2, .. (from 0 for targets). The first ``classes`` labels keep codes;
    every other value, seen or not, shares the next one; null stays null.

    Labels with codes are few by their number (``classes``) and are literals of the plan.
    """

    kind, output_type = "categorical", "int"
    RARE = "rare_label"
    HELD = 10_000

    def __init__(self, target: str, index: int, classes: int = 15, for_target: bool = False, rare_threshold: float | None = None):
        super().__init__(target, index)
        self.classes, self.for_target, self.rare_threshold = classes, for_target, rare_threshold
        self.counts: dict[str, int] = {}
        self.table: str | None = None
        self.labels: list[str] = []
        self.n_distinct = 0
        self.total = 0

    def count_categories(self, df: DataFrame) -> DataFrame:
        c = F.col(f"`{self.target}`").cast("string")
        return df.where(c.isNotNull()).groupBy(c.alias("label")).agg(F.count(F.lit(1)).alias("n"))

    def prepare(self, df: DataFrame) -> None:
        """Adds the labels of ``df`` to those of earlier batches. Up to ``HELD`` labels are kept with their counts; more
        of them are a table in the shared folder, so that any order of batches gives what one pass gives."""
        counted, spark = self.count_categories(df), df.sparkSession
        if self.table:
            counted = counted.union(spark.read.parquet(self.table))
        elif self.counts:
            counted = counted.union(spark.createDataFrame(list(self.counts.items()), "label string, n long"))
        counted = counted.groupBy("label").agg(F.sum("n").alias("n")) if self.table or self.counts else counted
        commonest = counted.orderBy(F.desc("n"), "label")
        top = commonest.limit(self.HELD + 1).collect()
        if len(top) <= self.HELD:
            self.total, self.n_distinct = sum(r.n for r in top), len(top)
        else:
            self.table = shared_path(spark, "labels")
            counted.write.parquet(self.table)
            self.total, self.n_distinct = spark.read.parquet(self.table).agg(F.sum("n"), F.count(F.lit(1))).first()
        self.counts = {r.label: r.n for r in top}
        ranked = [r.label for r in top[: self.classes]]
        if self.rare_threshold:
            ranked = [x for x in ranked if self.counts[x] >= self.rare_threshold * self.total]
        self.labels = ranked

    def stats(self) -> list[Column]:
        return []

    def bind(self, row: dict) -> None:
        self.fitted = True

    @property
    def offset(self) -> int:
        return 0 if self.for_target else 1

    @property
    def rare_code(self) -> int:
        return len(self.labels) + self.offset

    @property
    def num_categories(self) -> int:
        return len(self.labels) + 1

    def encode(self) -> list[Column]:
        c = F.col(f"`{self.target}`").cast("string")
        if self.labels:
            table = F.create_map(*(F.lit(x) for i, label in enumerate(self.labels) for x in (label, i + self.offset)))
            code = F.coalesce(F.try_element_at(table, c), F.lit(self.rare_code))
        else:
            code = F.lit(self.rare_code)
        return [F.when(c.isNotNull(), code).cast("int").alias(self.target)]

    def inverse(self) -> list[Column]:
        c = F.col(f"`{self.target}`").cast("int")
        label = F.lit(self.RARE)
        if self.labels:
            table = F.create_map(*(F.lit(x) for i, name in enumerate(self.labels) for x in (i + self.offset, name)))
            label = F.coalesce(F.try_element_at(table, c), label)
        return [F.when(c.isNotNull(), label).alias(self.target)]

    def metadata(self) -> dict:
        out = super().metadata()
        out[self.target] |= {"num_categories": self.num_categories, "counts": {x: self.counts[x] for x in self.labels}, "rare_labels": sorted(set(self.counts) - set(self.labels))}
        return out

    def params(self) -> dict:
        return {"target": self.target, "index": self.index, "classes": self.classes, "for_target": self.for_target, "rare_threshold": self.rare_threshold}

    def state(self) -> dict:
        return {"counts": self.counts, "table": self.table, "labels": self.labels, "n_distinct": self.n_distinct, "total": self.total}

    def restore(self, state: dict) -> None:
        self.counts, self.labels, self.n_distinct, self.total = dict(state["counts"]), list(state["labels"]), state["n_distinct"], state["total"]
        self.table = state.get("table")


class TimeCycleEncoder(Encoder):
    """Sine and cosine of a timestamp's position on a cycle."""

    kind = "chronologic"

    def __init__(self, target: str, index: int, numerator: Period | str = Period.DAY, denominator: Period | str = Period.WEEK):
        super().__init__(target, index)
        self.pair = Period(numerator), Period(denominator)
        if self.pair not in chrono.RATIOS:
            raise ValueError(f"no cycle of {self.pair[0].value} in {self.pair[1].value}")

    @property
    def outputs(self) -> list[str]:
        stem = f"{self.target}_{self.pair[0].value}_{self.pair[1].value}"
        return [f"{stem}_sin", f"{stem}_cos"]

    def stats(self) -> list[Column]:
        return []

    def bind(self, row: dict) -> None:
        self.fitted = True

    def encode(self) -> list[Column]:
        a = chrono.RATIOS[self.pair](F.col(f"`{self.target}`").cast("timestamp_ntz"))
        return [F.sin(a).alias(self.outputs[0]), F.cos(a).alias(self.outputs[1])]

    def inverse(self, compat: bool = False) -> list[Column]:
        """The position on the cycle, by both outputs; ``compat``: the principal values of each on its own."""
        s, c = (F.col(f"`{x}`") for x in self.outputs)
        if compat:
            return [chrono.inverse(F.asin(s), *self.pair).alias(self.outputs[0]), chrono.inverse(F.acos(c), *self.pair).alias(self.outputs[1])]
        return [chrono.inverse(chrono.angle(s, c), *self.pair).alias(self.target)]

    def params(self) -> dict:
        return {"target": self.target, "index": self.index, "numerator": self.pair[0].value, "denominator": self.pair[1].value}

    def state(self) -> dict:
        return {}

    def restore(self, state: dict) -> None:
        pass


class TimeDeltaEncoder(Encoder):
    """The time between a timestamp and an anchor column, in ``interval`` units, clipped to 0.75 of the least and 1.25 of
    the greatest seen, and scaled to [0, 1]. ``compat``: whole days don't count, and the greatest is taken off in place
    of the least."""

    kind = "chronologic"

    def __init__(self, target: str, index: int, anchor: str, timezone: str | None = None, interval: Period | str = Period.DAY, compat: bool = False):
        super().__init__(target, index)
        self.anchor, self.timezone, self.interval, self.compat = anchor, timezone, Period(interval), compat
        self.low = self.high = None

    @property
    def additional_targets(self) -> list[str]:
        return [self.anchor, *([self.timezone] if self.timezone else [])]

    def value(self) -> Column:
        a, b = F.col(f"`{self.target}`").cast("timestamp_ntz"), F.col(f"`{self.anchor}`").cast("timestamp_ntz")
        if self.timezone:
            hours = F.col(f"`{self.timezone}`").cast("int")
            a, b = chrono.localize_timestamp(a, hours), chrono.localize_timestamp(b, hours)
        return chrono.delta_seconds(a, b, self.compat) / chrono.SECONDS[self.interval]

    def stats(self) -> list[Column]:
        return [F.min(self.value()).alias(f"{self.index}__lo"), F.max(self.value()).alias(f"{self.index}__hi")]

    def bind(self, row: dict) -> None:
        lo, hi = row[f"{self.index}__lo"], row[f"{self.index}__hi"]
        if lo is not None:
            self.low = lo if self.low is None else min(self.low, lo)
            self.high = hi if self.high is None else max(self.high, hi)
        self.fitted = True

    def encode(self) -> list[Column]:
        if self.low is None:
            return [F.lit(None).cast("double").alias(self.target)]
        v = self.value()
        v = F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(1.25 * self.high)), F.lit(0.75 * self.low)))
        return [F.try_divide(v - (self.high if self.compat else self.low), F.lit(self.high - self.low)).alias(self.target)]

    def inverse(self) -> list[Column]:
        lo, hi = self.low or 0.0, self.high or 0.0
        return [(F.col(f"`{self.target}`") * (hi - lo) + (hi if self.compat else lo)).alias(self.target)]

    def params(self) -> dict:
        return {"target": self.target, "index": self.index, "anchor": self.anchor, "timezone": self.timezone, "interval": self.interval.value, "compat": self.compat}

    def state(self) -> dict:
        return {"low": self.low, "high": self.high}

    def restore(self, state: dict) -> None:
        self.low, self.high = state["low"], state["high"]
