"""Encoder pipelines: columns in declared order, one fused aggregate to fit, one projection to encode."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoders import KINDS, Encoder


class EncoderPipeline:
    """Encoders are added, then the pipeline is finalized; only then it fits and encodes."""

    def __init__(self):
        self.encoders: dict[str, Encoder] = {}
        self.frozen = False

    def add_encoder(self, encoder: Encoder) -> EncoderPipeline:
        if self.frozen:
            raise RuntimeError("the pipeline is finalized")
        if encoder.target in self.encoders:
            raise ValueError(f"{encoder.target} has an encoder")
        self.encoders[encoder.target] = encoder
        return self

    def finalize_setup(self) -> EncoderPipeline:
        """Sorts by position; positions must run from 0 without gaps."""
        ordered = sorted(self.encoders.values(), key=lambda e: e.index)
        if [e.index for e in ordered] != list(range(len(ordered))):
            raise ValueError("positions must run from 0 without gaps")
        self.encoders = {e.target: e for e in ordered}
        self.frozen = True
        return self

    def __getitem__(self, target: str) -> Encoder:
        return self.encoders[target]

    def _needs(self, frozen: bool = True, fitted: bool = False) -> None:
        if frozen and not self.frozen:
            raise RuntimeError("finalize_setup() comes first")
        if fitted and not self.is_fitted:
            raise RuntimeError("fit() comes first")

    @property
    def is_fitted(self) -> bool:
        return bool(self.encoders) and all(e.is_fitted for e in self.encoders.values())

    def validate_df(self, df: DataFrame) -> None:
        """Each encoder's column stands at its position under its name; what encoders read besides stands behind."""
        self._needs()
        names = df.columns
        for e in self.encoders.values():
            if e.index >= len(names) or names[e.index] != e.target:
                raise ValueError(f"column {e.index} should be {e.target}")
            for extra in e.additional_targets:
                if extra not in names:
                    raise ValueError(f"{e.target} needs column {extra}")

    def fit(self, df: DataFrame, reset: bool = False) -> EncoderPipeline:
        self.validate_df(df)
        exprs = []
        for e in self.encoders.values():
            if reset:
                e.reset()
            e.prepare(df)
            exprs += e.stats()
        row = df.agg(*exprs).first().asDict() if exprs else {}
        for e in self.encoders.values():
            e.bind(row)
        return self

    def encode(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        """The encoded columns, after ``keep``, as one projection. Null and NaN stay null."""
        self._needs(fitted=True)
        self.validate_df(df)
        return df.select(*keep, *(c for e in self.encoders.values() for c in e.encode()))

    def fit_encode(self, df: DataFrame) -> DataFrame:
        return self.fit(df).encode(df)

    def null_mask(self, df: DataFrame) -> DataFrame:
        """Whether each input is null or NaN."""
        kinds = dict(df.dtypes)
        return df.select(*((F.col(f"`{t}`").isNull() | (F.isnan(f"`{t}`") if kinds[t] in ("double", "float") else F.lit(False))).alias(t) for t in self.encoders))

    def decode(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        """The inverse of the encoded columns that df has."""
        self._needs(fitted=True)
        present = [e for e in self.encoders.values() if set(e.outputs) <= set(df.columns)]
        return df.select(*keep, *(c for e in present for c in e.inverse()))

    def metadata(self) -> dict:
        return {k: v for e in self.encoders.values() for k, v in e.metadata().items()}

    def output_mapping(self) -> dict[str, tuple[int, int]]:
        return {t: (e.index, len(e.outputs)) for t, e in self.encoders.items()}

    def output_column_names(self) -> list[str]:
        return [c for e in self.encoders.values() for c in e.outputs]

    def output_column_types(self) -> dict[str, str]:
        return {c: e.output_type for e in self.encoders.values() for c in e.outputs}

    def _places(self, kind: str) -> dict[str, int]:
        return {c: i for i, (c, e) in enumerate((c, e) for e in self.encoders.values() for c in e.outputs) if e.kind == kind}

    def get_categorical_output_info(self) -> dict[str, int]:
        """Categories of each categorical output."""
        return {c: e.num_categories for e in self.encoders.values() if e.kind == "categorical" for c in e.outputs}

    def get_numeric_output_info(self) -> list[int]:
        return list(self._places("numeric").values())

    def get_text_output_info(self) -> list[int]:
        return list(self._places("text").values())

    def get_profiler_output_info(self) -> dict[str, list[int]]:
        return {kind: list(self._places(kind).values()) for kind in ("numeric", "categorical", "chronologic", "text")}

    def to_json(self) -> str:
        self._needs()
        return json.dumps([e.info for e in self.encoders.values()])

    @classmethod
    def from_json(cls, text: str) -> EncoderPipeline:
        out = cls()
        for item in json.loads(text):
            e = KINDS[item["class"]](**item["params"])
            e.restore(item["state"])
            e.fitted = item["fitted"]
            out.add_encoder(e)
        return out.finalize_setup()


def save_pipeline(spark: SparkSession, pipeline: EncoderPipeline, path: str) -> None:
    """As one text file of JSON, in any store that Spark writes to."""
    spark.createDataFrame([(pipeline.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_pipeline(spark: SparkSession, path: str) -> EncoderPipeline:
    return EncoderPipeline.from_json("".join(r.value for r in spark.read.text(path).collect()))


def expand_list_column(df: DataFrame, column: str, size: int) -> DataFrame:
    """An array column as columns ``{column}_{i}``."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, *(F.col(column).getItem(i).alias(f"{column}_{i}") for i in range(size)))


def as_dataframe(spark: SparkSession, data) -> DataFrame:
    """A DataFrame from a DataFrame of Spark or pandas, a dict of equally long sequences, a Series, or an array whose
    first axis enumerates variables (named "0", "1", ..)."""
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, pd.DataFrame):
        return spark.createDataFrame(data)
    if isinstance(data, pd.Series):
        return spark.createDataFrame(data.to_frame(data.name or "0"))
    if isinstance(data, dict):
        if len({len(v) for v in data.values()}) > 1:
            raise ValueError("sequences must be equally long")
        return spark.createDataFrame(pd.DataFrame(data))
    rows = [data] if getattr(data, "ndim", 2) == 1 else data
    return spark.createDataFrame(pd.DataFrame({str(i): list(map(float, v)) for i, v in enumerate(rows)}))
