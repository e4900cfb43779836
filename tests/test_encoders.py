import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratakit.functions import chrono
from stratakit.operators import encoders as E
from stratakit.operators import moments
from stratakit.operators.pipeline import EncoderPipeline, as_dataframe, expand_list_column, load_pipeline, save_pipeline


@pytest.fixture
def numbers(spark):
    return spark.createDataFrame([(1.0,), (2.0,), (None,), (math.nan,), (1e9,), (-5.0,)], "v double")


def test_minmax_ignores_null_and_nan(numbers):
    e = E.MinMaxEncoder("v", 0).fit(numbers)
    got = [r.v for r in numbers.select(*e.encode()).collect()]
    assert got[2] is None and got[3] is None
    assert got[4] == 1.0 and got[5] == 0.0
    back = numbers.select(*e.encode()).select(*e.inverse()).collect()
    assert back[0].v == pytest.approx(1.0, abs=1e-6)


def test_constant_column_gives_null_or_zero(spark):
    df = spark.createDataFrame([(7.0,)] * 3, "v double")
    assert df.select(*E.MinMaxEncoder("v", 0).fit(df).encode()).first().v is None
    assert df.select(*E.StandardEncoder("v", 0).fit(df).encode()).first().v == 0.0


def test_standard_is_population_and_merges(spark):
    x = np.random.default_rng(0).normal(3, 2, 100)
    one, two = (spark.createDataFrame([(float(v),) for v in part], "v double") for part in (x[:30], x[30:]))
    e = E.StandardEncoder("v", 0).fit(one).fit(two)
    assert e.moments.mean == pytest.approx(x.mean()) and e.moments.std == pytest.approx(x.std())
    assert E.StandardEncoder("v", 0).fit(one).fit(two, reset=True).moments.mean == pytest.approx(x[30:].mean())


@pytest.mark.parametrize("q", [0.1, 0.25, 0.5, 0.75])
@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_midpoint_quantiles(spark, q, n):
    x = np.round(np.random.default_rng(n).normal(size=n), 1)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    assert moments.midpoint_quantiles(df, F.col("v"), [q]) == [pytest.approx(np.quantile(x, q, method="midpoint"))]


def test_order_statistics_narrow_brackets(spark):
    df = spark.range(3000).select((F.pmod(F.xxhash64("id"), F.lit(1000)) / 7).alias("v"))
    x = np.sort([r.v for r in df.collect()])
    assert moments.order_statistics(df, F.col("v"), [0, 10, 1500, 2999], small=50) == [x[0], x[10], x[1500], x[2999]]
    same = spark.range(1000).select(F.lit(2.5).alias("v"))
    assert moments.order_statistics(same, F.col("v"), [0, 999], small=50) == [2.5, 2.5]


@pytest.mark.parametrize("method", ["clip", "mean", "median"])
def test_impute(spark, method):
    x = np.r_[np.arange(20.0), 500.0]
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    e = E.MinMaxEncoder("v", 0, impute_method=method, impute_outliers=True).fit(df)
    q1, q3 = np.quantile(x, [0.25, 0.75], method="midpoint")
    hi = q3 + 2 * (q3 - q1)
    want = {"clip": hi, "mean": x.mean(), "median": np.median(x)}[method]
    assert df.select(e.value()).collect()[-1][0] == pytest.approx(want)


def test_categories_rare_unseen_null(spark):
    df = spark.createDataFrame([(v,) for v in "aaabbbc"] + [(None,)], "c string")
    e = E.CategoricalEncoder("c", 0, classes=2).fit(df)
    new = spark.createDataFrame([("a",), ("b",), ("c",), ("z",), (None,)], "c string")
    codes = new.select(*e.encode())
    assert [r.c for r in codes.collect()] == [1, 2, 3, 3, None]
    assert [r.c for r in codes.select(*e.inverse()).collect()] == ["a", "b", "rare_label", "rare_label", None]
    assert e.metadata()["c"]["num_categories"] == 3
    assert [r.c for r in new.select(*E.CategoricalEncoder("c", 0, for_target=True).fit(df).encode()).collect()] == [0, 1, 2, 3, None]


def test_cycles(spark):
    df = spark.createDataFrame([("2024-01-07 23:45:00",), ("2024-02-29 00:10:00",), ("2023-12-31 12:00:00",), ("2024-12-31 01:00:00",)], "s string").select(chrono.convert_timestamp(F.col("s")).alias("t"))
    rows = df.select(*(f(F.col("t")).alias(f.__name__) for f in chrono.RATIOS.values())).collect()
    assert rows[0].hour_per_day == pytest.approx(2 * math.pi)
    assert rows[0].day_per_week == pytest.approx(2 * math.pi)
    assert rows[1].day_per_month == pytest.approx(2 * math.pi)
    assert rows[2].day_per_year == rows[3].day_per_year == pytest.approx(2 * math.pi)
    e = E.TimeCycleEncoder("t", 0, "day", "year").fit(df)
    back = df.select(*e.encode()).select(*e.inverse()).collect()
    assert back[1].t == pytest.approx(60 / 366 * 365.25)
    with pytest.raises(ValueError):
        E.TimeCycleEncoder("t", 0, "year", "day")


def test_deltas(spark):
    rows = [("2024-01-04", "2024-01-01", 2), ("2024-01-01", "2024-01-01", 0), ("2024-01-01", "2024-01-02", None), (None, "2024-01-01", 1)]
    df = spark.createDataFrame(rows, "a string, b string, z int").select(F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"), "z")
    e = E.TimeDeltaEncoder("a", 0, "b", "z").fit(df)
    assert (e.low, e.high) == (0.0, 3.0)
    assert [r.a for r in df.select(*e.encode()).collect()] == [1.0, 0.0, pytest.approx(1 / 3), None]
    c = E.TimeDeltaEncoder("a", 0, "b", compat=True).fit(df)
    assert (c.low, c.high) == (0.0, 0.0)


def test_pipeline_checks_saves_and_loads(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "x"), (3.0, "y"), (5.0, "x")], "n double, c string")
    p = EncoderPipeline().add_encoder(E.CategoricalEncoder("c", 1)).add_encoder(E.MinMaxEncoder("n", 0))
    with pytest.raises(RuntimeError):
        p.fit(df)
    p.finalize_setup()
    with pytest.raises(RuntimeError):
        p.add_encoder(E.MinMaxEncoder("q", 2))
    with pytest.raises(ValueError):
        p.validate_df(df.select("c", "n"))
    out = p.fit_encode(df)
    assert out.columns == ["n", "c"] and [tuple(r) for r in out.collect()] == [(0.0, 1), (0.5, 2), (1.0, 1)]
    save_pipeline(spark, p, f"file://{tmp_path}/p")
    again = load_pipeline(spark, f"file://{tmp_path}/p")
    assert again.encode(df).collect() == out.collect() and again.metadata() == p.metadata()
    assert p.decode(out).collect()[1].c == "y"
    assert p.get_profiler_output_info() == {"numeric": [0], "categorical": [1], "chronologic": [], "text": []}
    with pytest.raises(ValueError):
        EncoderPipeline().add_encoder(E.MinMaxEncoder("n", 1)).finalize_setup()


def test_empty_table(spark):
    df = spark.createDataFrame([], "n double, c string")
    p = EncoderPipeline().add_encoder(E.MinMaxEncoder("n", 0, impute_outliers=True)).add_encoder(E.CategoricalEncoder("c", 1)).finalize_setup()
    assert p.fit_encode(df).collect() == []


def test_conversions(spark):
    assert as_dataframe(spark, {"a": [1, 2], "b": [3, 4]}).count() == 2
    assert as_dataframe(spark, np.ones((3, 2))).columns == ["0", "1", "2"]
    with pytest.raises(ValueError):
        as_dataframe(spark, {"a": [1], "b": [1, 2]})
    df = spark.createDataFrame([([1, 2],)], "v array<int>")
    assert expand_list_column(df, "v", 2).first().asDict() == {"v_0": 1, "v_1": 2}


def test_categories_of_batches_equal_one_pass(spark, monkeypatch):
    from stratakit.operators.encoders import CategoricalEncoder

    # c is third in every batch, and first over both
    batches = [["a"] * 5 + ["b"] * 5 + ["c"] * 4 + [f"x{i}" for i in range(6)], ["d"] * 5 + ["e"] * 5 + ["c"] * 4 + [None, "x0"]]
    frames = [spark.createDataFrame([(x,) for x in b], "label string") for b in batches]
    for held in (10_000, 3):  # in memory, and as a table
        monkeypatch.setattr(CategoricalEncoder, "HELD", held)
        whole, parts = (CategoricalEncoder("label", 0, classes=2) for _ in range(2))
        whole.prepare(frames[0].union(frames[1]))
        for f in frames:
            parts.prepare(f)
        assert parts.labels == whole.labels == ["c", "a"]
        assert (parts.total, parts.n_distinct) == (whole.total, whole.n_distinct) == (35, 11)
        again = CategoricalEncoder("label", 0, classes=2)
        again.restore(parts.state())
        again.prepare(frames[1])
        assert again.labels == ["c", "d"] and again.total == 50
