"""Queries of moments, projections, regressions, signals, layers and generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layers, moments, projections, regression, signal
from ..sources import generators
from ._base import R, query, r, t

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def vector(spark, digits=5, **columns):
    """A table of name and value."""
    return spark.createDataFrame([(k, float(v)) for k, v in columns.items()], "name string, value double").select("name", r(F.col("value"), digits).alias("value"))


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}|{b}' AS name, {R(f'covar_pop({a}, {b})', 2)} AS value FROM lineitem" for i, a in enumerate(NUMBERS) for b in NUMBERS[i:]) + ")")
def gram_covariance(spark, sf_dir):
    c = moments.gram(t(spark, sf_dir, "lineitem"), NUMBERS).covariance()
    return vector(spark, 2, **{f"{a}|{b}": c[i, j + i] for i, a in enumerate(NUMBERS) for j, b in enumerate(NUMBERS[i:])})


@query(f"""
WITH s AS (SELECT covar_pop(l_quantity, l_quantity) AS xx, covar_pop(l_tax, l_tax) AS zz, covar_pop(l_quantity, l_tax) AS xz, covar_pop(l_quantity, l_extendedprice) AS xy, covar_pop(l_tax, l_extendedprice) AS zy,
avg(l_quantity) AS mx, avg(l_tax) AS mz, avg(l_extendedprice) AS my FROM lineitem), b AS (SELECT *, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS b1, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS b2 FROM s)
SELECT 'intercept' AS name, {R('my - b1 * mx - b2 * mz', 5)} AS value FROM b UNION ALL SELECT 'l_quantity', {R('b1', 5)} FROM b UNION ALL SELECT 'l_tax', {R('b2', 5)} FROM b
""")
def ols(spark, sf_dir):
    w = regression.ols(t(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"], "l_extendedprice")
    return vector(spark, intercept=w[0], l_quantity=w[1], l_tax=w[2])


@query(f"WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS c, count(*) AS n FROM lineitem) SELECT 'first' AS name, {R('(1 + abs(c)) * n / (n - 1)', 5)} AS value FROM c UNION ALL SELECT 'second', {R('(1 - abs(c)) * n / (n - 1)', 5)} FROM c")
def pca_explained(spark, sf_dir):
    p = projections.pca(t(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], 2)
    return vector(spark, first=p.explained[0], second=p.explained[1])


@query()
def pca_projection(spark, sf_dir):
    df = t(spark, sf_dir, "lineitem")
    p = projections.pca(df, NUMBERS, 3)
    return df.select("l_orderkey", "l_linenumber", p.project().alias("components"))


@query()
def mca(spark, sf_dir):
    df = t(spark, sf_dir, "lineitem")
    flags = {**{f"l_returnflag={x}": F.col("l_returnflag") == x for x in ("A", "N", "R")}, **{f"l_linestatus={x}": F.col("l_linestatus") == x for x in ("F", "O")}}
    m = projections.mca(df.select(*(c.cast("double").alias(k) for k, c in flags.items())), list(flags), 2)
    return spark.createDataFrame([(k, *map(float, row)) for k, row in zip(flags, m.coordinates, strict=True)], "category string, x1 double, x2 double")


@query(f"""
WITH c AS (SELECT corr(l_quantity, l_tax) AS x, corr(l_quantity, l_extendedprice) AS y1, corr(l_tax, l_extendedprice) AS y2 FROM lineitem),
h AS (SELECT *, (sqrt(1 + x) + sqrt(1 - x)) / 2 AS a, (sqrt(1 + x) - sqrt(1 - x)) / 2 AS b FROM c),
k AS (SELECT a, b, (a * y1 - b * y2) / (a * a - b * b) AS b1, (a * y2 - b * y1) / (a * a - b * b) AS b2 FROM h)
SELECT 'l_quantity' AS name, {R('a * a * b1 * b1 + b * b * b2 * b2', 5)} AS value FROM k UNION ALL SELECT 'l_tax', {R('b * b * b1 * b1 + a * a * b2 * b2', 5)} FROM k
UNION ALL SELECT 'r2', {R('b1 * b1 + b2 * b2', 5)} FROM k
""")
def relative_weights(spark, sf_dir):
    w = regression.relative_weights(t(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"], "l_extendedprice")
    return vector(spark, l_quantity=w.raw[0], l_tax=w.raw[1], r2=w.r2)


@query("WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem) SELECT l_orderkey, l_linenumber, " + R("a + b * l_quantity", 2) + " AS prediction FROM lineitem, s")
def scg_regression(spark, sf_dir):
    df = t(spark, sf_dir, "lineitem")
    m = regression.Regression().fit(df, ["l_quantity"], "l_extendedprice")
    return m.predict(df).select("l_orderkey", "l_linenumber", r(F.col("prediction"), 2).alias("prediction"))


@query("SELECT " + R("regr_r2(l_extendedprice, l_quantity)") + " AS r_square FROM lineitem")
def r_square(spark, sf_dir):
    m = regression.Regression().fit(t(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.createDataFrame([(float(m.r_square),)], "x double").select(r(F.col("x")).alias("r_square"))


@query()
def scg_binary(spark, sf_dir):
    df = t(spark, sf_dir, "labels").join(t(spark, sf_dir, "documents"), "doc_id").select("doc_id", "toxic", F.log1p("n_chars").alias("size"), F.regexp_count("text", F.lit("!")).cast("double").alias("marks"))
    return regression.Regression("binary").fit_predict(df, ["size", "marks"], "toxic", iterations=30).select("doc_id", "prediction")


@query()
def scg_multinomial(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), regression.onehot_target("label", 10).alias("y"))
    return regression.Regression("multinomial").fit_predict(e, "x", "y", iterations=30).select("vec_id", "prediction")


@query()
def relative_weights_logistic(spark, sf_dir):
    df = t(spark, sf_dir, "labels").join(t(spark, sf_dir, "documents"), "doc_id").select("quality", F.log1p("n_chars").alias("size"), F.regexp_count("text", F.lit("!")).cast("double").alias("marks"))
    w = regression.relative_weights(df, ["size", "marks"], "quality", logistic=True)
    return vector(spark, size=w.raw[0], marks=w.raw[1], r2=w.r2)


@query(f"""
WITH e AS (SELECT value AS v, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events),
w AS (SELECT unnest(range(0, CASE WHEN n < 8 THEN 0 ELSE ceil((n - 7) / 6.0)::BIGINT END)) AS win_idx FROM (SELECT max(n) AS n FROM e))
SELECT win_idx, {R('sum(v)', 5)} AS total, {R('arg_min(v, i)', 5)} AS first FROM w JOIN e ON i >= win_idx * 6 AND i < win_idx * 6 + 8 GROUP BY win_idx
""")
def rolling_windows(spark, sf_dir):
    from ..functions import vec

    df = signal.rolling_windows(ordered(spark, sf_dir), "i", "value", 8, 2)
    return df.select("win_idx", r(vec.total(F.col("samples")), 5).alias("total"), r(F.col("samples")[0], 5).alias("first"))


def ordered(spark, sf_dir):
    """events numbered by event_id without one sorting task: ranges of ids are counted, then numbered within."""
    e = t(spark, sf_dir, "events").select("event_id", F.col("value").cast("double").alias("value")).withColumn("b", F.floor(F.col("event_id") / 4096))
    from pyspark.sql import Window

    before = e.groupBy("b").count().select("b", (F.sum("count").over(Window.orderBy("b")) - F.col("count")).alias("before"))
    w = Window.partitionBy("b").orderBy("event_id")
    return e.join(before, "b").select((F.col("before") + F.row_number().over(w) - 1).alias("i"), "value")


def vectors(spark, sf_dir):
    return t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


@query()
def spectrum(spark, sf_dir):
    return signal.power_spectrum(signal.rfft(vectors(spark, sf_dir), "x"), "x").drop("x")


@query()
def frequency_gate(spark, sf_dir):
    return signal.band_gated_fft(signal.frequency_fft(vectors(spark, sf_dir), "x"), "x", [1.0] * 8).drop("x")


@query()
def wavelets(spark, sf_dir):
    df = signal.discrete_wavelet(signal.wavelet_packets(vectors(spark, sf_dir), "x", 3, "db2"), "x", "db2")
    return signal.cwt(df, "x", [2.0, 5.0, 9.0], 64.0).drop("x")


@query("SELECT vec_id, " + R("embedding[1]::DOUBLE", 5) + " AS x0, " + R("embedding[64]::DOUBLE", 5) + " AS x63 FROM embeddings")
def wavelet_round_trip(spark, sf_dir):
    df = signal.wavelet_packets(vectors(spark, sf_dir), "x", 3, "db2")
    df = signal.wavelet_packets(df, "packets", 3, "db2", output="back", inverse=True)
    return df.select("vec_id", r(F.col("back")[0], 5).alias("x0"), r(F.col("back")[63], 5).alias("x63"))


@query()
def layer_network(spark, sf_dir):
    df = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array((F.col("l_quantity") - 25) / 15, F.col("l_discount") * 10, F.col("l_tax") * 10).alias("x"), ((F.col("l_extendedprice") - 38000) / 23000).alias("y"))
    net = layers.NeuralNetwork([layers.Dense(3, 10, "relu"), layers.Normalize(10), layers.Dropout(0.05), layers.Dense(10, 1, "linear", 7)])
    net.fit(df, "x", "y", epochs=3, optimizer=layers.SGD(0.05))
    return net.predict(df, "x").select("l_orderkey", "l_linenumber", "prediction")


@query()
def attention_blocks(spark, sf_dir):
    net = layers.NeuralNetwork([layers.FourierAttention(64, use_2d=False)])
    return net.predict(vectors(spark, sf_dir), "x").drop("x")


def _generator(task: str, **config):
    def run(spark, sf_dir):
        return generators.generate(spark, task, num_samples=2000, num_features=8, noise=0.33, **config)[0]

    run.__name__ = f"gen_{task}"
    return query()(run)


for _task, _config in {"regression": {}, "binary": {"onehot": True}, "multiclass": {"classes": 6, "onehot": True}, "multilabel": {"classes": 5}, "clustering": {"clusters": 8}}.items():
    _generator(_task, **_config)


@query()
def gen_phase_mix(spark, sf_dir):
    return generators.phase_mix(spark)


@query()
def gen_multifreq(spark, sf_dir):
    return generators.multifreq(spark)


