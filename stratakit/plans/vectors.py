"""Queries of distances, activations and losses, each over a whole table."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import activ, losses, vec
from ..operators import moments
from ._base import R, query, r, t

#: Each vector with the one of the next vec_id.
NEXT = "v AS (SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings), p AS (SELECT x.vec_id, x.a, y.a AS b FROM v x JOIN v y ON y.vec_id = x.vec_id + 1)"


def pairs(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")


def _distance(name: str, column, sql: str):
    def run(spark, sf_dir):
        return pairs(spark, sf_dir).select("vec_id", r(column(F.col("a"), F.col("b"))).alias("d"))

    run.__name__ = name
    return query(f"WITH {NEXT} SELECT vec_id, {R(sql)} AS d FROM p")(run)


SUM = "list_sum(list_transform(range(1, len(a) + 1), lambda i: {}))"
VAR = "(list_sum(list_transform({0}, lambda x: x * x)) / len({0}) - pow(list_sum({0}) / len({0}), 2))"
MINUS = "list_transform(range(1, len(a) + 1), lambda i: a[i] - b[i])"
_distance("dist_euclidean", vec.euclidean_distance, f"sqrt({SUM.format('pow(a[i] - b[i], 2)')})")
_distance("dist_manhattan", vec.manhattan_distance, SUM.format("abs(a[i] - b[i])"))
_distance("dist_cosine", vec.cosine_distance, "1 - list_dot_product(a, b) / greatest(sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)), 1e-15)")
_distance("dist_hamming", lambda a, b: vec.hamming_distance(F.transform(a, lambda x: F.signum(x)), F.transform(b, lambda x: F.signum(x))).cast("double"), SUM.format("(sign(a[i]) <> sign(b[i]))::INT"))
_distance("dist_variance_ratio", vec.variance_ratio, f"0.5 * {VAR.format('a')} / ({VAR.format('a')} + {VAR.format('b')})")
_distance("dist_normalized_euclidean", vec.normalized_euclidean_distance, f"0.5 * {VAR.format(MINUS)} / ({VAR.format('a')} + {VAR.format('b')})")
_distance("dist_elementwise", lambda a, b: F.array_max(vec.manhattan_distance(a, b, summed=False)), "list_max(list_transform(range(1, len(a) + 1), lambda i: abs(a[i] - b[i])))")
_distance("sim_jaccard", lambda a, b: vec.jaccard_similarity(F.transform(a, lambda x: (x > 0).cast("int")), F.transform(b, lambda x: (x > 0).cast("int"))), f"{SUM.format('(a[i] > 0 AND b[i] > 0)::INT')} / {SUM.format('(a[i] > 0 OR b[i] > 0)::INT')}::DOUBLE")


@query(f"""
WITH {NEXT}, z AS (SELECT vec_id, a[1] - b[1] AS x, a[2] - b[2] AS y FROM p),
c AS (SELECT var_samp(a[1]) AS xx, var_samp(a[2]) AS yy, covar_samp(a[1], a[2]) AS xy FROM v)
SELECT vec_id, {R('sqrt((yy * x * x - 2 * xy * x * y + xx * y * y) / (xx * yy - xy * xy))', 5)} AS d FROM z, c
""")
def mahalanobis_2d(spark, sf_dir):
    import numpy as np

    e = t(spark, sf_dir, "embeddings").select((F.col("embedding")[0]).cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    inverse = np.linalg.inv(moments.gram(e, ["x", "y"]).covariance(1)).tolist()
    return pairs(spark, sf_dir).select("vec_id", r(vec.mahalanobis_distance(F.slice("a", 1, 2), F.slice("b", 1, 2), inverse), 5).alias("d"))


@query("SELECT l_orderkey, l_linenumber, (abs(l_orderkey % 10 - l_partkey % 10) + abs(l_linenumber - l_suppkey % 10))::BIGINT AS d FROM lineitem")
def grid_manhattan(spark, sf_dir):
    df = t(spark, sf_dir, "lineitem")
    return df.select("l_orderkey", "l_linenumber", vec.grid_manhattan_distance(F.col("l_orderkey") % 10, F.col("l_linenumber"), F.col("l_partkey") % 10, F.col("l_suppkey") % 10).cast("long").alias("d"))


X = "((value - 50) / 25)"
S = f"(1 / (1 + exp(-{X})))"
ACTIVATION_SQL = {
    "linear": X, "sigmoid": S, "swish": f"{X} * {S}", "tanh": f"tanh({X})", "relu": f"greatest(0, {X})", "relu_leaky": f"CASE WHEN {X} > 0 THEN {X} ELSE 0.1 * {X} END",
    "mod_relu": f"sign({X}) * greatest(abs({X}) - 0.2, 0)",
}
DERIVATIVE_SQL = {
    "linear": "1.0", "sigmoid": f"{S} * (1 - {S})", "tanh": f"1 - pow(tanh({X}), 2)", "relu": f"CASE WHEN {X} < 0 THEN 0.0 ELSE 1.0 END", "relu_leaky": f"CASE WHEN {X} > 0 THEN 1.0 ELSE 0.1 END",
    "swish": f"{S} + {X} * {S} * (1 - {S})", "mod_relu": f"CASE WHEN abs({X}) > 0.2 THEN 1.0 ELSE 0.0 END",
}


@query("SELECT event_id, " + ", ".join(f"{R(sql)} AS {name}" for name, sql in ACTIVATION_SQL.items()) + " FROM events")
def activations(spark, sf_dir):
    x = (F.col("value") - 50) / 25
    return t(spark, sf_dir, "events").select("event_id", *(r(activ.ACTIVATIONS[n](x)).alias(n) for n in ACTIVATION_SQL))


@query("SELECT event_id, " + ", ".join(f"{R(sql)} AS {name}" for name, sql in DERIVATIVE_SQL.items()) + " FROM events")
def activation_derivatives(spark, sf_dir):
    x = (F.col("value") - 50) / 25
    arg = {"sigmoid": activ.sigmoid(x), "tanh": F.tanh(x)}
    out = {n: activ.DERIVATIVES[n](arg.get(n, x)) for n in DERIVATIVE_SQL if n != "mod_relu"}
    out["mod_relu"] = activ.mod_relu_derivative(x, F.lit(1.0))["d_z"]
    return t(spark, sf_dir, "events").select("event_id", *(r(out[n]).alias(n) for n in DERIVATIVE_SQL))


@query(f"""
WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: exp(x - list_max(embedding::DOUBLE[]))) AS e FROM embeddings),
s AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM v)
SELECT vec_id, {R('p[1]', 8)} AS first, {R('list_max(p)', 8)} AS largest, (list_position(p, list_max(p)) - 1)::INTEGER AS best, {R('p[1] * (1 - p[1])', 8)} AS slope, {R('-p[1] * p[2]', 8)} AS cross_slope FROM s
""")
def softmax(spark, sf_dir):
    p = activ.softmax(F.col("embedding").cast("array<double>"))
    df = t(spark, sf_dir, "embeddings").select("vec_id", p.alias("p"))
    j = activ.softmax_derivative(F.col("p"))
    return df.select("vec_id", r(F.col("p")[0], 8).alias("first"), r(F.array_max("p"), 8).alias("largest"), vec.argmax(F.col("p")).alias("best"), r(j[0][0], 8).alias("slope"), r(j[0][1], 8).alias("cross_slope"))


P, T = "l_discount", "l_tax"


@query(f"""SELECT {R('avg(pow(l_discount - l_tax, 2))', 8)} AS mse, {R('0.5 * avg(pow(l_discount - l_tax, 2))', 8)} AS half_mse, {R('sqrt(avg(pow(l_discount - l_tax, 2)))', 8)} AS rmse,
{R('sum(pow(l_discount - l_tax, 2))', 5)} AS sse, {R('avg(abs(l_discount - l_tax))', 8)} AS mae, {R('avg(abs(l_discount - l_tax))', 8)} AS mean_difference,
{R('2 * avg(pow(l_discount - l_tax, 2)) + 0.5 * avg(abs(l_discount - l_tax))', 8)} AS heads FROM lineitem""")
def losses_regression(spark, sf_dir):
    p, y = F.col(P), F.col(T)
    heads = losses.MultiHeadLoss([losses.mse, losses.mae], [2.0, 0.5])
    return t(spark, sf_dir, "lineitem").agg(
        r(losses.mse(p, y), 8).alias("mse"), r(losses.mse(p, y, half=True), 8).alias("half_mse"), r(losses.rmse(p, y), 8).alias("rmse"), r(losses.sse(p, y), 5).alias("sse"),
        r(losses.mae(p, y), 8).alias("mae"), r(losses.difference(p, y, "mean"), 8).alias("mean_difference"), r(heads([p, p], [y, y]), 8).alias("heads"),
    )


@query(f"""
WITH z AS (SELECT quality - 0.3 AS zq, quality AS q, toxic - 0.7 AS zt, toxic AS x FROM labels)
SELECT {R('avg(greatest(0, zq) - q * zq + ln(1 + exp(-abs(zq))))')} AS binary_loss, {R('avg(greatest(0, zt) - x * zt + ln(1 + exp(-abs(zt))))')} AS multilabel_loss,
{R('avg(ln(exp(zq) + exp(zt)) - CASE WHEN x = 1 THEN zt ELSE zq END)')} AS multinomial_loss FROM z
""")
def losses_cross_entropy(spark, sf_dir):
    df = t(spark, sf_dir, "labels")
    q, x = F.col("quality").cast("double"), F.col("toxic").cast("double")
    z = F.array(q - 0.3, x - 0.7)
    return df.agg(r(losses.cross_entropy(q - 0.3, q)).alias("binary_loss"), r(losses.cross_entropy(x - 0.7, x, "multilabel")).alias("multilabel_loss"), r(losses.cross_entropy(z, F.array(1 - x, x), "multinomial")).alias("multinomial_loss"))


@query(f"WITH {NEXT} SELECT {R('avg(1 - list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) + 1e-8))')} AS cosine FROM p")
def losses_cosine(spark, sf_dir):
    return pairs(spark, sf_dir).agg(r(losses.cosine(F.col("a"), F.col("b"))).alias("cosine"))


@query(f"""
WITH n AS (SELECT count(*) AS n, sqrt(avg(pow(l_discount - l_tax, 2))) AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, {R('1000 * 2 * (l_discount - l_tax) / n', 9)} AS mse, {R('1000 * sign(l_discount - l_tax) / n', 9)} AS mae, {R('1000 * (l_discount - l_tax) / (n * (v + 1e-15))', 9)} AS rmse,
{R('1000 * (1 / (1 + exp(-l_discount)) - l_tax) / n', 9)} AS xent FROM lineitem, n
""")
def loss_gradients(spark, sf_dir):
    df = t(spark, sf_dir, "lineitem")
    n, v = df.agg(F.count(F.lit(1)), losses.rmse(F.col(P), F.col(T))).first()
    p, y = F.col(P), F.col(T)
    out = {"mse": losses.mse_gradient(p, y, n), "mae": losses.mae_gradient(p, y, n), "rmse": losses.rmse_gradient(p, y, n, v), "xent": losses.cross_entropy_gradient(p, y, n)}
    return df.select("l_orderkey", "l_linenumber", *(r(1000 * c, 9).alias(k) for k, c in out.items()))


@query(f"""
WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings)
SELECT vec_id, {R('a[1] * cos(vec_id) - a[2] * sin(vec_id)')} AS x0, {R('a[1] * sin(vec_id) + a[2] * cos(vec_id)')} AS x1,
{R(f'a[3] * cos(vec_id * pow(10000.0, -{2 / 64}::DOUBLE)) - a[4] * sin(vec_id * pow(10000.0, -{2 / 64}::DOUBLE))')} AS x2 FROM p
""")
def rope(spark, sf_dir):
    from ..operators.signal import rope as turn

    x = turn(F.col("embedding").cast("array<double>"), F.col("vec_id").cast("double"))
    return t(spark, sf_dir, "embeddings").select("vec_id", x.alias("x")).select("vec_id", *(r(F.col("x")[i]).alias(f"x{i}") for i in range(3)))


_H = math.sqrt(0.5)


@query(f"""
WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings)
SELECT vec_id, {R(f'{_H}::DOUBLE * (a[1] + a[2])')} AS approx_0, {R(f'{_H}::DOUBLE * (a[1] - a[2])')} AS detail_0, {R('0.5 * (a[1] + a[2] - a[3] - a[4])')} AS detail_2_0, {R('0.5 * (a[1] + a[2] + a[3] + a[4])')} AS approx_2_0 FROM p
""")
def haar(spark, sf_dir):
    from ..operators import signal

    x = F.col("embedding").cast("array<double>")
    h, m = signal.haar(x), signal.haar_multiscale(x, 2)
    return t(spark, sf_dir, "embeddings").select("vec_id", r(h["approx"][0]).alias("approx_0"), r(h["detail"][0]).alias("detail_0"), r(m["details"][1][0]).alias("detail_2_0"), r(m["approx"][0]).alias("approx_2_0"))
