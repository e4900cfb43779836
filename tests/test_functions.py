import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratakit.functions import activ, losses, text, vec


def one(df, *columns):
    return df.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def test_distances(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=5), rng.normal(size=5)
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>")
    A, B = F.col("a"), F.col("b")
    got = one(df, vec.euclidean_distance(A, B), vec.manhattan_distance(A, B), vec.cosine_similarity(A, B), vec.hamming_distance(A, B), vec.variance(A), vec.normalized_euclidean_distance(A, B), vec.variance_ratio(A, B))
    want = [np.linalg.norm(a - b), np.abs(a - b).sum(), a @ b / np.linalg.norm(a) / np.linalg.norm(b), 5, a.var(), 0.5 * (a - b).var() / (a.var() + b.var()), 0.5 * a.var() / (a.var() + b.var())]
    assert list(got) == pytest.approx(want)
    inverse = np.linalg.inv(np.cov(rng.normal(size=(5, 50))))
    assert one(df, vec.mahalanobis_distance(A, B, inverse.tolist()))[0] == pytest.approx(math.sqrt((a - b) @ inverse @ (a - b)))


def test_zero_and_equal_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 70000.0])], "a array<double>, b array<double>")
    A, B = F.col("a"), F.col("b")
    assert tuple(one(df, vec.cosine_distance(A, B), vec.euclidean_distance(B, B), vec.jaccard_similarity(F.transform(A, lambda x: x.cast("int")), F.transform(A, lambda x: x.cast("int"))))) == (1.0, 0.0, None)


def test_indicators(spark):
    df = spark.createDataFrame([(2, [0, 3], [0.1, 0.7, 0.7])], "c int, k array<int>, s array<double>")
    got = one(df, vec.to_onehot(F.col("c"), 4), vec.to_khot(F.col("k"), 4), vec.argmax(F.col("s")), vec.argmin(F.col("s")), vec.to_int_classes(F.col("s"), True))
    assert tuple(got) == ([0, 0, 1, 0], [1, 0, 0, 1], 1, 0, [0, 1, 1])


@pytest.mark.parametrize("x", [-800.0, -1.5, 0.0, 0.3, 800.0])
def test_activations(spark, x):
    df = spark.createDataFrame([(x,)], "x double")
    got = one(df, *(activ.ACTIVATIONS[n](F.col("x")) for n in ("sigmoid", "swish", "tanh", "relu", "relu_leaky", "mod_relu")))
    s = 1 / (1 + math.exp(-x)) if x > -700 else 0.0
    assert list(got) == pytest.approx([s, x * s, math.tanh(x), max(x, 0), x if x > 0 else 0.1 * x, math.copysign(max(abs(x) - 0.2, 0), x) if x else 0.0], abs=1e-12)


def test_derivatives_match_differences(spark):
    h = 1e-6
    df = spark.createDataFrame([(0.4,), (-0.7,)], "x double")
    for name in ("swish", "relu", "relu_leaky"):
        f = activ.ACTIVATIONS[name]
        for r in df.select(activ.DERIVATIVES[name](F.col("x")), (f(F.col("x") + h) - f(F.col("x") - h)) / (2 * h)).collect():
            assert r[0] == pytest.approx(r[1], abs=1e-5)


def test_softmax_jacobian(spark):
    p = np.array([0.2, 0.5, 0.3])
    df = spark.createDataFrame([(p.tolist(), [1000.0, 1000.0, 999.0])], "p array<double>, z array<double>")
    j, s = one(df, activ.softmax_derivative(F.col("p")), activ.softmax(F.col("z")))
    assert np.allclose(j, np.diag(p) - np.outer(p, p)) and sum(s) == pytest.approx(1)


def test_losses(spark):
    rng = np.random.default_rng(2)
    p, t = rng.normal(size=20), (rng.random(20) > 0.5).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(p, t, strict=True)], "p double, t double")
    P, T = F.col("p"), F.col("t")
    got = df.agg(losses.mse(P, T), losses.rmse(P, T), losses.sse(P, T), losses.mae(P, T), losses.cross_entropy(P, T)).first()
    q = 1 / (1 + np.exp(-p))
    assert list(got) == pytest.approx([((p - t) ** 2).mean(), math.sqrt(((p - t) ** 2).mean()), ((p - t) ** 2).sum(), np.abs(p - t).mean(), -(t * np.log(q) + (1 - t) * np.log(1 - q)).mean()])


def test_cross_entropy_extremes(spark):
    df = spark.createDataFrame([(800.0, 1.0), (-800.0, 1.0), (0.0, 0.0)], "z double, t double")
    assert [r[0] for r in df.select(losses.cross_entropy_row(F.col("z"), F.col("t"), "binary")).collect()] == pytest.approx([0.0, 800.0, math.log(2)])


def test_cosine_gradient(spark):
    p, t, h = np.array([0.3, -1.0, 2.0]), np.array([1.0, 0.5, 0.2]), 1e-6

    def f(v):
        return 1 - v @ t / (np.linalg.norm(v) * np.linalg.norm(t) + 1e-8)

    want = [(f(p + h * e) - f(p - h * e)) / (2 * h) for e in np.eye(3)]
    df = spark.createDataFrame([(p.tolist(), t.tolist())], "p array<double>, t array<double>")
    assert one(df, losses.cosine_gradient(F.col("p"), F.col("t"), 1))[0] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(("raw", "want"), [("<b>x</b>", "x"), ("&lt;i&gt;y", "y"), ("a < b", "a < b"), ("<p>a<p>b</p></p>", "ab"), (None, None), ("", "")])
def test_strip_tags(raw, want):
    assert text.without_tags(raw) == want


def test_utilities(caplog):
    import logging
    import time

    from stratakit.functions import utilities

    calls = []

    @utilities.timed_lru_cache(0.05)
    def f(x):
        calls.append(x)
        return 2 * x

    assert f(2) == f(2) == 4 and calls == [2]
    time.sleep(0.06)
    assert f(2) == 4 and calls == [2, 2]
    with caplog.at_level(logging.INFO):
        assert utilities.log_timeit(lambda: 3)() == 3
        assert utilities.log_timeit(logger=logging.getLogger("x"))(lambda: 4)() == 4
    assert caplog.text.count("took") == 2
