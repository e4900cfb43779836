import numpy as np
import pytest
from pyspark.sql import functions as F

from stratakit.operators import centroid, grid, layers, metrics, moments, projections, regression, signal, som
from stratakit.sources import generators
from stratakit.streaming import incremental


@pytest.fixture(scope="module")
def blobs(spark):
    return generators.generate(spark, "clustering", num_samples=300, num_features=2, clusters=4, noise=0.2)[0].select("id", "features", F.col("true_label").alias("cluster")).cache()


def arrays(df, *columns):
    rows = df.orderBy("id").collect()
    return [np.array([r[c] for r in rows]) for c in columns]


def test_gram_and_correlation(spark):
    x = np.random.default_rng(0).normal(1e6, 2, (50, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    assert np.allclose(moments.gram(df, ["a", "b", "c"]).covariance(1), np.cov(x.T), rtol=1e-4)
    v = df.select(F.array("a", "b", "c").alias("v"))
    assert np.allclose(moments.vector_gram(v, "v", 3).mean, x.mean(axis=0))


def test_metrics_against_numpy(blobs):
    x, k = arrays(blobs, "features", "cluster")
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    s = []
    for i in range(len(x)):
        own = k == k[i]
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, k == o].mean() for o in set(k) - {k[i]})
        s.append((b - a) / max(a, b))
    assert metrics.silhouette(blobs, block=64).first()[0] == pytest.approx(np.mean(s))
    c = np.array([x[k == i].mean(axis=0) for i in range(4)])
    spread = [np.linalg.norm(x[k == i] - c[i], axis=1).mean() for i in range(4)]
    assert metrics.davies_bouldin(blobs).first()[0] == pytest.approx(np.mean([max((spread[i] + spread[j]) / np.linalg.norm(c[i] - c[j]) for j in range(4) if i != j) for i in range(4)]))
    w = sum(((x[k == i] - c[i]) ** 2).sum() for i in range(4))
    b = sum((k == i).sum() * ((c[i] - x.mean(axis=0)) ** 2).sum() for i in range(4))
    assert metrics.calinski_harabasz(blobs).first()[0] == pytest.approx(b / w * (len(x) - 4) / 3)


def test_silhouette_edges(spark):
    df = spark.createDataFrame([(1, [0.0], 0), (2, [1.0], 0), (3, [5.0], 1)], "id int, features array<double>, cluster int")
    assert metrics.silhouette(df).first()[0] == pytest.approx((0.8 + 0.75 + 1) / 3)
    assert metrics.silhouette(df, singleton=0.0).first()[0] == pytest.approx((0.8 + 0.75) / 3)
    assert metrics.silhouette(df.withColumn("cluster", F.lit(1))).first()[0] == 0.0


def test_information(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("b", 1), (None, 1)], "x string, y int")
    assert metrics.entropy(df, "x").first()[0] == pytest.approx(np.log(2))
    assert metrics.homogeneity(df, "x", "x").first()[0] == pytest.approx(1)
    assert 0 < metrics.homogeneity(df, "x", "y").first()[0] < 1
    assert metrics.contingency(df, "x", "y").count() == 3


def test_assign_both_ways(blobs):
    x, _ = arrays(blobs, "features", "cluster")
    few, many = x[:3].tolist(), np.repeat(x[:50], 4, axis=0).tolist()
    for c in (few, many):
        got = metrics.assign(blobs, c).orderBy("id").collect()
        d = ((x[:, None] - np.array(c)) ** 2).sum(axis=2)
        assert [r.distance for r in got] == pytest.approx(d.min(axis=1).tolist(), abs=1e-9)


def test_centroid_network_finds_blobs(blobs):
    m = centroid.CentroidNetwork(max_clusters=4).fit(blobs, fast_forward=False)
    out = m.predict(blobs, k=4).join(blobs.select("id", F.col("cluster").alias("truth")), "id")
    assert m.get_optimal() in (3, 4) and m.scores[4] > 0.5
    assert metrics.homogeneity(out, "truth", "cluster").first()[0] > 0.7


def test_som(blobs):
    m = som.SelfOrganisingMap(4, 4, seed=1).fit(blobs, epochs=3)
    assert m.errors[-1] < m.errors[0] and m.hits.sum() == 3 * 299
    out = m.predict(blobs, max_clusters=4)
    assert out.count() == 300 and {r.neuron for r in out.collect()} <= set(range(16))
    b = som.SelfOrganisingMap(4, 4).fit_batch(blobs, epochs=4)
    assert b.errors[-1] < b.errors[0] and b.u_matrix().shape == (7, 7)
    assert som.index_to_grid(som.grid_to_index(2, 3, 5), 5) == (2, 3)


def test_som_trains_on_all_rows(spark):
    df = spark.range(50_400).select("id", F.array(F.sin("id"), F.cos(F.col("id") * 3)).alias("features"))
    m = som.SelfOrganisingMap(2, 2, seed=1).fit(df, epochs=1)
    assert m.hits.sum() == 50_399


def test_regressions(spark):
    df, meta = generators.generate(spark, "regression", num_samples=400, num_features=3, noise=0.0)
    df = df.select(*(F.col("features")[i].alias(f"x{i}") for i in range(3)), "y")
    m = regression.Regression().fit(df, ["x0", "x1", "x2"], "y")
    assert m.r_square == pytest.approx(1) and regression.ols(df, ["x0", "x1", "x2"], "y")[1:] == pytest.approx(meta["weights"], rel=1e-6)
    assert m.get_residuals(df).agg(F.max(F.abs("residual"))).first()[0] < 1e-6
    w = regression.relative_weights(df, ["x0", "x1", "x2"], "y")
    assert w.raw.sum() == pytest.approx(w.r2) == pytest.approx(1)


@pytest.mark.parametrize(("task", "config"), [("binary", {"onehot": True}), ("multinomial", {"classes": 3, "onehot": True}), ("multilabel", {"classes": 3})])
def test_classifiers_on_both_paths(spark, task, config):
    df, _ = generators.generate(spark, task, num_samples=300, num_features=4, noise=0.1, **config)
    assert regression.determine_task(df, "y") == task
    local = regression.Regression(task).fit(df, "features", "y", iterations=15)
    far = regression.Regression(task, local_cells=0).fit(df, "features", "y", iterations=4)
    near = regression.Regression(task).fit(df, "features", "y", iterations=4)
    assert np.allclose(far.weights, near.weights, atol=1e-5) and local.r_square > 0.4
    p = local.predict(df).select("y", "prediction").collect()
    if task == "multinomial":
        assert np.mean([np.argmax(r.y) == np.argmax(r.prediction) for r in p]) > 0.8
    else:
        assert np.mean([np.round(r.prediction) == np.array(r.y) for r in p]) > 0.8
    penal = regression.Regression(task, use_elastic_reg=True).fit(df, "features", "y", iterations=15)
    assert np.abs(penal.weights[1:]).sum() < np.abs(local.weights[1:]).sum()


def test_projections(spark):
    x = np.random.default_rng(3).normal(size=(80, 3)) @ np.array([[1, 2, 0], [0, 1, 1], [0, 0, 0.1]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    p = projections.pca(df, ["a", "b", "c"], 2)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    values = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    assert p.explained == pytest.approx(values)
    got = np.array([r[0] for r in df.select(p.project()).collect()])
    assert np.allclose(got, z @ p.components)
    one = spark.createDataFrame([(1, 0, 1, 0), (0, 1, 0, 1), (1, 0, 0, 1)], "a int, b int, c int, d int")
    assert projections.mca(one, ["a", "b", "c", "d"], 2).coordinates.shape == (4, 2)


@pytest.mark.parametrize("prices", [[1, 2, 3, 4], [4, 3, 2, 1], [2, 4, 1, 3], [1, -1, -1, 1]])
def test_pair_of_components_by_any_correlation(spark, tmp_path, prices):
    import duckdb

    from stratakit.plans import registry

    spark.createDataFrame([(i, 1, float(q), float(x)) for i, (q, x) in enumerate(zip([1, 1, 2, 2] if prices[1] < 0 else range(4), prices, strict=True))], "l_orderkey int, l_linenumber int, l_quantity double, l_extendedprice double").coalesce(1).write.parquet(f"file://{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(registry.oracle_sql()["pca_pair"]).fetchall()
    got = [tuple(x) for x in registry.queries()["pca_pair"](spark, f"file://{tmp_path}").collect()]
    assert np.allclose(sorted(got), sorted(want), atol=2e-5)


def test_grid(spark):
    img = np.arange(12.0).reshape(3, 4)
    cells = spark.createDataFrame([(r, c, float(img[r, c])) for r in range(3) for c in range(4)], "r int, c int, v double")
    p = np.pad(img, 1)
    want = sum(a * b * p[1 + i : 4 + i, 1 + j : 5 + j] for i, a in ((-1, 1), (0, 2), (1, 1)) for j, b in ((-1, 1), (0, 2), (1, 1)))
    got = {(r.r, r.c): r.v for r in grid.blur(cells).collect()}
    assert all(got[r, c] == want[r, c] for r in range(3) for c in range(4))
    two = np.array([[0, 0, 5, 1, 1]] * 3, dtype=float)
    label = grid.watershed(two, 6)
    assert len({label[1, 0], label[1, 4]}) == 2 and label[1, 2] == 0
    u = grid.umat_infill(grid.umat_fill_outer(np.ones((5, 5))))
    assert u.shape == (5, 5) and (u > 0).all()
    assert grid.watershed_cells(cells).count() == 12


@pytest.mark.parametrize(("n", "w", "o"), [(10, 4, 0), (10, 4, 2), (10, 4, 3), (3, 4, 1), (4, 4, 0)])
def test_windows(spark, n, w, o):
    df = spark.range(n).select("id", F.col("id").cast("double").alias("v"))
    got = [r.samples for r in signal.rolling_windows(df, "id", "v", w, o).orderBy("win_idx").collect()]
    assert got == [list(map(float, range(i, i + w))) for i in range(0, n - w + 1, w - o)] and len(got) == signal.window_count(n, w, o)
    with pytest.raises(ValueError):
        signal.rolling_windows(df, "id", "v", 4, 4)


def test_transforms(spark):
    x = np.random.default_rng(4).normal(size=16)
    for name in signal.FILTERS:
        assert np.allclose(signal.idwt(*signal.dwt(x, name), name), x)
        assert np.allclose(signal.iwpt(signal.wpt(x, 2, name), 2, name), x)
    assert signal.wpt_bins(signal.wpt(x, 2), 2).shape == (4, 4)
    df = spark.createDataFrame([(1, x.tolist()), (2, None)], "p long, x array<double>")
    r = signal.rfft(df, "x").orderBy("p").collect()
    assert np.allclose(r[0].spectrum.re, np.fft.rfft(x).real) and r[1].spectrum is None
    back = df.select("p", signal.rope(signal.rope(F.col("x"), F.col("p")), F.col("p"), inverse=True).alias("x")).orderBy("p").first().x
    assert np.allclose(back, x)
    h = df.select(signal.haar(F.col("x")).alias("h")).first().h
    assert np.allclose(h.approx, signal.dwt(x)[0])
    energy, _ = signal.energy_phase(np.sin(2 * np.pi * 5 * np.arange(256) / 64), 5, 64, 7)
    assert energy[128] > 10 * signal.energy_phase(np.sin(2 * np.pi * 5 * np.arange(256) / 64), 15, 64, 7)[0][128]


LAYERS = [
    (lambda: layers.Dense(4, 3, "swish"), (5, 4)), (lambda: layers.Dense(4, 3, "sigmoid"), (5, 2, 4)), (lambda: layers.Normalize(4, True), (5, 4)), (lambda: layers.FrequencyFFT(8), (3, 8)), (lambda: layers.Fourier(), (2, 4, 4)),
    (lambda: layers.Fourier(False), (3, 6)), (lambda: layers.InverseFourier(), (2, 4, 4)), (lambda: layers.Rope(4, 6), (2, 4, 6)), (lambda: layers.FourierAttention(4), (2, 4, 4)), (lambda: layers.VotingGate(4, 3, 2), (5, 4)),
]


@pytest.mark.parametrize("case", range(len(LAYERS)))
def test_backward_is_the_gradient(case):
    make, shape = LAYERS[case]
    rng, layer = np.random.default_rng(case), make()
    x = rng.normal(size=shape)
    y = layer.forward(x)
    up = rng.normal(size=y.shape)
    got = layer.backward(up)
    h = 1e-6
    for _ in range(4):
        e = np.zeros(shape)
        e[tuple(rng.integers(0, s) for s in shape)] = h
        assert ((layer.forward(x + e) - layer.forward(x - e)) * up).sum() / (2 * h) == pytest.approx((got * e).sum() / h, rel=1e-4, abs=1e-5)


def test_layer_shapes():
    x = np.random.default_rng(5).normal(size=(2, 8, 6))
    assert layers.SpectreAttention(8, 6).forward(x).shape == x.shape
    s = layers.LatentStack()
    assert s.forward(x, x[..., :2]).shape == (2, 8, 8) and s.backward(np.ones((2, 8, 8)))[1].shape == (2, 8, 2)
    e = layers.Embedding(5, 3)
    e.forward(np.array([1, 1, 4]))
    e.backward(np.ones((3, 3)))
    assert e.grads["table"][1].sum() == pytest.approx(2)
    d = layers.Dropout(0.5)
    d.training = True
    assert 0.3 < (d.forward(np.ones((100, 10))) > 0).mean() < 0.7
    with pytest.raises(ValueError):
        layers.Dense(3, 2).forward(np.ones((2, 4)))


def test_network_learns(spark):
    df, _ = generators.generate(spark, "regression", num_samples=400, num_features=3, noise=0.1)
    net = layers.NeuralNetwork([layers.Dense(3, 10, "relu"), layers.Normalize(10), layers.Dropout(0.05), layers.Dense(10, 1)])
    losses = net.fit(df, "features", "y", epochs=8, optimizer=layers.SGD(0.05, clip=5.0))
    assert losses[-1] < 0.8 * losses[0] and net.num_parameters == 51
    assert len(net.predict(df, "features").first().prediction) == 1


def test_generators_do_not_depend_on_partitions(spark):
    a = generators.generate(spark, "multilabel", num_samples=50, num_features=3)[0].orderBy("id").collect()
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "1")
    b = generators.generate(spark, "multilabel", num_samples=50, num_features=3)[0].orderBy("id").collect()
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert a == b and all(sum(r.y) for r in a)
    assert generators.phase_mix(spark, 4, 16).count() == 4 and generators.multifreq(spark, 2, 8).count() == 16
    with pytest.raises(ValueError):
        generators.generate(spark, "classification")


def test_stream_fit_equals_batch_fit(spark, tmp_path):
    from stratakit.operators import encoders as E
    from stratakit.operators.pipeline import EncoderPipeline

    df = spark.range(300).select((F.col("id") * 1.5).alias("n"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("c"))
    df.repartition(3).write.parquet(f"file://{tmp_path}/in")

    def fresh():
        return EncoderPipeline().add_encoder(E.StandardEncoder("n", 0)).add_encoder(E.CategoricalEncoder("c", 1)).finalize_setup()

    p = fresh()
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    incremental.fit_stream(stream, p, f"file://{tmp_path}/check", f"file://{tmp_path}/state").awaitTermination()
    whole = fresh().fit(df)
    assert p["n"].moments.mean == pytest.approx(whole["n"].moments.mean) and p["n"].moments.std == pytest.approx(whole["n"].moments.std)
    assert p["c"].counts == whole["c"].counts
    m = incremental.merge_standardize(1.0, 2.0, 10, 3.0, 1.0, 30)
    assert m[2] == 40 and m[0] == pytest.approx(2.5)


def test_wav(spark, tmp_path):
    import wave

    from stratakit.sources import audio

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.arange(40, dtype="<i2").tobytes())
    df = audio.read_wav(spark, f"file://{tmp_path}/a.wav", standardize=False)
    assert [r.value for r in df.where("channel = 1").orderBy("t").collect()] == list(range(1, 40, 2))
    assert audio.windows(audio.read_wav(spark, f"file://{tmp_path}/a.wav"), 8, 2).count() == 6
