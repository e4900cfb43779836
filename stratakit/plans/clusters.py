"""Queries of clustering, its metrics, and matrix operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vec
from ..operators import centroid, grid, metrics, som
from ._base import R, query, r, t


def labelled(spark, sf_dir):
    return t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), F.col("label").alias("cluster"))


def rounded(df):
    return df.select(*(r(F.col(c)).alias(c) for c in df.columns))


V = "v AS (SELECT vec_id, label AS k, embedding::DOUBLE[] AS a FROM embeddings)"
CELLS = "x AS (SELECT vec_id, k, unnest(range(1, 65)) AS i, unnest(a) AS x FROM v)"


@query(f"""
WITH {V}, n AS (SELECT k, count(*) AS n FROM v GROUP BY k),
d AS (SELECT x.vec_id, x.k, y.k AS o, sum(list_distance(x.a, y.a)) AS s FROM v x, v y GROUP BY ALL),
e AS (SELECT vec_id, max(CASE WHEN d.k = o THEN s / greatest(n - 1, 1) END) AS a, min(CASE WHEN d.k <> o THEN s / n END) AS b FROM d JOIN n ON o = n.k GROUP BY vec_id)
SELECT {R('avg((b - a) / greatest(a, b))')} AS silhouette FROM e
""")
def silhouette(spark, sf_dir):
    return rounded(metrics.silhouette(labelled(spark, sf_dir)))


@query(f"""
WITH {V}, {CELLS}, c AS (SELECT k, i, avg(x) AS m FROM x GROUP BY k, i),
s AS (SELECT k, avg(d) AS s FROM (SELECT x.k, vec_id, sqrt(sum(pow(x - m, 2))) AS d FROM x JOIN c ON x.k = c.k AND x.i = c.i GROUP BY 1, 2) GROUP BY k),
a AS (SELECT p.k AS i, q.k AS j, sqrt(sum(pow(p.m - q.m, 2))) AS d FROM c p JOIN c q ON p.i = q.i AND p.k <> q.k GROUP BY 1, 2)
SELECT {R('avg(w)')} AS davies_bouldin FROM (SELECT a.i, max((si.s + sj.s) / d) AS w FROM a JOIN s si ON a.i = si.k JOIN s sj ON a.j = sj.k GROUP BY a.i)
""")
def davies_bouldin(spark, sf_dir):
    return rounded(metrics.davies_bouldin(labelled(spark, sf_dir)))


@query(f"""
WITH {V}, {CELLS}, c AS (SELECT k, i, avg(x) AS m, count(*) AS n, var_pop(x) * count(*) AS w FROM x GROUP BY k, i), g AS (SELECT i, avg(x) AS g FROM x GROUP BY i),
z AS (SELECT sum(w) AS w, sum(n * pow(m - g, 2)) AS b, sum(n) / 64 AS n, count(DISTINCT k) AS k FROM c JOIN g USING (i))
SELECT {R('b * (n - k) / (w * (k - 1))', 5)} AS calinski_harabasz FROM z
""")
def calinski_harabasz(spark, sf_dir):
    df = metrics.calinski_harabasz(labelled(spark, sf_dir))
    return df.select(r(F.col("calinski_harabasz"), 5).alias("calinski_harabasz"))


@query("SELECT lang AS label_a, source AS label_b, count(*)::BIGINT AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2")
def contingency(spark, sf_dir):
    return metrics.contingency(t(spark, sf_dir, "documents"), "lang", "source")


J = """j AS (SELECT lang AS a, source AS b, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2),
m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM j)"""


@query(f"WITH {J} SELECT {R('sum(n / t * ln(n * t / (na * nb)))')} AS mutual_information FROM m")
def mutual_information(spark, sf_dir):
    return rounded(metrics.mutual_information(t(spark, sf_dir, "documents"), "lang", "source"))


@query(f"WITH c AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1), p AS (SELECT n / sum(n) OVER () AS p FROM c) SELECT {R('-sum(p * ln(p))')} AS entropy FROM p")
def entropy(spark, sf_dir):
    return rounded(metrics.entropy(t(spark, sf_dir, "documents"), "lang"))


@query(f"WITH {J} SELECT {R('1 - sum(n / t * ln(n / nb)) / sum(n / t * ln(na / t))')} AS homogeneity FROM m")
def homogeneity(spark, sf_dir):
    return rounded(metrics.homogeneity(t(spark, sf_dir, "documents"), "lang", "source"))


CENTRES = "v AS (SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings), c AS (SELECT k, embedding::DOUBLE[] AS b FROM (SELECT embedding, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings) WHERE k < 4)"
NEAREST = "n AS (SELECT vec_id, a, k, pow(list_distance(a, b), 2) AS d, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(a, b), k) AS i FROM v, c)"


def four(spark, sf_dir):
    """The centres of the assignment queries: the four vectors with the least ids."""
    df = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))
    return df, [x[0] for x in df.orderBy("id").limit(4).select("features").collect()]


@query(f"WITH {CENTRES}, {NEAREST} SELECT vec_id AS id, k::INTEGER AS cluster, {R('d')} AS distance FROM n WHERE i = 1")
def kmeans_assign(spark, sf_dir):
    df, centres = four(spark, sf_dir)
    return metrics.assign(df, centres).select("id", "cluster", r(F.col("distance")).alias("distance"))


@query(f"WITH {CENTRES}, {NEAREST}, x AS (SELECT k, unnest(range(0, 64)) AS dim, unnest(a) AS x FROM n WHERE i = 1) SELECT k::INTEGER AS cluster, dim::INTEGER AS dim, {R('avg(x)')} AS mean FROM x GROUP BY 1, 2")
def lloyd_step(spark, sf_dir):
    df, centres = four(spark, sf_dir)
    c = metrics.centroids(metrics.assign(df, centres))
    return c.select("cluster", F.posexplode("centre").alias("dim", "mean")).select("cluster", "dim", r(F.col("mean")).alias("mean"))


@query()
def centroid_network(spark, sf_dir):
    df = labelled(spark, sf_dir)
    return centroid.CentroidNetwork(max_clusters=4).fit(df, num_iterations=6).predict(df)


@query()
def som_clusters(spark, sf_dir):
    df = labelled(spark, sf_dir).select("id", "features")
    m = som.SelfOrganisingMap(5, 5, seed=123).fit(df, epochs=2)
    return m.predict(df, max_clusters=3)


@query()
def som_batch_bmu(spark, sf_dir):
    df = labelled(spark, sf_dir).select("id", "features")
    return som.SelfOrganisingMap(5, 5).fit_batch(df, epochs=3).bmu(df)


CELL = "g AS (SELECT l_linenumber AS r, (l_quantity)::INT AS c, sum(l_extendedprice) / 1000 AS v FROM lineitem GROUP BY 1, 2)"


def cells(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("r"), F.col("l_quantity").cast("int").alias("c")).agg((F.sum("l_extendedprice") / 1000).alias("v"))


@query(f"""
WITH {CELL}, h AS (SELECT g.r, g.c, coalesce(a.v, 0) + 2 * g.v + coalesce(b.v, 0) AS v FROM g LEFT JOIN g a ON a.r = g.r AND a.c = g.c - 1 LEFT JOIN g b ON b.r = g.r AND b.c = g.c + 1)
SELECT h.r::INTEGER AS r, h.c::INTEGER AS c, {R('coalesce(a.v, 0) + 2 * h.v + coalesce(b.v, 0)', 6)} AS v FROM h LEFT JOIN h a ON a.c = h.c AND a.r = h.r - 1 LEFT JOIN h b ON b.c = h.c AND b.r = h.r + 1
""")
def blur(spark, sf_dir):
    out = grid.blur(cells(spark, sf_dir))
    return out.select("r", "c", r(F.col("v"), 6).alias("v"))


@query()
def watershed(spark, sf_dir):
    return grid.watershed_cells(cells(spark, sf_dir), levels=10)


@query("SELECT vec_id AS id, (list_position(a, list_max(a)) - 1)::INTEGER AS most, (list_position(a, list_min(a)) - 1)::INTEGER AS least FROM (SELECT vec_id, embedding AS a FROM embeddings)")
def argmax(spark, sf_dir):
    return t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), vec.argmax(F.col("embedding")).alias("most"), vec.argmin(F.col("embedding")).alias("least"))


@query("SELECT lang, count(*) FILTER (source = 'src0')::BIGINT AS src0, count(*) FILTER (source = 'src1')::BIGINT AS src1 FROM documents GROUP BY lang")
def contingency_matrix(spark, sf_dir):
    return metrics.contingency_matrix(t(spark, sf_dir, "documents"), "lang", "source").select("lang", "src0", "src1")


@query()
def cluster_points(spark, sf_dir):
    from ..operators import tidy

    df, centres = four(spark, sf_dir)
    return tidy.cluster_points(metrics.assign(df, centres), centres)


@query("SELECT floor((event_id - (SELECT min(event_id) FROM events)) / (SELECT greatest(1, ceil((max(event_id) - min(event_id) + 1) / 100.0)) FROM events)::DOUBLE)::INTEGER AS bucket, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def waveform(spark, sf_dir):
    from ..operators import tidy

    return tidy.waveform(t(spark, sf_dir, "events"), "event_id", "value", 100)
