"""Queries of encoders and pipelines over the fact tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chrono, text, vec
from ..functions.chrono import Period
from ..operators import encoders as E
from ..operators import moments
from ..operators.moments import Moments
from ..operators.pipeline import EncoderPipeline, expand_list_column
from ..streaming.incremental import merge_standardize
from ._base import R, query, r, t

CODES = "(SELECT {c} AS k, row_number() OVER (ORDER BY count(*) DESC, {c}) AS code FROM {t} WHERE {c} IS NOT NULL GROUP BY {c})"
DAY_WEEK = "isodow(l_shipdate) / 7.0::DOUBLE * 2 * pi()"


@query(f"""
WITH s AS (SELECT min(l_quantity) lo, max(l_quantity) hi, avg(l_extendedprice) m, stddev_pop(l_extendedprice) sd FROM lineitem),
c AS {CODES.format(c='l_returnflag', t='lineitem')}
SELECT l_orderkey, l_linenumber, {R('(l_quantity - lo) / (hi - lo)')} AS l_quantity, {R('(l_extendedprice - m) / (sd + 1e-12)')} AS l_extendedprice,
       code::INTEGER AS l_returnflag, {R(f'sin({DAY_WEEK})')} AS l_shipdate_day_week_sin, {R(f'cos({DAY_WEEK})')} AS l_shipdate_day_week_cos
FROM lineitem CROSS JOIN s LEFT JOIN c ON l_returnflag = k
""")
def encode_pipeline(spark, sf_dir):
    df = t(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber")
    p = EncoderPipeline()
    p.add_encoder(E.MinMaxEncoder("l_quantity", 0)).add_encoder(E.StandardEncoder("l_extendedprice", 1)).add_encoder(E.CategoricalEncoder("l_returnflag", 2)).add_encoder(E.TimeCycleEncoder("l_shipdate", 3))
    out = p.finalize_setup().fit(df).encode(df, ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", "l_returnflag", *(r(F.col(c)).alias(c) for c in ("l_quantity", "l_extendedprice", "l_shipdate_day_week_sin", "l_shipdate_day_week_cos")))


@query(f"SELECT l_orderkey, l_linenumber, {R('l_quantity', 4)} AS l_quantity, {R('l_extendedprice', 4)} AS l_extendedprice, coalesce(l_returnflag, 'none') AS l_returnflag FROM lineitem")
def decode_pipeline(spark, sf_dir):
    df = t(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_returnflag", "l_orderkey", "l_linenumber")
    p = EncoderPipeline()
    p.add_encoder(E.MinMaxEncoder("l_quantity", 0, encoding_range=(-1, 1))).add_encoder(E.StandardEncoder("l_extendedprice", 1)).add_encoder(E.CategoricalEncoder("l_returnflag", 2))
    keys = ["l_orderkey", "l_linenumber"]
    p.finalize_setup().fit(df)
    out = EncoderPipeline.from_json(p.to_json()).decode(p.encode(df, keys), keys)
    return out.select(*keys, r(F.col("l_quantity"), 4).alias("l_quantity"), r(F.col("l_extendedprice"), 4).alias("l_extendedprice"), F.coalesce("l_returnflag", F.lit("none")).alias("l_returnflag"))


@query(f"SELECT o_orderkey, {R('(o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()) * 2 - 1')} AS o_totalprice FROM orders")
def enc_minmax(spark, sf_dir):
    df = t(spark, sf_dir, "orders")
    return df.select("o_orderkey", *(r(c).alias("o_totalprice") for c in E.MinMaxEncoder("o_totalprice", 0, encoding_range=(-1, 1)).fit(df).encode()))


@query(f"SELECT c_custkey, {R('(c_acctbal - avg(c_acctbal) OVER ()) / (stddev_pop(c_acctbal) OVER () + 1e-12)')} AS c_acctbal FROM customer")
def enc_zscore(spark, sf_dir):
    df = t(spark, sf_dir, "customer")
    return df.select("c_custkey", *(r(c).alias("c_acctbal") for c in E.StandardEncoder("c_acctbal", 0).fit(df).encode()))


BOUNDS = """
o AS (SELECT value AS v, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL AND NOT isnan(value)),
q AS (SELECT avg(v) FILTER (i IN (floor((n - 1) * 0.25), ceil((n - 1) * 0.25))) AS q1, avg(v) FILTER (i IN (floor((n - 1) * 0.75), ceil((n - 1) * 0.75))) AS q3,
             avg(v) FILTER (i IN (floor((n - 1) * 0.5), ceil((n - 1) * 0.5))) AS med, avg(v) AS mean FROM o),
b AS (SELECT q1 - 2 * (q3 - q1) AS lo, q3 + 2 * (q3 - q1) AS hi, mean, med FROM q)
"""


@query(f"WITH {BOUNDS} SELECT {R('lo')} AS low, {R('hi')} AS high FROM b")
def iqr_bounds(spark, sf_dir):
    lo, hi = moments.iqr_bounds(t(spark, sf_dir, "events"), F.col("value"))
    return spark.createDataFrame([(lo, hi)], "low double, high double").select(r(F.col("low")).alias("low"), r(F.col("high")).alias("high"))


@query(f"WITH {BOUNDS} SELECT event_id, value > hi OR value < lo AS outlier FROM events, b")
def outlier_flags(spark, sf_dir):
    df = t(spark, sf_dir, "events")
    return df.select("event_id", moments.is_outlier(F.col("value"), moments.iqr_bounds(df, F.col("value"))).alias("outlier"))


def _imputed(method: str):
    fill = {"clip": "greatest(least(value, hi), lo)", "mean": "CASE WHEN value > hi OR value < lo THEN mean ELSE value END", "median": "CASE WHEN value > hi OR value < lo THEN med ELSE value END"}[method]
    sql = f"WITH {BOUNDS}, v AS (SELECT event_id, {fill} AS x FROM events, b) SELECT event_id, {R('(x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ())')} AS value FROM v"

    def run(spark, sf_dir):
        df = t(spark, sf_dir, "events")
        e = E.MinMaxEncoder("value", 0, impute_method=method, impute_outliers=True).fit(df)
        return df.select("event_id", r(e.encode()[0]).alias("value"))

    run.__name__ = f"impute_{method}"
    return query(sql)(run)


impute_clip, impute_mean, impute_median = map(_imputed, ("clip", "mean", "median"))


@query(f"SELECT count(l_tax)::BIGINT AS n, {R('avg(l_tax)')} AS mean, {R('stddev_pop(l_tax)')} AS std FROM lineitem")
def running_moments_merge(spark, sf_dir):
    df = t(spark, sf_dir, "lineitem")
    parts = [Moments.of(x.asDict(), "v") for x in df.groupBy(F.col("l_linenumber")).agg(*Moments.exprs(F.col("l_tax"), "v")).collect()]
    mean, std, n = 0.0, 0.0, 0
    for p in parts:
        mean, std, n = merge_standardize(mean, std, n, p.mean, p.std, p.n)
    return spark.createDataFrame([(n, mean, std)], "n long, mean double, std double").select("n", r(F.col("mean")).alias("mean"), r(F.col("std")).alias("std"))


@query(f"SELECT p_partkey, {R('(p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER ()')} AS p_retailprice FROM part")
def standardize_data(spark, sf_dir):
    df = moments.standardize(t(spark, sf_dir, "part"), ["p_retailprice"])
    return df.select("p_partkey", r(F.col("p_retailprice")).alias("p_retailprice"))


@query(f"WITH c AS {CODES.format(c='p_brand', t='part')} SELECT p_partkey, (CASE WHEN code <= 5 THEN code ELSE 6 END)::INTEGER AS p_brand FROM part LEFT JOIN c ON p_brand = k")
def enc_category_topn(spark, sf_dir):
    df = t(spark, sf_dir, "part")
    return df.select("p_partkey", *E.CategoricalEncoder("p_brand", 0, classes=5).fit(df).encode())


@query(f"WITH c AS {CODES.format(c='p_brand', t='part')} SELECT p_partkey, CASE WHEN code <= 5 THEN p_brand ELSE 'rare_label' END AS p_brand FROM part LEFT JOIN c ON p_brand = k")
def enc_category_inverse(spark, sf_dir):
    df = t(spark, sf_dir, "part")
    e = E.CategoricalEncoder("p_brand", 0, classes=5).fit(df)
    return df.select("p_partkey", *e.encode()).select("p_partkey", *e.inverse())


@query("SELECT c_mktsegment AS label, count(*)::BIGINT AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1")
def category_counts(spark, sf_dir):
    return E.CategoricalEncoder("c_mktsegment", 0).count_categories(t(spark, sf_dir, "customer"))


@query(f"WITH c AS {CODES.format(c='o_orderpriority', t='orders')} SELECT o_orderkey, (code = 1)::INTEGER AS p_0, (code = 2)::INTEGER AS p_1, (code = 3)::INTEGER AS p_2, (code - 1)::INTEGER AS back FROM orders LEFT JOIN c ON o_orderpriority = k")
def onehot(spark, sf_dir):
    df = t(spark, sf_dir, "orders")
    e = E.CategoricalEncoder("o_orderpriority", 0, for_target=True).fit(df)
    codes = df.select("o_orderkey", *e.encode()).select("o_orderkey", vec.to_onehot(F.col("o_orderpriority"), e.num_categories).alias("p"))
    return expand_list_column(codes.withColumn("back", vec.to_int_classes(F.col("p"))), "p", 3)


@query("SELECT l_orderkey, l_linenumber, (l_linenumber = 1 OR l_linenumber % 4 = 1)::INTEGER AS k_1, (l_linenumber % 4 = 2)::INTEGER AS k_2 FROM lineitem")
def khot(spark, sf_dir):
    df = t(spark, sf_dir, "lineitem")
    k = vec.to_khot(F.array(F.col("l_linenumber") % 4, F.when(F.col("l_linenumber") == 1, 1).otherwise(F.col("l_linenumber") % 4)), 4)
    return df.select("l_orderkey", "l_linenumber", k[1].alias("k_1"), k[2].alias("k_2"))


CYCLES = {
    (Period.MINUTE, Period.HOUR): "minute(ts) / 60.0::DOUBLE",
    (Period.HOUR, Period.DAY): "(hour(ts) + (minute(ts) >= 30)::INT) / 24.0::DOUBLE",
    (Period.DAY, Period.WEEK): "isodow(ts) / 7.0::DOUBLE",
    (Period.DAY, Period.MONTH): "day(ts) / day(last_day(ts))::DOUBLE",
    (Period.DAY, Period.YEAR): "dayofyear(ts) / dayofyear(make_date(year(ts), 12, 31))::DOUBLE",
    (Period.WEEK, Period.MONTH): "round(day(ts) / 7.0::DOUBLE, 1) / floor(day(last_day(ts)) / 7.0)::DOUBLE",
    (Period.WEEK, Period.YEAR): "round(dayofyear(ts) / 7.0::DOUBLE, 1) / 52.1775::DOUBLE",
    (Period.MONTH, Period.YEAR): "month(ts) / 12.0::DOUBLE",
}


def _cycle(pair, ratio: str):
    sql = f"SELECT event_id, {R(f'sin(({ratio}) * 2 * pi())')} AS s, {R(f'cos(({ratio}) * 2 * pi())')} AS c, {R(f'({ratio}) * {chrono.TURNS[pair]}::DOUBLE')} AS position FROM events"

    def run(spark, sf_dir):
        df = t(spark, sf_dir, "events")
        e = E.TimeCycleEncoder("ts", 0, *pair).fit(df)
        a = chrono.RATIOS[pair](F.col("ts").cast("timestamp_ntz"))
        s, c = e.encode()
        return df.select("event_id", r(s).alias("s"), r(c).alias("c"), r(chrono.inverse(a, *pair)).alias("position"))

    run.__name__ = f"cycle_{pair[0].value}_{pair[1].value}"
    return query(sql)(run)


for _pair, _ratio in CYCLES.items():
    _cycle(_pair, _ratio)


@query(f"""
WITH d AS (SELECT l_orderkey, l_linenumber, floor(abs(epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1000000.0) / 86400.0 AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT min(v) lo, max(v) hi FROM d)
SELECT l_orderkey, l_linenumber, {R('(greatest(least(v, 1.25 * hi), 0.75 * lo) - lo) / (hi - lo)')} AS l_shipdate FROM d, s
""")
def delta_days(spark, sf_dir):
    df = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_shipdate", "o_orderdate")
    e = E.TimeDeltaEncoder("l_shipdate", 2, "o_orderdate").fit(df)
    return df.select("l_orderkey", "l_linenumber", r(e.encode()[0]).alias("l_shipdate"))


@query("SELECT event_id, strftime(ts + to_hours((user_id % 5)::INT), '%Y-%m-%d %H:%M:%S') AS shifted FROM events")
def localize(spark, sf_dir):
    shifted = chrono.localize_timestamp(F.col("ts").cast("timestamp_ntz"), (F.col("user_id") % 5).cast("int"))
    return t(spark, sf_dir, "events").select("event_id", F.date_format(shifted, "yyyy-MM-dd HH:mm:ss").alias("shifted"))


@query("SELECT item_id, sha256(text) AS hash FROM benchmark")
def sha256_col(spark, sf_dir):
    return t(spark, sf_dir, "benchmark").select("item_id", text.hash_string(F.col("text")).alias("hash"))


@query(r"""
WITH u AS (SELECT page_id, replace(replace(replace(replace(replace(html, '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '"'), '&amp;', '&'), '&amp', '&') AS x FROM pages)
SELECT page_id, regexp_replace(regexp_replace(x, '&([a-zA-Z][-.a-zA-Z0-9]*)([^a-zA-Z0-9;])', '&\1;\2', 'g'), '<!--.*?-->|<[!?][^>]*>|</?[a-zA-Z][^>]*>', '', 'gs') AS text FROM u
""")
def strip_tags(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", text.strip_tags(F.col("html")).alias("text"))


@query("SELECT page_id, length(regexp_replace(html, '<[^>]*>', '', 'g'))::BIGINT AS n FROM pages")
def strip_tags_native(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", F.length(text.strip_tags_native(F.col("html"))).cast("long").alias("n"))


@query("SELECT event_id, event_type IS NULL AS event_type, value IS NULL OR isnan(value) AS value FROM events")
def null_mask(spark, sf_dir):
    df = t(spark, sf_dir, "events").select("event_type", "value", "event_id")
    p = EncoderPipeline().add_encoder(E.CategoricalEncoder("event_type", 0)).add_encoder(E.MinMaxEncoder("value", 1)).finalize_setup()
    mask = p.null_mask(df)
    return df.select("event_id", *(c.alias(n) for n, c in zip(mask.columns, [F.col("event_type").isNull(), F.col("value").isNull() | F.isnan("value")], strict=True)))


@query(f"SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS window_start, strftime(time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY, '%Y-%m-%d') AS window_end, event_type, count(value)::BIGINT AS n, {R('avg(value)', 5)} AS mean, {R('stddev_pop(value)', 5)} AS std FROM events GROUP BY 1, 2, 3")
def windowed_moments(spark, sf_dir):
    from ..streaming.incremental import windowed_moments as windowed

    out = windowed(t(spark, sf_dir, "events"), "ts", "value", "1 day", by=["event_type"])
    return out.select(*(F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("window_start", "window_end")), "event_type", "n", r(F.col("mean"), 5).alias("mean"), r(F.col("std"), 5).alias("std"))


@query("SELECT l_orderkey, l_linenumber, epoch_us(try_cast(strftime(l_shipdate, '%Y-%m-%d') AS TIMESTAMP)) // 1000000 AS seconds FROM lineitem")
def convert_timestamp(spark, sf_dir):
    text_ = F.date_format("l_shipdate", "yyyy-MM-dd")
    ts = chrono.convert_timestamp(text_)
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts).alias("seconds"))


@query(f"""
WITH d AS (SELECT l_orderkey, l_linenumber, (floor(abs(epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1000000.0) % 86400) / 3600.0 AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, {R('v')} AS hours FROM d
""")
def delta_within_day(spark, sf_dir):
    df = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    e = E.TimeDeltaEncoder("l_shipdate", 0, "o_orderdate", interval="hour", compat=True)
    return df.select("l_orderkey", "l_linenumber", r(e.value()).alias("hours"))


@query("SELECT 'multilabel' AS task WHERE (SELECT max(quality + toxic) FROM labels) > 1 UNION ALL SELECT 'binary' WHERE (SELECT max(quality + toxic) FROM labels) = 1")
def determine_task(spark, sf_dir):
    from ..operators.regression import determine_task as task

    df = t(spark, sf_dir, "labels").select(F.array("quality", "toxic").alias("y"))
    return spark.createDataFrame([(task(df, "y"),)], "task string")


@query("SELECT event_id, list_min([value, 1.0::DOUBLE, user_id::DOUBLE]) AS low, list_max([value, 1.0::DOUBLE, user_id::DOUBLE]) AS high, 3 AS n FROM events")
def flatten_containers(spark, sf_dir):
    flat = vec.flatten_containers(F.array("value", F.lit(1.0)), F.array(F.col("user_id").cast("double")))
    return t(spark, sf_dir, "events").select("event_id", F.array_min(flat).alias("low"), F.array_max(flat).alias("high"), F.size(flat).alias("n"))
