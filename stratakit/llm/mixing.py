"""Mixing sources to target weights, with DataFrame functions only.

Every row gets a hash-random key. Sources are cut into ranges of keys; the ranges' word counts, summed up in key
order, and a running sum within each range give every row the words before it in its source. A source takes whole
epochs while its budget lasts, then the rows in key order up to the exact word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(C.WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """sizes: source, source_size; a small table, a row a source. Adds target (double).

    Weights go to the sources by code point, null last, in turn. A target stops at ``most`` times its source's
    size; the excess is shared by weight among the others until none is above. In the order of cap to weight a
    source is capped just if its cap is at most its share of what those before it leave.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sizes = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1)).cast("long")).withColumn("cap", F.col("source_size") * most)
    ahead = Window.orderBy((F.col("cap").cast("double") / F.col("w")), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = sizes.select(
        "*",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(ahead), F.lit(0))).alias("rest"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(ahead), F.lit(0))).alias("rest_w"),
    ).withColumn("capped", F.col("cap").cast("double") * F.col("rest_w") <= F.col("w").cast("double") * F.col("rest"))
    shared = F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0))
    among = F.sum("w").over(every) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("w"))).over(every), F.lit(0))
    share = (F.col("w") * shared).cast("double") / F.when(among > 0, among)
    return left.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, seed: str = "mix", range_rows: int = 100_000) -> DataFrame:
    """``docs`` (doc_id, text, source and any others) with __size, __source_size, __target, __taken.

    A null text has size 0; a null source is a source; a null doc_id counts as ``null``. The key is a hash of doc_id and
    text, so that rows of one id, or of none, lie apart; rows that agree in both come in order of size. Ranges of keys
    hold about ``range_rows`` rows at most, as many as the table takes; what is taken doesn't depend on them. Repeated rows
    count each. An empty table gives no rows.
    """
    count, digits = docs.count(), 1
    while count > range_rows * 16**digits and digits < 7:
        digits += 1
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text).cast("binary"))
    rows = C.dealt(docs).select(
        "*",
        words(F.col("text")).alias("__size"),
        F.col("source").alias("__source"),
        F.conv(F.substring(key, 1, 15), 16, 10).cast("long").alias("__key"),
    ).withColumn("__range", F.shiftright("__key", 60 - 4 * digits))
    per_range = rows.groupBy("__source", "__range").agg(F.sum("__size").alias("__n"))
    sizes = targets(per_range.groupBy(F.col("__source").alias("source")).agg(F.sum("__n").alias("source_size")))
    sizes = sizes.select(F.col("source").alias("__of"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    before = F.sum("__n").over(Window.partitionBy("__source").orderBy("__range")) - F.col("__n")
    starts = per_range.select(F.col("__source").alias("__s"), F.col("__range").alias("__r"), before.alias("__start")).join(sizes, F.col("__s").eqNullSafe(F.col("__of"))).drop("__of")
    order = Window.partitionBy("__source", "__range").orderBy("__key", "doc_id", "__size")
    rows = rows.withColumn("__within", F.coalesce(F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(starts, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__r")))
    budget, size = F.floor("__target"), F.col("__source_size")
    epochs = F.when(size > 0, F.floor(budget / size)).otherwise(0)
    part = F.least(F.col("__size"), F.greatest(F.lit(0), budget - epochs * size - F.col("__start") - F.col("__within")))
    return rows.select(*(f"`{c}`" for c in docs.columns), "__size", "__source_size", "__target", (epochs * F.col("__size") + part).cast("long").alias("__taken"))


def op8(docs: DataFrame) -> DataFrame:
    mixed = mix(C.pick(docs, doc_id="long", text="string", source="string"))
    return mixed.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))


def apply(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each epoch of a document. The document in which a
    source's budget ends gives its words up to there, joined by single spaces, and n_chars follows. Documents
    without words, null texts among them, are left out; repeated rows count each; an empty table stays empty."""
    mixed = mix(docs).where("__taken > 0")
    whole = F.floor(F.col("__taken") / F.col("__size")).cast("int")
    part = (F.col("__taken") % F.col("__size")).cast("int")
    copies = mixed.withColumn("__words", F.explode(F.concat(F.array_repeat(F.lit(-1), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))))
    cut = F.when(F.col("__words") < 0, F.col("text")).otherwise(F.concat_ws(" ", F.slice(F.regexp_extract_all("text", F.lit(f"({C.WORD})"), 1), 1, F.greatest(F.col("__words"), F.lit(0)))))
    out = copies.withColumn("text", cut)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__words") < 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*(f"`{c}`" for c in docs.columns))


#: The same for DuckDB; {docs} is the relation of documents.
SQL = """
WITH rows AS (
  SELECT doc_id, source, length(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS k
  FROM {docs}),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM rows GROUP BY source),
a AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER ()::BIGINT AS t, sum(w) OVER ()::BIGINT AS tw,
         coalesce(sum(3 * source_size) OVER o, 0)::BIGINT AS c_before, coalesce(sum(w) OVER o, 0)::BIGINT AS w_before
  FROM s WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, cap::DOUBLE * (tw - w_before) <= w::DOUBLE * (t - c_before) AS capped FROM a),
c AS (
  SELECT source, source_size,
         CASE WHEN capped THEN cap::DOUBLE ELSE (w * (t - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)))::DOUBLE
              / (tw - coalesce(sum(CASE WHEN capped THEN w END) OVER (), 0)) END AS target
  FROM b),
d AS (
  SELECT r.*, source_size, target, floor(target)::BIGINT AS budget,
         CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs,
         coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM rows r JOIN c ON r.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(size, greatest(0, budget - epochs * source_size - before)))::BIGINT AS taken
FROM d
"""
