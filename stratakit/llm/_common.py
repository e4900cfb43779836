"""Helpers the operators share: inputs, the shared folder, lineage cuts, text splitting."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import itertools
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, for Java and DuckDB patterns.
WORD = "[^\\x20\\x09-\\x0D]+"
_counter = itertools.count()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **types: str) -> DataFrame:
    """The named columns only, with the types asked for, so that other columns can't clash."""
    return df.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in types.items()))


def dealt(df: DataFrame) -> DataFrame:
    """``df``, dealt out to all cores if it is a plain scan of fewer pieces than there are cores: a small file is one."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def batches(spark: SparkSession, rows: int = 1000, mb: int = 8) -> None:
    """Bounds an Arrow batch by rows and bytes: texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


_held: list = [None, None]


def held(key, make):
    """What ``make`` gives, kept by this process from task to task until another key is asked for: a Python worker
    remembers for one operator at a time."""
    if _held[0] != key:
        if _held[0] is None:
            _arrays_apart()
        _held[:] = [None, None]
        _give_back()
        _held[:] = [key, make()]
    return _held[1]


def _arrays_apart(least: int = 1 << 20) -> None:
    """Arrays of ``least`` bytes or more get pages of their own, which go back to the system when they are freed: glibc
    would raise that limit to the largest array freed so far, and keep what lies below."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).mallopt(-3, least)


def _give_back() -> None:
    """Memory that allocators keep for later goes back to the system: the worker's next operator needs other sizes."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset: in the warehouse,
    on a single machine a temporary one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = sc.getCheckpointDir()
        if not found:
            # a folder of this machine does only where everything runs on it
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="stratakit-") if sc.master.startswith("local") else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
            found = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{os.getpid()}-{next(_counter)}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, what: str, **options) -> tuple[DataFrame, str]:
    """The rows as a Parquet table in the shared folder (this cuts the lineage), and its path; options are the writer's."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def remainder(column: str, n: int):
    """crc32(column as text) mod n; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null"))) % F.lit(n)


def hashed_share(df: DataFrame, keep: int, *cols: str) -> DataFrame:
    """About ``keep`` rows, all if there are fewer, chosen by a hash of ``cols``: the same rows each time."""
    total = df.count()
    if total <= keep:
        return df
    return df.where(F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) < int((1 << 30) * keep / total))


def spread(left: DataFrame, right: DataFrame, keys: list[str], by: str, size: int, counts: DataFrame, how: str = "inner", parts: int = 1 << 13) -> DataFrame:
    """``left`` joined with ``right``, which has a row a key, so that no task gets all rows of a frequent key.

    counts: the keys, n (about how many rows of ``left`` have it); size: about how many rows ``left`` has. A key with
    more than a ``parts``-th of these is dealt out in pieces by a hash of ``by``, each with its own copy of the row of
    ``right``. There are at most ``parts`` such keys, and twice as many pieces: that is what is broadcast and copied.
    """
    spark = left.sparkSession
    most = max(1, -(-size // parts))
    often = counts.where(F.col("n") > 2 * most).select(*keys, F.least(F.ceil(F.col("n") / most), F.lit(parts)).cast("int").alias("__pieces")).collect()
    # the plan is the same without such a key: then the first one stands for them, in one piece
    often = often or counts.select(*keys, F.lit(1).alias("__pieces")).take(1)
    if not often:
        return left.join(right, keys, how)
    pieces = F.broadcast(spark.createDataFrame(often, counts.select(*keys, F.lit(1).alias("__pieces")).schema))
    dealt = left.join(pieces, keys, "left").withColumn("__piece", F.pmod(F.xxhash64(by), F.coalesce("__pieces", F.lit(1))).cast("int")).drop("__pieces")
    copied = right.join(pieces, keys, "left").withColumn("__piece", F.explode(F.sequence(F.lit(0), F.coalesce("__pieces", F.lit(1)) - 1))).drop("__pieces")
    return dealt.join(copied, [*keys, "__piece"], how).drop("__piece")


def grouped(frames: Iterator, weight, least: int) -> Iterator[list]:
    """Runs of frames with a summed weight of ``least`` or more; the last may be lighter."""
    held, heavy = [], 0
    for frame in frames:
        held.append(frame)
        heavy += weight(frame)
        if heavy >= least:
            yield held
            held, heavy = [], 0
    if held:
        yield held
