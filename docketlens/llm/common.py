"""Shared helpers: the shared scratch folder, table readers, bounded Arrow batches."""

from __future__ import annotations

import gc
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One or more characters that are neither a space nor one of \t \n \v \f \r.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
SPACE_PATTERN = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only where it is unset and the master is a single machine (tests) does it
    fall back to a folder of its own; on a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(told)
        return told.rstrip("/")
    if not (sc.master.startswith("local[") or sc.master == "local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir("/tmp/checkpoints/docketlens")
    return "/tmp/checkpoints/docketlens"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/docketlens/{name}-{uuid.uuid4().hex}"


_PASSING: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


def stored(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the
    lineage, survives a lost executor, and is evaluated once.  Inside ``passing_tables`` it goes at their end; a
    lasting one at the end of those around them, if there are any."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    around = _PASSING.get()[: -1 if lasting else None]
    if around:
        around[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing_tables(spark: SparkSession):
    """Tables stored inside go at the end, but for lasting ones: nothing that is used later may read them."""
    held: list[str] = []
    token = _PASSING.set((*_PASSING.get(), held))
    try:
        yield
    finally:
        _PASSING.reset(token)
        for path in held:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        release_shuffles(spark)


def release_shuffles(spark: SparkSession) -> None:
    """Spark removes shuffle files when the driver collects what refers to them; between the steps of a long operator, do."""
    gc.collect()
    spark._jvm.System.gc()


#: Keys that may be called hot at most, whatever the table's size, and rows of a key below which none is.
HOT_KEYS, HOT_ROWS = 100_000, 512


def hot_keys(rows: DataFrame, keys: list[str]) -> list[DataFrame | None]:
    """For each of the columns ``_hot, _parts``: values with more than ``HOT_ROWS`` rows and more than their share
    of ``HOT_KEYS``, so a bounded list, and in how many parts to split them; None where there are none."""
    each = [rows.groupBy(F.lit(i).alias("i"), F.col(k).alias("k")).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_ROWS) for i, k in enumerate(keys)]
    counts = stored(reduce(DataFrame.unionByName, each), "hot-keys")
    total = {r.i: r.n for r in counts.groupBy("i").agg(F.sum("_n").alias("n")).collect()}  # a row per column
    out: list[DataFrame | None] = []
    for i in range(len(keys)):
        limit = max(HOT_ROWS, total.get(i, 0) // HOT_KEYS)
        own = counts.where((F.col("i") == i) & (F.col("_n") > limit)).select(F.col("k").alias("_hot"), F.ceil(F.col("_n") / limit).alias("_parts"))
        out.append(own if i in total else None)
    return out


def join_one(many: DataFrame, one: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """Inner join with a row per key; the rows of hot keys stay where they are."""
    if hot is None:
        return many.join(one, key)
    hot = F.broadcast(hot.select("_hot"))
    of_hot = F.broadcast(one.join(hot, F.col(key) == F.col("_hot"), "left_semi"))
    return many.join(of_hot, key).unionByName(many.join(hot, F.col(key) == F.col("_hot"), "left_anti").join(one, key))


def join_spread(many: DataFrame, one: DataFrame, key: str, by: str, hot: DataFrame | None) -> DataFrame:
    """Inner join with a (large) row per key; hot keys are split by ``by``, and their row is copied to each part."""
    if hot is None:
        return many.join(one, key)
    hot = F.broadcast(hot)
    left = many.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_part", F.expr(f"pmod(xxhash64(`{by}`), coalesce(_parts, 1L))")).drop("_hot", "_parts")
    right = one.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_part", F.explode(F.expr("sequence(0L, coalesce(_parts, 1L) - 1)"))).drop("_hot", "_parts")
    return left.join(right, [key, "_part"]).drop("_part")


#: What one Arrow batch holds at most; a single longer row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and by bytes.  Plans read this when they run, so every
    operator asks for the same bounds: no query changes another one's batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text):
    """Number of words of a text column, 0 for null; one regex pass, nothing materialised."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def crc_mod(column, n: int):
    """crc32 of the value written as text, modulo n; null for null."""
    return F.crc32(column.cast("string").cast("binary")) % n
