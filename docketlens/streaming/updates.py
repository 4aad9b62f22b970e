"""Mentions of cases kept by court and year, and brought up to date batch by batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What tells mentions of a case apart.
KEYS = ("judge_enum", "party_enum", "docket_index", "full_span_start")
PARTS = ("court", "yy")


def _equal(a: DataFrame, b: DataFrame, columns) -> F.Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[f"_{c}"]) for c in columns])


def merged(old: DataFrame, updates: DataFrame, case: str = "ucid", keys: tuple = KEYS) -> DataFrame:
    """Old mentions, those with a key of ``updates`` (null equals null) replaced, and all mentions of cases that ``old`` does not have.

    A case that is known gets no further mentions.  Of updates with the same key the largest in order counts; rows
    without a case are no updates.  Running it again on its own result changes nothing, as long as new cases' keys are unique.
    """
    told = updates.select(*old.columns).where(F.col(case).isNotNull())
    # Both meet in one shuffle by case; old mentions without a case stay as they are, where they are.
    both = old.where(F.col(case).isNotNull()).withColumn("_old", F.lit(True)).unionByName(told.withColumn("_old", F.lit(False)))
    both = both.repartition(case).sortWithinPartitions(case, *keys)
    both = both.withColumn("_known", F.bool_or("_old").over(Window.partitionBy(case)))
    both = both.withColumn("_u", F.max(F.when(~F.col("_old"), F.struct(*old.columns))).over(Window.partitionBy(case, *keys))).where("_old OR NOT _known")
    now = F.col("_old") & F.col("_u").isNotNull()
    kept = both.select(*[F.when(now, F.col(f"_u.{c}")).otherwise(F.col(c)).alias(c) for c in old.columns])
    return kept.unionByName(old.where(F.col(case).isNull()))


def _done(spark: SparkSession, path: str) -> bool:
    """Was a table written to its end?"""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def write_cases(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Mentions as Parquet by court and two-digit year; with ``overwrite`` only the parts that ``rows`` has are written."""
    rows.repartition(*PARTS, F.pmod(F.xxhash64("ucid"), F.lit(8))).write.option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).mode(mode).parquet(path)


def read_cases(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def apply_batch(updates: DataFrame, batch: int, path: str, staging: str, keys: tuple = KEYS) -> None:
    """Bring the parts that a batch touches up to date; a case lies in one part, by its court and its year, and stays there.

    The new parts are written in full beside the table first, and replace the old ones from there.  A batch that comes again,
    after a failure at any point, is applied from what it wrote the first time, so it counts once.
    """
    spark, staged = updates.sparkSession, f"{staging}/batch={batch}"
    schema = updates.schema
    if not _done(spark, staged):
        touched = updates.where("ucid IS NOT NULL").select(*[F.col(c).alias(f"_{c}") for c in PARTS]).distinct()
        table = read_cases(spark, path, schema)
        # One row a part of the table, however many mentions there are.
        merged(table.join(F.broadcast(touched), _equal(table, touched, PARTS), "left_semi"), updates, keys=keys).write.mode("overwrite").parquet(staged)
    write_cases(spark.read.schema(schema).parquet(staged), path, "overwrite")


def update_stream(stream: DataFrame, path: str, staging: str, checkpoint: str, keys: tuple = KEYS) -> None:
    """Apply a stream of updates to the table at ``path`` until all that is there is read."""
    stream.writeStream.foreachBatch(lambda rows, i: apply_batch(rows, i, path, staging, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
