"""Where chains of pointers end, and names of one level told by the level above it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share; one of its own on a single machine only."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not told and not (master.startswith("local[") or master == "local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (told or "/tmp/checkpoints/docketlens").rstrip("/")


def cut(rows: DataFrame) -> DataFrame:
    """The rows as a checkpoint in the shared folder: no lineage, and they survive a lost executor."""
    context = rows.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint()


def endpoints(pointers: DataFrame, node: str, target: str) -> DataFrame:
    """``node, target``: where each node's chain of pointers ends.

    Pointers are doubled: after k rounds each node knows the one 2^k steps on, so a chain of 1,000 takes ten rounds,
    each one self-join of what still moves.  A node without a pointer, with a null one or with itself as target is an end;
    only nodes are told.  Nodes on a circle, and those that lead into one, have no end: null.  Of several pointers of one
    node the smallest target counts.
    """
    first = pointers.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(F.when(F.col(target) != F.col(node), F.col(target))).alias("at"))
    first = cut(first)
    done = first.where("at IS NULL").select("node", F.col("node").alias("end"))
    # Targets that have no pointer of their own are ends as well.
    own = first.where("at IS NOT NULL").select(F.col("node").alias("_n"))
    moving = cut(first.where("at IS NOT NULL").join(own, F.col("at") == F.col("_n"), "left").select("node", "at", F.col("_n").isNull().alias("ended")))
    rounds = (max(first.count(), 1) - 1).bit_length() + 1
    for _ in range(rounds):
        if moving.where("NOT ended").isEmpty():
            break
        on = moving.select(F.col("node").alias("_n"), F.col("at").alias("_at"), F.col("ended").alias("_ended"))
        # What has ended stays where it is; of the others each takes its target's place, which tells whether it has ended.
        step = moving.where("NOT ended").join(on, F.col("at") == F.col("_n")).select("node", F.col("_at").alias("at"), F.col("_ended").alias("ended"))
        moving = cut(moving.where("ended").unionByName(step))
    done = done.unionByName(moving.where("ended").select("node", F.col("at").alias("end")))
    moving = moving.where("NOT ended")
    out = done.unionByName(moving.select("node", F.lit(None).cast(first.schema["node"].dataType).alias("end")))
    return out.select(F.col("node").alias(node), F.col("end").alias(target))


def chained(levels: list[DataFrame], node: str, target: str) -> DataFrame:
    """The end of each node of the first level, carried through the levels above: case, then court, then everywhere.
    What a level does not know stays what it is."""
    out = endpoints(levels[0], node, target)
    for level in levels[1:]:
        above = endpoints(level, node, target).select(F.col(node).alias("_n"), F.col(target).alias("_t"))
        out = out.join(above, F.col(target) == F.col("_n"), "left").select(node, F.coalesce("_t", target).alias(target))
    return out
