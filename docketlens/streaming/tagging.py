"""Stream of new rows tagged against a frozen table, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tagged_stream(stream: DataFrame, entities: DataFrame, key: str, label: str, default: str = "Inconclusive") -> DataFrame:
    """Stream-static left join: each new row with the label of its key."""
    known = entities.select(F.col(key).alias("_k"), F.col(label).alias("_l"))
    return stream.join(known, F.col(key) == F.col("_k"), "left").withColumn(label, F.coalesce("_l", F.lit(default))).drop("_k", "_l")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and stop; a rerun goes on where it ended."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by tumbling window and key; rows later than ``late`` are dropped by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
