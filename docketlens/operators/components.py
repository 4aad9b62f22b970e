"""Connected components of a graph as repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .endpoints import cut


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component``: the smallest node that each node of an edge is linked with; nulls are no nodes.

    Stars are grown in turn among the larger and the smaller neighbours, so the number of rounds grows with the
    logarithm of the graph, not with its longest path.  A node's neighbours are never in one place: only their minimum is.
    """
    pair = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    loops = pair.where("u = v").select("u", "v")
    stars = cut(pair.where("u <> v").distinct())
    size = stars.count()
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        centre = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(centre, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        grown = cut(moved.unionByName(centre.select("u", F.col("m").alias("v"))).distinct())
        n = grown.count()
        same = n == size and grown.join(stars, ["u", "v"], "left_anti").isEmpty()
        stars, size = grown, n
        if same:
            break
    told = stars.unionByName(stars.select(F.col("v").alias("u"), "v")).unionByName(loops)
    return told.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
