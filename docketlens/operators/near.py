"""Pairs of texts of a given likeness by a join on their rarest stretches."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import similarity


def _width(least: int) -> int:
    return 3 if least >= 93 else 2


def _shared(total: int, r: float, q: int) -> int:
    """Stretches of ``q`` characters that two texts of ``total`` characters in all have in common at the least."""
    return ceil(r * total / 2 - 1e-9) - (q - 1) * (floor((1 - r) * total + 1e-9) + 1)


def near_pairs(rows: DataFrame, text: str, least: int, within: tuple = ()) -> DataFrame:
    """``within, a, b`` (a before b): different texts of a ratio of ``least`` (rounded; 81 or more), equal in ``within``.

    At ratio r, two texts of T characters match in at least r T / 2 of them, in at most (1 - r) T + 1 pieces, so they
    share a number of stretches that grows with T (equal ones counted as often as they stand).  A text therefore looks
    for partners by its rarest stretches only, as many as leave less than that number: a common stretch is no meeting
    place unless all of a text's are common.
    """
    q, r = _width(least), (least - 0.5) / 100
    # Texts shorter than a stretch have no different partner; of the others every pair must share one.
    if least > 100 or any(_shared(t, r, q) < 1 for t in range(2 * q, 400)):
        raise ValueError("near_pairs is proven for ratios from 81 to 100")
    n = F.length(text)
    each = rows.select(*within, text).where(F.length(text) >= q).distinct()
    grams = F.transform(F.sequence(F.lit(1), n - q + 1), lambda i: F.substring(F.col(text), i, F.lit(q)))
    numbered = F.transform(F.col("_g"), lambda g, i: F.concat(g, F.size(F.filter(F.slice(F.col("_g"), F.lit(1), i + 1), lambda h: h == g)).cast("string")))
    low, high = F.ceil(n * (r / (2 - r)) - 1e-9), F.floor(n * ((2 - r) / r) + 1e-9)
    held = lambda m: F.ceil((n + m) * (r / 2) - 1e-9) - (q - 1) * (F.floor((n + m) * (1 - r) + 1e-9) + 1)
    keep = (n - q + 2 - F.array_min(F.transform(F.sequence(low, high), held))).cast("int")
    spread = each.withColumn("_keep", keep).withColumn("_g", grams).withColumn("_g", F.explode(numbered))
    often = spread.groupBy("_g").agg(F.count("*").alias("_n"))
    rare = spread.join(often, "_g").groupBy(*within, text).agg(F.slice(F.array_sort(F.collect_list(F.struct("_n", "_g"))), 1, F.max("_keep")).alias("_r"))
    keyed = rare.select(*within, F.col(text).alias("_t"), F.explode("_r._g").alias("_g"))
    a, b = keyed.withColumnRenamed("_t", "a"), keyed.withColumnRenamed("_t", "b")
    met = a.join(b, [*within, "_g"]).where("a < b")
    met = met.where(200 * F.least(F.length("a"), F.length("b")) >= (least - 0.5) * (F.length("a") + F.length("b"))).select(*within, "a", "b").distinct()
    return met.where(similarity("ratio", F.col("a"), F.col("b")) >= least)


def near_names(names: DataFrame, name: str, text: str, least: int, within: tuple = ()) -> DataFrame:
    """``a, b``, both ways round: different names whose ``text`` is equal or near."""
    rows = names.select(*within, text, name).where(F.col(text).isNotNull()).distinct()
    near = near_pairs(rows, text, least, within)
    same = rows.select(*within, F.col(text).alias("a"), F.col(text).alias("b")).distinct()
    texts = near.unionByName(near.select(*within, F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(same)
    x, y = (rows.select(*within, F.col(text).alias(t), F.col(name).alias(n)) for t, n in (("a", "_x"), ("b", "_y")))
    return texts.join(x, [*within, "a"]).join(y, [*within, "b"]).where("_x <> _y").select(F.col("_x").alias("a"), F.col("_y").alias("b")).distinct()
