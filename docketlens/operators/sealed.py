"""Sealing indicators: the matrix, its tidy form, and quotients by court."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions.text import indicators


def matrix(lines: DataFrame, text: str, keep: list[str]) -> DataFrame:
    return lines.select(*keep, F.col(text).alias("text"), *indicators(F.col(text)))


def tidy(flags: DataFrame) -> DataFrame:
    """Partial outcomes into full ones, "is granted" and "is denied", motions without outcomes.

    A motion counts only if no other flag is set; the sealing motion is settled
    first, and its settled value counts against the unsealing one.
    """
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    unseal, mention = low.contains("unseal"), low.rlike(P.UNSEAL)
    one = flags.withColumns({
        "sealed_without_motion": F.col("system_entry") | F.col("parenthesis"),
        "unseal_grant_deny": F.col("part_grant_deny") & unseal,
        "seal_grant_deny": F.col("part_grant_deny") & ~unseal,
    })
    full = {f: F.col(f) | (F.col(f"{f}_p") & ~F.col("part_grant_deny")) for f in ("seal_grant", "seal_deny", "unseal_grant", "unseal_deny")}
    two = one.withColumns(full)
    granted, denied = low.contains("granted"), low.contains("denied")
    three = two.withColumns({
        "unseal_grant": F.col("unseal_grant") | (granted & mention & ~F.col("unseal_grant_deny")),
        "seal_grant": F.col("seal_grant") | (granted & ~mention & ~F.col("seal_grant_deny")),
        "unseal_deny": F.col("unseal_deny") | (denied & mention & ~F.col("unseal_grant_deny") & ~low.contains("if there are sealed")),
        "seal_deny": F.col("seal_deny") | (denied & ~mention & ~F.col("unseal_grant_deny")),
    })
    names = [*P.INDICATORS, "sealed_without_motion", "unseal_grant_deny", "seal_grant_deny"]
    any_but = lambda skip: reduce(lambda a, b: a | b, [F.col(n) for n in names if n != skip])
    four = three.withColumn("seal_motion", F.col("seal_motion") & ~any_but("seal_motion"))
    five = four.withColumn("unseal_motion", F.col("unseal_motion") & ~any_but("unseal_motion"))
    return five.drop("system_entry", "parenthesis", "part_grant_deny", *[n for n in names if n.endswith("_p")])


def sealed_item():
    """A sealed article (whatever else the line is), or restricted without a motion or one of these outcomes of tidy rows."""
    settled = reduce(lambda a, b: a | b, [F.col(c) for c in ("seal_motion", "unseal_motion", "seal_grant", "unseal_grant", "unseal_deny", "seal_grant_deny", "unseal_grant_deny")])
    return F.col("sealed_article") | (F.col("restricted") & ~settled)


def quotients(rows: DataFrame, court: str, case: str, article: str, motion: str) -> DataFrame:
    """By court: cases, lines, articles, motions, and articles per motion (null without motions)."""
    out = rows.groupBy(court).agg(
        F.countDistinct(case).alias("case_count"), F.count("*").alias("docket_lines"),
        F.sum(F.col(article).cast("int")).alias("sealed_article"), F.sum(F.col(motion).cast("int")).alias("seal_motion"),
    )
    return out.withColumn("ratio", F.try_divide(F.col("sealed_article").cast("double"), F.col("seal_motion").cast("double")))


def timeframe(lines: DataFrame, case: str, index: str, flag: str) -> DataFrame:
    """Before, at or after the first flagged line of the case; ``none`` without one."""
    first = F.min(F.when(F.col(flag), F.col(index))).over(Window.partitionBy(case))
    return lines.withColumn("timeframe", F.when(first.isNull(), "none").when(F.col(index) < first, "before").when(F.col(index) == first, "protective").otherwise("after"))
