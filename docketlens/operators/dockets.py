"""Case-level operators over docket lines: order-dependent choices as windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions.text import contains_any


def phrase_gate(lines: DataFrame, case: str, text: str, basic: list[str] | None = None, every: list[str] | None = None) -> DataFrame:
    """Lines with any phrase, of cases that have a line with a basic phrase."""
    basic, every = basic or P.BASIC_PHRASES, every or P.ALL_PHRASES
    admitted = lines.where(contains_any(F.col(text), basic)).select(case).distinct()
    return lines.where(contains_any(F.col(text), every)).join(admitted, case, "left_semi")


def valid_docket(first_text, any_line):
    """A docket that records no mistake: ``any_line(word)`` says whether any line has it."""
    ok = ~F.coalesce(first_text.contains("EXECUTIVE COMMITTEE ORDER") | first_text.contains("in error") | first_text.contains("shall not be used for any other proceeding"), F.lit(False))
    return ok & ~any_line("clerical error")


def wrong_assignment(lines: DataFrame, case: str, text: str) -> DataFrame:
    """Cases with ``wrong``: a line says that the case was assigned or entered by mistake."""
    t = F.coalesce(F.col(text), F.lit(""))
    hit = (t.contains("assigned") & t.contains("in error")) | t.contains("clerical error") | t.contains("shall not be used for any other proceeding")
    return lines.groupBy(case).agg(F.bool_or(hit).alias("wrong"))


def between_lines(lines: DataFrame, case: str, index: str, opens, closes) -> DataFrame:
    """Of each case the lines from its first one that ``opens`` to the first after it that ``closes``; cases without either have none."""
    of_case = Window.partitionBy(case)
    opened = lines.withColumn("_first", F.min(F.when(opens, F.col(index))).over(of_case))
    closed = opened.withColumn("_last", F.min(F.when(closes & (F.col(index) > F.col("_first")), F.col(index))).over(of_case))
    return closed.where(F.col(index).between(F.col("_first"), F.col("_last"))).drop("_first", "_last")


def outcome_priority(lines: DataFrame, case: str, index: str, outcome: str, order: list[int] | None = None) -> DataFrame:
    """Of each case the first line of its best outcome; without one, its first line with outcome 0."""
    order = order or P.OUTCOME_PRIORITY
    rank = F.lit(len(order))
    for i, value in enumerate(order):
        rank = F.when(F.col(outcome) == value, i).otherwise(rank)
    best = lines.groupBy(case).agg(F.min_by(F.struct(index, outcome), F.struct(rank, F.col(index))).alias("b"))
    return best.select(case, f"b.{index}", F.when(F.col(f"b.{outcome}").isin(order), F.col(f"b.{outcome}")).otherwise(0).alias("resolution"))


def status_argmax(statuses: DataFrame, case: str, index: str, seq: str, action: str, kind: str, text: str) -> DataFrame:
    """The best scored resolution of each case; ties go to the earliest.

    One point for an order's heading, half for standing last, one if the line
    has a single kind of resolution, one without an appeal, 1.5 for a grant or
    one for a denial.
    """
    ends = statuses.where(F.col(action) != "application")
    whole, line = Window.partitionBy(case), Window.partitionBy(case, index)
    score = (
        F.when(F.col(kind).isin("ORDER", "DECISION", "OPINION"), 1.0).otherwise(0.0)
        + F.when(F.col(index) == F.max(index).over(whole), 0.5).otherwise(0.0)
        + F.when(F.size(F.collect_set(action).over(line)) == 1, 1.0).otherwise(0.0)
        + F.when(~contains_any(F.col(text), P.APPEAL_PHRASES), 1.0).otherwise(0.0)
        + F.when(F.col(action) == "grant", 1.5).when(F.col(action) == "deny", 1.0).otherwise(0.0)
    )
    first = whole.orderBy(F.desc("score"), seq)
    return ends.withColumn("score", score).withColumn("_r", F.row_number().over(first)).where("_r = 1 AND score > 0").drop("_r")


def outside_windows(statuses: DataFrame, windows: DataFrame, case: str, index: str, start: str = "start", end: str = "end") -> DataFrame:
    """Statuses in none of their case's half-open windows."""
    w = windows.select(F.col(case).alias("_case"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    return statuses.join(w, (F.col(case) == F.col("_case")) & (F.col("_s") <= F.col(index)) & (F.col(index) < F.col("_e")), "left_anti")


def transfer_blocks(lines: DataFrame, case: str, index: str, is_transfer) -> DataFrame:
    """Lines with the number of their block; a transfer line ends its block and opens the next, so it is in both."""
    before = Window.partitionBy(case).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    flagged = lines.withColumn("_t", F.coalesce(is_transfer, F.lit(False)))
    own = F.coalesce(F.sum(F.col("_t").cast("int")).over(before), F.lit(0))
    blocks = F.when(F.col("_t"), F.array(own, own + 1)).otherwise(F.array(own))
    return flagged.withColumn("_b", blocks).select(*lines.columns, F.explode("_b").alias("block"))


def first_seen_mode(rows: DataFrame, case: str, value: str, index: str) -> DataFrame:
    """Each case's most frequent value; ties go to the one seen first."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(case, value).agg(F.count("*").alias("n"), F.min(index).alias("first"))
    best = counts.groupBy(case).agg(F.max_by(F.struct(value, "n"), F.struct("n", (-F.col("first")).alias("f"))).alias("b"))
    return best.select(case, f"b.{value}", "b.n")


def unique_mode(rows: DataFrame, case: str, value: str) -> DataFrame:
    """Each case's most frequent value if only one is, else null."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(case, value).agg(F.count("*").alias("n"))
    most = Window.partitionBy(case)
    top = counts.withColumn("_m", F.max("n").over(most)).where("n = _m")
    return top.groupBy(case).agg(F.when(F.count("*") == 1, F.min(value)).alias(value), F.max("n").alias("n"))


def nearest_line(anchors: DataFrame, lines: DataFrame, case: str, index: str, value: str, preceding_first: bool = True) -> DataFrame:
    """For each anchor the nearest line of its case that has the value: preceding lines before
    succeeding ones (or the reverse), the nearer first.  One pass over the case in order."""
    both = anchors.select(case, F.col(index).alias("_i"), F.lit(None).cast(lines.schema[value].dataType).alias("_v"), F.lit(True).alias("_a")).unionByName(
        lines.where(F.col(value).isNotNull()).select(case, F.col(index).alias("_i"), F.col(value).alias("_v"), F.lit(False).alias("_a"))
    )
    order = Window.partitionBy(case).orderBy("_i")
    hit = F.when(F.col("_v").isNotNull(), F.struct("_i", "_v"))
    back = F.last(hit, ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, -1))
    ahead = F.first(hit, ignorenulls=True).over(order.rangeBetween(1, Window.unboundedFollowing))
    pick = F.coalesce(back, ahead) if preceding_first else F.coalesce(ahead, back)
    return both.withColumn("_p", pick).where("_a").select(case, F.col("_i").alias(index), F.col("_p._i").alias("found_at"), F.col("_p._v").alias(value))


def cascade(cases: DataFrame, candidates: list[tuple[str, str]]) -> DataFrame:
    """The first non-null of the candidate columns and the name of its method, else ``not_found``."""
    method = F.lit("not_found")
    for name, column in reversed(candidates):
        method = F.when(F.col(column).isNotNull(), name).otherwise(method)
    return cases.withColumn("attributed", F.coalesce(*[F.col(c) for _, c in candidates])).withColumn("method", method)


def asof(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Rows of ``left`` with the latest ``value`` of ``right`` at or before their time.

    Both sides meet in one sort by key and time; no row is paired with every
    earlier one.  Of several right rows at one time, the greatest value counts.
    """
    kind = right.schema[value].dataType
    tagged = left.select(F.struct(*left.columns).alias("_l"), F.col(key).alias("_k"), F.col(time).alias("_t"), F.lit(None).cast(kind).alias("_v"), F.lit(1).alias("_s")).unionByName(
        right.where(F.col(time).isNotNull()).select(F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"), F.col(key).alias("_k"), F.col(time).alias("_t"), F.col(value).alias("_v"), F.lit(0).alias("_s"))
    )
    order = Window.partitionBy("_k").orderBy("_t", "_s", "_v").rowsBetween(Window.unboundedPreceding, 0)
    return tagged.withColumn("_w", F.last("_v", ignorenulls=True).over(order)).where("_s = 1").select("_l.*", F.col("_w").alias(value))


def durations(cases: DataFrame, lines: DataFrame, case: str, start: str, end: str, line_date: str) -> DataFrame:
    """Days from the start to the later of the end and the last line."""
    last = lines.groupBy(case).agg(F.max(line_date).alias("_last"))
    return cases.join(last, case, "left").select(case, F.datediff(F.greatest(F.col(end), F.col("_last")), F.col(start)).alias("days"))
