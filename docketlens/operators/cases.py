"""Which cases and docket lines the sealing study takes, and its table by court."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import indicators
from .sealed import sealed_item


def select_cases(files: DataFrame, year: int | None = None, court: str | None = None, nos: str | None = None, sample: int | None = None, seed: int = 0, key: str = "ucid") -> DataFrame:
    """Cases of a year, of a court, whose nature of suit begins with ``nos``; of these, if asked for, ``sample`` by chance."""
    out = files if year is None else files.where(F.col("year") == year)
    out = out if court is None else out.where(F.col("court") == court)
    out = out if nos is None else out.where(F.coalesce("nature_suit", F.lit("")).startswith(str(nos)))
    return out if sample is None else out.orderBy(F.xxhash64(F.lit(seed), key)).limit(sample)


def sealing_lines(lines: DataFrame, text: str = "text", filed: str = "filing_date", entered: str = "date_filed") -> DataFrame:
    """Lines not older than their case (a line without a date stays) that speak of sealing in their first
    ``READ`` characters, with ``days_from_filing``, the flags of those characters, and the text cut at ``KEPT``."""
    begin = F.substring(F.coalesce(F.col(text), F.lit("")), 1, P.READ)
    days = lines.withColumn("days_from_filing", F.datediff(F.to_date(entered), F.to_date(filed)))
    some = days.where("coalesce(days_from_filing, 0) >= 0").where(F.lower(begin).rlike("|".join(P.WIDE_NET)))
    return some.select("*", *indicators(begin)).withColumn(text, F.substring(text, 1, P.KEPT))


def with_any_flag(rows: DataFrame, flags: list[str]) -> DataFrame:
    return rows.where(reduce(lambda a, b: a | b, [F.col(f) for f in flags]))


def single_cases(rows: DataFrame, case_type: str = "case_type", nos: str = "nature_suit", multi: str = "is_multi") -> DataFrame:
    """Without cases of several districts; a criminal case's nature of suit is ``criminal``."""
    return rows.where(~F.coalesce(F.col(multi), F.lit(False))).withColumn(nos, F.when(F.col(case_type) == "cr", "criminal").otherwise(F.col(nos)))


def first_phrase_line(lines: DataFrame, case: str, index: str, text: str, phrase: str = "forma pauperis", exclusions: list[str] | None = None, none: int = 9999) -> DataFrame:
    """Of each case the first line with the phrase and without an excluded one (``none`` if there is none), and whether there is one."""
    low = F.lower(F.col(text))
    hit = reduce(lambda a, b: a & b, [~low.contains(x) for x in (P.OUTCOME_EXCLUSIONS if exclusions is None else exclusions)], low.contains(phrase))
    out = lines.groupBy(case).agg(F.coalesce(F.min(F.when(hit, F.col(index))), F.lit(none).cast("long")).alias("first_line"))
    return out.withColumn("is_found", (F.col("first_line") != none).cast("int"))


def case_spans(cases: DataFrame, lines: DataFrame, flagged: DataFrame, key: str, filed: str, ended: str, entered: str, discovery: Column) -> DataFrame:
    """Of each case with lines: its days from filing to its end or latest line, whichever is later, its number of
    lines, and whether it has sealing lines (``flagged``) or one of them about discovery."""
    latest = lines.groupBy(key).agg(F.max(entered).alias("latest_date"), F.count("*").alias("n_lines"))
    told = flagged.groupBy(key).agg(F.bool_or(discovery).alias("discovery")).withColumn("sealed", F.lit(True))
    out = cases.join(latest, key).join(told, key, "left")
    return out.withColumns({
        "days": F.datediff(F.greatest(ended, "latest_date"), F.col(filed)),
        "sealed": F.coalesce("sealed", F.lit(False)),
        "discovery": F.coalesce("discovery", F.lit(False)),
    })


def court_quotients(rows: DataFrame, spans: DataFrame, key: str = "ucid", court: str = "court") -> DataFrame:
    """By court, over closed cases with discovery lines: cases, lines, sealed articles and items, motions, their
    quotients (null without motions), and whether the court has local patent rules."""
    closed = spans.where("status = 'closed' AND discovery").select(key)
    kept = rows.join(closed, key, "left_semi").withColumn("_item", sealed_item())
    out = kept.groupBy(court).agg(
        F.countDistinct(key).alias("case_count"), F.count("*").alias("docket_lines"), F.count_if("sealed_article").alias("sealed_article"),
        F.count_if("seal_motion").alias("seal_motion"), F.count_if("_item").alias("sealed_item"),
    )
    return out.withColumns({
        "articles_motions": F.try_divide(F.col("sealed_article").cast("double"), F.col("seal_motion").cast("double")),
        "items_motions": F.try_divide(F.col("sealed_item").cast("double"), F.col("seal_motion").cast("double")),
        "plr": F.col(court).isin(P.PLR_DISTRICTS),
        "is_txed": F.when(F.col(court) == "txed", "txed").otherwise("other"),
    })


def decided_share(rows: DataFrame, keys: list[str], outcome: str) -> DataFrame:
    """Cases, decisions (1 or -1), and the share of grants among decisions (null without any)."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("total_cases"), F.count_if(F.col(outcome).isin(1, -1)).alias("total_decisions"), F.count_if(F.col(outcome) == 1).alias("_g"))
    return out.withColumn("decision_average", F.try_divide(F.col("_g").cast("double"), F.col("total_decisions").cast("double"))).drop("_g")


def resolution(action: Column) -> Column:
    """grant 1, deny -1, none 0; null for any other."""
    return F.when(action == "grant", 1).when(action == "deny", -1).when(action == "none", 0)
