"""What a study of rulings gives out: the cases that count, the report with its judges' totals, and the table for checking by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.courts import circuit
from ..functions.text import is_prisoner, keyed_hash

#: A judge's name that stands for "leave this case out".
VOID = "Void"


def status_text(status: Column) -> Column:
    """``grant on line 4`` of a struct ``line, action``; ``none`` without one."""
    return F.when(status.isNotNull(), F.concat(status["action"], F.lit(" on line "), status["line"].cast("string"))).otherwise("none")


def kept_cases(cases: DataFrame, keep_unclear: bool = False, by_hand: DataFrame | None = None) -> DataFrame:
    """Cases with ``resolution_category`` and ``resolution`` (1 grant, -1 deny, 0 none; null for ``other``).

    ``cases`` has structs ``application`` and ``resolution`` (``line, action``; null: none) and ``judge_name``.  Left out are
    cases with neither, those whose judge is void, and those that end in ``other``: always without an application, and with one
    unless ``keep_unclear``.  ``by_hand`` (``ucid, category``, one row a case) overrules the category, but gives no case that has
    neither an application nor a resolution.
    """
    category = F.coalesce(F.col("resolution.action"), F.lit("no_resolution"))
    if by_hand is not None:
        told = by_hand.groupBy(F.col("ucid").alias("_u")).agg(F.min("category").alias("_hand"))
        cases, category = cases.join(told, F.col("ucid") == F.col("_u"), "left"), F.coalesce(F.col("_hand"), category)
    unclear = (F.col("resolution_category") == "other") & (F.col("application").isNull() if keep_unclear else F.lit(True))
    out = cases.withColumn("resolution_category", category).where((F.col("application").isNotNull() | F.col("resolution").isNotNull()) & ~unclear & ~F.col("judge_name").eqNullSafe(VOID))
    value = F.when(F.col("resolution_category") == "grant", 1).when(F.col("resolution_category") == "deny", -1).when(F.col("resolution_category") == "no_resolution", 0)
    return out.withColumn("resolution", value).drop("_u", "_hand")


def _totals(cases: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """By keys, without null ones: cases, decisions, and grants among all cases."""
    known = cases
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    n, granted = F.count("*"), F.count(F.when(F.col("resolution") == 1, 1))
    return known.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(n.alias(f"{prefix}case_total"), F.count(F.when(F.col("resolution").isin(1, -1), 1)).alias(f"{prefix}decision_total"), (granted / n).alias(f"{prefix}decision_average"))


def living_report(cases: DataFrame, key: str | None = None, plain: tuple = ()) -> DataFrame:
    """``court, case_id, judge_name, resolution, year, case_type, nature_of_suit_prisoner, circuit`` with the judge's totals and those of the year.

    ``cases`` has ``court, case_id, nos_code, judge_name, resolution, filedate`` (month/day/year); cases without a judge have no
    totals.  With ``key``, case ids and judges' names are pseudonyms, but for the names in ``plain``.  Totals are grouped first and
    joined to the cases, so no judge's cases are in one task.
    """
    told = cases.select(
        "court", "case_id", "judge_name", "resolution", F.try_element_at(F.split("filedate", "/"), F.lit(-1)).try_cast("int").alias("year"), F.try_element_at(F.split("case_id", "-"), F.lit(2)).alias("case_type"), "nos_code"
    )
    told = told.withColumn("nature_of_suit_prisoner", is_prisoner(F.col("nos_code").cast("string"), F.col("case_type"))).drop("nos_code").withColumn("circuit", circuit(F.col("court")))
    every, yearly = _totals(told, ["judge_name"], ""), _totals(told, ["judge_name", "year"], "y")
    out = told.join(every, F.col("judge_name") == F.col("_judge_name"), "left").drop("_judge_name")
    out = out.join(yearly, (F.col("judge_name") == F.col("_judge_name")) & (F.col("year") == F.col("_year")), "left").drop("_judge_name", "_year")
    if key is None:
        return out
    hidden = F.when(F.col("judge_name").isin(*plain), F.col("judge_name")).otherwise(keyed_hash(F.col("judge_name"), key)) if plain else keyed_hash(F.col("judge_name"), key)
    return out.withColumns({"case_id": keyed_hash(F.col("case_id"), key), "judge_name": hidden})


def validation_table(cases: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """``ucid, fpath, jpath, app, res``: where a case is to be read, and what was found on which line (``none`` for nothing).

    ``cases`` has ``ucid`` and the structs ``application`` and ``resolution``; every file has a row, in a form fit for CSV.
    """
    found = cases.select(F.col("ucid").alias("_u"), "application", "resolution")
    page = F.concat(F.lit(root.rstrip("/") + "/"), F.replace("fpath", F.lit("json"), F.lit("html")))
    return files.select("ucid", page.alias("fpath")).join(found, F.col("ucid") == F.col("_u"), "left").select(
        "ucid", "fpath", F.replace("fpath", F.lit("html"), F.lit("json")).alias("jpath"), status_text(F.col("application")).alias("app"), status_text(F.col("resolution")).alias("res")
    )
