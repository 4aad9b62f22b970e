"""Statuses of a case's lines (what a sentence says about its application), and the judge they are credited to.

A status is ``case, idx, action, s_start, s_end, seq``: ``seq`` is its place in the case, the span lies in its line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions.text import contains_any, sentences
from .dockets import cascade, unique_mode


def status_spans(lines: DataFrame, case: str, index: str, text: str, groups: dict[str, list[str]] | None = None, exclusions: list[str] | None = None) -> DataFrame:
    """A status for every pattern that a sentence holds, sentences with an excluded phrase left out.

    Sentences are searched in lower case with single blanks.  A span is the place in that form, moved by
    where the line first has the sentence, so it is exact unless the sentence has longer gaps.
    """
    parts = lines.select(case, index, F.col(text).alias("_t"), F.posexplode_outer(sentences(F.col(text))).alias("_n", "_s")).where("_s <> ''")
    low = F.trim(F.regexp_replace(F.lower("_s"), r"\s+", " "))
    parts = parts.where(~contains_any(F.col("_s"), exclusions or P.OUTCOME_EXCLUSIONS)).withColumn("_low", low)
    tried = [(action, pattern) for action, group in (groups or P.STATUS_GROUPS).items() for pattern in group]
    # A pattern is searched once a sentence, and only where the sentence has a word that it needs; how long its match is, is asked of matches only.
    # Of an outer explosion Spark infers no filter on the array, which would search everything again, on texts not yet prepared; the array is never empty.
    places = parts.withColumn("_places", F.array(*[_place(F.col("_low"), pattern) for _, pattern in tried]))
    hits = places.select(case, index, "_t", "_s", "_low", "_n", F.posexplode_outer("_places").alias("_k", "_began")).where("_began > 0")
    action = F.element_at(F.array(*[F.lit(action) for action, _ in tried]), F.col("_k") + 1)
    length = F.length(reduce(lambda rest, k: rest.when(F.col("_k") == k, F.regexp_extract("_low", f"({tried[k][1]})", 1)), range(1, len(tried)), F.when(F.col("_k") == 0, F.regexp_extract("_low", f"({tried[0][1]})", 1))))
    start = F.instr("_t", F.col("_s")) - 1 + F.col("_began") - 1
    hits = hits.select(case, index, "_n", "_k", action.alias("action"), start.alias("s_start"), length.alias("_length"))
    seq = F.row_number().over(Window.partitionBy(case).orderBy(index, "_n", "_k"))
    return hits.select(case, index, "action", "s_start", (F.col("s_start") + F.col("_length")).alias("s_end"), seq.alias("seq"))


def _place(low: Column, pattern: str) -> Column:
    """Where a pattern is first found, from 1; 0 if it is not."""
    found = F.regexp_instr(low, F.lit(f"({pattern})"))
    words = P.STATUS_WORDS.get(pattern)
    return F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), found).otherwise(0) if words else found


def best_application(statuses: DataFrame, case: str, index: str, seq: str, kind: str, text: str) -> DataFrame:
    """The best scored application of each case, ties to the earliest: one point for a request's heading, half for
    standing last among the applications, one without an appeal."""
    asked = statuses.where("action = 'application'")
    of_case = Window.partitionBy(case)
    score = (
        F.when(F.col(kind).isin("APPLICATION", "MOTION", "REQUEST", "COMPLAINT"), 1.0).otherwise(0.0)
        + F.when(F.col(index) == F.max(index).over(of_case), 0.5).otherwise(0.0)
        + F.when(~contains_any(F.col(text), P.APPEAL_PHRASES), 1.0).otherwise(0.0)
    )
    scored = asked.withColumn("score", score).where("score > 0")
    return scored.withColumn("_r", F.row_number().over(of_case.orderBy(F.desc("score"), seq))).where("_r = 1").drop("_r")


def answering(statuses: DataFrame, edges: DataFrame, applications: DataFrame, case: str, index: str) -> DataFrame:
    """Of each case the grants and denials whose line points at the application's line; all its statuses, if none does.

    ``edges``: ``case, source, target``; ``applications``: ``case, index``, one row a case.
    """
    aimed = edges.join(applications.select(case, F.col(index).alias("target")), [case, "target"], "left_semi")
    sources = aimed.select(case, F.col("source").alias(index)).distinct().withColumn("_aimed", F.lit(True))
    hit = F.coalesce(F.col("_aimed"), F.lit(False)) & F.col("action").isin("grant", "deny")
    told = statuses.join(sources, [case, index], "left").withColumn("_hit", hit)
    some = F.bool_or("_hit").over(Window.partitionBy(case))
    return told.withColumn("_some", some).where("_hit OR NOT _some").select(*statuses.columns)


def appeal_windows(lines: DataFrame, edges: DataFrame, case: str, index: str, number: str, text: str) -> DataFrame:
    """Half-open windows ``start, end`` opened by each line that begins with an appeal.

    In a case with edges a window ends after the last line that points at its opening (after the case, if none
    does); in others after the last later line that names the opening's number as a notice of appeal or a docket
    number.  Numbers are compared whole, so line and number meet by an equi-join.
    """
    low = F.regexp_replace(F.lower(text), r"\s+", " ")
    begins = lines.where(F.expr(" OR ".join(f"startswith(ltrim(lower(`{text}`)), '{p}')" for p in P.APPEAL_OPENINGS)))
    opened = begins.select(case, F.col(index).alias("start"), F.col(number).cast("string").alias("_no"))
    length = lines.groupBy(case).agg(F.count("*").alias("_lines"))
    pointing = edges.groupBy(case, F.col("target").alias("start")).agg(F.max("source").alias("_last"))
    edged = edges.select(case).distinct().withColumn("_edged", F.lit(True))
    named = F.flatten(F.array(*[F.regexp_extract_all(low, F.lit(p), 1) for p in P.APPEAL_NUMBERS]))
    named = lines.select(case, F.col(index).alias("_i"), F.explode(F.array_distinct(named)).alias("_no"))
    # A line may name several openings, and a number may stand on several lines.
    later = opened.join(named, [case, "_no"]).where("_i > start").groupBy(case, "start").agg(F.max("_i").alias("_named"))
    out = opened.select(case, "start").join(length, case).join(edged, case, "left").join(pointing, [case, "start"], "left").join(later, [case, "start"], "left")
    end = F.when(F.col("_edged"), F.coalesce("_last", "_lines")).otherwise(F.coalesce("_named", "start")) + 1
    return out.select(case, "start", end.cast("long").alias("end")).distinct()


def exact_matches(statuses: DataFrame, mentions: DataFrame, case: str, index: str) -> DataFrame:
    """Statuses with the judge of their own line: its only one, or of several the one whose single mention starts or
    ends in the status's span.  Statuses of one span are one, with the least ``seq``.  Statuses without a judge
    are left out."""
    once = statuses.groupBy(case, index, "s_start", "s_end").agg(F.min("seq").alias("seq"))
    inside = F.expr("start BETWEEN s_start AND s_end OR end BETWEEN s_start AND s_end")
    met = once.join(mentions.select(case, index, "start", "end", "sjid"), [case, index])
    k, n = F.countDistinct("sjid"), F.count_if(inside)
    found = F.when(k == 1, F.max("sjid")).when((k > 1) & (n == 1), F.max(F.when(inside, F.col("sjid"))))
    return met.groupBy(case, index, "s_start", "s_end").agg(found.alias("sjid"), F.min("seq").alias("seq")).where("sjid IS NOT NULL")


def attributed(cases: DataFrame, statuses: DataFrame, mentions: DataFrame, case: str, index: str) -> DataFrame:
    """``case, attributed, method``: the judge credited with a case's resolution, or else with its application.

    ``cases``: ``case``, and of the chosen application and resolution (null: none) line and span as ``app_line,
    app_start, app_end, res_line, res_start, res_end``.  ``mentions``: ``case, index, start, end, sjid, method, seq``,
    headers on line -1.  In turn: the case's only judge; the judge on the line itself; on the nearest other line
    with a status (before it first; without a resolution, after it first); the one most frequent between
    application and resolution, or among all lines with statuses if there is none or it is on line 0; the
    header's assigned, then its referred judge.  A resolution on line 0 without an application there is void.
    Methods beside these steps: ``void`` and ``not_found``.
    """
    header = F.when((F.col(index) == -1) & F.col("method").isin("assigned_judge", "referred_judges"), F.struct((F.col("method") != "assigned_judge").alias("b"), "seq"))
    named = mentions.where("sjid IS NOT NULL")
    whole = named.groupBy(case).agg(F.when(F.countDistinct("sjid") == 1, F.max("sjid")).alias("single"), F.min_by("sjid", header).alias("header"))
    reach = statuses.groupBy(case).agg(F.min(index).alias("_lo"), F.max(index).alias("_hi"), F.bool_or((F.col(index) == 0) & (F.col("action") == "application")).alias("_zero"))
    solved = F.col("res_line").isNotNull()
    aim = cases.join(reach, case, "left").select(
        case, solved.alias("_solved"), *[F.when(solved, F.col(f"res_{c}")).otherwise(F.col(f"app_{c}")).alias(f"_{c}") for c in ("line", "start", "end")],
        F.when(F.col("res_line") != 0, F.col("app_line")).otherwise(F.col("_lo")).alias("_from"), F.when(F.col("res_line") != 0, F.col("res_line")).otherwise(F.col("_hi")).alias("_to"),
        (solved & (F.col("res_line") == 0) & ~F.coalesce("_zero", F.lit(False))).alias("_void"),
    )
    exact = exact_matches(statuses, mentions, case, index).withColumnRenamed(index, "_i").join(aim, case)
    wrong_side = (F.col("_i") < F.col("_line")) != F.col("_solved")
    nearest = F.when(F.col("_i") != F.col("_line"), F.struct(wrong_side.alias("w"), F.abs(F.col("_i") - F.col("_line")).alias("d"), "seq"))
    own = F.max(F.when(F.expr("_i = _line AND s_start = _start AND s_end = _end"), F.col("sjid")))
    near = exact.groupBy(case).agg(own.alias("direct"), F.min_by("sjid", nearest).alias("neighbour"))
    between = named.join(aim.select(case, "_from", "_to"), case).where(F.col(index).between(F.col("_from"), F.col("_to")))
    mode = unique_mode(between, case, "sjid").select(case, F.col("sjid").alias("mode"))
    told = aim.join(whole, case, "left").join(near, case, "left").join(mode, case, "left")
    steps = ["single", "direct", "neighbour", "mode", "header"]
    out = cascade(told, [(s, s) for s in steps])
    void: Column = F.col("_void")
    return out.select(case, F.when(~void, F.col("attributed")).alias("attributed"), F.when(void, "void").otherwise(F.col("method")).alias("method"))
