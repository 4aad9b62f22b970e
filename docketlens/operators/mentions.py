"""Mentions of names before and between the steps of resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P


def eligibility(rows: DataFrame, entity: str, prefix: str | None = None) -> DataFrame:
    """``eligible`` and ``is_exception``.

    An exception has a title inside the name, or follows "judges" and has a
    comma before a word that is no suffix.  Not eligible are names without
    text (unless such an exception), of one character, or of a suffix alone.
    """
    e = F.col(entity)
    suffix = "|".join(P.SUFFIXES)
    listed = F.lit(False)
    if prefix:
        listed = F.coalesce(F.lower(F.col(prefix)).contains("judges") & F.trim(e).rlike(f"(?i),(?! ({suffix})\\.*( |$))"), F.lit(False))
    bad = (e.isNull() & ~listed) | F.coalesce((F.length(e) <= 1) | F.lower(F.trim(e)).isin(P.SUFFIXES), F.lit(False))
    return rows.withColumns({"eligible": ~bad, "is_exception": listed | F.coalesce(e.rlike(P.TITLE_INSIDE), F.lit(False))})


def is_short_consonants(name: Column) -> Column:
    """Fewer than four letters and none of a, e, i, o, u, y: initials rather than a name."""
    return F.coalesce(name.rlike("(?i)^[b-df-hj-np-tv-xz]+$") & (F.length(name) < 4), F.lit(False))


def words_of(name: Column) -> Column:
    return F.array_remove(F.split(F.trim(name), r"\s+"), "")


def free_candidates(nodes: DataFrame, name: str, eligible: str, ambiguous: str) -> DataFrame:
    """Nodes that may match anywhere: eligible, unambiguous, no short consonants, several words, one of them longer than a letter."""
    words = words_of(F.col(name))
    return nodes.where(F.col(eligible) & ~F.col(ambiguous) & ~is_short_consonants(F.col(name)) & (F.size(words) > 1) & (F.array_max(F.transform(words, F.length)) > 1))


def with_words(nodes: DataFrame, name: str) -> DataFrame:
    """``is_single``: one word, once a suffix at the end is left out."""
    words = words_of(F.lower(F.regexp_replace(name, r"\.", "")))
    last = F.coalesce(F.try_element_at(words, F.lit(-1)).isin(P.SUFFIXES), F.lit(False)) & (F.size(words) > 1)
    return nodes.withColumn("is_single", F.size(words) - last.cast("int") == 1)


def court_ignored(rows: DataFrame, entity: str, court: str, case: str, category: str, most: int = 3) -> DataFrame:
    """By entity and court: distinct cases, mentions after a title, and ``ignore``: few cases, one word, never a title."""
    out = rows.groupBy(entity, court).agg(F.countDistinct(case).alias("n_ucids"), F.count_if(F.col(category) != "No_Keywords").alias("titled"))
    return out.withColumn("ignore", (F.col("n_ucids") <= most) & (F.size(words_of(F.col(entity))) == 1) & (F.col("titled") == 0))


def with_header_flag(rows: DataFrame, headers: DataFrame, keys: list[str]) -> DataFrame:
    """``was_header``: the keys stand among the headers, however often."""
    flags = headers.select(*keys).distinct().withColumn("was_header", F.lit(True))
    return rows.join(flags, keys, "left").withColumn("was_header", F.coalesce("was_header", F.lit(False)))


def repointed(rows: DataFrame, remap: DataFrame, keys: list[str], name: str, to: str = "points_to", party: str = "is_party") -> DataFrame:
    """Rows with where they point to (themselves, if nowhere else), without parties."""
    out = rows.join(remap.select(*keys, to, party), keys, "left")
    return out.withColumn(to, F.coalesce(to, name)).where(~F.coalesce(F.col(party), F.lit(False))).drop(party)


def overwritten(rows: DataFrame, found: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows with the columns of ``found`` where it has the keys, null ones included."""
    new = found.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns]).withColumn("_triggered", F.lit(True))
    out = rows.join(new, keys, "left")
    return out.withColumns({c: F.when(F.col("_triggered"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}).select(*rows.columns)


def added_counts(parts: list[DataFrame], key: str, counts: list[str]) -> DataFrame:
    """Counts of several sources added up: what two sources share counts twice."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(*[F.sum(c).alias(c) for c in counts])


def only_overlap(statuses: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Distinct statuses ``key, s_start, s_end`` with the only span ``key, start, end`` of their line that starts or ends
    inside them, bounds included; null where there is none or several.  A span around the status is none."""
    inside = F.expr("start BETWEEN s_start AND s_end OR end BETWEEN s_start AND s_end")
    met = statuses.select(key, "s_start", "s_end").distinct().join(spans, key, "left")
    one = lambda c: F.when(F.count_if(inside) == 1, F.max(F.when(inside, F.col(c)))).alias(c)
    return met.groupBy(key, "s_start", "s_end").agg(one("start"), one("end"))


def case_path(base: str, ucid: Column, court: Column, update: bool = False) -> Column:
    """Where a case's file lies: below its court and its year of two digits, updates in a folder of their own."""
    year = F.substring(F.get(F.split(F.get(F.split(ucid, ";;"), F.lit(1)), ":"), F.lit(1)), 1, 2)
    name = F.regexp_replace(ucid, ";;|:", "-")
    return F.concat(F.lit(base.rstrip("/") + "/"), court, F.lit("/"), year, F.lit("/_updates/" if update else "/"), name, F.lit("_U.jsonl" if update else ".jsonl"))
