"""Known judges as nodes of their courts, and the nodes of one judge reduced to the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.courts import UNALLOCATED, classified
from .ground_truth import appointment_kind, full_name, positions


def clean_truth_name(name: Column) -> Column:
    """A judge's name as published, in the words of the cleaned names: lower case, single spaces."""
    out = F.translate(name, *P.ACCENTS)
    for pattern, put in P.TRUTH_STEPS:
        out = F.regexp_replace(out, pattern, put)
    return F.trim(F.regexp_replace(F.lower(out), r"\s+", " "))


def name_forms(name: Column) -> Column:
    """Cleaned forms, the truest first: ``C[hristian] Roe`` goes by ``c roe`` (the shorter), and is ``christian roe`` too."""
    bracket = r"(?i)^(.*?)(?:(?<=[a-z])|^)\[[a-z]+\](?= [a-z]|$)"
    forms = F.when(name.rlike(bracket), F.array(clean_truth_name(F.regexp_replace(name, bracket, "$1")), clean_truth_name(F.translate(name, "[]", "")))).otherwise(F.array(clean_truth_name(name)))
    return F.transform(F.array_sort(F.transform(forms, lambda f, i: F.struct(F.length(f).alias("n"), i.alias("i"), f.alias("f")))), lambda s: s["f"])


def _placed(people: DataFrame, courts: str) -> DataFrame:
    """A row for each court of each judge; those without a court stand in ``Unallocated``."""
    known = F.when(F.size(F.coalesce(F.col(courts), F.array().cast("array<string>"))) > 0, F.col(courts)).otherwise(F.array(F.lit(UNALLOCATED)))
    return people.withColumn("court", F.explode(known))


def tenured_nodes(appointments: DataFrame) -> DataFrame:
    """``court, name, forms, nid, ba_mag_id, courts`` of ``nid, FullName, court_name`` rows, one for each appointment.

    A judge of several courts has a node in each; appeals and other courts give none.  Rows without ``nid`` or name are left
    out; of a judge's several names the first in order counts."""
    told = classified(appointments.select("nid", "FullName", "court_name").where("nid IS NOT NULL AND FullName IS NOT NULL"), "court_name")
    people = told.groupBy("nid").agg(F.min("FullName").alias("_full"), F.array_sort(F.collect_set("court")).alias("courts")).withColumn("forms", name_forms(F.col("_full")))
    return _placed(people, "courts").select("court", F.col("forms")[0].alias("name"), "forms", F.col("nid").cast("string").alias("nid"), F.lit(None).cast("string").alias("ba_mag_id"), "courts")


def other_nodes(people: DataFrame, held: DataFrame) -> DataFrame:
    """The same of bankruptcy and magistrate judges: ``people`` (``JUDGE_ID, NAME_FIRST`` ...) with a position in ``held``
    (``JUDGE_ID, TITLE, INSTITUTION``) at a federal court that no toss word excludes."""
    courts = classified(positions(held, P.TOSS_COURTS).select("JUDGE_ID", "INSTITUTION"), "INSTITUTION").groupBy("JUDGE_ID").agg(F.array_sort(F.collect_set("court")).alias("courts"))
    name = clean_truth_name(full_name(*[F.col(f"NAME_{p}") for p in ("FIRST", "MIDDLE", "LAST", "SUFFIX")]))
    named = people.select("JUDGE_ID", name.alias("name")).where("name <> ''").distinct()
    none = F.lit(None).cast("string")
    return _placed(named.join(courts, "JUDGE_ID"), "courts").select("court", "name", F.array("name").alias("forms"), none.alias("nid"), F.col("JUDGE_ID").cast("string").alias("ba_mag_id"), "courts")


def kinds(people: DataFrame) -> DataFrame:
    return people.select("JUDGE_ID", appointment_kind(F.col("JUDGE_ID")).alias("kind"))


def allocated(nodes: DataFrame, scopes: DataFrame) -> DataFrame:
    """Nodes, with ``Unallocated`` for courts that no mention is from (``scopes`` has a column ``court``)."""
    seen = scopes.select(F.col("court").alias("_c")).where("_c IS NOT NULL").distinct()
    return nodes.join(seen, F.col("court") == F.col("_c"), "left").withColumn("court", F.coalesce("_c", F.lit(UNALLOCATED))).drop("_c")


def reduced(nodes: DataFrame) -> DataFrame:
    """``node, points_to, courts``: nodes of one known judge end in the first of them, which takes all their courts.

    A node with both ids follows its tenured one.  ``nodes`` has ``node`` (a unique number), ``nid``, ``ba_mag_id`` and ``courts``; nodes without an id stay.
    """
    key = F.when(F.col("nid").isNotNull(), F.concat(F.lit("n"), F.col("nid"))).when(F.col("ba_mag_id").isNotNull(), F.concat(F.lit("b"), F.col("ba_mag_id")))
    keyed = nodes.select("node", key.alias("_k"), "courts")
    every = keyed.where("_k IS NOT NULL").select("_k", "node", F.explode_outer("courts").alias("_c"))
    first = every.groupBy("_k").agg(F.min("node").alias("points_to"), F.array_sort(F.collect_set("_c")).alias("_all"))
    out = keyed.join(first, "_k", "left")
    return out.select("node", F.coalesce("points_to", "node").alias("points_to"), F.when(F.col("points_to") == F.col("node"), F.col("_all")).otherwise(F.col("courts")).alias("courts"))
