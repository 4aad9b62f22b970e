"""Ground truth about judges: appointments, positions, and the label that held at a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any
from .dockets import asof
from .relational import unpivot_appointments

APPOINTMENT = ["Court Type", "Court Name", "Appointment Title", "Confirmation Date", "Commission Date", "Termination Date"]


def full_name(*parts: Column) -> Column:
    """The parts that are there, in single spaces."""
    return F.trim(F.regexp_replace(F.concat_ws(" ", *parts), " +", " "))


def any_date(text: Column) -> Column:
    """A date written either way, null for anything else."""
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "MM/dd/yyyy"))


def appointments(wide: DataFrame, today, numbers: int = 6) -> DataFrame:
    """One row per numbered appointment with a court.  No termination yet counts as ``today``; no
    commission date as the first day of the year of termination."""
    keys = [c for c in ("nid", "jid", "FullName") if c in wide.columns]
    names = [c.lower().replace(" ", "_") for c in APPOINTMENT]
    long = unpivot_appointments(wide, keys, {i: [f"`{c} ({i})`" for c in APPOINTMENT] for i in range(1, numbers + 1)}, names).where("court_name IS NOT NULL")
    end = F.coalesce(any_date(F.col("termination_date")), F.lit(today).cast("date"))
    return long.withColumn("termination_date", end).withColumn(
        "commission_date", F.coalesce(any_date(F.col("commission_date")), F.make_date(F.year("termination_date"), F.lit(1), F.lit(1)))
    )


def judges(appointments: DataFrame, courts: DataFrame) -> DataFrame:
    """By judge: first commission, last termination and known courts (``court_name, court`` maps names)."""
    known = appointments.join(courts, "court_name", "left")
    return known.groupBy("nid", "FullName").agg(F.min("commission_date").alias("commission_date"), F.max("termination_date").alias("termination_date"), F.array_sort(F.collect_set("court")).alias("courts"))


def dormant(judges: DataFrame, bound) -> tuple[DataFrame, DataFrame]:
    """Judges active after the bound, and those whose service ended by then."""
    ended = F.coalesce(F.col("termination_date") <= F.lit(bound).cast("date"), F.lit(False))
    return judges.where(~ended), judges.where(ended)


def positions(table: DataFrame, toss: list[str] | None = None) -> DataFrame:
    """Positions of judges at federal courts; ``toss`` lists words of institutions to leave out."""
    title, place = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("TITLE", "INSTITUTION"))
    return table.where(title.contains("judge") & place.contains("court") & place.startswith("u.s.")).where(~contains_any(place, toss) if toss else F.lit(True))


def appointment_kind(id_: Column) -> Column:
    return F.when(id_.contains("bnk"), "Bankruptcy_Judge").when(id_.contains("mag"), "Magistrate_Judge")


def bankruptcy_magistrate(people: DataFrame, held: DataFrame) -> DataFrame:
    """People with a federal position: name, kind, courts, and the ids that share the name."""
    courts = positions(held).groupBy("JUDGE_ID").agg(F.array_sort(F.collect_set("INSTITUTION")).alias("courts"))
    named = people.withColumn("name", full_name(*[F.col(f"NAME_{p}") for p in ("FIRST", "MIDDLE", "LAST", "SUFFIX")])).withColumn("kind", appointment_kind(F.col("JUDGE_ID")))
    shared = named.groupBy(F.lower("name").alias("_n")).agg(F.concat_ws("/", F.array_sort(F.collect_list("JUDGE_ID"))).alias("pseudo_id"))
    return named.join(shared, F.lower("name") == F.col("_n")).join(courts, "JUDGE_ID").select("JUDGE_ID", "name", "kind", "courts", "pseudo_id")


def category(source: Column, court_type: Column, label: Column) -> Column:
    """The simple label of an appointment at its time; without one, the entity's own label."""
    kind = F.lower(court_type)
    return (
        F.when((source == "Article III") & kind.contains("district court"), "District Judge")
        .when((source == "Article III") & kind.contains("appeals"), "Appellate Judge")
        .when((source == "Article III") & kind.contains("supreme court"), "Supreme Court Justice")
        .when((source == "Article III") & kind.contains("other"), "Article III Judge")
        .when((source == "Bankruptcy-Magistrate") & kind.contains("district court"), "Magistrate Judge")
        .when((source == "Bankruptcy-Magistrate") & kind.contains("bankruptcy"), "Bankruptcy Judge")
        .otherwise(F.regexp_replace(label, "_", " "))
    )


def back_annotate(mentions: DataFrame, held: DataFrame, entities: DataFrame) -> DataFrame:
    """Mentions with the label that held at their date: ``held`` is ``sjid, start, source, court_type``,
    ``entities`` is ``sjid, label``."""
    marked = held.withColumn("_h", F.struct("source", "court_type"))
    told = asof(mentions, marked.select("sjid", F.col("start").alias("date"), "_h"), "sjid", "date", "_h")
    own = entities.select(F.col("sjid").alias("_s"), F.col("label").alias("_label"))
    return told.join(own, F.col("sjid") == F.col("_s"), "left").withColumn("label_at_date", category(F.col("_h.source"), F.col("_h.court_type"), F.col("_label"))).drop("_s", "_label", "_h")
