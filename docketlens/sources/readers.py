"""Readers and writers of docket data.  Paths may be anything Spark opens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(spark: SparkSession, path, encoding: str = "UTF-8") -> DataFrame:
    """Case documents, one JSON object per file."""
    return spark.read.schema(schemas.CASE).option("multiLine", True).option("encoding", encoding).json(path)


def docket_lines(cases: DataFrame) -> DataFrame:
    """One row per docket line, numbered from 0."""
    return cases.select("ucid", "court", F.posexplode_outer("docket").alias("docket_index", "l")).select(
        "ucid", "court", "docket_index", F.try_to_date(F.col("l.date_filed"), "MM/dd/yyyy").alias("date_filed"), "l.ind", "l.docket_text", "l.edges"
    )


def edges(lines: DataFrame) -> DataFrame:
    """Directed links between lines: ``ucid, src, dst``."""
    return lines.select("ucid", F.explode("edges").alias("e")).select("ucid", "e.src", "e.dst")


def entry_entities(spark: SparkSession, path) -> DataFrame:
    """Extracted names of a folder of CSV files, without repeated rows; header files are routed by name."""
    raw = spark.read.schema(schemas.ENTRY_ENTITY).option("header", True).option("multiLine", True).option("escape", '"').option("recursiveFileLookup", True).csv(path)
    return raw.where(~F.col("_metadata.file_name").contains("headers")).dropDuplicates()


def parties(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(schemas.PARTY).option("header", True).option("escape", '"').csv(path)


def entities(spark: SparkSession, path) -> DataFrame:
    """The entity list, a JSON object a line.  The label stands in ``Judge_Label`` or in the column whose name ends with ``_Guess``;
    ids written as decimals lose their fraction."""
    told = spark.read.text(path).select(F.from_json("value", "map<string,string>").alias("m")).where("m IS NOT NULL")
    guess = F.try_element_at(F.map_values(F.map_filter("m", lambda k, v: k.endswith("_Guess"))), F.lit(1))
    pick = lambda c: F.coalesce(F.try_element_at("m", F.lit(c)), guess) if c == "Judge_Label" else F.try_element_at("m", F.lit(c))
    fields = [f.strip().split(" ") for f in schemas.ENTITY.split(",")]
    out = told.select(*[pick(c).cast(kind if kind != "long" else "double").cast(kind).alias(c) for c, kind in fields])
    return out.withColumn("NID", F.regexp_extract("NID", r"^[^.]*", 0))


def mentions(spark: SparkSession, path) -> DataFrame:
    """Mention files below a folder, one a case: JSON lines or one array; indices as integers.  Each file is read once, and
    equal mentions are as many as it holds."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    text = F.ltrim("value")
    each = F.when(text.startswith("["), F.from_json(text, f"array<struct<{schemas.MENTION_FIELDS}>>")).otherwise(
        F.transform(F.filter(F.split("value", "\n"), lambda line: F.trim(line) != ""), lambda line: F.from_json(line, f"struct<{schemas.MENTION_FIELDS}>"))
    )
    rows = files.select(F.explode(each).alias("m")).select("m.*").where("ucid IS NOT NULL")
    return rows.withColumn("docket_index", F.col("docket_index").cast("long"))


def write_mentions(mentions: DataFrame, path: str) -> None:
    """JSON lines by court and two-digit year; inconclusive mentions without keywords are left out."""
    kept = mentions.where(~((F.col("SJID") == "Inconclusive") & (F.col("Prefix_Categories") == "No_Keywords")))
    by = kept.withColumn("yy", F.lpad((F.col("year") % 100).cast("string"), 2, "0"))
    by.repartition("court", "yy").write.partitionBy("court", "yy").mode("errorifexists").json(path)
