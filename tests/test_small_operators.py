"""Operators without a query of their own."""

from pyspark.sql import functions as F

from docketlens.functions import text as T
from docketlens.operators import dockets, ground_truth, relational
from docketlens.streaming import tagging


def test_case_ids_prisoners_and_pseudonyms(spark):
    df = spark.createDataFrame([("16cv123-abc", "530: habeas", "cv"), ("1:16-cr-00012", "830", "cr"), (None, None, None), ("2:09-CV-7", "440", "cv")], "c string, nos string, kind string")
    got = df.select(T.clean_case_id(F.col("c")), T.is_prisoner(F.col("nos"), F.col("kind")), T.keyed_hash(F.col("c"), "k")).collect()
    assert [r[0] for r in got] == ["16-cv-123-abc", "1:16-cr-00012", None, "2:09-cv-7"] and [r[1] for r in got] == [1, 1, 0, 0]
    assert got[2][2] is None and len({r[2] for r in got}) == 4 and got[0][2] != df.select(T.keyed_hash(F.col("c"), "other")).first()[0]


def test_valid_dockets(spark):
    df = spark.createDataFrame([("COMPLAINT", False), ("assigned in error", False), ("EXECUTIVE COMMITTEE ORDER", False), ("COMPLAINT", True), (None, False)], "t string, slip boolean")
    assert [r[0] for r in df.select(dockets.valid_docket(F.col("t"), lambda word: F.col("slip"))).collect()] == [True, False, False, False, True]


def test_dormant_judges_are_split_at_the_bound(spark):
    df = spark.createDataFrame([("a", "1995-01-01"), ("b", "1995-01-02"), ("c", None)], "n string, d string").select("n", F.to_date("d").alias("termination_date"))
    active, ended = ground_truth.dormant(df, "1995-01-01")
    assert sorted(r.n for r in active.collect()) == ["b", "c"] and [r.n for r in ended.collect()] == ["a"]


def test_bankruptcy_and_magistrate_judges(spark):
    people = spark.createDataFrame([("1bnk", "Ann", None, "Poe", None), ("2mag", "ann", "", "poe", None), ("3mag", "Ruth", "B", "Roe", "Jr"), ("4mag", "No", None, "Court", None)], "JUDGE_ID string, NAME_FIRST string, NAME_MIDDLE string, NAME_LAST string, NAME_SUFFIX string")
    held = spark.createDataFrame([("1bnk", "Judge", "U.S. Bankruptcy Court x"), ("2mag", "Magistrate Judge", "U.S. District Court y"), ("3mag", "Judge", "U.S. District Court y"), ("3mag", "Judge", "U.S. Court of Appeals"), ("4mag", "Clerk", "U.S. District Court y")], "JUDGE_ID string, TITLE string, INSTITUTION string")
    got = {r.JUDGE_ID: r for r in ground_truth.bankruptcy_magistrate(people, held).collect()}
    assert set(got) == {"1bnk", "2mag", "3mag"} and got["1bnk"].kind == "Bankruptcy_Judge" and got["3mag"].kind == "Magistrate_Judge"
    assert got["3mag"].courts == ["U.S. Court of Appeals", "U.S. District Court y"] and got["1bnk"].pseudo_id == got["2mag"].pseudo_id == "1bnk/2mag" and got["3mag"].name == "Ruth B Roe Jr"


def test_windows_close_behind_the_watermark(spark, tmp_path):
    rows = [("2020-01-01 01:00:00", "a"), ("2020-01-01 23:00:00", "a"), ("2020-01-01 02:00:00", "b"), ("2020-01-02 00:00:00", "a"), ("2020-01-10 00:00:00", "a")]
    events = spark.createDataFrame(rows, "t string, k string").select(F.to_timestamp("t").alias("t"), "k")
    events.write.parquet(str(tmp_path / "in"))
    counts = tagging.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "t", "k")
    for _ in range(2):  # a rerun finds nothing new
        tagging.run_once(counts, str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.schema(counts.schema).parquet(str(tmp_path / "out")).orderBy("start", "k").collect()
    assert [(str(r.start), r.k, r.n) for r in got] == [("2020-01-01 00:00:00", "a", 2), ("2020-01-01 00:00:00", "b", 1), ("2020-01-02 00:00:00", "a", 1)]


def test_unique_container_of_short_and_long_names(spark):
    names = ["a", "ab", "abc", "xabcx", "zz", "zzq", "", "mno pq", "mno", "no p", "lonely", None, "a"]
    own = {n for n in names if n is not None}
    want = {}
    for n in own:
        longer = [m for m in own if len(m) > len(n) and n in m]
        want[n] = longer[0] if len(longer) == 1 else n
    got = relational.unique_container(spark.createDataFrame([(n,) for n in names], "name string"), "name")
    assert {r.name: r.resolved for r in got.collect()} == want and want["ab"] == "ab" and want["abc"] == "xabcx"
