"""Which cases count, and the circuits of courts."""

from pyspark.sql import functions as F

from docketlens.functions.courts import COURTS, circuit
from docketlens.operators import report


def test_every_court_has_its_circuit(spark):
    rows = spark.createDataFrame([(c,) for c in [*COURTS.values(), "zzz", None]], "court string").select("court", circuit(F.col("court")).alias("c")).collect()
    got = {r.court: r.c for r in rows}
    assert got["zzz"] is None and got[None] is None and sum(v is not None for v in got.values()) == 94
    assert [got[c] for c in ("ilnd", "vawd", "wvsd", "nmid", "dcd", "med")] == ["7", "4", "4", "9", "DC", "1"]


def test_cases_that_count(spark):
    app, res = (1, "application"), lambda a: (2, a)
    rows = [("grant", app, res("grant"), "J"), ("open", app, None, "J"), ("other", app, res("other"), "J"), ("lone other", None, res("other"), "J"), ("nothing", None, None, "J"), ("void", app, res("grant"), "Void"), ("no judge", None, res("deny"), None), ("hand", app, res("other"), "J")]
    df = spark.createDataFrame(rows, "ucid string, application struct<line:long,action:string>, resolution struct<line:long,action:string>, judge_name string")
    hand = spark.createDataFrame([("hand", "deny"), ("hand", "grant"), ("nothing", "grant"), (None, "grant")], "ucid string, category string")
    value = lambda d: {r.ucid: r.resolution for r in d.collect()}
    assert value(report.kept_cases(df)) == {"grant": 1, "open": 0, "no judge": -1}
    assert value(report.kept_cases(df, keep_unclear=True, by_hand=hand)) == {"grant": 1, "open": 0, "other": None, "no judge": -1, "hand": -1}
    assert report.kept_cases(df.limit(0)).count() == 0
