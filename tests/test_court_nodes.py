"""Courts of institutions, names of known judges, and their nodes."""

import pytest
from pyspark.sql import functions as F

from docketlens.functions.courts import COURTS, classified
from docketlens.operators import court_nodes

INSTITUTIONS = {
    "U.S. District Court for the Northern District of Illinois": "ilnd", "U.S. Bankruptcy Court, Western District of Virginia": "vawd", "u.s. district court for the southern district of west virginia": "wvsd",
    "U.S. District Court for the District of Columbia": "dcd", "U.S. District Court for the District of Massachusetts": "mad", "U.S. District Court for the Northern Mariana Islands": None, "U.S. District Court for the District of the Northern Mariana Islands": "nmid",
    "U.S. District Court for the District of the Virgin Islands": "vid", "U.S. Court of Appeals for the District of Columbia Circuit": None, "Supreme Court of the United States": None, "U.S. District Court for the Northern District of Massachusetts": None,
    "U.S. District Court for the District of Illinois": None, "U.S. District Court for the  Central District of California ": "cacd", "": None, None: None,
}


def test_courts(spark):
    assert len(COURTS) == 94 == len(set(COURTS.values()))
    df = spark.createDataFrame([(k,) for k in INSTITUTIONS], "i string")
    # The islands' court is named without "District of" at times.
    want = INSTITUTIONS | {"U.S. District Court for the Northern Mariana Islands": "nmid"}
    assert {r.i: r.court for r in classified(df, "i").collect()} == want


@pytest.mark.parametrize(
    ("name", "forms"),
    [
        ("C[hristian] John Roe", ["c john roe", "christian john roe"]), ("[Ann] Mary Poe", ["mary poe", "ann mary poe"]), ("J[ohn]", ["j", "john"]), ("José M. O' Brien, Jr.", ["jose m o brien jr"]), ("A.B. Poe- Roe", ["a b poe-roe"]),
        ("Ruth  Lee2", ["ruth lee"]), ("", [""]),
    ],
)
def test_name_forms(spark, name, forms):
    assert spark.createDataFrame([(name,)], "n string").select(court_nodes.name_forms(F.col("n"))).first()[0] == forms


def test_nodes_of_known_judges(spark):
    held = [(1, "A[nn] Roe", "U.S. District Court for the Northern District of Illinois"), (1, "A[nn] Roe", "U.S. District Court for the District of Maine"), (1, "A[nn] Roe", "U.S. Court of Appeals for the First Circuit"),
            (2, "Tom Poe", "U.S. Court of Appeals for the First Circuit"), (None, "x", "y"), (3, None, "z"), (1, "A[nn] Roe", "U.S. District Court for the District of Maine")]
    df = spark.createDataFrame(held, "nid long, FullName string, court_name string").withColumns({c: F.lit(1) for c in ("court", "_key", "courts", "forms")})
    got = court_nodes.tenured_nodes(df)
    assert sorted((r.court, r.name, r.nid, tuple(r.courts)) for r in got.collect()) == [("Unallocated", "tom poe", "2", ()), ("ilnd", "a roe", "1", ("ilnd", "med")), ("med", "a roe", "1", ("ilnd", "med"))]
    people = spark.createDataFrame([("5bnk", "Lu", None, "Fox", "Jr."), ("6mag", "Al", "B.", "Yi", None), ("7mag", "No", None, "Seat", None), ("8mag", None, None, None, None)], "JUDGE_ID string, NAME_FIRST string, NAME_MIDDLE string, NAME_LAST string, NAME_SUFFIX string")
    seats = spark.createDataFrame([("5bnk", "Judge", "U.S. Bankruptcy Court for the District of Maine"), ("5bnk", "Judge", "U.S. Tax Court"), ("6mag", "Magistrate Judge", "U.S. Court of Federal Claims"), ("7mag", "Judge", "U.S. Court of Appeals for the First Circuit"), ("8mag", "Judge", "U.S. District Court for the District of Maine")], "JUDGE_ID string, TITLE string, INSTITUTION string")
    other = court_nodes.other_nodes(people, seats)
    assert sorted((r.court, r.name, r.ba_mag_id) for r in other.collect()) == [("Unallocated", "al b yi", "6mag"), ("med", "lu fox jr", "5bnk")]
    every = court_nodes.allocated(got.unionByName(other), spark.createDataFrame([("med",), ("med",), (None,)], "court string"))
    assert sorted((r.court, r.name) for r in every.collect()) == [("Unallocated", "a roe"), ("Unallocated", "al b yi"), ("Unallocated", "tom poe"), ("med", "a roe"), ("med", "lu fox jr")]
    assert court_nodes.tenured_nodes(df.limit(0)).count() == 0


def test_nodes_of_one_judge_end_in_the_first(spark):
    rows = [(1, "7", None, ["a"]), (2, "7", None, ["b", "a"]), (3, None, "x", None), (4, None, "x", ["c"]), (5, None, None, ["d"]), (6, "7", "x", ["e"])]
    got = court_nodes.reduced(spark.createDataFrame(rows, "node long, nid string, ba_mag_id string, courts array<string>"))
    assert sorted((r.node, r.points_to, r.courts) for r in got.collect()) == [(1, 1, ["a", "b", "e"]), (2, 1, ["b", "a"]), (3, 3, ["c"]), (4, 3, ["c"]), (5, 5, ["d"]), (6, 1, ["e"])]
