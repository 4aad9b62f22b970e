"""Pointers, and the last look at unresolved names, against plain loops."""

import random

from pyspark.sql import functions as F

from docketlens.functions.fuzzy import partial_ratio
from docketlens.functions import fuzzy
from docketlens.operators import crosscheck, endpoints


def test_endpoints_of_chains_circles_and_gaps(spark):
    rnd = random.Random(1)
    pointers = {i: i - 1 if i % 1000 else None for i in range(2500)}  # chains of a thousand
    pointers |= {3000 + i: 3000 + rnd.randrange(i) if i else None for i in range(400)}  # a tree
    pointers |= {4000: 4001, 4001: 4002, 4002: 4000, 4003: 4002, 4004: 4004, 4005: 9999, 4006: 4005}  # a circle and what leads there, itself, no node
    rows = [*pointers.items(), (4007, 1), (4007, 0), (None, 5)]
    df = spark.createDataFrame(rows, "node long, target long").withColumns({c: F.lit(1) for c in ("at", "end", "_n")})

    def end(i):
        seen = set()
        while pointers.get(i) not in (None, i):
            if i in seen:
                return None
            seen.add(i)
            i = pointers[i]
        return i

    want = {i: end(i) for i in pointers} | {4007: 0}
    assert {r.node: r.target for r in endpoints.endpoints(df, "node", "target").collect()} == want
    assert endpoints.endpoints(df.limit(0), "node", "target").count() == 0


def test_chained_levels_fill_with_what_is_known(spark):
    level = lambda *rows: spark.createDataFrame(rows, "node string, target string")
    out = endpoints.chained([level(("a", "b"), ("b", None), ("c", None), ("d", "c")), level(("b", "x"), ("x", None)), level(("x", "y"))], "node", "target")
    assert {r.node: r.target for r in out.collect()} == {"a": "y", "b": "y", "c": "c", "d": "c"}


def plain_crosscheck(rows):
    cases = {}
    for c, raw, final, sjid in set(rows):
        if c is not None and final and sjid is not None:
            cases.setdefault(c, []).append((final, raw, sjid))
    new = {}
    for c, names in cases.items():
        good = [n for n in names if n[2] != "Inconclusive"]
        for final, raw, sjid in names:
            if sjid != "Inconclusive":
                continue
            close = [g for g in good if partial_ratio(final, g[0]) >= 90 or (raw is not None and g[1] is not None and partial_ratio(raw, g[1]) >= 90)]
            if len(close) == 1 and sum(final in g[0] for g in good) == 1:
                new.setdefault((c, final), []).append((close[0][0], close[0][2]))
    return sorted(((c, raw, *(min(new[c, final]) if (c, final) in new else (final, sjid))) for c, raw, final, sjid in rows), key=str)


def test_final_crosscheck_matches_a_plain_loop(spark):
    rnd = random.Random(7)
    parts = ["ruth", "ann", "poe", "roe", "smith", "smyth", "van dyke", "b", "jo", "q"]
    rows = []
    for _ in range(900):
        name = " ".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3)))
        raw = rnd.choice((name, name.title(), name[: rnd.randint(1, len(name))], None))
        rows.append((rnd.choice((*range(90), None)), raw, name if rnd.random() < 0.95 else rnd.choice(("", None)), rnd.choice(("Inconclusive", "SJ1", "SJ2", "SJ3", None) if rnd.random() < 0.9 else ("SJ1",))))
    df = spark.createDataFrame(rows, "case string, raw string, final string, sjid string").withColumns({c: F.lit("?") for c in ("k", "g_f", "n")})
    got = crosscheck.final_crosscheck(df, "case", "raw", "final", "sjid")
    assert got.columns == df.columns
    want = plain_crosscheck([(str(c) if c is not None else None, *rest) for c, *rest in rows])
    assert sum(a != (str(b[0]) if b[0] is not None else None, *b[1:]) for a, b in zip(sorted(want, key=str), sorted(rows, key=str), strict=True)) > 0
    assert sorted((tuple(r) for r in got.select("case", "raw", "final", "sjid").collect()), key=str) == want
    assert crosscheck.final_crosscheck(df.limit(0), "case", "raw", "final", "sjid").count() == 0


def test_crosscheck_measures_names_once_and_large_cases_by_keys(spark, monkeypatch):
    one = [("ruth poe", "SJ1"), ("ann smith", "SJ2"), ("poe", "Inconclusive"), ("smith", "Inconclusive"), ("roe", "Inconclusive")]
    calls = spark.sparkContext.accumulator(0)
    measure = fuzzy.MEASURES["partial_ratio"]

    def counted(a, b):
        calls.add(1)
        return measure(a, b)

    monkeypatch.setitem(fuzzy.MEASURES, "partial_ratio", counted)
    df = spark.createDataFrame([(c, n, n, s) for c in range(40) for n, s in one], "case long, raw string, final string, sjid string")
    want = {(c, *r) for c in range(40) for r in (("ruth poe", "ruth poe", "SJ1"), ("ann smith", "ann smith", "SJ2"), ("poe", "ruth poe", "SJ1"), ("smith", "ann smith", "SJ2"), ("roe", "roe", "Inconclusive"))}
    for few in (crosscheck.FEW, 0):
        monkeypatch.setattr(crosscheck, "FEW", few)
        calls.value = 0
        assert {tuple(r) for r in crosscheck.final_crosscheck(df, "case", "raw", "final", "sjid").collect()} == want
        assert 0 < calls.value <= 8  # two pairs of names, by two forms, whatever the number of cases
