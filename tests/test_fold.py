"""The fold by components against one loop over a whole scope, and the rules of a case run in it."""

import random

from docketlens.functions import fuzzy
from docketlens.operators import anchors, resolve

PARTS = "ann ruth r poe poes roe smith smyth smithe vandyke".split()


def plain_fold(nodes, edges):
    out = {}
    for scope in {s for s, _, _, _ in nodes}:
        mine = {o: (n, w) for s, n, w, o in nodes if s == scope}
        to = {o: o for o in mine}
        for _, _, a, b in sorted(e for e in edges if e[0] == scope):
            if to[a] == a and to[b] == b:
                def better(o):
                    n, w = mine[o]
                    return len(n.split()) > 1, w, len(n.split()), len(n), -o
                win, lose = sorted((a, b), key=better, reverse=True)
                to[lose] = win
        for o in mine:
            end = o
            while to[end] != end:
                end = to[end]
            out[scope, mine[o][0]] = mine[end][0]
    return out


def test_fold_is_one_loop(spark):
    rnd = random.Random(4)
    rows = [(rnd.randrange(3), " ".join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 3))), i) for i in range(240)]
    nodes = resolve.ordered(spark.createDataFrame([(c, n, sum((c, n) == r[:2] for r in rows)) for c, n in sorted({r[:2] for r in rows})], "court long, name string, weight long"), "court", "name").select("court", "name", "weight", "ord")
    held = [tuple(r) for r in nodes.collect()]
    by = {}
    for s, _, _, o in held:
        by.setdefault(s, []).append(o)
    edges = [(s, rnd.randint(1, 4), *sorted(rnd.sample(by[s], 2))) for s in (rnd.choice(list(by)) for _ in range(90))]
    got = resolve.fold(nodes, spark.createDataFrame(edges, "court long, rule int, a_ord int, b_ord int"), "court", "name", "weight").collect()
    assert {(r.court, r.name): r.points_to for r in got} == plain_fold(held, edges) and len(got) == len(held)
    none = resolve.fold(nodes, spark.createDataFrame([], "court long, rule int, a_ord int, b_ord int"), "court", "name", "weight").collect()
    assert len(none) == len(held) and all(r.name == r.points_to for r in none)


def test_rules_of_a_case(spark):
    rows = [("c1", "ruth ann poe", "u1", False), ("c1", "ruth ann poe", "u2", False), ("c1", "poe", "u1", True), ("c1", "o brien", "u1", False), ("c1", "mary obrien", "u3", False), ("c1", "jude fox", "u1", False), ("c1", "tom fox", "u4", False),
            ("c2", "poe", "u5", False), (None, "poe", "u5", False), ("c2", None, "u5", False)]
    df = spark.createDataFrame(rows, "court string, name string, ucid string, head boolean")
    got = {(r.court, r.name): r.points_to for r in anchors.resolve_case(df, "court", "name", "ucid", header="head").collect()}
    assert got["c1", "poe"] == "ruth ann poe" and got["c2", "poe"] == "poe" and len(got) == 7
    assert got["c1", "o brien"] == got["c1", "mary obrien"] and got["c1", "jude fox"] == got["c1", "tom fox"]
    assert anchors.resolve_case(df.limit(0), "court", "name", "ucid").count() == 0


def test_names_are_compared_once_however_many_scopes_share_them(spark, monkeypatch):
    names = ["ruth ann poe", "ruth poe", "poes", "r poe", "mary obrien", "o brien", "ruth a poe", "brien"]
    calls = spark.sparkContext.accumulator(0)
    for measure, f in list(fuzzy.MEASURES.items()):

        def counted(a, b, f=f):
            calls.add(1)
            return f(a, b)

        monkeypatch.setitem(fuzzy.MEASURES, measure, counted)
    asked = {}
    for scopes in (1, 6):
        df = spark.createDataFrame([(c, n, f"{c}{i}") for c in range(scopes) for i, n in enumerate(names)], "court long, name string, ucid string")
        told = [anchors.resolve_case(df, "court", "name", "ucid"), resolve.resolve(df, "court", "name", "ucid", rules="all"), resolve.resolve(df, "court", "name", "ucid", 85)]
        ends = [{(r.court, r.name): r.points_to for r in x.collect()} for x in told]
        assert all(x[c, n] == x[0, n] for x in ends for c in range(scopes) for n in names) and ends[0][0, "r poe"] != "r poe"
        asked[scopes] = calls.value
        calls.value = 0
    assert asked[1] == asked[6] > 0
