"""Units with hand-derived expectations."""

import random

import pytest
from pyspark.sql import functions as F

from docketlens.functions import fuzzy, student
from docketlens.functions import text as T
from docketlens.operators import dockets, ground_truth, relational, resolve, sealed, statistics


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_t_quantile():
    assert student.t_quantile(0.975, 10) == pytest.approx(2.2281388519862744, abs=1e-9)
    assert student.t_quantile(0.025, 1) == pytest.approx(-12.706204736174694, abs=1e-8)


def test_fuzzy():
    assert fuzzy.ratio("smith", "smith") == 100 and fuzzy.partial_ratio("smith", "john smith") == 100
    assert fuzzy.token_sort_ratio("smith john", "john smith") == 100 and fuzzy.token_set_ratio("john", "john smith") == 100
    assert fuzzy.ratio("karen j williams", "karen m williams") < 95


def test_outcome_and_null(spark):
    df = spark.createDataFrame([("order granting motion to proceed in forma pauperis",), ("ORDER denying ifp; den the ifp",), ("order of service",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(T.outcome(F.col("t"))).collect()] == [1, -1, 0, None, 0]


def test_presentable(spark):
    df = spark.createDataFrame([("john mcDonald iii",)], "n string")
    assert df.select(T.presentable(F.col("n"))).first()[0] == "John McDonald III"


def test_transfer_blocks_share_the_boundary(spark):
    df = spark.createDataFrame([("c", 0, False), ("c", 1, True), ("c", 2, False)], "k string, i int, t boolean")
    assert rows(dockets.transfer_blocks(df, "k", "i", F.col("t")).select("i", "block")) == [(0, 0), (1, 0), (1, 1), (2, 1)]


def test_first_seen_mode_ties(spark):
    df = spark.createDataFrame([("c", "b", 1), ("c", "a", 2), ("c", "a", 3), ("c", "b", 4), ("d", None, 1)], "k string, v string, i int")
    assert rows(dockets.first_seen_mode(df, "k", "v", "i")) == [("c", "b", 2)]


def test_asof_matches_brute_force(spark):
    rnd = random.Random(1)
    left = [(i, rnd.randint(0, 3), rnd.randint(0, 30)) for i in range(60)]
    right = [(rnd.randint(0, 3), rnd.randint(0, 30), rnd.randint(0, 9)) for _ in range(40)]
    got = rows(dockets.asof(spark.createDataFrame(left, "id int, k int, t int"), spark.createDataFrame(right, "k int, t int, v int"), "k", "t", "v").select("id", "v"))
    want = []
    for i, k, t in left:
        before = [(rt, v) for rk, rt, v in right if rk == k and rt <= t]
        want.append((i, max(before)[1] if before else None))
    assert got == sorted(want)


def test_tidy_settles_the_sealing_motion_first(spark):
    df = spark.createDataFrame([(1, "Motion to seal"), (2, "motion to unseal"), (3, "Order granting motion to seal"), (4, None)], "i int, t string")
    out = {r["i"]: r.asDict() for r in sealed.tidy(sealed.matrix(df, "t", ["i"])).collect()}
    assert out[1]["seal_motion"] and not out[3]["seal_motion"] and out[3]["seal_grant"]
    assert not out[2]["seal_motion"] and not any(v for k, v in out[4].items() if isinstance(v, bool))


def test_upsert_null_safe_and_no_new_keys(spark):
    old = spark.createDataFrame([(1, None, "x"), (2, "b", "y")], "a int, b string, v string")
    new = spark.createDataFrame([(1, None, "z"), (3, "c", "w")], "a int, b string, v string")
    assert rows(relational.upsert(old, new, ["a", "b"], ["v"]).select("a", "v")) == [(1, "z"), (2, "y")]


def test_token_subset(spark):
    df = spark.createDataFrame([("k j williams", "karen jane williams"), ("karen m williams", "karen j williams"), ("smith", "john smith"), ("smith john", "john smith"), ("john", "john smith"), ("john smith jr", "smith"), ("j s", "john smith"), ("smith", "smith")], "a string, b string")
    assert [r[0] for r in df.select(resolve.token_subset(F.col("a"), F.col("b"))).collect()] == [True, False, True, False, False, True, True, True]


def test_resolution_merges_once_and_is_idempotent(spark):
    m = spark.createDataFrame([("c", "john q smith", "1"), ("c", "john q smith", "2"), ("c", "john q smiths", "3"), ("c", "j q smith", "4"), ("c", "mary jones", "5"), ("d", "john q smith", "6")], "court string, name string, ucid string")
    one = resolve.resolve(m, "court", "name", "ucid")
    found = {(r.court, r.name): r.points_to for r in one.collect()}
    assert found[("c", "john q smiths")] == "john q smith" and found[("c", "mary jones")] == "mary jones"
    assert all(found[(c, p)] == p for (c, _), p in found.items())


def test_blocked_pairs_lose_no_close_pair(spark):
    rnd = random.Random(5)
    names = sorted({"".join(rnd.choice("abcde ") for _ in range(rnd.randint(6, 12))).strip() for _ in range(150)} | {"ab cd", "ab dc", "abdexfg", "abcdefg", "john smith", "jon smith", "john smyth"})
    nodes = resolve.ordered(spark.createDataFrame([("s", n) for n in names], "scope string, name string"), "scope", "name")
    for least in (75, 80, 85, 93):
        pairs = {frozenset((r.a, r.b)) for r in resolve.blocked_pairs(nodes, "scope", "name", least=least).collect()}
        close = {frozenset((a, b)) for a in names for b in names if a < b and fuzzy.ratio(a, b) >= least}
        assert close and close <= pairs


def test_percentile_rank_ties(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.1)], "j int, r double")
    assert rows(statistics.percentile_rank(df, "r", "j").select("j", "place")) == [(1, 2), (2, 3), (3, 1)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "judge int, court string, g int")
    assert statistics.leave_one_out(none, "judge", "court", "g").count() == 0


def pair(spark, a, b):
    return spark.createDataFrame([("s", 1, a, 2, b)], "scope string, a_ord int, a string, b_ord int, b string")


def test_rules(spark):
    hits = lambda rule, a, b: rule(pair(spark, a, b), "scope").count() == 1
    assert hits(resolve.initialism_edges, "karen m k", "karen mary kline") and not hits(resolve.initialism_edges, "karen m k", "karen jane kline")
    assert hits(resolve.single_word_edges, "smith", "smiths") and not hits(resolve.single_word_edges, "smith", "jones")
    assert hits(resolve.first_last_edges, "jon smith", "john smith") and not hits(resolve.first_last_edges, "karen j williams", "karen m williams")
    assert hits(resolve.token_sort_edges, "lewis wilma a", "wilma a lewis") and not hits(resolve.token_sort_edges, "lewis a", "a lewis")
    assert hits(resolve.fused_edges, "john van dyke", "john vandyke")


def test_appointments_fill_dates(spark):
    cols = [f"{c} ({i})" for i in (1, 2) for c in ground_truth.APPOINTMENT]
    schema = "nid string, FullName string, " + ", ".join(f"`{c}` string" for c in cols)
    df = spark.createDataFrame([("1", "A B", "t", "court x", "judge", None, "01/02/1990", "1999-05-06", "t", "court y", "judge", None, None, None)], schema)
    out = ground_truth.appointments(df, "2020-07-01", numbers=2).orderBy("number").collect()
    assert [(str(r.commission_date), str(r.termination_date)) for r in out] == [("1990-01-02", "1999-05-06"), ("2020-01-01", "2020-07-01")]


def test_positions(spark):
    df = spark.createDataFrame([("1bnk", "Judge", "U.S. Bankruptcy Court"), ("2", "Clerk", "U.S. District Court"), ("3", "Judge", "U.S. Court of Appeals"), ("4", None, None), ("5", "Judge", "Supreme Court of Ohio")], "JUDGE_ID string, TITLE string, INSTITUTION string")
    assert sorted(r.JUDGE_ID for r in ground_truth.positions(df).collect()) == ["1bnk", "3"]


def test_config():
    from datetime import date

    from docketlens.plans.config import Config

    c = Config.read("[in]\nentries = a\n[bounds]\ntoday = 2020-01-02\nleast_similarity = 90\n")
    assert (c.entries, c.today, c.least_similarity) == ("a", date(2020, 1, 2), 90)
    with pytest.raises(ValueError):
        Config.read("[x]\nnope = 1\n")


def test_every_sealing_flag_is_met_and_missed():
    from docketlens.plans import catalog

    con = __import__("duckdb").connect()
    con.execute("CREATE TABLE events AS SELECT range AS event_id FROM range(1000)")
    for name in ("indicator_matrix", "indicator_tidy", "sealed_item"):
        rows = con.execute(catalog.ORACLES[name])
        names = [c[0] for c in rows.description]
        values = list(zip(*rows.fetchall(), strict=True))
        assert all(set(v) == {True, False} for n, v in zip(names, values, strict=True) if n != "idx")


def test_name_cleaner(spark):
    from docketlens.functions.text import clean_name

    want = {
        "José A. Núñez": "jose a nunez", "Magistrate Judge John O'Neil": "john oneil", "J.R. Smith": "j r smith", "Doe, John Snr.": "doe john sr", "Ann Lee Junior": "ann lee jr",
        "Mary Smith's order": "mary smith order", "Bob Brown's jr": "bob browns jr", "Al Green' s": "al green", "Smith - Jones": "smith jones", "Smith -Jones": "smith jones", "C[hristian] Rozolis": "christian rozolis",
        "James 4th & Co.": "james th co", "the ' quoted": "the quoted", "MagJud Kim": "kim", "  two   spaces ": "two spaces", "": "", "K. Lee": "k lee",
    }
    df = spark.createDataFrame([(k,) for k in want] + [(None,)], "n string")
    got = {r.n: r.c for r in df.select("n", clean_name(df.n).alias("c")).collect()}
    assert got == want | {None: None}


def test_label_ladder_rules(spark):
    cats = ["Bankruptcy_Judge", "Circuit_Appeals", "District_Judge", "Magistrate_Judge", "Nondescript_Judge", "Judicial_Actor", "No_Keywords"]
    # name, counts by category, total, head, known judge, earlier id, label
    rows = [
        ("fjc", (0, 0, 0, 0, 0, 0, 9), 9, 0, True, None, "FJC Judge"), ("rare", (0, 0, 1, 0, 0, 0, 0), 1, 0, False, None, "deny - low occurence"), ("kept", (0, 0, 1, 0, 0, 0, 0), 1, 0, False, "SJ1", "Maintain Prior JEL"),
        ("junk", (0, 0, 0, 0, 0, 0, 9), 9, 1, False, None, "deny - Junk"), ("one", (0, 7, 0, 0, 0, 0, 0), 7, 0, False, None, "Circuit_Appeals"), ("weak", (0, 0, 0, 0, 4, 1, 3), 8, 0, False, None, "Magistrate_Judge"),
        ("district", (0, 0, 1, 0, 4, 0, 3), 8, 0, False, None, "District_Judge"), ("half", (5, 1, 4, 0, 0, 0, 0), 10, 0, False, None, "Bankruptcy_Judge"), ("quarter", (2, 1, 2, 3, 2, 0, 0), 10, 0, False, None, "Magistrate_Judge"),
        ("header", (0, 40, 10, 5, 45, 0, 0), 100, 2, False, None, "District_Judge**"), ("next", (3, 30, 3, 3, 61, 0, 0), 100, 0, False, None, "Circuit_Appeals"), ("generic", (6, 9, 6, 6, 73, 0, 0), 100, 0, False, None, "Nondescript_Judge"),
        ("silent", (1, 1, 1, 1, 1, 1, 94), 100, 0, False, None, "--- deny --- insufficient data"), ("clerk", (1, 33, 1, 0, 0, 45, 20), 100, 0, False, None, "--- deny --- clerk or attorney"), ("rest", (4, 30, 1, 0, 5, 25, 35), 100, 0, False, None, "Nondescript_Judge"),
    ]
    df = spark.createDataFrame([(n, *c, t, h, f, p) for n, c, t, h, f, p, _ in rows], f"entity string, {', '.join(c + ' long' for c in cats)}, total long, head long, fjc boolean, prior string")
    got = {r.entity: r.label for r in relational.label_ladder(df, "total", "head", cats, fjc="fjc", prior="prior").collect()}
    assert got == {r[0]: r[-1] for r in rows}


def test_lines_between(spark):
    rows = [(1, i, t) for i, t in enumerate("xapybp")] + [(2, 0, "p"), (2, 1, "a"), (3, 0, "p"), (None, 0, "a"), (None, 1, "p")]
    df = spark.createDataFrame(rows, "c long, i long, t string")
    got = {(r.c, r.i) for r in dockets.between_lines(df, "c", "i", df.t == "a", df.t == "p").collect()}
    assert got == {(1, 1), (1, 2), (None, 0), (None, 1)}


def test_significance_without_intervals(spark):
    rows = [("x", "a", 1)] * 8 + [("x", "b", 0)] + [("nmid", "a", 1)] * 9 + [("nmid", "b", 0)] * 9 + [("y", "a", 1)] * 9 + [("y", "a", 0)] + [("y", "b", 0)] * 9 + [("y", "b", 1)]
    df = spark.createDataFrame(rows, "court string, judge string, g int")
    run = statistics.welch_intervals(df, "judge", "court", "g")
    assert {(r.court, r.judge): r.sig for r in run.collect()} == {("x", "a"): False, ("nmid", "a"): False, ("nmid", "b"): False, ("y", "a"): True, ("y", "b"): True}
    table = {r.court: (r.jsum, r.jcount, r.is_sig) for r in statistics.significance_table([("all", run)], "court").collect()}
    assert table == {"x": (0, 1, False), "y": (2, 2, True)}


def test_cases_and_mentions_of_odd_rows(spark):
    from docketlens.operators import cases, mentions

    rows = [(None, 2016, "cand", None, "cv", None), ("b", None, "txed", "830: x", "cr", True), ("c", 2016, "cand", "830: y", "cr", False)]
    files = spark.createDataFrame(rows, "ucid string, year int, court string, nature_suit string, case_type string, is_multi boolean")
    assert [r.ucid for r in cases.select_cases(files, year=2016, nos="83").collect()] == ["c"] and cases.select_cases(files, sample=2).count() == 2
    assert {(r.ucid, r.nature_suit) for r in cases.single_cases(files).collect()} == {(None, None), ("c", "criminal")}
    lines = spark.createDataFrame([("a", 0, None), ("a", 4, "In Forma Pauperis"), ("a", 5, "forma pauperis"), ("b", 1, "Order of Service, forma pauperis"), (None, 3, "forma pauperis")], "c string, i long, t string")
    assert {tuple(r) for r in cases.first_phrase_line(lines, "c", "i", "t").collect()} == {("a", 4, 1), ("b", 9999, 0), (None, 3, 1)}
    names = spark.createDataFrame([(None, "x"), (None, "Judges of"), ("Doe, Roe", "JUDGES"), ("III", "x"), ("", "x"), ("Lee", None)], "n string, p string")
    got = [(r.eligible, r.is_exception) for r in mentions.eligibility(names, "n", "p").collect()]
    assert got == [(False, False), (False, False), (True, True), (False, False), (False, False), (True, False)]
    spans = spark.createDataFrame([(1, 0, 4), (1, 6, 9), (2, 0, 100), (3, 5, 9)], "k long, start long, end long")
    status = spark.createDataFrame([(1, 4, 6), (2, 5, 6), (3, 9, 12), (4, 0, 1)], "k long, s_start long, s_end long")
    assert {tuple(r) for r in mentions.only_overlap(status, spans, "k").collect()} == {(1, 4, 6, None, None), (2, 5, 6, None, None), (3, 9, 12, 5, 9), (4, 0, 1, None, None)}
    paths = spark.createDataFrame([("mdd;;1:16-cv-02159", "mdd"), ("odd", "x")], "u string, c string")
    assert [r.p for r in paths.select(mentions.case_path("b/", paths.u, paths.c, update=True).alias("p")).collect()] == ["b/mdd/16/_updates/mdd-1-16-cv-02159_U.jsonl", None]
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert {tuple(r) for r in mentions.overwritten(old, spark.createDataFrame([(2, None)], "k long, v string"), ["k"], ["v"]).collect()} == {(1, "a"), (2, None)}


def test_two_statuses_at_one_span_are_one(spark):
    from docketlens.operators import statuses

    st = spark.createDataFrame([(1, 4, "grant", 10, 30, 1), (1, 4, "other", 10, 30, 2), (1, 4, "grant", 40, 60, 3)], "case int, idx int, action string, s_start int, s_end int, seq int")
    me = spark.createDataFrame([(1, 4, 12, 20, "A"), (1, 4, 70, 80, "B"), (1, 4, 42, 50, "A"), (1, 4, 52, 58, "B")], "case int, idx int, start int, end int, sjid string")
    assert rows(statuses.exact_matches(st, me, "case", "idx").select("s_start", "sjid", "seq")) == [(10, "A", 1)]


def test_statuses_as_published(spark):
    from docketlens.operators import dockets, statuses

    said = {
        "motion to proceed without the payment of costs": {"application"}, "allows plaintiff to proceed in forma pauperis": {"grant"}, "request for ifp is denied as moot": {"other"},
        "the motion to proceed in forma pauperis on appeal": set(), "order granted plaintiff thirty days to pay for ifp": set(), "denied in part the ifp request": set(),
    }
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(said)], "case int, idx int, t string")
    got = {i: set() for i in range(len(said))}
    for r in statuses.status_spans(df, "case", "idx", "t").collect():
        got[r.idx].add(r.action)
    assert got == dict(enumerate(said.values()))
    gate = spark.createDataFrame([(1, "leave without the payment"), (1, "case remanded"), (1, "hearing"), (2, "cases consolidated")], "case int, t string")
    assert [r.t for r in dockets.phrase_gate(gate, "case", "t").orderBy("t").collect()] == ["case remanded", "leave without the payment"]
    kinds = spark.createDataFrame([("MINUTE ORDER granting",), ("ORDER on",), ("AFFIDAVIT of",), ("NOTICE of",), (None,)], "t string")
    assert [r[0] for r in kinds.select(T.entry_type(F.col("t"))).collect()] == ["MINUTE ORDER", "ORDER", "AFFIDAVIT", None, None]


def test_subset_pairs_meet_initials(spark):
    rnd = random.Random(8)
    names = sorted({" ".join(rnd.choice(("john", "j", "smith", "s", "ann", "a", "lee", "jr")) for _ in range(rnd.randint(1, 4))) for _ in range(150)})
    df = spark.createDataFrame([("s", n) for n in names], "scope string, name string")
    nodes = resolve.ordered(df, "scope", "name")
    n = nodes.select("name", "ord")
    all_pairs = n.toDF("a", "a_ord").crossJoin(n.toDF("b", "b_ord")).where("a_ord < b_ord").where(resolve.token_subset(F.col("a"), F.col("b"))).select("a_ord", "b_ord")
    assert rows(resolve.token_edges(resolve.subset_pairs(nodes, "scope", "name"), "scope").select("a_ord", "b_ord")) == rows(all_pairs)


def test_ids_go_on_from_range_to_range(spark):
    names = [f"n{i:05d}" for i in range(3000)]
    df = spark.createDataFrame([(n,) for n in reversed(names)], "name string").repartition(7)
    got = {r.name: r.sjid for r in relational.assign_ids(df, ["name"], start=998_500).collect()}
    assert got == {n: f"SJ{998_500 + i:06d}" for i, n in enumerate(names)}  # seven digits where six are not enough
    assert relational.assign_ids(df.limit(0), ["name"]).count() == 0
