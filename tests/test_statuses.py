"""Statuses: each pattern is searched once a sentence, and its words lose no match."""

import random

from docketlens.functions import patterns as P
from docketlens.operators import statuses

WORDS = (
    "granting;granted;grant;denied;denying;denies;deny;in part;as moot;moot;leave to;motion;request for;application;to proceed;in forma pauperis;ifp;IFP;without prepaying;without the pay;under 28 USC 1915;may proceed;"
    "waive filing fee;allows;order;ORDER;ordered to pay;the full;order to consolidate cases;all future pleadings;case was assigned incorrectly;hereby ordered;transferred;remanding;to;the district;no longer pending in this court;"
    "notice of;voluntary;dismissal;dismissing;the case;as frivolous;entirety;appeal;good faith;should not;directing;to file;has not;submitted;reduced;payment;filing fee;procedure;find;terminated;x  y"
).split(";")


def test_each_pattern_is_searched_once_a_sentence(spark):
    rows = spark.createDataFrame([(1, 0, "a")], "c int, i int, t string")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = statuses.status_spans(rows, "c", "i", "t")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("regexp_instr(") == sum(map(len, P.STATUS_GROUPS.values()))


def test_words_of_the_patterns_lose_no_match(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(2, 9))) for _ in range(1500)] + [None, "", "; ", "grant"]
    lines = spark.createDataFrame([(i % 7, i, t) for i, t in enumerate(texts)], "c int, i int, t string").cache()
    bare = {action: [f"(?:{p})" for p in group] for action, group in P.STATUS_GROUPS.items()}  # no known patterns: searched everywhere
    assert not {p for g in bare.values() for p in g} & set(P.STATUS_WORDS)
    got, want = (sorted(map(tuple, statuses.status_spans(lines, "c", "i", "t", groups).collect())) for groups in (None, bare))
    assert got == want and {r[2] for r in got} == set(P.STATUS_GROUPS)
