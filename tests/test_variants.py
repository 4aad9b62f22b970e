"""Variants by hand, and names that hold one another against all pairs."""

import random

from pyspark.sql import functions as F

from docketlens.functions.court_words import SUFFIXES
from docketlens.operators import variants as V


def told(name, **how):
    return sorted(" ".join(v) for v in V.variants(name, **how))


def test_written_by_hand():
    assert told("john robert smith") == ["john robert smith"] and told("john robert smith", first=True) == ["j robert smith"] and told("john robert smith", middle=True) == ["john r smith"]
    assert told("john robert smith", first=True, middle=True) == ["j r smith"] and told("john smith", first=True) == ["j smith"] and told("smith", first=True) == ["smith"]
    assert told("john smith jr", first=True) == ["j smith jr"] and told("smith jr", first=True) == ["smith jr"] and told("john robert smith jr", middle=True) == ["john r smith jr"]
    assert told("a bee cee dee", middle=True) == ["a b c dee", "a b cee dee", "a bee c dee"] and told("al bee cee dee eff jr", first=True) == ["a bee cee dee eff jr"]
    assert told("ann poe-roe") == ["ann poe roe", "ann poe-roe"] and told("") == []


def test_nicknames_and_unified_by_hand():
    assert told("edward smith", style="nicknames") == ["ed smith", "edward smith"] and told("joseph daniel poe", style="nicknames") == ["j dan poe", "j daniel poe", "joe dan poe", "joe daniel poe", "joseph dan poe", "joseph daniel poe"]
    assert told("brian mikel poe", style="unified") == ["bryan michael poe"] and told("ruth poe", style="unified") == [] and told("poe edward", style="nicknames") == ["poe edward"]


def holds(s, l):
    if len(s) == 1 and len(l) > 1:
        return s[0] == (l[-2] if l[-1] in SUFFIXES else l[-1])
    left, places = {}, []
    for i, w in enumerate(l):
        left.setdefault(w, []).append(i)
    for w in s:
        if not left.get(w):
            return False
        places.append(left[w].pop(0))
    return places == sorted(places)


def test_matches_are_all_pairs(spark):
    rnd = random.Random(3)
    words = ["john", "j", "robert", "r", "smith", "ed", "edward", "jr", "brian", "bryan", "poe-roe", "poe", "iii"]
    rows = [(rnd.choice(("x", "y")), " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 5)))) for _ in range(160)] + [("x", None), (None, "john"), ("x", ""), ("x", "john smith")] * 2
    df = spark.createDataFrame(rows, "scope string, name string").withColumns({c: F.lit(1) for c in ("words", "l", "s", "w", "n")})
    some = 0
    for style in V.STYLES:
        for first, middle in ((False, False), (True, False), (False, True), (True, True)):
            made = {n: V.variants(n, first, middle, style) for _, n in rows if n}
            want = set()
            for s, a in set(rows):
                for t, b in set(rows):
                    if a and b and s and s == t and a < b and any(holds(x, y) or holds(y, x) if (len(x) == 1) == (len(y) == 1) else holds(min(x, y, key=len), max(x, y, key=len)) for x in made[a] for y in made[b]):
                        want.add((s, a, b))
            got = V.subset_matches(df, "scope", "name", first, middle, style).collect()
            assert {tuple(r) for r in got} == want and len(got) == len(want)
            some += len(want)
    assert some > 500
    assert V.subset_matches(df.limit(0), "scope", "name").count() == 0
