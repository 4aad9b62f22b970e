"""Names widened by the words beside them, against a plain loop."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from docketlens.functions.keywords import Phrases
from docketlens.operators import neighbourhood as N

ROW = "id int, original_text string, full_span_start int, extracted_pre_5 string, extracted_entity string, extracted_post_5 string, Ent_span_start int, Ent_span_end int"


def test_phrases_against_patterns():
    rnd = random.Random(6)
    for _ in range(400):
        words = ["john", "j", "j.", "john r", "r.", ", jr", ", jr.", "jr", "o'neil", "x y z"]
        chosen = rnd.sample(words, 4)
        text = "".join(rnd.choice((*words, "R", "JOHN", "q")) + rnd.choice((" ", ", ", "", ".", "  ")) for _ in range(rnd.randint(0, 5)))
        low, out, at = text.lower(), [], 0
        pattern = re.compile("(?:" + "|".join(map(re.escape, sorted(chosen, key=len, reverse=True))) + ")(?![0-9a-z_])")
        while at < len(low):
            if m := pattern.match(low, at):
                out.append(m.span())
                at = m.end() + 1
            else:
                at += max(1, len(re.match("[0-9a-z_]*", low[at:])[0]) + 1 if re.match("[0-9a-z_]", low[at]) else 1)
        assert Phrases(chosen).spans(text) == out


def test_pre_clean(spark):
    names = {"..J.R. Smith": "jr smith", "by  Ann-Marie Poe": "ann marie poe", "Poe's": "poe", "Poe, Jr.": "poe jr", "re": None, "-'Poe.'": "poe", "": None, "To": None, "Tom": "tom", "from Roe": "roe", None: None}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", N.pre_clean(F.col("n"))).collect()
    assert {r[0]: r[1] for r in got} == names


def test_searches_and_spellings():
    assert N.searches("poe", "ann b poe") == [("pre", "ann b ")] and N.searches("ann", "ann b poe") == [("post", " b poe")] and N.searches("b", "ann b poe") == [("pre", "ann "), ("post", " poe")]
    assert N.searches("poe", "ann poes") == [] and N.searches("poe", "poe to") == [] and N.searches("jones", "jones' order x") == []
    assert N.spellings("poe", "pre", "ann j r ") == {"ann j. r.", "ann j.r.", "ann j r", "ann"}
    assert N.spellings("poe", "post", " jr") == {"jr", ", jr", ", jr.", "jr.", ", jr"} | {", jr", ", jr."}
    assert N.spellings("jr", "pre", "poe ") == {"poe", "poe,"} and "iam x" not in N.spellings("will", "post", "iam x y") and N.spellings("x", "pre", " ") == set()


def plain(rows, clean):
    """Every name against every known name, every row against its name's phrases."""
    counts = Counter(c for c in clean if c)
    known = {k for k, n in counts.items() if n > N.FREQUENT} | {k for names in N.OVERRIDES.values() for k in names}
    known = {k for k in known if len(k.split()) >= 2 and "judge" not in k and "magistrate" not in k}
    out = []
    for row, name in zip(rows, clean, strict=True):
        i, text, start, pre, entity, post, first, stop = row
        found = None
        if name and text is not None and len(name) > 1 and len(name.split()) <= 2 and not name.isdigit():
            sides = {"pre": set(), "post": set()}
            for k in known:
                if name in k and name != k:
                    for side, search in N.searches(name, k):
                        sides[side] |= N.spellings(name, side, search)
            if name == "will" and re.search(N.WILL, f"will {text[stop - start :]}"):
                found = (first, stop, pre, "", post)
            else:
                found = N.widen(text, start, first, stop, pre or "", post or "", Phrases(sides["pre"]), Phrases(sides["post"]))
        a, b, p, e, q = found or (first, stop, pre, entity, post)
        out.append((i, p, e, q, a, b, found is not None))
    return sorted(out, key=str)


def test_reextraction_matches_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(N, "FREQUENT", 5)
    rnd, rows = random.Random(12), []
    before, names, behind = ["", "Ann ", "J. R. ", "J.R. ", "Mary B. ", "of "], ["Poe", "Roe", "Will", "Smith", "Poe Jr.", "12", "x", None, "Van Tatenhove", "Ann Poe"], ["", " Jr.", ", Jr. on", " Smith", " will rule", " rule on", " III"]
    for i in range(1200):
        a, n, z = rnd.choice(before), rnd.choice(names), rnd.choice(behind)
        text, s, e = a + (n or "") + z, len(a), len(a) + len(n or "")
        if n and rnd.random() < 0.4:
            s = 0
        if n and rnd.random() < 0.3:
            e = len(text)
        rows.append((i, text, 50, text[:s], text[s:e] if n else None, text[e:].lstrip(), 50 + s, 50 + e))
    rows += [(5000, None, 0, None, "Poe", None, 0, 3), (5001, "by Gregory F. Van Tatenhove x", 0, "by Gregory F. ", "Van Tatenhove", "x", 14, 27)] * 2
    df = spark.createDataFrame(rows, ROW).withColumns({c: F.lit("?") for c in ("clean", "part", "kind", "side", "phrase", "row", "new", "n")})
    clean = [r[1] for r in df.select("id", N.pre_clean(F.col("extracted_entity"))).collect()]
    columns = ("id", "extracted_pre_5", "extracted_entity", "extracted_post_5", "Ent_span_start", "Ent_span_end", "was_widened")
    run = lambda d: sorted((tuple(r) for r in N.reextracted(d).select(*columns).collect()), key=str)
    want = plain(rows, clean)
    assert sum(w[-1] for w in want) > 150 and any(w[2] == "Gregory F. Van Tatenhove" for w in want) and any(w[2] == "" for w in want)
    assert run(df) == want
    monkeypatch.setattr(N, "PART_ROWS", 20)  # names with many rows are split
    assert run(df) == want
    assert N.reextracted(df).columns == [*df.columns, "was_widened"] and N.reextracted(df.limit(0)).count() == 0
