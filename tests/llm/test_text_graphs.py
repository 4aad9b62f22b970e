"""Spelling variants, the conversation trie and decontamination against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from conftest import words as made_words
from pyspark.sql import functions as F

from docketlens.llm import decontamination, prefix_trie, spelling

LOW = str.maketrans({c: c + 32 for c in range(65, 91)})


def plain_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    kept = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near, same = defaultdict(set), defaultdict(set)
    for w in kept:
        for i in range(len(w)):
            cut = w[:i] + w[i + 1 :]
            same[i, cut].add(w)
            if cut in kept:
                near[w].add(cut)
                near[cut].add(w)
    for group in same.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in kept:
        if near[w]:
            best = min(near[w], key=lambda v: (-kept[v], v))
            if kept[best] >= 5 * kept[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), kept[w], len(near[w]), kept[form[w]] if w in form else None) for w in kept)


def variants(df):
    return sorted(tuple(r) for r in spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect())


def spelling_rows():
    """Chains of forms, runs of one letter, letters beyond ASCII, edits at every position, words of one first half, and a long run."""
    rnd, out = random.Random(5), []
    base = ["aaaaaab", "mississippi", "straße", "éléphant", "zzzzzzzz", "ÿÿÿÿÿÿÿ", "counterrevolution"]
    some = Counter()
    for w in base:
        some[w] += 700
        for i in range(len(w) + 1):
            for v in (w[:i] + w[i + 1 :], w[:i] + rnd.choice("abzÿé") + w[i + 1 :], w[:i] + (w[i - 1] if i else w[0]) + w[i:], w[:i] + rnd.choice("abzÿé") + w[i:]):
                some[v] += rnd.choice((3, 5, 6, 100))
                some[v[:-1] + "q"] += 5
    for _ in range(900):  # many words with one first half
        some["halfword" + "".join(rnd.choice("abc") for _ in range(rnd.randint(5, 8)))] += 5
    long = "".join(rnd.choice("ab") for _ in range(2_000))
    some[long] += 30
    some[long[:700] + "c" + long[700:]] += 5
    some[long[:1_999] + "x"] += 6
    flat = [w for w, c in some.items() for _ in range(c)]
    rnd.shuffle(flat)
    for i in range(0, len(flat), 50):
        out.append((i, " ".join(flat[i : i + 50])))
    return [*out, (None, "Straße straße " * 3), (1, None), (2, ""), (3, "x×÷x abcdefg " * 7), (3, "x×÷x abcdefg " * 7)]


def test_spelling_variants(spark, odd, empty, monkeypatch):
    rows = spelling_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("w")).withColumn("n", F.lit(1)).withColumn("form", F.lit(None).cast("string"))
    want = plain_variants(rows)
    assert len(want) > 500 and any(w[1] and w[1] != w[2] for w in want)  # chains of forms
    assert variants(df) == want
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 40)  # many blocks, hot first halves visit several
    monkeypatch.setattr(spelling, "CHUNK_QUERIES", 64)
    assert variants(df) == want
    assert variants(odd) == plain_variants([(r.doc_id, r.text) for r in odd.collect()]) and variants(empty) == []


def test_a_run_of_a_megabyte(spark):
    rnd = random.Random(1)
    long = "".join(rnd.choice("ab") for _ in range(1_000_000))
    far = long[:400_000] + "c" + long[400_000:]
    rows = [(0, f"{long} " * 25 + f"{far} " * 5 + "zebras " * 9)]
    got = {w: (f, r, n, near) for w, f, r, n, near, _ in variants(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got == {long: (None, long, 25, 1), far: (long, long, 5, 1), "zebras": (None, "zebras", 9, 0)}


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 100):
        values = rng.permutation(n)
        tree = spelling.Wavelet(values)
        a, b, c, d = (rng.integers(0, n + 1, 200) for _ in range(4))
        q, v = tree.report(a, b, c, d)
        want = sorted((k, int(x)) for k in range(200) for x in values[a[k] : b[k]] if c[k] <= x < d[k])
        assert sorted(zip(q.tolist(), v.tolist(), strict=True)) == want


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    nodes = {}
    for c in sorted(convs):
        own, h = [t[2:] for t in sorted(convs[c])], zlib.crc32(str(c).encode()) % 4
        base = int(np.fix(c / 20)) * 20
        path = [t[2:] for t in sorted(convs.get(base, []))][:h] + own[h:]
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), ([], [], set()))[0].append(c)
            if d:
                nodes[tuple(path[: d - 1])][2].add(tuple(path[:d]))
        nodes[tuple(path)][1].append(c)
    below, out = {}, []
    for key in sorted(nodes, key=len, reverse=True):
        members, ends, children = nodes[key]
        saved = (len(members) - 1) * (len(re.findall("[^\x20\x09-\x0d]+", key[-1][1])) if key else 0)
        below[key] = (sum(below[k][0] for k in children) or 1, saved + sum(below[k][1] for k in children))
        parent = nodes[key[:-1]][0][0] if key else None
        out.append((members[0], len(key), parent, len(members), len(children), *below[key], hashlib.sha256(",".join(map(str, sorted(ends))).encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string"


def trie(df):
    return sorted((tuple(r) for r in prefix_trie.trie(df).collect()), key=str)


def test_prefix_trie(spark, monkeypatch):
    rnd = random.Random(3)
    texts = ["hello there", "a b c", "", None, "one two three four", "x"]
    rows = []
    for c in [*range(-45, 400, 3), *range(0, 400, 20), 10**9, 10**9 + 1]:
        for t in range(rnd.randint(1, 6)):
            rows.append((c, t if t else rnd.choice((0, None)), rnd.choice(("user", "assistant", None)), rnd.choice(texts)))
    rows = list({(r[0], r[1]): r for r in rows}.values())
    rows += [(c, t, "user", "the same") for c in range(1000, 1300) for t in range(3)]  # copies
    rows += [(2001, t, "user", f"turn {t % 7}") for t in range(800)]  # one conversation with a third of all rows
    rows += [(2002, 0, "user", "twice")] * 5 + [(None, 0, "user", "nobody's")] * 3  # repeated rows, rows of no conversation
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("?") for c in ("base", "words", "x", "depth", "head")})
    want = plain_trie(rows)
    assert trie(df) == want
    assert any(w[3] == 1 and w[4] == 0 and w[1] == 0 for w in plain_trie([(1, 0, "u", "x")])) and trie(spark.createDataFrame([(1, 0, "u", "x")], TURNS)) == plain_trie([(1, 0, "u", "x")])
    monkeypatch.setattr(prefix_trie, "BLOCK", 40)  # ends hashed over many blocks
    assert trie(df) == want
    assert prefix_trie.trie(df.limit(0)).count() == 0
    assert prefix_trie.trie(df.where("conv_id = 2002").repartition(3)).count() == len(plain_trie([r for r in rows if r[0] == 2002]))


def test_a_long_conversation_is_cut_into_ranges(spark):
    """Its numbers, prefixes and word totals go on from range to range."""
    rows = [(7, t, "user", f"{t % 11} words") for t in range(1500)] + [(8, t, "user", f"{t % 11} words") for t in range(1200)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert trie(spark.createDataFrame(rows, TURNS).repartition(5)) == plain_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain_contamination(docs, items):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    found = defaultdict(set)
    for item, text in items:
        w = word.findall((text or "").translate(LOW))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            found[tuple(w[i : i + n])].add(item)
    out = []
    for doc_id, text in docs:
        w = word.findall((text or "").translate(LOW))
        hit, ids = set(), set()
        for n in {len(k) for k in found}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in found:
                    hit |= set(range(i, i + n))
                    ids |= found[tuple(w[i : i + n])] - {None}
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def digests(docs, items, **how):
    rows = decontamination.digests(decontamination.contamination(docs, items, ["doc_id"], **how)).select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return sorted((tuple(r) for r in rows.collect()), key=str)


def test_decontamination(spark, odd, empty):
    rnd = random.Random(11)
    asked = [" ".join(made_words(rnd, n)) for n in (30, 12, 10, 9, 3, 1, 60)]
    items = [(i, t) for i, t in enumerate(asked)] + [(2, asked[2]), (40, asked[0]), (None, "nobody asked this one"), (5, None), (6, " ;; "), (100, "ÄÖÜ 数字"), (7, "a b a b")]
    texts = [asked[0].upper(), f"so: {asked[1]}. And {asked[1]}", f"x {asked[2].replace(' ', '--')} y", asked[3][:-1], asked[4] + asked[4], "nobody Asked; this one", "äöü 数字 ÄÖÜ 数字", "a b a b a b a b", None, "",
             " ".join(made_words(rnd, 20_000)) + " " + " ".join(asked[6].split()[20:35]) + " tail" * 100_000]
    rows = [(i, t) for i, t in enumerate(texts)] * 2 + [(None, asked[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n_words", "hits", "items", "row", "key")})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("pattern", F.lit("p"))
    want = plain_contamination(rows, items)
    assert sum(w[-1] for w in want) > 10
    assert digests(docs, bench) == want
    assert digests(docs, bench, block_chars=300) == want  # several automata, put together
    for d in (odd, empty):
        assert digests(d, bench) == plain_contamination([(r.doc_id, r.text) for r in d.collect()], items)
    assert not any(r[-1] for r in digests(docs, bench.limit(0)))
    two = bench.select("item_id", F.col("text").alias("question"), F.lit("words of an answer only").alias("answer"))
    assert digests(docs, two, columns=("question", "answer")) == plain_contamination(rows, items + [(i, "words of an answer only") for i, _ in items])


def test_hits_map_to_the_original_text(spark):
    bench = spark.createDataFrame([(1, "Where Does the river END?")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Ä – where  does, THE river\nend! Nobody knows.", 3), (2, None, 4)], "doc_id long, text string, hits int")
    found = {r.row.doc_id: r for r in decontamination.contamination(docs, bench, ["doc_id", "text"]).collect()}
    text = found[1].row.text
    assert [text[a:b] for a, b in decontamination.original_spans(text, found[1].hits)] == ["where  does, THE river\nend"] and found[1]["items"] == [1]
    clean = decontamination.without_benchmark(docs, bench)
    assert clean.columns == docs.columns and {tuple(r) for r in clean.collect()} == {(1, "Ä – ! Nobody knows.", 3), (2, None, 4)}


def test_registered_queries_match_their_sql(spark):
    import duckdb

    from docketlens.llm import queries_text_graphs as q

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    for name, query in q.QUERIES.items():
        df = query(spark, "/root/testdata/sf0.001")
        cur = con.execute(q.ORACLES[name])
        names = [c[0] for c in cur.description]
        want = [tuple(r[names.index(c)] for c in df.columns) for r in cur.fetchall()]
        assert sorted(df.columns) == sorted(names) and sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
