"""Round trips and brute-force versions of the operators on texts."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketlens.llm import jaccard, lang_id, mixing, packing, pii, quality, token_files, toxicity
from docketlens.llm.tokenizing import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_measures(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {i + o for i, x in enumerate(windows) if n[x] > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, odd):
    more = spark.createDataFrame([(100, "a b c a b c a b c d"), (101, "x\nx\n \nx y\nx y"), (102, "** # a|b")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").union(more)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.ledger(docs).collect())
    assert got == Counter((r.doc_id, *brute_measures(r.text)) for r in docs.collect())


def test_quality_policies_and_filters(odd, empty):
    led = quality.ledger(odd)
    kept = {r.doc_id for r in led.where(quality.passes()).collect()}
    assert {0, 1, 2, 7} <= kept and not kept & {3, 4, 5, 6}
    out = quality.kept_documents(odd)
    assert out.columns == odd.columns and out.count() == led.where(quality.passes()).count()
    ab = {r.rule: r for r in quality.ablations(led).collect()}
    assert ab["few_words"].kept_without >= ab["few_words"].kept == led.where(quality.passes()).count()
    assert quality.ledger(empty).count() == 0


def test_mixing_targets_match_repeated_resharing(spark):
    sizes = {"a": 10, "b": 1000, "c": 400, "d": 3}
    weights = dict(zip(sorted(sizes), (5, 2, 1, 5), strict=True))
    left, capped, open_ = float(sum(sizes.values())), {}, set(sizes)
    while True:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            capped[s], left = 3.0 * sizes[s], left - 3 * sizes[s]
        open_ -= over
    want = capped | {s: level * weights[s] for s in open_}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(want)


def test_mixing_meets_targets_and_reruns_agree(spark, odd, empty):
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, " ".join(["w"] * int(rng.integers(1, 60))), "hot" if i % 3 else f"s{i % 5}") for i in range(3000)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, fan_in=16).collect()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0
        t = by.setdefault(r.source_size, [0, r.target])
        t[0] += r.taken
    assert all(abs(a - b) <= 60 for a, b in by.values()) and len(rows) == 3000
    again = mixing.mix(docs, fan_in=16).collect()
    assert sorted(rows) == sorted(again)
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(empty).count() == 0
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns and out.count() == mixing.mix(odd).agg(F.sum("copies")).first()[0] - mixing.mix(odd).where("doc_id is null").agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0] + out.where("doc_id is null").count()


def test_bit_packing_round_trip():
    rng = np.random.default_rng(0)
    for bits in (1, 3, 8, 13, 16, 17):
        ids = rng.integers(0, 1 << bits, 9001).astype(np.uint32)
        assert (token_files.unpack_bits(token_files.pack_bits(ids, bits), len(ids), bits) == ids).all()
        image = token_files.Image(token_files.build_image([5, None, 9], [0, 4000, 5001], ids, bits))
        assert (image.ids(4090, 8200) == ids[4090:8200]).all() and len(image.document(0)) == 0 and (image.document(2) == ids[4000:]).all()


def test_token_files_and_packing_match_the_library(odd, empty):
    from tokenizers import Tokenizer

    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got = token_files.token_digests(odd, vocabulary("word_bpe_49k.json"), 2).collect()
    texts = odd.select("doc_id", "text").collect()
    want = Counter((r.doc_id, len(i), crc(i)) for r in texts for i in [lib.encode(r.text or "", add_special_tokens=False).ids + [2]])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    place = sorted(got, key=lambda r: r.start)
    assert [r.start for r in place] == [sum(x.n_tokens for x in place[:i]) for i in range(len(place))]
    known = [r.doc_id for r in place if r.doc_id is not None]
    assert known == sorted(known)
    lib = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    pieces = packing.packed_digests(odd, vocabulary("byte_bpe_50k.json"), 1).collect()
    all_ids = {(r.doc_id, r.text): lib.encode(r.text or "", add_special_tokens=False).ids + [1] for r in texts}
    options = {(k[0], s, len(p), crc(p), len(v)) for k, v in all_ids.items() for s in range(0, len(v), 2048) for p in [v[s : s + 2048]]}
    assert all((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) in options for p in pieces)
    assert sum(p.length for p in pieces) == sum(len(all_ids[(r.doc_id, r.text)]) for r in texts)
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.packed_digests(empty, vocabulary("byte_bpe_50k.json"), 1).count() == 0
    assert token_files.token_digests(empty, vocabulary("word_bpe_49k.json"), 2).count() == 0


def test_chunked_encoding_is_exact():
    import random

    from tokenizers import Tokenizer

    from docketlens.llm.tokenizing import ChunkTokenizer

    rnd = random.Random(2)
    texts = ["".join(rnd.choice("aB' \n\t\r.,1é\xa0 <|endoftext|>\x1c漢") for _ in range(rnd.randint(0, 30))) for _ in range(3000)] + [" a", "a ", "  a  b", "it's  we'll\n\n x", "<|endoftext|> a"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        lib, own = Tokenizer.from_file(vocabulary(name)), ChunkTokenizer(vocabulary(name), slots=1 << 8, pool_ids=1 << 10, piece_bytes=200)
        for i in range(0, len(texts), 100):
            some = texts[i : i + 100]
            assert own.encode(some) == [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch(some, add_special_tokens=False)]


def test_first_fit_decreasing_matches_a_plain_loop():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 101, 400)
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    room, want = [], {}
    for k in np.argsort(-sizes, kind="stable"):
        b = next((i for i, r in enumerate(room) if r >= sizes[k]), len(room))
        if b == len(room):
            room.append(100)
        want[int(k)] = (b, 100 - room[b])
        room[b] -= sizes[k]
    assert {i: (int(b), int(o)) for i, (b, o) in enumerate(zip(bins, offsets, strict=True))} == want


def brute_spans(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append((kind, *m.span()))
    return out


def test_base_spans_match_the_patterns():
    import random

    rnd = random.Random(3)
    for _ in range(20000):
        text = "".join(rnd.choice("a@.-+ 1245(%\n٣é") for _ in range(rnd.randint(0, 40)))
        assert pii.base_spans(text) == brute_spans(text)
    assert pii.base_spans("a" * 200_000 + "@") == [] and pii.base_spans("1" * 200_000) == []


def test_personal_data(spark, odd, empty):
    got = {r.doc_id: r for r in pii.private(odd, ["doc_id"]).collect()}
    assert (got[9].n_email, got[9].n_ip, got[9].n_card, got[9].n_phone) == (1, 1, 1, 1) and got[3].spans == "" and got[0].spans == ""
    clean = {r.doc_id: r.text for r in pii.sanitised_documents(odd).collect()}
    assert clean[9] == "mail [EMAIL] or [PHONE], [IP], [CARD]" and clean[3] is None
    assert pii.private(empty, ["doc_id"]).count() == 0


def test_terms_that_give_an_entity_away_are_found(spark):
    import random

    from conftest import words

    rnd = random.Random(1)
    rows = [(i, " ".join(words(rnd, 60))) for i in range(300)]
    rows += [(1000 + i, " ".join([*words(rnd, 20), "zebulon", "zz@secret.org", *words(rnd, 20)])) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.private(docs, ["doc_id"]).collect()}
    assert all("term:" in got[1000 + i] for i in range(6)) and not any(got[i] for i in range(300))
    assert all("zebulon" not in r.text for r in pii.sanitised_documents(docs).collect())


def brute_terms(texts):
    """Of each text the terms from 0.7 up, by the formula, over distinct texts."""
    from math import log

    texts = sorted({t for t in texts if t})
    held, terms = {}, {}
    for t in texts:
        spans = pii.base_spans(t)
        for k, s, e in spans:
            held.setdefault(pii.entity(k, t[s:e]), set()).add(t)
        for m in re.finditer(r"[^\W\d_]+", t):
            terms.setdefault(m[0].lower(), [set(), set()])[0].add(t)
            if not any(s < m.end() and m.start() < e for _, s, e in spans):
                terms[m[0].lower()][1].add(t)
    out = {t: set() for t in texts}
    for e, own in held.items():
        for term, (all_, outside) in terms.items():
            if (both := own & outside) and len(own) < len(texts) and log(len(both) * len(texts) / (len(own) * (len(all_) + 1))) / log(len(texts) / len(own)) >= 0.7:
                for t in both:
                    out[t].add(term)
    return out


def test_terms_match_the_formula(spark):
    import random

    from conftest import words

    rnd = random.Random(5)
    rows = [(i, " ".join(words(rnd, 60))) for i in range(300)]
    # One text only; a fixed footer at the end of different texts; a list of addresses; a word of two letters; two texts.
    rows.append((1000, " ".join([*words(rnd, 20), "zebulon far", *words(rnd, 30), "one@rare.org"])))
    rows += [(2000 + i, " ".join([*words(rnd, 30), "ask Jane Smithers, Records Office, jane@x.org"])) for i in range(40)]
    rows.append((3000, " ".join(f"{w} m{i}@list.org" for i, w in enumerate(words(rnd, 50)))))
    rows += [(4000 + i, " ".join([*words(rnd, 10), "qx +1 (555) 123-4567", *words(rnd, 10)])) for i in range(2)]
    rows += [(5000, rows[300][1])] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_terms([t for _, t in rows])
    got = pii.private(docs.select("doc_id", "text"), ["doc_id"]).collect()
    by_id = dict(rows)
    for r in got:
        spans = [x.split(":") for x in r.spans.split(",") if x.startswith("term")]
        assert {by_id[r.doc_id][int(s) : int(e)].lower() for _, s, e in spans} == want[by_id[r.doc_id]]
    assert len(got) == len(rows) and "zebulon" in want[by_id[5000]] and {"jane", "smithers"} <= want[by_id[2007]] and "qx" in want[by_id[4001]]


def test_terms_follow_from_the_text_not_from_the_id(spark):
    import random

    from conftest import words

    rnd = random.Random(6)
    rows = [(i, " ".join(words(rnd, 40))) for i in range(60)]
    for key in (None, 500):
        rows += [(key, f"zebulon{key} a{key}@x.org"), (key, f"zebulon{key} b{key}@x.org quiet"), (key, f"plain zebulon{key} quiet")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_terms([t for _, t in rows])
    for r in pii.private(docs.selectExpr("doc_id", "text", "text AS own"), ["own"]).collect():
        spans = [x.split(":") for x in r.spans.split(",") if x.startswith("term")]
        assert {r.own[int(s) : int(e)].lower() for _, s, e in spans} == want[r.own]


def brute_components(rows):
    sets = {}
    for key, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[key] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def test_jaccard_join_matches_brute_force(spark):
    import random

    from conftest import words

    rnd = random.Random(11)
    passage = words(rnd, 60)
    rows, key = [], 0
    for _ in range(12):
        seed = words(rnd, rnd.choice([6, 40, 120]))
        for _ in range(rnd.choice([1, 3, 9])):
            w = list(seed)
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(["zz", "qq"])
            rows.append((key, " ".join(w if rnd.random() < 0.8 else w + passage)))
            key += 1
    # A chain: neighbours are similar, the ends are not; and one hot group of near copies.
    chain = words(rnd, 130)
    rows += [(500 + i, " ".join(chain[2 * i : 2 * i + 100])) for i in range(12)]
    hot = words(rnd, 100)
    for i in range(60):
        w = list(hot)
        for p in rnd.sample(range(100), 2):
            w[p] = f"v{i}x{p}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000, None), (2001, ""), (2002, "A b"), (2003, "a B"), (2004, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == brute_components(rows)


def test_every_link_is_found_and_counted(spark, monkeypatch):
    import random

    from conftest import words

    monkeypatch.setattr(jaccard, "LINK_BLOCK", 16)
    rnd = random.Random(13)
    hot, chain, rows = words(rnd, 100), words(rnd, 130), []
    for i in range(60):
        w = list(hot)
        for p in rnd.sample(range(100), rnd.choice([1, 2, 3])):
            w[p] = f"v{i}x{p}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(chain[2 * i : 2 * i + 100])) for i in range(12)] + [(200 + i, rows[5][1]) for i in range(3)] + [(300, "")]
    sets = {k: frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for k, t in rows for w in [t.split()]}
    similar = lambda x, y: bool(x and y) and 100 * len(x & y) >= 75 * len(x | y)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = {s: k for k, s in sorted(sets.items(), reverse=True)}
    want = {(a, b) for a in first.values() for b in first.values() if a < b and similar(sets[a], sets[b])}
    got = [(r.a, r.b) for r in jaccard.links(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300
    counted = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.linked_documents(docs).collect()}
    whole = brute_components(rows)
    assert counted == {a: (*whole[a], sum(a != b and similar(sets[a], sets[b]) for b in sets)) for a in sets}


def test_shingle_sets_of_texts_hashed_together(monkeypatch):
    rnd = np.random.default_rng(4)
    texts = [None, "", " \t\v", "One", "one two THREE", "a b c d e", "e " * 40, "\u00c4 \u00e4 \ud800 x \u00a0 y"]
    texts += ["".join(rnd.choice(list("abAB  \n\f\u00e9"), n)) for n in rnd.integers(0, 400, 300)] + ["long text " * 9000]
    calls, real = [], jaccard.word_hashes
    monkeypatch.setattr(jaccard, "word_hashes", lambda data: calls.append(1) or real(data))
    together = jaccard.shingle_sets(texts)
    assert len(calls) < 10
    seen = {}
    for text, got in zip(texts, together, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        k = min(len(words), 5)
        want = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()
        assert len(got) == len(want) and np.array_equal(got, jaccard.shingles(text))
        assert seen.setdefault(frozenset(want), got.tobytes()) == got.tobytes()
    assert len(set(seen.values())) == len(seen)


def test_jaccard_odd_rows(odd, empty):
    got = jaccard.near_duplicates(odd).collect()
    assert len(got) == odd.count() and {r.component_id for r in got if r.doc_id in (0, 1, 2)} == {0}
    out = jaccard.one_of_each(odd)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == odd.columns and ids.count(0) == 1 and 1 not in ids and 2 not in ids
    assert jaccard.near_duplicates(empty).count() == 0


def test_one_of_each_keeps_different_texts_without_an_id_or_under_one_id(spark):
    import random

    from conftest import words

    rnd = random.Random(8)
    a, b, c, d, e, f = (" ".join(words(rnd, 60)) for _ in range(6))
    rows = [(None, a), (None, b), (None, b), (None, c + " tail"), (1, c), (2, d), (2, e), (3, e + " tail"), (4, f), (4, f), (5, f), (None, None), (None, ""), (6, None), (7, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in jaccard.one_of_each(docs).collect())
    assert got == Counter([(None, a), (None, b), (1, c), (2, d), (2, e), (4, f), (None, None), (None, ""), (6, None), (7, None)])


def test_the_sample_takes_no_less_for_copies(spark):
    rows = spark.range(20000).select(F.lit("x").alias("g"), F.when(F.col("id") < 19900, 0).otherwise(F.col("id")).alias("t")).select("g", F.xxhash64("t").alias("_h"))
    got = [r._h for r in lang_id.smallest_hashes(rows, "g", F.lit(60)).collect()]
    assert sorted(got) == sorted(r._h for r in rows.distinct().collect())[:60]
    assert lang_id.smallest_hashes(rows, "g", F.lit(300)).count() == 101


def test_language_held_out_accuracy(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = lang_id.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.where("lang = lang_pred").count() >= 0.97 * out.count()
    got = lang_id.languages(odd).collect()
    assert len(got) == odd.count() and all(r.lang_pred == "und" for r in got if r.doc_id in (3, 4, 5)) and all(0 <= r.score <= 1 for r in got)
    assert lang_id.languages(empty).count() == 0


def test_toxicity(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").select("toxic", "predicted").collect()
    hits = sum(r.toxic == r.predicted == 1 for r in out)
    # 295 toxic training texts only: clean documents are left alone, what is found is right.
    assert hits >= 0.4 * sum(r.toxic == 1 for r in out) and hits >= 0.75 * sum(r.predicted == 1 for r in out)
    got = toxicity.toxicity(odd, labels.limit(0)).collect()
    assert len(got) == odd.count() and all(r.score == 0 and r.predicted == 0 for r in got)
    assert toxicity.toxicity(empty, labels).count() == 0


def test_toxicity_is_found_on_made_rows(spark):
    import random

    from conftest import words as made

    rnd = random.Random(17)
    bad = ["".join(rnd.choice(("vex", "gri", "dul", "kor", "zag", "mub")) for _ in range(3)) for _ in range(40)]
    rows, marks = [], []
    for i in range(3000):
        w, toxic = made(rnd, rnd.randint(30, 150)), int(i % 4 == 0)
        for _ in range(len(w) // 6 if toxic else 0):
            w[rnd.randrange(len(w))] = rnd.choice(bad) + rnd.choice(("", "s", "ed"))
        rows.append((i, " ".join(w)))
        marks += [(i, toxic)] * (1 + i % 2) + ([(i, None)] if i % 5 == 0 else [])  # repeated and null labels
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int").withColumn("quality", F.lit(1))
    truth = {i: t for i, t in marks if t is not None}
    out = [(truth[r.doc_id], r.predicted) for r in toxicity.toxicity(docs, labels).where("held_out").collect()]
    hits = sum(t == p == 1 for t, p in out)
    assert hits >= 0.9 * sum(t for t, _ in out) and hits >= 0.9 * sum(p for _, p in out)


def test_toxicity_scores_match_a_plain_loop():
    import random

    import zstandard

    rnd = random.Random(5)
    plain = ["alder", "birch", "cedar", "maple", "willow", "poplar", "linden", "hazel"]
    make = lambda bad: " ".join(rnd.choice(["vexgrim", "dulkorf"] if rnd.random() < bad else plain) + rnd.choice(["", "s", "en"]) for _ in range(rnd.randint(1, 90)))
    model = toxicity.Model([make(0.2) for _ in range(60)], [make(0.0) for _ in range(120)], 3.0)
    texts = [make(rnd.choice([0, 0.05, 0.3])) for _ in range(60)] + [None, "", " \n", "vexgrim"]

    def size(window, content, room):
        how = zstandard.ZstdCompressionParameters(window_log=17, chain_log=17, hash_log=16, search_log=6, min_match=3, target_length=64, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False)
        d = zstandard.ZstdCompressionDict(content.rjust(room, b"\x00") + toxicity.PRIMER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=how)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress(window))

    def step(v, steps):
        at = 0.0
        for x, p in zip(*steps, strict=True):
            at = p if v >= x else at
        return at

    room = max(len(model.toxic), len(model.ordinary))
    for text, got in zip(texts, model.scores(texts), strict=True):
        words = (text or "").encode().lower().split()
        ws = [toxicity.PRIMER + b" " + b" ".join(words[i : i + 5]) + b" " for i in range(0, len(words), 5)]
        ev = [size(w, model.ordinary, room) - size(w, model.toxic, room) for w in ws]
        best = max(step(sum(e >= level for e in ev) / (1 + slope * len(ev) / 100), steps) for level, slope, steps in model.thresholds.levels)
        assert got == step(best, model.thresholds.last) and 0 <= got <= 1
    found = model.scores([make(0.3) for _ in range(50)] + [make(0.0) for _ in range(50)]) >= 0.7
    assert found[:50].mean() > 0.8 and found[50:].mean() < 0.1


def test_isotonic_steps_match_all_partitions():
    from itertools import combinations

    rng = np.random.default_rng(3)
    for _ in range(30):
        n = int(rng.integers(1, 7))
        x, y, w = np.arange(n).astype(float), rng.integers(0, 2, n).astype(float), rng.uniform(0.5, 2, n)
        got = toxicity.stepped(x, toxicity.isotonic(x, y, w))
        best = None
        for k in range(n):
            for cuts in combinations(range(1, n), k):
                parts = np.split(np.arange(n), cuts)
                means = [np.average(y[p], weights=w[p]) for p in parts]
                if all(a <= b for a, b in zip(means, means[1:])):
                    fit = np.concatenate([np.full(len(p), m) for p, m in zip(parts, means)])
                    loss = (w * (y - fit) ** 2).sum()
                    if best is None or loss < best[0] - 1e-12:
                        best = loss, fit
        assert np.allclose(got, best[1])


def test_jaccard_components_do_not_depend_on_what_is_hot(spark, monkeypatch):
    import random

    from docketlens.llm import common

    rnd = random.Random(11)
    base = [[f"w{rnd.randrange(400)}" for _ in range(40)] for _ in range(4)]
    rows = []
    for i in range(120):
        w = list(base[i % 4])
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = f"x{i % 7}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {tuple(r) for r in jaccard.near_duplicates(docs).collect()}
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(common, "HOT_KEYS", 5)
    monkeypatch.setattr(jaccard, "LONG_PAIRS", 4)
    monkeypatch.setattr(jaccard, "LIST_BLOCK", 3)
    monkeypatch.setattr(jaccard, "LEADER_ROUNDS", 0)
    assert {tuple(r) for r in jaccard.near_duplicates(docs).collect()} == want
