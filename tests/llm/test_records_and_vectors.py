"""Archives and vector search."""

import hashlib
import random

import numpy as np
import pytest

from docketlens.llm import ann, warc


def test_arc_versions_round_trip():
    records = [("http://a/x y", b"HTTP/1.1 200 OK\r\n\r\npay\nload"), ("http://b/", b"HTTP/1.1 200 OK\r\n\r\n")]
    for version in (1, 2):
        found = list(warc.parse_arc(warc.arc_image(records, version)))
        assert [d for _, d in found] == [d for _, d in records] and found[0][0]["URL"] == "http://a/x%20y" and ("Checksum" in found[0][0]) == (version == 2)
    image = bytearray(warc.arc_image(records, 1))
    with pytest.raises(ValueError):
        list(warc.parse_arc(bytes(image[:-3])))


def test_archives(spark):
    big = "é" * 60
    rows = [(1, "http://a", big, "x"), (2, None, big, "x"), (2, None, big, "x"), (3, "http://c\n d", None, None), (4, "http://d", "WARC/1.1\r\n\r\n", None), (5, "u", "same", None), (6, "u", "same", None), (None, "u", big, None), (7, "u", "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = sorted((r.page_id if r.page_id is not None else -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived(pages).collect())
    want = []
    for key, _, html, _ in rows:
        p = (html or "").encode()
        again = len(p) >= 100 and key != 1
        want.append((-1 if key is None else key, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", 1 if again else None))
    assert got == sorted(want, key=lambda r: (r[0], r[1]))
    assert warc.archived(pages.limit(0)).count() == 0


def test_hilbert_is_a_curve():
    side = np.stack(np.meshgrid(range(8), range(8), range(8)), -1).reshape(-1, 3)
    keys = ann.hilbert(side, 3)
    path = side[np.argsort(keys)]
    assert sorted(keys) == list(range(512)) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def brute(rows, k=5):
    out = {}
    for q, v in rows:
        if q is None or q % 50:
            continue
        near = []
        for i, u in rows:
            if i is not None and i != q and u is not None and v is not None and len(u) == len(v):
                x, y = np.array(u, float), np.array(v, float)
                if np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any():
                    near.append((-round(float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y))), 9), i))
        if near:
            out[q] = [i for _, i in sorted(set(near))[:k]]
    return out


def test_search_recall_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 16))
    rows = [(i, [float(x) for x in centres[i % 20] + 0.2 * rng.standard_normal(16)]) for i in range(2000)]
    rows += [(3000 + i, [1.0] + [0.0] * 15) for i in range(200)]  # a hot vector
    rows += [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [None] * 16), (5200, []), (5250, [1.0, 2.0]), (5251, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df = df.unionByName(df.where("vec_id = 50"))
    got = {}
    for r in sorted(ann.search(df).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute([(i, None if v is None or None in v else v) for i, v in [(r.vec_id, r.embedding) for r in df.collect()]])
    assert set(got) == set(want) and got[5250] == [5251] and got[3000] == want[3000] and got[3150] == want[3150]
    recall = sum(len(set(got[q]) & set(want[q])) for q in want) / sum(map(len, want.values()))
    assert recall >= 0.9
    assert ann.search(df.limit(0)).count() == 0


def test_recall_on_the_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    p = df.toPandas()
    x = np.array(p.embedding.tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = p.vec_id.to_numpy()
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in got:
        s = x @ x[ids == q][0]
        s[ids == q] = -2
        hits += len(got[q] & set(ids[np.argsort(-s)[:5]]))
    assert hits >= 0.9 * 5 * len(got)


def test_recall_of_windows_smaller_than_the_table(spark):
    """Twenty noisy copies of every vector: the windows decide, and a query meets at most a fifth of the rows."""
    from pyspark.sql import functions as F

    base = np.array(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas().embedding.tolist(), float)
    x = np.repeat(base, 20, 0)
    x += 0.6 * base.std() * np.random.default_rng(1).standard_normal(x.shape)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.astype(np.float32).tolist())], "vec_id long, embedding array<float>")
    classes = ann.usable(df).select(F.col("vec_id").alias("cls"), (F.col("vec_id") % 50 == 0).alias("is_q"), "v")
    ranks = ann.ranked(ann.orderings(classes))
    reach = ann.window(classes, ranks)
    assert 0 < 2 * reach * ann.ORDERINGS <= len(x) / 5
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, len(u), 50):
        s = u @ u[q]
        s[q] = -2
        hits += len(got[q] & set(np.argpartition(-s, 5)[:5]))
    assert len(got) == len(u) // 50 and hits >= 0.9 * 5 * len(got)
