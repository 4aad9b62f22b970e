"""Language identification by nearest centroid.

A text is its n-grams of one to three letters (other characters are a space),
hashed into ``2**BITS`` places, weighted by TF-IDF and normalised.  Each
language has several centroids, clustered from its training vectors; the
nearest by cosine names the language.  A text further from its centroid than
that cluster's own texts are is flagged ``rejected``.

The classifier is fitted on a bounded sample of the labelled rows: at most
``PER_LANG`` a language and ``TOTAL`` in all, those with the smallest hash of
the text.  Prediction reads whole texts and nothing but the text.

Defined results: null text or text without a letter: ``und``, score 0, not
rejected; no training rows: every text is ``und``; null languages are not
learned; repeated rows count each; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, crc_mod

BITS, PER_LANG, TOTAL, CLUSTERS, SHARPNESS = 12, 300, 4000, 4, 25.0

_FOLD: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """Code point -> lower-case code point of a letter, else 32."""
    global _FOLD
    if _FOLD is None:
        table = np.full(sys.maxunicode + 1, 32, np.uint32)
        for c in range(sys.maxunicode + 1):
            if unicodedata.category(ch := chr(c))[0] == "L":
                table[c] = ord(ch.lower()[0])
        _FOLD = table
    return _FOLD


def counts(text: str, bits: int = BITS) -> np.ndarray | None:
    """Hashed n-gram counts of a whole text; None without a letter."""
    codes = fold_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = codes == 32
    if space.all():
        return None
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    c = np.concatenate([[32], codes[keep], [32]]).astype(np.uint32)
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (c[1:] * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
    three = (two[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    shift = np.uint32(32 - bits)
    out = np.bincount(one[c != 32] >> shift, minlength=1 << bits)
    out += np.bincount(two >> shift, minlength=1 << bits)
    out += np.bincount(three >> shift, minlength=1 << bits)
    return out.astype(np.float32)


def vectors(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(rows) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; deterministic."""
    seeds = [int(np.argmax(x @ x.mean(0)))]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin((x @ x[seeds].T).max(1))))
    c = x[seeds]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


class Model:
    """Centroids with their language and the cosine below which a text is rejected."""

    def __init__(self, samples: list[tuple[str, np.ndarray]], clusters: int = CLUSTERS):
        self.langs = sorted({lang for lang, _ in samples})
        raw = np.stack([v for _, v in samples])
        self.idf = (np.log((1 + len(raw)) / (1 + (raw > 0).sum(0))) + 1).astype(np.float32)
        x = vectors(raw, self.idf)
        lang = np.array([v for v, _ in samples])
        centroids, owner, least = [], [], []
        for i, name in enumerate(self.langs):
            own = x[lang == name]
            for c in cluster(own, clusters):
                centroids.append(c)
                owner.append(i)
        self.centroids, self.owner = np.stack(centroids).astype(np.float32), np.array(owner)
        sims = x @ self.centroids.T
        near = sims.argmax(1)
        for j in range(len(owner)):
            own = sims[near == j, j]
            least.append(float(own.min() - 0.5 * own.std()) if len(own) else -1.0)
        self.least = np.array(least)

    def predict(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score in 0..1, and whether the distance is too large."""
        sims = vectors(raw, self.idf) @ self.centroids.T
        best = np.full((len(raw), len(self.langs)), -1.0)
        for i in range(len(self.langs)):
            best[:, i] = sims[:, self.owner == i].max(1)
        near = sims.argmax(1)
        soft = np.exp(SHARPNESS * (best - best.max(1, keepdims=True)))
        winner = self.owner[near]
        score = soft[np.arange(len(raw)), winner] / soft.sum(1)
        return winner, np.clip(score, 0, 1), sims[np.arange(len(raw)), near] < self.least[near]


def smallest_hashes(rows: DataFrame, group: str, bound) -> DataFrame:
    """``group, _h``: each group's ``bound`` smallest distinct hashes, or all of fewer.

    Only hashes below the share that some four times the bound are expected
    under reach the ranking: no task sees more of a group, whatever its size.
    The share is of distinct hashes, so copies take nothing from it.
    """
    rows = rows.select(group, "_h").distinct()
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    told = sizes.select(F.col(group).alias("_g"), F.least(F.lit(1.0), 4.0 * bound / F.col("n")).alias("_f"), bound.alias("_b"))
    low = rows.join(F.broadcast(told), F.col(group) == F.col("_g")).where("_h / 9223372036854775808D <= 2 * _f - 1")
    first = Window.partitionBy(group).orderBy("_h")
    return low.select(group, "_h", "_b").withColumn("_r", F.row_number().over(first)).where("_r <= _b").select(group, "_h")


def fit(train: DataFrame, per_lang: int = PER_LANG, total: int = TOTAL) -> Model | None:
    """``text, lang`` -> model; None without usable rows."""
    labelled = train.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang", F.xxhash64("text").alias("_h"))
    langs = max(1, labelled.select("lang").distinct().count())
    bound = max(10, min(per_lang, total // langs))
    chosen = smallest_hashes(labelled, "lang", F.lit(bound))
    sample = labelled.join(F.broadcast(chosen), ["lang", "_h"]).dropDuplicates(["lang", "_h"]).select("text", "lang")

    def vectorise(batches):
        for batch in batches:
            texts, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [(n, c) for t, n in zip(texts, names, strict=True) if (c := counts(t)) is not None]
            yield pa.RecordBatch.from_pydict({"lang": [n for n, _ in found], "v": [c.tobytes() for _, c in found]}, schema=pa.schema([("lang", pa.string()), ("v", pa.binary())]))

    rows = sample.mapInArrow(vectorise, "lang string, v binary").collect()  # at most ``total`` fixed-width vectors
    samples = sorted((r.lang, bytes(r.v)) for r in rows)
    return Model([(lang, np.frombuffer(v, np.float32)) for lang, v in samples]) if samples else None


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``lang_pred, score, rejected`` of every whole text."""
    bound_batches(docs.sparkSession)
    kept = docs.select(*keep, "text")
    fields = [kept.schema[c] for c in keep]
    langs = model.langs if model else []

    def run(batches):
        for batch in batches:
            found = [None if t is None else counts(t) for t in batch.column(len(keep)).to_pylist()] if model else [None] * batch.num_rows
            at = [i for i, c in enumerate(found) if c is not None]
            lang, score, rejected = ["und"] * len(found), [0.0] * len(found), [False] * len(found)
            if at:
                for i, w, s, r in zip(at, *model.predict(np.stack([found[i] for i in at])), strict=True):
                    lang[i], score[i], rejected[i] = langs[w], float(s), bool(r)
            cols = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lang), pa.array(score, pa.float64()), pa.array(rejected)], names=[*keep, "lang_pred", "score", "rejected"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return kept.mapInArrow(run, f"{ddl}, lang_pred string, score double, rejected boolean")


def held_out(n: int, rest: int):
    """The rows whose crc32(doc_id as text) leaves ``rest``; false for a null id."""
    return F.coalesce(crc_mod(F.col("doc_id"), n) == rest, F.lit(False))


def languages(docs: DataFrame) -> DataFrame:
    """Fit on the rows that are not held out, predict all: ``doc_id, held_out, lang_pred, score, rejected``."""
    marked = docs.select("doc_id", "text", "lang", held_out(4, 2).alias("held_out"))
    model = fit(marked.where("NOT held_out AND doc_id IS NOT NULL"))
    return predict(marked, model, ["doc_id", "held_out"])
