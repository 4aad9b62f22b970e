"""Toxicity by compression distance.

Two zstandard dictionaries are trained by the library's trainer, one on toxic
and one on ordinary text.  What of a class's texts the trainer gets to see are
the byte strings inside words that many documents of the class share and few of
the other class do (and, for ordinary text, what the toxic strings share with
it), as often as they stand in its documents; the rest of a text is alike in
both classes and would fill both dictionaries.  A text is read in windows of
whole words; a window's evidence is how many bytes shorter it becomes with the
toxic dictionary than with the ordinary one.

Thresholds are calibrated on training documents.  For each of a few levels of
evidence, the windows that reach it are counted against the text's length, at
the slope that tells the classes apart best; the count's threshold is what
makes a document toxic with a stated chance.  A document's score is the highest
chance that any level gives it, set right once more for taking the highest.
Both calibrations are monotone steps, with documents weighed as often as their
class occurs in the training rows.

Both dictionaries end in the same primer, with which every window starts: the
fixed cost of a first match is then paid alike by all windows, and one short
string found is enough to be seen.

The classifier is fitted on a bounded sample of labelled training documents
(at most ``PER_CLASS`` toxic and twice as many ordinary ones, those with the
smallest hash of the text, and of these at most ``SAMPLE_BYTES`` a class).
Scoring reads whole texts and nothing but the text.

Defined results: null or empty text scores as a document without evidence;
null labels are not learned; an id with both labels is learned with both; ids
in several rows are learned with each text; without both labels every score is
0; repeated rows of a text count once in the sample; where the strings are too
few for the trainer, they are the dictionary as they are; a very long text has
more windows, at the same memory a batch; further columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, stored
from .lang_id import held_out, smallest_hashes

WINDOW_WORDS, PER_CLASS, SAMPLE_BYTES, THRESHOLD = 5, 1200, 32 << 20, 0.7
#: A dictionary string: its lengths, the share of the class's documents that hold
#: it, how many times the other class's share that is; and the dictionary's size.
SHORTEST, LONGEST, SUPPORT, RATIO, DICT_BYTES = 5, 11, 0.03, 20, 16384
#: Segments of the trainer and the strings it counts, in bytes; what parts the strings of a sample.
SEGMENT, STRING, GAP = 16, 6, b"\x00\x00"
#: Levels of evidence, and how many more windows a text of 100 windows may hold by chance, to try.
LEVELS, SLOPES = (1, 2, 3, 4, 5, 6), (0.0, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0)
PRIMER = b"\x01ab\x02cd\x03ef\x04gh\x05"


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def windows(text: str | None) -> list[bytes]:
    """Runs of ``WINDOW_WORDS`` words of the whole text, ASCII lower-cased."""
    words = tokens(text)
    return [PRIMER + b" " + b" ".join(words[i : i + WINDOW_WORDS]) + b" " for i in range(0, len(words), WINDOW_WORDS)]


def distinct_texts(texts: list[str]) -> list[str]:
    """Without near copies, which would make any of their words seem typical: texts
    that share one of four minimum hashes of word runs count once."""
    seen, out = set(), []
    for text in texts:
        w = tokens(text)
        runs = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
        keys = {(j, min(zlib.crc32(r, 7919 * j) for r in runs)) for j in range(4)}
        if not keys & seen:
            out.append(text)
        seen |= keys
    return out


def _strings(words: set[bytes], n: int, inner: set[bytes] | None) -> set[bytes]:
    """Strings of length n inside words (with a space at either end); if given, only those
    whose first and last n - 1 bytes are in ``inner``."""
    out = set()
    for w in words:
        w = b" " + w + b" "
        for i in range(len(w) - n + 1):
            g = w[i : i + n]
            if inner is None or (g[:-1] in inner and g[1:] in inner):
                out.add(g)
    return out


def _holding(texts: list[set[bytes]], wanted: set[bytes]) -> Counter:
    """How many texts hold each wanted string inside a word."""
    lengths, out = sorted({len(g) for g in wanted}), Counter()
    for words in texts:
        here = set()
        for w in words:
            w = b" " + w + b" "
            here.update(g for n in lengths for i in range(len(w) - n + 1) if (g := w[i : i + n]) in wanted)
        out.update(here)
    return out


def _maximal(strings: dict[bytes, int], share: float) -> dict[bytes, int]:
    """Without strings inside a longer one that is about as frequent."""
    out: dict[bytes, int] = {}
    for g in sorted(strings, key=lambda g: (-len(g), -strings[g], g)):
        if not any(g in h and k >= share * strings[g] for h, k in out.items()):
            out[g] = strings[g]
    return out


def typical(own: list[set[bytes]], other: list[set[bytes]]) -> tuple[dict[bytes, int], dict[bytes, int]]:
    """Strings that many documents of ``own`` share and few of ``other`` do; and the parts of
    these strings that are not typical, which ``other`` must have too: then a match of such a
    part alone is no evidence, only what goes beyond it."""
    least, frequent, inner = max(6, SUPPORT * len(own)), {}, None
    for n in range(SHORTEST, LONGEST + 1):
        found = Counter()
        for words in own:
            found.update(_strings(words, n, inner))
        found = {g: k for g, k in found.items() if k >= least}
        if not found:
            break
        frequent |= found
        inner = set(found)
    elsewhere = _holding(other, set(frequent))
    chosen = _maximal({g: k for g, k in frequent.items() if k / len(own) >= RATIO * (elsewhere[g] + 1) / (len(other) + 1)}, 0.6)
    parts = {g[i:j] for g in chosen for i in range(len(g)) for j in range(i + 4, len(g) + 1)} - set(chosen)
    here, there = _holding(own, parts), _holding(other, parts)
    plain = {g: there[g] for g in parts if there[g] > 0 and here[g] / len(own) < RATIO * (there[g] + 1) / (len(other) + 1)}
    return chosen, _maximal(plain, 0.0)


def samples(texts: list[str], strings) -> list[bytes]:
    """Of each text with any of the strings, all that stand in it, one after another."""
    if not strings:
        return []
    any_ = re.compile(b"|".join(re.escape(g) for g in sorted(strings, key=lambda g: (-len(g), g))))
    found = (any_.findall(b" " + b"  ".join(tokens(t)) + b" ") for t in texts)
    return [GAP.join([b"", *f, b""]) for f in found if f]


def trained(parts: list[bytes]) -> bytes:
    """A dictionary's bytes, by the library's trainer."""
    parts = [p.ljust(8, b"\x00") for p in parts]
    try:
        return zstandard.train_dictionary(DICT_BYTES, parts, k=SEGMENT, d=STRING).as_bytes()
    except zstandard.ZstdError:  # too few
        return b"".join(sorted(set(parts)))[-DICT_BYTES:]


class Compressor:
    def __init__(self, content: bytes, size: int):
        how = zstandard.ZstdCompressionParameters(
            window_log=17, chain_log=17, hash_log=16, search_log=6, min_match=3, target_length=64, strategy=zstandard.STRATEGY_BTOPT,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        d = zstandard.ZstdCompressionDict(content.rjust(size, b"\x00") + PRIMER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=how)
        self.one = zstandard.ZstdCompressor(dict_data=d, compression_params=how)

    def lengths(self, items: list[bytes]) -> np.ndarray:
        run = self.one.compress
        return np.fromiter((len(run(x)) for x in items), np.int32, len(items))


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From which ``x`` on, and how large, the steps of the best non-decreasing fit of ``y`` are."""
    steps: list[list[float]] = []  # mean, weight, first x
    values, at = np.unique(x, return_inverse=True)
    w = np.bincount(at, weight)
    for v, mean, k in zip(values, np.bincount(at, weight * y) / w, w, strict=True):
        steps.append([mean, k, v])
        while len(steps) > 1 and steps[-2][0] >= steps[-1][0]:
            m, k, _ = steps.pop()
            last = steps[-1]
            last[0], last[1] = (last[0] * last[1] + m * k) / (last[1] + k), last[1] + k
    return np.array([s[2] for s in steps]), np.array([s[0] for s in steps])


def stepped(x: np.ndarray, steps: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    k = np.searchsorted(steps[0], x, side="right")
    return np.where(k > 0, steps[1][np.maximum(k - 1, 0)], 0.0)


class Thresholds:
    """Windows' evidence -> the chance that the document is toxic."""

    def __init__(self, evidence: list[np.ndarray], y: np.ndarray, weight: np.ndarray):
        self.levels = []
        for level in LEVELS:
            best = None
            for slope in SLOPES:
                x = self.counted(evidence, level, slope)
                steps = isotonic(x, y, weight)
                hit = stepped(x, steps) >= THRESHOLD
                f = 2 * weight[hit & (y == 1)].sum() / (weight[hit].sum() + weight[y == 1].sum())
                if best is None or f > best[0]:
                    best = f, slope, steps
            self.levels.append((level, best[1], best[2]))
        self.last = isotonic(self.highest(evidence), y, weight)

    @staticmethod
    def counted(evidence: list[np.ndarray], level: int, slope: float) -> np.ndarray:
        """Windows that reach the level, for one and ``slope`` more in a hundred windows."""
        return np.array([(e >= level).sum() / (1 + slope * len(e) / 100) for e in evidence])

    def highest(self, evidence: list[np.ndarray]) -> np.ndarray:
        return np.max([stepped(self.counted(evidence, level, slope), steps) for level, slope, steps in self.levels], axis=0)

    def scores(self, evidence: list[np.ndarray]) -> np.ndarray:
        return stepped(self.highest(evidence), self.last)


class Model:
    """``ordinary_share``: ordinary training texts for each toxic one, of which the samples may hold fewer."""

    def __init__(self, toxic: list[str], ordinary: list[str], ordinary_share: float):
        toxic, ordinary = distinct_texts(toxic), distinct_texts(ordinary)
        sets = [[set(tokens(t)) for t in part] for part in (toxic, ordinary)]
        (toxic_own, toxic_parts), (plain_own, plain_parts) = typical(*sets), typical(*sets[::-1])
        self.toxic = trained(samples(toxic, set(toxic_own) | set(plain_parts)))
        self.ordinary = trained(samples(ordinary, set(plain_own) | set(toxic_parts)))
        evidence = [self.evidence(windows(t)) for t in (*toxic, *ordinary)]
        y = np.repeat([1.0, 0.0], [len(toxic), len(ordinary)])
        self.thresholds = Thresholds(evidence, y, np.where(y == 1, 1.0, ordinary_share * len(toxic) / len(ordinary)))

    def evidence(self, items: list[bytes]) -> np.ndarray:
        if getattr(self, "_ready", None) is None:
            size = max(len(self.ordinary), len(self.toxic))
            self._ready = Compressor(self.ordinary, size), Compressor(self.toxic, size)
        return (self._ready[0].lengths(items) - self._ready[1].lengths(items)).astype(np.float64)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return self.thresholds.scores([self.evidence(windows(t)) for t in texts])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_ready"}


def fit(train: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """``doc_id, text`` and ``doc_id, toxic`` -> model; None unless both labels occur.

    Labels meet ids and hashes of texts; only the chosen texts move, by their hash.
    """
    hashed = train.where("text IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("_h"))
    known = labels.select(F.col("doc_id").alias("_id"), "toxic").where("toxic IN (0, 1)")
    rows = stored(hashed.select("doc_id", "_h").join(known, F.col("doc_id") == F.col("_id")).select("toxic", "_h"), "toxic-labelled")
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count_distinct("_h").alias("n")).collect()}  # two rows at most
    if len(n) < 2:
        return None
    chosen = smallest_hashes(rows, "toxic", F.when(F.col("toxic") == 1, per_class).otherwise(2 * per_class))
    wanted = hashed.select("text", "_h").join(F.broadcast(chosen), "_h")
    sizes = wanted.groupBy("toxic", "_h").agg(F.max(F.octet_length("text")).alias("_size"))
    so_far = F.sum("_size").over(Window.partitionBy("toxic").orderBy("_h"))
    sizes = stored(sizes.withColumn("_sum", so_far).where((F.col("_sum") <= SAMPLE_BYTES) | (F.col("_sum") == F.col("_size"))), "toxic-sample")
    sample = hashed.select("text", "_h").join(F.broadcast(sizes.select("toxic", "_h")), "_h").dropDuplicates(["toxic", "_h"])
    found = sorted((r.toxic, r._h, r.text) for r in sample.collect())  # at most 3 * per_class texts, 2 * SAMPLE_BYTES
    toxic, ordinary = ([t for k, _, t in found if k == v] for v in (1, 0))
    return Model(toxic, ordinary, n[0] / n[1])


def predict(docs: DataFrame, model: Model | None, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns with ``score`` and ``predicted`` of every whole text."""
    bound_batches(docs.sparkSession)
    kept = docs.select(*keep, "text")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keep)

    def run(batches):
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            score = model.scores(texts) if model and texts else np.zeros(len(texts))
            cols = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], names=[*keep, "score", "predicted"])

    return kept.mapInArrow(run, f"{ddl}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on labelled rows that are not held out, score all: ``doc_id, held_out, score, predicted``."""
    marked = docs.select("doc_id", "text", held_out(3, 1).alias("held_out"))
    train = marked.where("NOT held_out AND doc_id IS NOT NULL")
    return predict(marked, fit(train, labels), ["doc_id", "held_out"])
