"""Spelling variants: words one edit apart, by two-dimensional range reporting.

Words are sorted forwards and, spelt backwards, a second time: a point for each
word.  An edit of a word at position i leaves the i code points before it and
all behind it.  The words with the former are an interval of the forward order,
those with the latter an interval of the backward order, and the near words are
the points in both, read from a wavelet tree over backward ranks in forward
order.  There is a tree for each length: with a point's length known, what lies
between prefix and suffix is one code point.  So a word asks the tree of its
own length for replacements and the next one for insertions; a deletion is the
insertion seen from the longer word.

No task holds the dictionary.  It is cut into blocks of the forward and of the
backward order, by cuts from a bounded sample.  Edits in a word's second half
leave its first half, which is a short interval of the forward order: the word
visits the blocks that the interval meets, nearly always its own.  Edits in the
first half are those of the second half of the word spelt backwards.  A block's
words are held as its trees; visitors stream past them.

Only code points up to U+00FF are in words, so a word is a row of bytes.

Defined results: null and empty texts hold no words; rows without doc_id hold
words, of which none is changed; repeated rows are each counted; of near words
with equal n the first in code-point order is the form; a word of any length
is treated alike (it is compared with its two neighbours in each order before
any position is tried); an empty table has no words; further columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, stored

LEAST_LENGTH, LEAST_COUNT, CHANGED, FORM_RATIO = 6, 5, 199, 5
#: Words of a block, and bytes; blocks of either order at most (so that the cuts stay a bounded list).
BLOCK_WORDS, BLOCK_BYTES, MAX_BLOCKS, CUT_LENGTH = 5_000, 16 << 20, 10_000, 256
#: Words of the sample for each block.
CUT_SAMPLE = 20
#: Bytes of query strings and tree queries treated at once.
CHUNK_BYTES, CHUNK_QUERIES = 8 << 20, 1 << 18

_RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST_LENGTH)
_UPPER = str.maketrans({c: c + 32 for c in range(65, 91)})
_AFTER = "Ā"  # beyond every code point of a word


def text_words(text: str | None, doc_id: int | None) -> Counter:
    """Words of a text and how often it holds them, after the one change in ``CHANGED``."""
    out: Counter = Counter()
    seed = None if doc_id is None else zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(_RUN.findall(text or "")).items():
        run = run.translate(_UPPER)
        if seed is not None and (h := zlib.crc32(run.encode(), seed)) % CHANGED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LEAST_LENGTH:
            out[run] += n
    return out


def dictionary(docs: DataFrame, flush: int = 100_000) -> DataFrame:
    """``word, n``: the words of all texts with their occurrences, from ``LEAST_COUNT`` up."""
    bound_batches(docs.sparkSession)

    def run(batches):
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text, doc_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.update(text_words(text, doc_id))
                if len(counts) > flush:
                    yield out()
                    counts = Counter()
        if counts:
            yield out()

    partial = docs.select("text", F.col("doc_id").cast("long")).mapInArrow(run, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Wavelet:
    """A wavelet tree (as a matrix of levels) over a permutation of 0 .. n-1."""

    def __init__(self, values: np.ndarray):
        self.levels = max(1, int(len(values) - 1).bit_length())
        self.zeros, self.before = [], []
        for k in range(self.levels - 1, -1, -1):
            one = (values >> k & 1).astype(bool)
            rank = np.zeros(len(values) + 1, np.int64)
            np.cumsum(~one, out=rank[1:])
            self.zeros.append(rank)
            self.before.append(int(rank[-1]))
            values = np.concatenate([values[~one], values[one]])

    def report(self, lo, hi, low, high):
        """For each query the values v with low <= v < high at places lo .. hi-1: arrays of query numbers and values."""
        q = np.flatnonzero((lo < hi) & (low < high))
        left, right, v = lo[q], hi[q], np.zeros(len(q), np.int64)
        for rank, zeros, k in zip(self.zeros, self.before, range(self.levels - 1, -1, -1), strict=True):
            l0, r0 = rank[left], rank[right]
            q = np.concatenate([q, q])
            left, right, v = np.concatenate([l0, zeros + left - l0]), np.concatenate([r0, zeros + right - r0]), np.concatenate([v << 1, v << 1 | 1])
            stay = (left < right) & (v << k < high[q]) & (v + 1 << k > low[q])
            q, left, right, v = q[stay], left[stay], right[stay], v[stay]
        return q, v


def _strings(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as fixed-length strings."""
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each two rows (columns of the shorter)."""
    width = min(a.shape[1], b.shape[1])
    differ = a[:, :width] != b[:, :width]
    return np.where(differ.any(1), differ.argmax(1), width)


class SameLength:
    """The words of one length: both orders and the tree."""

    def __init__(self, rows: np.ndarray, counts: np.ndarray):
        forward = np.argsort(_strings(rows), kind="stable")
        self.rows, self.counts = rows[forward], counts[forward]
        self.forward = _strings(self.rows)
        backward = _strings(self.rows[:, ::-1])
        self.order = np.argsort(backward, kind="stable")  # backward rank -> forward rank
        self.backward = backward[self.order]
        rank = np.empty(len(self.order), np.int64)
        rank[self.order] = np.arange(len(self.order))
        self.tree = Wavelet(rank)

    def _nearest(self, strings: np.ndarray, rows: np.ndarray, spelt: np.ndarray, order) -> np.ndarray:
        """Longest prefix that each row shares with another word, in one order."""
        at = np.searchsorted(strings, spelt, "left")
        same = (at < len(strings)) & (strings[np.minimum(at, len(strings) - 1)] == spelt)
        best = np.full(len(rows), -1)
        for place in (at - 1, at + same):
            ok = (place >= 0) & (place < len(strings))
            which = self.rows[order[place[ok]] if order is not None else place[ok]]
            best[ok] = np.maximum(best[ok], _common(rows[ok], which if order is None else which[:, ::-1]))
        return best

    def near(self, rows: np.ndarray, start: int, spelt_back: bool):
        """Words of this length one replacement (rows of this length) or insertion (of one less) from ``rows``, at a position of
        at least ``start``: arrays of row and word numbers.  An insertion into a run of its letter is told at one position,
        the run's first in the word as it is spelt forwards."""
        length, width = rows.shape[1], self.rows.shape[1]
        back, spelt = rows[:, ::-1], _strings(rows)
        ahead = self._nearest(self.forward, rows, spelt, None)
        behind = self._nearest(self.backward, back, _strings(back), self.order)
        # Replacing at i leaves length - 1 - i behind it, inserting at i leaves length - i.
        first, last = np.maximum(start, width - 1 - behind), np.minimum(ahead, width - 1)
        tries = np.maximum(0, last - first + 1)
        found_row, found_word = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        ends = np.cumsum(tries)
        step = max(1, min(CHUNK_QUERIES, CHUNK_BYTES // (4 * width)))
        for begin in range(0, int(ends[-1]) if len(ends) else 0, step):
            number = np.arange(begin, min(begin + step, int(ends[-1])))
            q = np.searchsorted(ends, number, "right")
            i = first[q] + number - (ends[q] - tries[q])
            keep_behind = width - 1 - i
            lo, hi = self._interval(self.forward, rows[q], i, width)
            low, high = self._interval(self.backward, back[q], keep_behind, width)
            k, v = self.tree.report(lo, hi, low, high)
            word = self.order[v]
            at = i[k]
            if length == width:
                new = self.forward[word] != spelt[q[k]]
            elif spelt_back:
                new = (at == length) | (rows[q[k], np.minimum(at, length - 1)] != self.rows[word, at])
            else:
                new = (at == 0) | (rows[q[k], np.maximum(at - 1, 0)] != self.rows[word, at])
            found_row.append(q[k][new])
            found_word.append(word[new])
        return np.concatenate(found_row), np.concatenate(found_word)

    @staticmethod
    def _interval(strings: np.ndarray, rows: np.ndarray, n: np.ndarray, width: int):
        """Where the words that begin with the first n bytes of each row lie."""
        wide = np.zeros((len(rows), width), np.uint8)
        wide[:, : rows.shape[1]] = rows[:, :width]
        beyond = np.arange(width) >= n[:, None]
        low, high = np.where(beyond, 0, wide).astype(np.uint8), np.where(beyond, 255, wide).astype(np.uint8)
        return np.searchsorted(strings, _strings(low), "left"), np.searchsorted(strings, _strings(high), "right")


def cuts(words: DataFrame) -> tuple[list[str], list[str]]:
    """Where the forward and the backward order are cut into blocks; any cuts give the same result."""
    size = words.agg(F.count("*").alias("n"), F.sum(F.octet_length("word")).alias("bytes")).first()
    blocks = min(MAX_BLOCKS, max(1, size.n // BLOCK_WORDS, (size.bytes or 0) // BLOCK_BYTES))
    sample = words.where(F.expr(f"pmod(xxhash64(word), {max(1, size.n)}) < {CUT_SAMPLE * blocks}"))
    rows = sample.select(F.left("word", F.lit(CUT_LENGTH)).alias("f"), F.left(F.reverse("word"), F.lit(CUT_LENGTH)).alias("b")).collect() if blocks > 1 else []
    every = max(1, len(rows) // blocks)
    return sorted(r.f for r in rows)[every::every], sorted(r.b for r in rows)[every::every]


def routed(words: DataFrame, forward: list[str], backward: list[str]) -> DataFrame:
    """``side, block, visits, key, n``: every word in its block of either order (spelt backwards on side 1), and as a visitor in
    the other blocks where words begin with its first half."""

    def run(batches):
        for batch in batches:
            out = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                half = len(word) // 2
                for side, key, first, at in ((0, word, half, forward), (1, word[::-1], len(word) - half, backward)):
                    own = bisect_right(at, key)
                    for block in range(bisect_right(at, key[:first]), bisect_left(at, key[:first] + _AFTER) + 1):
                        out.append((side, block, int(block != own), key, n))
            types = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["side", "block", "visits", "key", "n"])

    bound_batches(words.sparkSession)
    return words.select("word", "n").mapInArrow(run, "side int, block int, visits int, key string, n long")


def _by_length(words: list[tuple[str, int]]):
    """Words as rows of bytes, with their counts, by length."""
    groups: dict[int, list[tuple[str, int]]] = {}
    for w in words:
        groups.setdefault(len(w[0]), []).append(w)
    for length, group in groups.items():
        rows = np.frombuffer("".join(w for w, _ in group).encode("latin-1"), np.uint8).reshape(-1, length)
        yield length, rows, np.array([n for _, n in group], np.int64)


def _pairs(trees: dict[int, SameLength], words: list[tuple[str, int]], side: int):
    """Batches of ``word, n, near, near_n`` for some words against a block's trees."""

    def told(rows, counts, near, near_counts):
        spelt = lambda r: [bytes(x).decode("latin-1") for x in (r[:, ::-1] if side else r)]
        columns = [pa.array(spelt(rows), pa.string()), pa.array(counts, pa.int64()), pa.array(spelt(near), pa.string()), pa.array(near_counts, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["word", "n", "near", "near_n"])

    for length, rows, counts in _by_length(words):
        half = length - length // 2 if side else length // 2
        for tree, start in ((trees.get(length), half), (trees.get(length + 1), half + side)):
            if tree is None:
                continue
            q, v = tree.near(rows, start, bool(side))
            if len(q):
                yield told(rows[q], counts[q], tree.rows[v], tree.counts[v])
                if tree.rows.shape[1] != length:
                    yield told(tree.rows[v], tree.counts[v], rows[q], counts[q])


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n`` for every word and every word one edit from it, once."""
    rows = routed(words, *cuts(words)).repartition("side", "block").sortWithinPartitions("side", "block", "visits")

    def run(batches):
        block, members, trees = None, [], None

        def built():
            return {length: SameLength(r, c) for length, r, c in _by_length(members)}

        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(3)]
            keys, n = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            change = np.flatnonzero((np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0) | (np.diff(columns[2]) != 0)) + 1
            for a, b in zip([0, *change], [*change, len(keys)], strict=True):
                if a == b:
                    continue
                here, visits = (int(columns[0][a]), int(columns[1][a])), columns[2][a]
                if here != block:
                    if trees is None and members:
                        yield from _pairs(built(), members, block[0])
                    block, members, trees = here, [], None
                own = list(zip(keys[a:b], n[a:b], strict=True))
                if not visits:
                    members += own
                    continue
                if trees is None:
                    trees = built()
                    yield from _pairs(trees, members, block[0])
                yield from _pairs(trees, own, block[0])
        if trees is None and members:
            yield from _pairs(built(), members, block[0])

    return rows.mapInArrow(run, "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: each word's pointer is doubled until none moves.  A form's n is at least
    ``FORM_RATIO`` times its word's, so no chain is longer than 28 steps and five rounds reach all ends."""
    at = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(5):
        on = at.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        moved = stored(at.join(on, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "spelling-roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return at


def variants(docs: DataFrame) -> DataFrame:
    """Each word with ``form, root, n, n_near, form_n``."""
    words = stored(dictionary(docs), "spelling-words")
    best = near_pairs(words).groupBy("word").agg(F.first("n").alias("n"), F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    stands = F.expr(f"-best.less >= {FORM_RATIO} * n")
    near = stored(best.select(F.col("word").alias("_n"), "n_near", F.when(stands, F.col("best.near")).alias("form"), F.when(stands, -F.col("best.less")).alias("form_n")), "spelling-near")
    ends = roots(near.where("form IS NOT NULL").select(F.col("_n").alias("word"), "form")).select(F.col("word").alias("_w"), "root")
    out = words.join(near, F.col("word") == F.col("_n"), "left").join(ends, F.col("word") == F.col("_w"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
