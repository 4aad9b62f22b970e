"""Benchmark decontamination: one Aho-Corasick automaton over normalised test questions and answers.

Normalising lower-cases A-Z and keeps words (runs of digits, letters a-z and
everything beyond ASCII), one space between them.  Every window of ``WINDOW``
consecutive words of an item is a pattern; an item of fewer words, but not
none, is one pattern.  A text is scanned once; a word inside any occurrence is
hit.  Hits are word numbers of the normalised text, and map back to code points
of the original.

The automaton holds at most about ``BLOCK_CHARS`` characters of patterns, so
that a worker's memory does not grow with the benchmark.  Patterns beyond that
go to further blocks, by their hash: each block is collected, sent and scanned
for by itself, and what the blocks found is put together by the text's hash.

Defined results: null and empty texts (of documents and items) have no words;
items with one id count once, however many rows or columns hold it; an item
without an id hits words but is not counted; equal patterns of several items
occur for all of them; a very long text is scanned whole, in time linear in its
length; repeated rows give a row each; an empty table on either side gives no
hits; further columns are kept where asked for, in a struct of their own, so
that no name clashes.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, stored

WINDOW = 10
#: Characters of patterns (and 8 for each item id of a pattern) in one automaton; a character is a node of some 40 bytes.
BLOCK_CHARS = 2_000_000

#: Bytes of UTF-8: ASCII that is no letter or digit is a space, A-Z is lowered, the rest stays.
_NORMAL = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()  # bytes.lower() knows ASCII only
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def words(text: bytes | None) -> list[bytes]:
    """The normalised words of a text in UTF-8."""
    return text.translate(_NORMAL).split() if text else []


def windows(of: list[bytes], length: int = WINDOW) -> set[bytes]:
    return {b" ".join(of[i : i + length]) for i in range(max(1, len(of) - length + 1))} if of else set()


def patterns(benchmark: DataFrame, columns: tuple[str, ...] = ("text",), length: int = WINDOW) -> DataFrame:
    """``pattern, items``: each distinct window and the ids of the items that hold it."""
    texts = reduce(DataFrame.unionAll, [benchmark.select(F.col("item_id").cast("long").alias("item"), F.col(c).alias("t")) for c in columns])

    def run(batches):
        for batch in batches:
            out = [(w.decode(), i) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True) for w in windows(words(t), length)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.string()), pa.array([i for _, i in out], pa.int64())], names=["pattern", "item"])

    return texts.mapInArrow(run, "pattern string, item long").groupBy("pattern").agg(F.collect_set("item").alias("items"))


class Scanner:
    """The automaton of some patterns and the items of each."""

    def __init__(self, rows: list[tuple[str, list[int]]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.lengths, self.items = [], []
        for i, (pattern, items) in enumerate(rows):
            self.automaton.add_word(f" {pattern} ", i)
            self.lengths.append(pattern.count(" ") + 1)
            self.items.append(items)
        if rows:
            self.automaton.make_automaton()

    def scan(self, of: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit words as disjoint ascending ranges (first, last), and the items found."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        if not of or not self.lengths:
            return spans, items
        text, at, word = f" {b' '.join(of).decode()} ", 0, -1
        for end, i in self.automaton.iter(text):  # ends ascend; a pattern ends on the space after its last word
            word, at = word + text.count(" ", at, end), end
            first = word - self.lengths[i] + 1
            while spans and first <= spans[-1][1] + 1:
                first = min(first, spans.pop()[0])
            spans.append((first, word))
            items.update(self.items[i])
        return spans, items


#: The scanner that this worker built last: tasks of one job share it.
_BUILT: dict[str, Scanner] = {}


def _scanner(key: str, rows) -> Scanner:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Scanner(rows)
    return _BUILT[key]


_FOUND = "n_words long, hits array<struct<first: int, last: int>>, items array<long>"
_HITS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _scan(rows: DataFrame, block: list, found_only: bool = False) -> DataFrame:
    """``row, n_words, hits, items`` from ``row, text``; with ``found_only`` just rows with hits."""
    kind, key, sent = rows.schema["row"].dataType.simpleString(), uuid.uuid4().hex, rows.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        scanner = _scanner(key, sent.value)
        for batch in batches:
            counts, hits, items = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                of = words(text)
                spans, found = scanner.scan(of)
                counts.append(len(of))
                hits.append([{"first": a, "last": b} for a, b in spans])
                items.append(sorted(found))
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(hits, _HITS), pa.array(items, pa.list_(pa.int64()))], names=["row", "n_words", "hits", "items"])
            yield out.filter(pa.array([bool(h) for h in hits])) if found_only else out

    return rows.mapInArrow(run, f"row {kind}, {_FOUND}")


def _merged(lists) -> list[dict[str, int]]:
    """The ranges of several blocks as disjoint ascending ones."""
    out: list[dict[str, int]] = []
    for h in sorted((h for hits in lists for h in hits), key=lambda h: h["first"]):
        if out and h["first"] <= out[-1]["last"] + 1:
            out[-1]["last"] = max(out[-1]["last"], h["last"])
        else:
            out.append(dict(h))
    return out


def _merge(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            hits = pa.array([_merged(x or ()) for x in batch.column(1).to_pylist()], _HITS)
            items = pa.array([sorted({i for part in x or () for i in part}) for x in batch.column(2).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), hits, items], names=["key", "hits", "items"])

    return rows.mapInArrow(run, "key struct<x: long, y: long>, hits array<struct<first: int, last: int>>, items array<long>")


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], columns: tuple[str, ...] = ("text",), length: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``row`` (a struct of the ``keep`` columns), ``n_words``, ``hits`` (ranges of word numbers), ``items`` (sorted ids)."""
    spark = docs.sparkSession
    bound_batches(spark)
    found = stored(patterns(benchmark, columns, length), "decontamination-patterns")
    total = found.agg(F.sum(F.length("pattern") + 8 * F.size("items"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    block = lambda b: [(r.pattern, r.items) for r in found.where(F.expr(f"pmod(xxhash64(pattern), {blocks})") == b).collect()]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), "text")
    if blocks == 1:
        return _scan(rows, block(0))
    key = F.struct(F.xxhash64("text").alias("x"), F.xxhash64(F.lit(1), "text").alias("y"))
    keyed, parts = docs.select(key.alias("row"), "text"), []
    for b in range(blocks):
        part = _scan(keyed, block(b), found_only=True).groupBy(F.col("row").alias("key")).agg(F.first("hits").alias("hits"), F.first("items").alias("items"))
        parts.append(stored(part, "decontamination-hits"))  # a row for each text with hits
    each = reduce(DataFrame.unionAll, parts).groupBy("key").agg(F.collect_list("hits").alias("hits"), F.collect_list("items").alias("items"))  # a list a block
    merged = _merge(each)
    counted = _scan(rows.select(F.struct("row", key.alias("key")).alias("row"), "text"), [])
    out = counted.select("row.row", F.col("row.key").alias("_key"), "n_words").join(merged, F.col("_key") == F.col("key"), "left")
    none = F.expr("cast(array() as array<struct<first: int, last: int>>)")
    return out.select("row", "n_words", F.coalesce("hits", none).alias("hits"), F.coalesce("items", F.expr("cast(array() as array<long>)")).alias("items"))


def digests(found: DataFrame) -> DataFrame:
    """``contamination``'s rows with ``n_hit, n_items, items_sha256, contaminated`` in place of their lists."""
    n_hit = F.expr("aggregate(hits, 0L, (n, h) -> n + h.last - h.first + 1)")
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("row", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def original_spans(text: str, hits: list) -> list[tuple[int, int]]:
    """Code points (end exclusive) of hit word ranges in the original text, ends included from first to last word."""
    if not hits:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[h["first"]][0], at[h["last"]][1]) for h in hits]


def without_benchmark(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents with every hit passage cut out of their texts, with the columns they came with; ``n_chars`` stays as it was."""
    spark, cols = docs.sparkSession, docs.columns
    found = contamination(docs, benchmark, cols, **how)
    kind = found.schema["row"].dataType.simpleString()
    at = cols.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(0).field(at).to_pylist()
            clean = []
            for text, hits in zip(texts, batch.column(1).to_pylist(), strict=True):
                for a, b in reversed(original_spans(text, hits) if hits else []):
                    text = text[:a] + text[b:]
                clean.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, pa.string())], names=["row", "clean"])

    bound_batches(spark)
    out = found.select("row", "hits").mapInArrow(run, f"row {kind}, clean string")
    return out.select(*[F.col("clean").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in cols])
