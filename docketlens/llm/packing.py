"""Packing token pieces into fixed-length sequences: first-fit decreasing.

Documents fall into groups by a hash, so that each group is a random sample of
about ``group_docs`` documents and packs on its own: bounded memory, no order
between groups, and as little waste as a global packing but for the last bins
of each group.  Inside a group the pieces go, longest first, each into the
first bin with room; a tournament tree over the bins' free room finds it in
O(log bins).

A document is cut at multiples of the sequence length; its full pieces fill a
sequence each, only its rest is packed with others.

Defined results: null text counts as empty (a piece of the end id alone);
repeated rows are packed each; equal sizes go in any order; a very long text is
looked up in parts, and its pieces may lie in several groups; further columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .tokenizing import tokenizer

LENGTH = 2048
#: Documents of a group, on average.
GROUP_DOCS = 4096


class Tournament:
    """Free room of bins 0..n-1; each inner node holds the most room below it."""

    def __init__(self, n: int, room: int):
        self.leaves = 1 << max(0, (max(n, 1) - 1).bit_length())
        self.most = [room] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """Put ``size`` into the first bin with that room and return the bin."""
        most, at = self.most, 1
        while at < self.leaves:
            at *= 2
            if most[at] < size:
                at += 1
        most[at] -= size
        bin_ = at - self.leaves
        at //= 2
        while at:
            more = most[2 * at] if most[2 * at] >= most[2 * at + 1] else most[2 * at + 1]
            if most[at] == more:
                break
            most[at] = more
            at //= 2
        return bin_


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size; equal sizes go in the order given."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    full = int((sizes == room).sum())
    bins[order[:full]] = np.arange(full)
    rest = order[full:]
    tree, used = Tournament(len(rest), room), np.zeros(max(1, len(rest)), np.int64).tolist()
    for k, size in zip(rest.tolist(), sizes[rest].tolist(), strict=True):
        b = tree.first_fit(size)
        bins[k], offsets[k] = full + b, used[b]
        used[b] += size
    return bins, offsets


def cut(docs: DataFrame, vocab: str, end_id: int, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, turn`` and, if asked for, ``ids`` (little-endian
    unsigned 32-bit): one row per piece; ``turn`` counts the pieces of a task."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("turn", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def pieces(batches):
        tok, turn, end = tokenizer(vocab), 0, np.array([end_id], "<u4")
        for batch in batches:
            rows = []
            for key, ids in zip(batch.column(0).to_pylist(), tok.arrays(batch.column(1).to_pylist()), strict=True):
                ids = np.concatenate([ids.astype("<u4", copy=False), end])
                for i in range(0, len(ids), length):
                    piece = ids[i : i + length].tobytes()
                    rows.append((key, i, len(piece) // 4, zlib.crc32(piece), len(ids), turn, piece)[: len(schema)])
                    turn += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    bound_batches(docs.sparkSession)
    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, turn long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, ddl)


def pack(pieces: DataFrame, n_docs: int, room: int = LENGTH, group_docs: int = GROUP_DOCS) -> DataFrame:
    """``doc_id, start, length, turn, ...`` -> the same without ``turn``, with ``sequence_id, offset``.

    Groups are dealt by every column that tells pieces apart, ``turn`` among
    them: rows without an id or repeated ones spread as all others do.
    """
    groups = max(1, -(-n_docs // group_docs))
    grouped = pieces.withColumn("_grp", F.pmod(F.xxhash64("doc_id", "start", "length", "turn"), F.lit(groups))).drop("turn")
    columns = [c for c in pieces.columns if c != "turn"]

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "start"], kind="stable", na_position="first")
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(np.int64), room)
        out = group[columns].copy()
        out["sequence_id"] = (int(group["_grp"].iloc[0]) << 32) + bins
        out["offset"] = offsets
        return out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "turn")
    return grouped.groupBy("_grp").applyInPandas(place, f"{fields}, sequence_id long, offset long")


def padded_length(used: int, room: int = LENGTH) -> int:
    """What a sequence takes: a power of two as it is, else ``room``."""
    return used if used and used & (used - 1) == 0 else room


def packed_digests(docs: DataFrame, vocab: str, end_id: int) -> DataFrame:
    """The pieces of all documents with ``ids_crc32`` and their place."""
    return pack(cut(docs, vocab, end_id), docs.count())
