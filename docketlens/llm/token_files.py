"""Token files: ids at a fixed width of the fewest bits the vocabulary needs.

A shard image is one self-describing byte string::

    magic "DLTK" | version u16 | bits u16 | block u32 | docs u32 | ids u64
    doc_id i64 x docs | null flag u8 x docs | first id of each document u64 x (docs + 1)
    byte offset of each block u64 x (blocks + 1) | packed blocks

(all little-endian).  Every block holds ``block`` ids (the last one the rest),
padded to whole bytes, so that any range of ids is read by unpacking only its
blocks, vectorised.  Images are the rows of a Parquet table: Spark commits
them, so a lost executor's images are written again and never seen twice.

Defined results: null text counts as empty (its document is the end id alone);
documents go in ascending ``doc_id`` (null first), equal ids by a hash of the
text, equal rows in any order; a very long text is looked up in parts and may
make its shard longer than ``SHARD_IDS``; further columns are ignored; an empty
table gives an empty table of files.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, scratch
from .tokenizing import tokenizer

MAGIC, VERSION = b"DLTK", 1
_HEAD = struct.Struct("<4sHHIIQ")
#: Ids of a block, and ids after which a shard is closed.
BLOCK, SHARD_IDS = 4096, 1 << 20


def bits_for(vocab_size: int) -> int:
    """The fewest bits that hold every id below ``vocab_size``."""
    return max(1, int(vocab_size - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids, least significant bit first, without gaps; padded to whole bytes."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count=n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits)
    return (flat.reshape(n, bits).astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def build_image(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    blocks = [pack_bits(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks], dtype=np.uint64)]).astype("<u8")
    starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.uint64)]).astype("<u8")
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return b"".join([_HEAD.pack(MAGIC, VERSION, bits, block, len(doc_ids), len(ids)), keys.tobytes(), nulls.tobytes(), starts.tobytes(), offsets.tobytes(), *blocks])


class Image:
    """Random access to a shard image."""

    def __init__(self, data: bytes):
        magic, version, self.bits, self.block, docs, self.n_ids = _HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file of this version")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.null = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.starts = np.frombuffer(data, "<u8", docs + 1, at := at + 9 * docs)
        blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at := at + 8 * (docs + 1))
        self.data, self.at = data, at + 8 * (blocks + 1)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """The ids from ``begin`` to ``end``, unpacking only the blocks that hold them."""
        if end <= begin:
            return np.empty(0, np.uint32)
        first, last, out = begin // self.block, (end - 1) // self.block, []
        for b in range(first, last + 1):
            n = min(self.block, self.n_ids - b * self.block)
            out.append(unpack_bits(self.data[self.at + int(self.offsets[b]) : self.at + int(self.offsets[b + 1])], n, self.bits))
        return np.concatenate(out)[begin - first * self.block : end - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


IMAGES = "part int, shard int, start_in_part long, n_docs long, n_ids long, image binary"
_ARROW = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("start_in_part", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("image", pa.binary())])


def _writer(vocab: str, end_id: int, shard_ids: int):
    def write(batches):
        from pyspark import TaskContext

        tok, part = tokenizer(vocab), TaskContext.get().partitionId()
        bits, end = bits_for(max(tok.vocab_size, end_id + 1)), np.array([end_id], np.uint32)
        docs, lengths, held, n, shard, start = [], [], [], 0, 0, 0

        def close():
            image = build_image(docs, lengths, np.concatenate(held), bits)
            return pa.RecordBatch.from_pydict({"part": [part], "shard": [shard], "start_in_part": [start], "n_docs": [len(docs)], "n_ids": [n], "image": [image]}, schema=_ARROW)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for key, ids in zip(keys, tok.arrays(batch.column(1).to_pylist()), strict=True):
                docs.append(key)
                held += (ids, end)
                lengths.append(len(ids) + 1)
                n += lengths[-1]
                if n >= shard_ids:
                    yield close()
                    docs, lengths, held, shard, start, n = [], [], [], shard + 1, start + n, 0
        if docs:
            yield close()

    return write


def write_token_files(docs: DataFrame, path: str, vocab: str, end_id: int, shard_ids: int = SHARD_IDS) -> None:
    """Encode ``doc_id, text`` and write shard images in ascending ``doc_id`` order to ``path``."""
    bound_batches(docs.sparkSession)
    # The third key lets equal rows spread over several ranges.
    ordered = (
        docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_h"), (F.monotonically_increasing_id() % 1021).alias("_s"))
        .repartitionByRange("doc_id", "_h", "_s")
        .sortWithinPartitions("doc_id", "_h", "_s")
        .select("doc_id", "text")
    )
    ordered.mapInArrow(_writer(vocab, end_id, shard_ids), IMAGES).write.parquet(path)


_DIGEST = "doc_id long, start_in_part long, n_tokens long, ids_crc32 long"


def _digests(batches):
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("start_in_part", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for part, start, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            image = Image(data)
            # Whole blocks are unpacked once, then cut into documents.
            ids = image.ids(0, image.n_ids).astype("<u4")
            n = len(image.doc_ids)
            at = image.starts.astype(np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "part": [part] * n,
                    "doc_id": [None if z else int(d) for d, z in zip(image.doc_ids, image.null, strict=True)],
                    "start_in_part": (at[:-1] + start).tolist(),
                    "n_tokens": (at[1:] - at[:-1]).tolist(),
                    "ids_crc32": [zlib.crc32(ids[i:j].tobytes()) for i, j in zip(at[:-1], at[1:], strict=True)],
                },
                schema=schema,
            )


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read from the files."""
    bound_batches(spark)
    files = spark.read.parquet(path)
    # One row per part; a part's offset is the ids of all parts before it.
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    rows = files.select("part", "start_in_part", "image").mapInArrow(_digests, "part int, " + _DIGEST)
    return rows.join(offsets, F.col("part") == F.col("_part")).select(
        "doc_id", (F.col("_base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_digests(docs: DataFrame, vocab: str, end_id: int) -> DataFrame:
    """Write token files to the shared folder and read them back as digests."""
    path = scratch(docs.sparkSession, "tokens")
    write_token_files(docs, path, vocab, end_id)
    return read_digests(docs.sparkSession, path)
