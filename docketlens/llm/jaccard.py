"""Similarity join on word shingles: rare-first prefix filtering, exact at 0.75.

1. Every text becomes its set of 64-bit shingle hashes.  Documents with equal
   sets form a class, represented by its smallest id: copies never meet again.
2. Shingles are ordered rare first, by a count sketch of fixed size over the
   whole corpus.  A set's prefix (the first quarter of it, plus one) must hold
   a shingle of any set it is similar to.
3. Prefix shingles are joined.  A pair must pass the length filter, the
   positional filter and the shorter prefix of the smaller set.  In a list of
   many sets not all pairs are formed: first each set meets the list's leader,
   verified links join sets into components, and then only sets of different
   components still meet.  What is left out can change no component.
4. Pairs are verified once, with a suffix filter before the intersection.
5. ``links`` and ``linked_documents`` give every link: similar sets are always of one
   component, so within each the sets meet all to all, in blocks of ``LINK_BLOCK``.

A list is keyed by 48 bits of the hash (a collision only adds a candidate);
lists the sketch knows to be long are split over tasks, and meet again in the
steps between components.  Links and components are tables, never collected.

Defined results: null text or text without words has an empty set, size 0 and
is its own component; fewer than ``WORDS`` words are one shingle; rows that
repeat an id with the same text are one document, and so is the smallest of
equal texts; ids are taken to name one text each (``near_duplicates`` may judge an
id with different texts by one of them; ``one_of_each`` tells such rows apart
by id and text); a null id takes part only through its class; a pair of exactly 0.75 is
linked; a very long text is hashed whole, in arrays of a few times its size;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, hot_keys, join_one, join_spread, passing_tables, stored

WORDS = 5
#: Buckets of the count sketch (its size is fixed), and of the pieces it is summed in.
SKETCH, PIECE = 1 << 20, 1 << 14
#: A list that the sketch puts above this is split into lists of about this many.
LONG_LIST = 4096
#: Rounds of leaders by chance, at most (an even number), before all that is left meets.
LEADER_ROUNDS = 4
#: Sets in a list from which pairs are formed at their first common shingle only.
LONG_PAIRS = 16
#: Sets of a component, and of a list, in a block; two blocks meet in a task.
LINK_BLOCK, LIST_BLOCK = 256, 1024
#: Bytes of texts that are hashed together.
GROUP_BYTES = 1 << 16
#: Ids (8 bytes each) up to which a list of documents is broadcast; beyond, it is joined.
BROADCAST_IDS = 1_000_000

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _M3)
_STEP = [_mix(np.array([k + 1], np.uint64) * _M2)[0] | np.uint64(1) for k in range(64)]
#: Bytes with A-Z in lower case and every blank as a space.
_LOWER = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_ROOT = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(1 << 17, 1 << n.bit_length())
        for name, base in (("up", _ROOT), ("down", pow(_ROOT, -1, 1 << 64))):
            a = np.full(size, np.uint64(base), np.uint64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and a 64-bit hash of it, A-Z lower-cased; the bytes begin and end with a blank."""
    data = np.frombuffer(data.translate(_LOWER), np.uint8)
    blank = data == 32
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE.take(data) * up[:-1], out=total[1:])
    return starts, _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _M3)


def _hashed(sums: np.ndarray, width: int) -> np.ndarray:
    return _mix(sums + np.uint64((width * int(_M3)) & 0xFFFFFFFFFFFFFFFF))


def _group_sets(texts: list[bytes]) -> list[np.ndarray]:
    starts, words = word_hashes(b" ".join([b"", *texts, b""]))
    n = len(words)
    sums = words[: max(n - WORDS + 1, 0)] * _STEP[0]
    for j in range(1, WORDS if len(sums) else 1):
        sums += words[j : n - WORDS + 1 + j] * _STEP[j]
    hashes, out = _hashed(sums, WORDS), []
    # A text's windows are those that begin in it and end in it.
    bounds = np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in texts)])).tolist()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        k = b - a
        if k >= WORDS:
            s = np.sort(hashes[a : b - WORDS + 1])
            new = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=new[1:])
            out.append(s[new])
        elif k:
            out.append(_hashed((words[a:b] * np.array(_STEP[:k])).sum(keepdims=True, dtype=np.uint64), k))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def shingle_sets(texts: list[str | bytes | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each whole text (bytes: UTF-8); short texts are worked on together."""
    out, held, size = [], [], 0
    for text in texts:
        data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
        if held and size + len(data) > GROUP_BYTES:
            out += _group_sets(held)
            held, size = [], 0
        held.append(data)
        size += len(data)
    return out + _group_sets(held) if held else out


def shingles(text: str | bytes | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    return shingle_sets([text])[0]


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums of a set; equal sets agree."""
    return tuple(int(x) for x in np.array([s.sum(dtype=np.uint64), _mix(s + _M3).sum(dtype=np.uint64)]).view(np.int64))


def prefix_length(n):
    """Shingles of which any similar set must hold one."""
    return n - (3 * n + 3) // 4 + 1


def least_overlap(n, m):
    """The smallest intersection with 100 * i >= 75 * (n + m - i)."""
    return (3 * (n + m) + 6) // 7


def bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(44)).astype(np.int64)  # the top 20 bits


def _survey(batches):
    """Per document: size and fingerprint; at the end the task's part of the sketch."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("piece", pa.int32()), ("counts", pa.binary())])
    sketch = np.zeros(SKETCH, np.uint32)
    for batch in batches:
        n, f1, f2, held = [], [], [], []
        for s in shingle_sets(_texts(batch.column(1))):
            a, b = fingerprint(s)
            n.append(len(s))
            f1.append(a)
            f2.append(b)
            held.append(s)
        sketch += np.bincount(bucket(np.concatenate(held)), minlength=SKETCH).astype(np.uint32)
        none = [None] * len(n)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(none, pa.int32()), pa.array(none, pa.binary())], schema=schema)
    for p in range(SKETCH // PIECE):
        part = sketch[p * PIECE : (p + 1) * PIECE]
        if part.any():
            yield pa.RecordBatch.from_pydict({"doc_id": [None], "n": [None], "f1": [None], "f2": [None], "piece": [p], "counts": [_pack_piece(part)]}, schema=schema)


def _pack_piece(part: np.ndarray) -> bytes:
    """Counts of a piece: all of them, or the non-zero ones with their places where that is shorter."""
    at = np.flatnonzero(part)
    few = len(at) * 10 < part.nbytes * 2
    return b"s" + at.astype("<u2").tobytes() + part[at].astype("<u8").tobytes() if few else b"d" + part.astype("<u8").tobytes()


def _add_piece(total: np.ndarray, data: bytes) -> None:
    if data[:1] == b"d":
        total += np.frombuffer(data, "<u8", offset=1)
    else:
        n = (len(data) - 1) // 10
        total[np.frombuffer(data, "<u2", n, 1)] += np.frombuffer(data, "<u8", n, 1 + 2 * n)




def survey(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """``doc_id, n, f1, f2`` of every document, and the sketch (``SKETCH`` counts, whatever the input's size)."""
    import pandas as pd

    both = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_survey, "doc_id long, n long, f1 long, f2 long, piece int, counts binary"), "jaccard-survey", lasting=True)

    def add(frames):
        total: dict[int, np.ndarray] = {}
        for pdf in frames:
            for p, c in zip(pdf["piece"], pdf["counts"], strict=True):
                _add_piece(total.setdefault(p, np.zeros(PIECE, np.uint64)), c)
        yield pd.DataFrame({"piece": list(total), "counts": [_pack_piece(c) for c in total.values()]})

    # Summed in each task as read, then across tasks, a piece at a time.
    pieces = both.where("piece IS NOT NULL").select("piece", "counts").mapInPandas(add, "piece int, counts binary")
    whole = pieces.repartition(16, "piece").mapInPandas(add, "piece int, counts binary")
    sketch = np.zeros(SKETCH, np.uint64)
    for r in whole.collect():
        _add_piece(sketch[r.piece * PIECE : (r.piece + 1) * PIECE], bytes(r.counts))
    return both.where("piece IS NULL").drop("piece", "counts"), sketch


def classes_with_prefix(docs: DataFrame, counts) -> DataFrame:
    """``rep, n, f1, f2, prefix``: a row per class of equal non-empty sets."""

    def run(batches):
        freq = counts.value
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("prefix", pa.binary())])
        for batch in batches:
            rows = {k: [] for k in schema.names}
            for key, s in zip(batch.column(0).to_pylist(), shingle_sets(_texts(batch.column(1))), strict=True):
                if len(s):
                    first = s[np.lexsort((s, freq[bucket(s)]))[: prefix_length(len(s))]]
                    for k, v in zip(schema.names, (key, len(s), *fingerprint(s), first.tobytes()), strict=True):
                        rows[k].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, f1 long, f2 long, prefix binary")
    return rows.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix")).where("rep IS NOT NULL")


def postings(classes: DataFrame, counts) -> DataFrame:
    """``key, rep, n, pos``: key is 48 bits of the shingle and 16 of the part of a long list (0: not split)."""

    def run(batches):
        freq = counts.value
        schema = pa.schema([("key", pa.int64()), ("rep", pa.int64()), ("np", pa.int64())])
        for batch in batches:
            for rep, n, prefix in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = np.frombuffer(prefix, np.uint64)
                parts = np.minimum(freq[bucket(s)] // np.uint64(LONG_LIST), np.uint64(65534))
                turn = _mix(np.array([rep], np.int64).view(np.uint64))[0]
                part = np.where(parts > 0, 1 + turn % np.maximum(parts, 1), 0).astype(np.uint64)
                key = ((s >> np.uint64(16)) << np.uint64(16)) | part
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(s), rep, np.int64)), pa.array((n << 32) + np.arange(len(s), dtype=np.int64))], schema=schema)

    return classes.select("rep", "n", "prefix").mapInArrow(_batched(run), "key long, rep long, np long")


def _batched(run, rows: int = 200_000):
    """Join small output batches into larger ones."""

    def out(batches):
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return out


#: a is the smaller set (by size, then id), b the larger one.
_FILTERS = """
4 * an >= 3 * bn
AND apos < an - cast(floor((6 * an + 6) / 7) as long) + 1
AND 1 + least(an - apos - 1, bn - bpos - 1) >= cast(floor((3 * (an + bn) + 6) / 7) as long)
"""


def _pairs(rows: DataFrame) -> DataFrame:
    """Rows of ``x: struct<n, rep, pos>`` and ``y`` -> distinct filtered pairs ``a, b``."""
    ordered = rows.where("x.rep <> y.rep").select(F.least("x", "y").alias("s"), F.greatest("x", "y").alias("l"))
    flat = ordered.select(*[F.col(f"{side}.{f}").alias(f"{name}{f}") for side, name in (("s", "a"), ("l", "b")) for f in ("n", "rep", "pos")])
    return flat.where(F.expr(_FILTERS)).select(F.col("arep").alias("a"), F.col("brep").alias("b")).distinct()


def suffix_rejects(x: np.ndarray, y: np.ndarray, need: int) -> bool:
    """True if the sizes of the sets' parts by hash range already exclude an overlap of ``need``."""
    cuts = np.arange(1, 16, dtype=np.uint64) << np.uint64(60)
    cx = np.diff(np.searchsorted(x, cuts), prepend=0, append=len(x))
    cy = np.diff(np.searchsorted(y, cuts), prepend=0, append=len(y))
    return int(np.minimum(cx, cy).sum()) < need


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    need = least_overlap(len(x), len(y))
    if min(len(x), len(y)) < need or suffix_rejects(x, y, need):
        return False
    return len(np.intersect1d(x, y, assume_unique=True)) >= need


def _sets(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """``rep, s``: the sets of the documents ``rep``."""
    ids = reps.select(F.col("rep").alias("_rep"))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    def sets(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(_texts(batch.column(1)))], pa.binary())], names=["rep", "s"])

    some = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(ids, F.col("rep") == F.col("_rep"), "left_semi")
    return stored(some.mapInArrow(sets, "rep long, s binary"), "jaccard-sets").dropDuplicates(["rep"])


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose sets are similar: ``a, b``."""
    need = pairs.select(F.col("a").alias("rep")).distinct().unionByName(pairs.select(F.col("b").alias("rep")).distinct())
    found = _sets(docs, stored(need.distinct(), "jaccard-need"))

    def check(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            rows = [(a, b) for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True) if similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))]
            yield pa.RecordBatch.from_pydict({"a": [r[0] for r in rows], "b": [r[1] for r in rows]}, schema=schema)

    # A leader meets many sets: its pairs spread over tasks.
    hot_a, hot_b = hot_keys(pairs, ["a", "b"])
    with_x = join_spread(pairs.select("a", "b"), found.select(F.col("rep").alias("a"), F.col("s").alias("x")), "a", "b", hot_a)
    both = join_spread(with_x, found.select(F.col("rep").alias("b"), F.col("s").alias("y")), "b", "a", hot_b)
    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every linked node: alternating large-star and small-star steps, until no root has a root."""
    with passing_tables(links.sparkSession):
        return stored(_stars(links).select(F.col("u").alias("node"), F.col("v").alias("root")), "jaccard-labels", lasting=True)


def _stars(links: DataFrame) -> DataFrame:
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "jaccard-edges")
    while not edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).unionByName(
        edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi").select("u", F.lit(1).alias("n")).limit(1)
    ).isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Large star: neighbours above a node move to its lowest neighbour.
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "jaccard-large")
        # Small star: a node and its neighbours below move to the lowest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u <> v").distinct(), "jaccard-edges")
    return edges


def _labelled(shared: DataFrame, labels: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Postings of lists that still hold different components: ``gram, x, label, size``."""
    told = shared.join(labels, F.col("x.rep") == F.col("node"), "left").select("gram", "x", F.coalesce("root", "x.rep").alias("label"))
    if hot is not None:
        told = stored(told, "jaccard-told")
    mixed = told.groupBy("gram").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count("*").alias("size")).where("l <> h").select("gram", "size")
    return join_one(told, mixed, "gram", hot)


def _remaining(left: DataFrame, shared: DataFrame) -> DataFrame:
    """All filtered pairs of different components that share a list.

    Two sets that share many long lists would meet in each of them.  In a long
    list they meet only if none of their earlier shingles is common: a similar
    pair passes the filters at its first common shingle, so this loses none.
    """
    join = "gram = g AND x < y AND label <> m AND 4 * x.n >= 3 * y.n"
    other = [F.col("gram").alias("g"), F.col("x").alias("y"), F.col("label").alias("m")]
    short = left.where(F.col("size") < LONG_PAIRS)
    pairs = _pairs(short.join(short.select(*other), F.expr(join)).select("x", "y"))
    long = left.where(F.col("size") >= LONG_PAIRS)
    reps = long.select(F.col("x.rep").alias("_r")).distinct()
    grams = shared.select(F.col("x.rep").alias("r"), F.struct("x.pos", "gram").alias("p")).join(reps, F.col("r") == F.col("_r"), "left_semi")
    grams = grams.groupBy("r").agg(F.collect_list("p").alias("all"))
    long = stored(
        long.join(grams, F.col("x.rep") == F.col("r")).select("gram", "x", "label", "size", F.expr("transform(filter(all, p -> p.pos < x.pos), p -> p.gram)").alias("early")),
        "jaccard-long",
    )
    # The sets of a list are dealt into blocks, and every two blocks meet in a group of their own.
    blocks = f"cast(ceil(size / {LIST_BLOCK}) as long)"
    dealt = long.withColumn("own", F.expr(f"pmod(xxhash64(x.rep), {blocks})")).withColumn("k", F.explode(F.expr(f"sequence(0L, {blocks} - 1)")))
    dealt = dealt.select("gram", "x", "label", "early", "own", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"))
    met = dealt.select(*other, F.col("early").alias("f"), F.col("own").alias("own2"), F.col("i").alias("i2"), F.col("j").alias("j2"))
    again = F.expr(f"{join} AND i = i2 AND j = j2 AND (i = j OR own <> own2) AND NOT arrays_overlap(early, f)")
    return pairs.unionByName(_pairs(dealt.join(met, again).select("x", "y"))).distinct()


def _more(links: DataFrame, pairs: DataFrame, docs: DataFrame) -> tuple[DataFrame, bool]:
    """Links with those that the pairs add; whether they add any."""
    if pairs.isEmpty():
        return links, False
    with passing_tables(docs.sparkSession):
        new = stored(verify(pairs, docs), "jaccard-links", lasting=True)
    return (links, False) if new.isEmpty() else (links.unionByName(new), True)


def _joined(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes and fingerprints of the documents, their classes, and the components of linked classes."""
    bound_batches(docs.sparkSession)
    with passing_tables(docs.sparkSession):
        return _join_steps(docs)


def _join_steps(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    spark = docs.sparkSession
    sizes, sketch = survey(docs)
    counts = spark.sparkContext.broadcast(sketch)  # SKETCH numbers
    classes = stored(classes_with_prefix(docs, counts), "jaccard-classes", lasting=True)
    list_ = Window.partitionBy("key")
    x = F.struct(F.shiftright("np", 32).alias("n"), "rep", F.col("np").bitwiseAND(F.lit(0xFFFFFFFF)).alias("pos"))
    spread = postings(classes, counts).select("key", x.alias("x"))
    shared = (
        spread.withColumn("size", F.count("*").over(list_))
        .withColumn("leader", F.min("x").over(list_))
        .where("size > 1 OR (key & 65535) > 0")
        .select(F.shiftright("key", 16).alias("gram"), "x", "leader")
    )
    shared = stored(shared, "jaccard-lists")
    # Each set with the leader of its list.
    tried = stored(_pairs(shared.select("x", F.col("leader").alias("y"))), "jaccard-pairs")
    with passing_tables(spark):
        links = stored(verify(tried, docs), "jaccard-links", lasting=True)
    labels = components(links)
    (hot,) = hot_keys(shared, ["gram"])
    # Lists of several components: each set with other leaders, by chance, while that adds links.
    with passing_tables(spark):
        left = stored(_labelled(shared, labels, hot), "jaccard-left", lasting=True)
    # Components are found anew after every second round only.
    for turn in range(0, LEADER_ROUNDS, 2):
        added = False
        for seed in (turn, turn + 1):
            other = left.groupBy("gram").agg(F.max_by(F.struct("x", "label"), F.xxhash64(F.lit(seed), "gram", "x.rep")).alias("o"))
            again = _pairs(join_one(left, other, "gram", hot).where("label <> o.label").select("x", F.col("o.x").alias("y")))
            again = stored(again.join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
            links, more = _more(links, again, docs)
            tried, added = tried.unionByName(again), added or more
        if not added:
            break
        labels = components(links)
        with passing_tables(spark):
            left = stored(_labelled(shared, labels, hot), "jaccard-left", lasting=True)
    # All pairs of different components that are left.
    rest = stored(_remaining(left, shared).join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
    links, more = _more(links, rest, docs)
    labels = components(links) if more else labels
    return sizes, classes, stored(labels, "jaccard-components", lasting=True)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row per row of ``docs``."""
    sizes, classes, labels = _joined(docs)
    keyed = classes.select("rep", F.col("n").alias("_n"), F.col("f1").alias("_f1"), F.col("f2").alias("_f2"))
    keyed = keyed.join(labels, F.col("rep") == F.col("node"), "left").select("_n", "_f1", "_f2", F.coalesce("root", "rep").alias("root"))
    return sizes.join(keyed, F.expr("n = _n AND f1 = _f1 AND f2 = _f2"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id")
    )


def _met(docs: DataFrame, weights: DataFrame, labels: DataFrame, how, ddl: str) -> DataFrame:
    """``how(reps, weights, similar)`` of every two blocks of a component's sets: ``similar`` is a matrix that
    holds each similar pair of the component in one of the groups, in one of its halves."""
    import pandas as pd

    members = labels.select(F.col("node").alias("rep"), "root").unionByName(labels.select(F.col("root").alias("rep"), "root")).distinct()
    blocks = members.groupBy("root").agg(F.ceil(F.count("*") / LINK_BLOCK).alias("blocks")).withColumnRenamed("root", "_root")
    members = stored(members.join(blocks, F.col("root") == F.col("_root")).select("rep", "root", "blocks"), "jaccard-members")
    held = members.join(_sets(docs, members).withColumnRenamed("rep", "_r"), F.col("rep") == F.col("_r")).join(weights, "rep")
    held = held.withColumn("own", F.expr("pmod(xxhash64(rep), blocks)")).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    held = held.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "weight", "s")

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        own, sets = pdf["own"].to_numpy(), [np.frombuffer(x, np.uint64) for x in pdf["s"]]
        n = np.array([len(x) for x in sets])
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        starts = np.r_[0, np.cumsum(n)[:-1]]
        hit, similar_ = np.zeros(codes.max() + 1, np.int32), np.zeros((len(sets), len(sets)), bool)
        for k in range(len(sets)):
            mine = codes[starts[k] : starts[k] + n[k]]
            hit[mine] = 1
            similar_[k] = np.add.reduceat(hit[codes], starts) >= least_overlap(n[k], n)
            hit[mine] = 0
        # Pairs inside a block belong to the group of that block alone.
        if pdf["i"].iloc[0] != pdf["j"].iloc[0]:
            similar_ &= own[:, None] != own[None, :]
        np.fill_diagonal(similar_, False)
        return how(pdf["rep"].to_numpy(), pdf["weight"].to_numpy(), similar_)

    return held.groupBy("root", "i", "j").applyInPandas(find, ddl)


def links(docs: DataFrame) -> DataFrame:
    """``a, b``: every two similar classes of different sets, each by its smallest id, the smaller one first."""
    import pandas as pd

    def pairs(reps, weights, similar_):
        x, y = np.nonzero(np.triu(similar_))  # reps are in order
        return pd.DataFrame({"a": reps[x], "b": reps[y]})

    _, classes, labels = _joined(docs)
    return _met(docs, classes.select("rep", F.lit(1).cast("long").alias("weight")), labels, pairs, "a long, b long")


def linked_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links``: with the number of other documents (with an id) that are similar,
    copies among them; counted by class and weighed by the classes' documents, so pairs are not listed."""
    import pandas as pd

    def counts(reps, weights, similar_):
        return pd.DataFrame({"rep": reps, "n": similar_ @ weights})

    sizes, classes, labels = _joined(docs)
    same = sizes.where("n > 0 AND doc_id IS NOT NULL").distinct().groupBy("n", "f1", "f2").agg(F.count("*").alias("weight"))
    classes = stored(classes.select("rep", "n", "f1", "f2").join(same, ["n", "f1", "f2"]), "jaccard-weights")
    more = _met(docs, classes.select("rep", "weight"), labels, counts, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("more"))
    keyed = classes.join(labels, F.col("rep") == F.col("node"), "left").join(more, "rep", "left")
    keyed = keyed.select(F.col("n").alias("_n"), F.col("f1").alias("_f1"), F.col("f2").alias("_f2"), F.coalesce("root", "rep").alias("root"), (F.col("weight") + F.coalesce("more", F.lit(0))).alias("all"))
    return sizes.join(keyed, F.expr("n = _n AND f1 = _f1 AND f2 = _f2"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"),
        F.coalesce(F.col("all") - F.col("doc_id").isNotNull().cast("long"), F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without all but the smallest id of each component.

    Rows are told apart by id and text together: different texts under one id,
    or without an id, are judged each by its own component, where rows without
    an id come last.  Of rows that repeat a text and an id (or have none) one
    stays; rows without words and without an id all do.
    """
    node = F.xxhash64("doc_id", "text")
    groups = stored(near_duplicates(docs.select(node.alias("doc_id"), "text")), "jaccard-groups")
    ids = docs.select(node.alias("_n"), "doc_id").distinct()
    rows = groups.groupBy(F.col("doc_id").alias("node")).agg(F.count("*").alias("times"), F.first("n_shingles").alias("n"), F.first("component_id").alias("root"))
    rows = stored(rows.join(ids, F.col("node") == F.col("_n")).select("node", "times", "n", "root", "doc_id"), "jaccard-nodes")
    first = rows.where("n > 0").groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "node")).alias("f")).select(F.col("f.node").alias("_first"))
    gone = stored(rows.where("n > 0").join(first, F.col("node") == F.col("_first"), "left_anti").select(F.col("node").alias("_gone")), "jaccard-gone")
    again = rows.where("times > 1 AND (n > 0 OR doc_id IS NOT NULL)").select(F.col("node").alias("_again"))
    again = stored(again.join(gone, F.col("_again") == F.col("_gone"), "left_anti"), "jaccard-again")
    few = [F.broadcast(x) if x.count() <= BROADCAST_IDS else x for x in (gone, again)]
    kept = docs.withColumn("_node", node).join(few[0], F.col("_node") == F.col("_gone"), "left_anti")
    once = kept.join(few[1], F.col("_node") == F.col("_again"), "left_anti")
    repeated = kept.join(few[1], F.col("_node") == F.col("_again"), "left_semi").dropDuplicates(["_node"])
    return once.unionByName(repeated).drop("_node")
