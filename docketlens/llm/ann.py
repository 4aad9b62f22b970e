"""Nearest neighbours by cosine from several shifted Hilbert orderings.

Equal vectors form a class that is indexed once; of its members only the
smallest ids can ever be answers.  Each class gets a position on ``ORDERINGS``
Hilbert curves, each over its own random projection with its own shift.  Spark
sorts every ordering by ranges; a global rank cuts it into blocks of equal
size, however many vectors share a key.  A query looks at the blocks within a
window around its own in every ordering.  What travels with the orderings is
the vector's direction in one byte a component; of what the windows hold, each
query's ``KEEP`` best by these codes merge and are ranked again by exact cosine
in double precision on the original vectors.

The window is calibrated at every size: for at most ``SAMPLE`` queries the true
neighbours are found by a blocked scan, and the window is as wide as brings
``TARGET`` of them within reach in at least one ordering.  On data without
structure that reach grows with the table; only where all windows together
would hold more than the table does, one ordering is read whole instead.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part; vectors of different lengths are not compared; rows
that repeat a query's id are not its neighbours, and an id with several vectors
asks with each of them; ties go to the smaller id; fewer candidates than k give
fewer rows; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, stored

K, QUERY_STEP = 5, 50
ORDERINGS, DIMS, LEVELS = 16, 12, 5
#: Ranks of a block (when an ordering is read whole: of a large one), queries that meet it in one task.
BLOCK, LARGE_BLOCK, TILE = 256, 2048, 2048
SAMPLE, TARGET, SEED = 256, 0.97, 7
#: Candidates of a query, and of a query in one block, that are ranked by exact cosine.
KEEP = 32


def projections(d: int) -> tuple[np.ndarray, np.ndarray]:
    """``ORDERINGS`` orthonormal maps from d to ``DIMS`` dimensions, and shifts; fixed by d."""
    rng = np.random.default_rng([SEED, d])
    maps = [np.linalg.qr(rng.standard_normal((max(d, DIMS), DIMS)))[0][:d] for _ in range(ORDERINGS)]
    return np.stack(maps), rng.uniform(-0.5, 0.5, (ORDERINGS, DIMS))


def hilbert(cells: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """Hilbert index of integer cells (rows) with ``levels`` bits an axis: exchange and
    invert the low bits of each axis by the higher ones, Gray-code, then interleave."""
    x = [cells[:, i].astype(np.int64).copy() for i in range(cells.shape[1])]
    n, q = len(x), 1 << (levels - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[i]
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (levels - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(t)
    for bit in range(levels - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ t) >> bit) & 1)
    return key


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v``: the rows that take part; negative zeros are zeros."""
    ok = "embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)"
    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).where(ok).select(
        "vec_id", F.expr("transform(embedding, x -> x + 0D)").alias("v")
    )


def codes(unit: np.ndarray) -> list[bytes]:
    """Unit vectors in one byte a component, after their scale (a 32-bit float)."""
    scale = np.maximum(np.abs(unit).max(1), 1e-30) / 127
    bytes_ = np.rint(unit / scale[:, None]).astype(np.int8)
    return [x.tobytes() + y.tobytes() for x, y in zip(scale.astype("<f4"), bytes_, strict=True)]


def decoded(column) -> np.ndarray:
    """Rough directions, a row each, of codes of equal length."""
    raw = np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)
    x = raw[:, 4:].view(np.int8).astype(np.float32)
    return x * np.ascontiguousarray(raw[:, :4]).view("<f4")


def orderings(classes: DataFrame) -> DataFrame:
    """``ord, key, cls, is_q, c``: every class and its code on every curve; ``ord`` also holds the dimension."""

    def run(batches):
        for batch in batches:
            cls, is_q, vs = (c.to_pylist() for c in batch.columns)
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(vs):
                by_dim.setdefault(len(v), []).append(i)
            for d, at in by_dim.items():
                x = np.array([vs[i] for i in at])
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                maps, shifts = projections(d)
                code = codes(unit)
                for o in range(ORDERINGS):
                    y = unit @ maps[o] * np.sqrt(d) / 6 + 0.5 + shifts[o] / (1 << 3)
                    key = hilbert(np.clip((y * (1 << LEVELS)).astype(np.int64), 0, (1 << LEVELS) - 1))
                    yield pa.RecordBatch.from_pydict(
                        {"ord": [d * ORDERINGS + o] * len(at), "key": key, "cls": [cls[i] for i in at], "is_q": [is_q[i] for i in at], "c": code},
                        schema=pa.schema([("ord", pa.int64()), ("key", pa.int64()), ("cls", pa.int64()), ("is_q", pa.bool_()), ("c", pa.binary())]),
                    )

    return classes.select("cls", "is_q", "v").mapInArrow(run, "ord long, key long, cls long, is_q boolean, c binary")


def ranked(rows: DataFrame) -> DataFrame:
    """With ``rank`` in each ordering, from range-partitioned sorted runs and the sizes of the runs."""

    def number(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            idx = []
            for o in batch.column(0).to_pylist():
                idx.append(seen.get(o, 0))
                seen[o] = idx[-1] + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(idx), pa.int32()), pa.array(idx, pa.int64())], names=[*batch.schema.names, "part", "idx"])

    runs = rows.repartitionByRange("ord", "key", "cls").sortWithinPartitions("ord", "key", "cls")
    runs = stored(runs.mapInArrow(number, "ord long, key long, cls long, is_q boolean, c binary, part int, idx long").drop("key"), "ann-runs")
    sizes = runs.groupBy("ord", "part").agg(F.count("*").alias("n"))  # a row per run
    before = Window.partitionBy("ord").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(sizes.select(F.col("ord").alias("_o"), F.col("part").alias("_p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "ann-offsets")
    return runs.join(F.broadcast(offsets), F.expr("ord = _o AND part = _p")).select("ord", "cls", "is_q", "c", (F.col("base") + F.col("idx")).alias("rank"))


def _top(ids: np.ndarray, x: np.ndarray, q: np.ndarray, k: int):
    """For each query the k nearest by (cosine, smaller id): indices and exact cosines."""
    nx, nq = np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", q, q))
    rough = (q / nq[:, None]) @ (x / nx[:, None]).T
    some = min(k + 3, len(x))
    pick = np.argpartition(-rough, some - 1, axis=1)[:, :some] if some < len(x) else np.tile(np.arange(len(x)), (len(q), 1))
    # All that tie with the last one picked must be seen, to choose by id.
    last = np.take_along_axis(rough, pick, 1).min(1)
    for i in range(len(q)):
        at = pick[i] if some == len(x) else np.flatnonzero(rough[i] >= last[i] - 1e-9)
        exact = np.einsum("ij,j->i", x[at], q[i]) / (nx[at] * nq[i])
        best = np.lexsort((ids[at], -exact))[:k]
        yield i, at[best], np.clip(exact[best], -1.0, 1.0)


def _scan(classes: DataFrame, sample: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """The sample's nearest classes by a scan of all: ``q, cls``."""

    def run(batches):
        for batch in batches:
            cls, vs = np.array(batch.column(0).to_pylist(), np.int64), batch.column(1).to_pylist()
            dims = np.array([len(v) for v in vs])
            for d in np.unique(dims):
                qs = [s for s in sample if len(s[1]) == d]
                at = np.flatnonzero(dims == d)
                if qs:
                    rows = [(qs[i][0], int(cls[at[j]]), float(s)) for i, js, ss in _top(cls[at], np.array([vs[i] for i in at]), np.array([s[1] for s in qs]), k + 1) for j, s in zip(js, ss, strict=True)]
                    yield pa.RecordBatch.from_pydict({"q": [r[0] for r in rows], "cls": [r[1] for r in rows], "s": [r[2] for r in rows]})

    best = Window.partitionBy("q").orderBy(F.desc("s"), "cls")
    found = classes.select("cls", "v").mapInArrow(run, "q long, cls long, s double").where("q <> cls")
    return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("q", "cls")


def window(classes: DataFrame, ranks: DataFrame, k: int = K, sample: int = SAMPLE, target: float = TARGET) -> int:
    """Ranks to either side that bring ``target`` of a bounded sample's true neighbours within reach."""
    picked = classes.where("is_q").orderBy(F.xxhash64("cls")).limit(sample).select("cls", "v").collect()
    if not picked:
        return 0
    truth = stored(_scan(classes, [(r.cls, list(r.v)) for r in picked], k), "ann-truth")  # at most sample * k rows
    light = ranks.select("ord", "cls", "rank")
    mine = light.join(F.broadcast(truth.select(F.col("q").alias("cls")).distinct()), "cls").select(F.col("ord").alias("o"), F.col("cls").alias("q"), F.col("rank").alias("qr"))
    theirs = light.join(F.broadcast(truth), "cls")
    reach = theirs.join(mine.withColumnRenamed("q", "_q"), F.expr("ord = o AND q = _q")).groupBy("q", "cls").agg(F.min(F.abs(F.col("rank") - F.col("qr"))).alias("w"))
    w = reach.agg(F.expr(f"percentile(w, {target})")).first()[0]
    return int(np.ceil(w or 0))


def candidates(ranks: DataFrame, n: int, reach: int) -> DataFrame:
    """``q, cls``: of each query class the ``KEEP`` best by their codes, itself among them."""
    block = BLOCK
    sides = -(-reach // block)
    if 2 * reach * ORDERINGS >= n:  # the windows hold more than the table: one ordering, all of it
        block = LARGE_BLOCK
        ranks, sides = ranks.where(F.col("ord") % ORDERINGS == 0), -(-n // block)
    blocks = ranks.withColumn("block", F.expr(f"rank div {block}"))
    last = blocks.groupBy("ord").agg(F.max("block").alias("last")).withColumnRenamed("ord", "_o")
    asking = blocks.where("is_q").join(F.broadcast(last), F.col("ord") == F.col("_o"))
    n_q = asking.where(F.col("ord") % ORDERINGS == 0).count()
    tiles = max(1, -(-min(n_q, (2 * sides + 1) * block) // TILE))
    queries = asking.select(
        F.col("ord").alias("_ord"),
        F.explode(F.expr(f"sequence(greatest(block - {sides}, 0L), least(block + {sides}, last))")).alias("_block"),
        F.expr(f"pmod(xxhash64(cls), {tiles})").alias("_tile"),
        F.col("cls").alias("q"),
        F.col("c").alias("_c"),
    )
    held = blocks.select("ord", "block", F.explode(F.expr(f"sequence(0L, {tiles - 1}L)")).alias("tile"), "cls", "c")

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"q": [], "cls": [], "rough": []}
        if len(left) and len(right):
            left = left.sort_values("cls")
            ids, asked = left["cls"].to_numpy(np.int64), right["q"].to_numpy(np.int64)
            rough = decoded(right["_c"]) @ decoded(left["c"]).T
            best = np.argsort(-rough, axis=1, kind="stable")[:, :KEEP] if len(ids) > KEEP else np.tile(np.arange(len(ids)), (len(asked), 1))
            out = {"q": np.repeat(asked, best.shape[1]), "cls": ids[best].ravel(), "rough": np.take_along_axis(rough, best, 1).ravel()}
        return pd.DataFrame(out).astype({"q": "int64", "cls": "int64", "rough": "float32"})

    found = held.groupBy("ord", "block", "tile").cogroup(queries.groupBy("_ord", "_block", "_tile")).applyInPandas(find, "q long, cls long, rough float")
    found = found.groupBy("q", "cls").agg(F.max("rough").alias("rough"))
    best = Window.partitionBy("q").orderBy(F.desc("rough"), "cls")
    return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= KEEP).select("q", "cls")


def nearest_classes(classes: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``q, cls, score``: of each query class the k + 1 nearest of its candidates by exact cosine."""

    def score(batches):
        for batch in batches:
            q, cls, x, y = (c.to_pylist() for c in batch.columns)
            s = [float(np.dot(a, b) / (np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b)))) for a, b in zip(map(np.array, x), map(np.array, y), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(cls, pa.int64()), pa.array(np.clip(s, -1.0, 1.0), pa.float64())], names=["q", "cls", "score"])

    pairs = found.join(classes.select(F.col("cls").alias("q"), F.col("v").alias("x")), "q").join(classes.select("cls", F.col("v").alias("y")), "cls")
    scored = pairs.select("q", "cls", "x", "y").mapInArrow(score, "q long, cls long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "cls")
    return scored.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")


def search(vectors: DataFrame, k: int = K, step: int = QUERY_STEP) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the queries ``vec_id % step = 0`` against all rows."""
    bound_batches(vectors.sparkSession)
    rows = usable(vectors)
    same = Window.partitionBy("v").orderBy("vec_id")
    members = stored(
        rows.withColumn("_r", F.dense_rank().over(same)).where(F.col("_r") <= k + 1)
        .groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).select(F.col("ids")[0].alias("cls"), "v", "ids"),
        "ann-classes",
    )
    asking = rows.where(F.col("vec_id") % step == 0).select(F.col("vec_id").alias("query_id"), "v").distinct()
    queries = stored(asking.join(members.select("cls", "v"), "v").select("query_id", F.col("cls").alias("q")), "ann-queries")
    asked = queries.select("q").distinct().withColumn("_q", F.lit(True))
    classes = stored(members.join(asked, F.col("cls") == F.col("q"), "left").select("cls", F.coalesce("_q", F.lit(False)).alias("is_q"), "v"), "ann-asked")
    ranks = ranked(orderings(classes))
    near = nearest_classes(classes, candidates(ranks, classes.count(), window(classes, ranks, k)), k)
    expanded = near.join(members.select("cls", "ids"), "cls").select("q", "score", F.explode("ids").alias("vec_id"))
    first = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    expanded = expanded.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).drop("r")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        queries.join(expanded, "q").where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    )
