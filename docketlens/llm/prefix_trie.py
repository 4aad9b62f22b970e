"""Prefix trie of conversations, merged family first.

Conversations whose ids share ``c - c % FAMILY`` are a family.  The base's first
turns and its family's conversations are brought together by base id and every
conversation is rebuilt: the first h turns of the base, then its own turns after
its first h.  Each family's paths are combined into its own small trie, a row a
node; only these rows are shuffled again and merged into the nodes of all.

A node is the sequence of turns from the root, known by 128 bits: the exclusive
or of a hash of each turn with its depth.  So prefixes are running aggregates,
no text moves after the first pass, and a long conversation may be cut anywhere.

What a node's subtree adds up to is additive over its members, so no pass goes
from level to level.  A node belongs to its smallest member; what a conversation
owns is the end of its path, from depth a on.  It saves the words of its turns
before a once in every node that it passes (the owner is the one that does not),
and it is a leaf of every node that it passes where it owns its own childless end.

No task holds a conversation or a family: turns are numbered in ranges of
(conv_id, turn), which cut long conversations, and what a range adds to the
next ones is at most a row for each range.

Defined results: null role or text is empty, turns order null first, turns with
equal numbers by the hashes of role and text (equal rows are each a turn); rows
without conv_id belong to no conversation; base ids of negative ids truncate
towards zero, as ``%`` does; an empty table has no nodes, not even a root; a
very long text is read once, where it lies; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, stored, word_count

FAMILY, HEADS = 20, 4
#: Families whose ends are put together before ends are hashed in order.
BLOCK = 500 * FAMILY

_EMPTY_SHA = hashlib.sha256().hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, a, b, words``: each turn by a 128-bit hash of its role and text."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL")
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), role, text).alias("b"), word_count(text).alias("words"))


def families(rows: DataFrame) -> DataFrame:
    """One row a conversation, beside its base's first turns: ``conv_id, base, h, shift, head`` with the turns taken from the
    base, at most three, and the depth of an own turn less its number."""
    own = rows.groupBy("conv_id").agg(F.count("*").alias("n_turns")).withColumn("base", F.expr(f"conv_id - conv_id % {FAMILY}"))
    first = rows.where(f"conv_id % {FAMILY} = 0").withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "a", "b"))).where(f"pos < {HEADS}")
    heads = first.groupBy(F.col("conv_id").alias("_base")).agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b", "words"))).alias("head"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    met = own.join(heads, F.col("base") == F.col("_base"), "left").withColumn("h", h)
    met = met.withColumn("head", F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), F.expr("cast(array() as array<struct<pos: int, a: long, b: long, words: long>>)")))
    return met.select("conv_id", "base", "h", (F.size("head") - F.col("h")).alias("shift"), "head")


def _offsets(parts: DataFrame, adds: dict) -> DataFrame:
    """What earlier ranges add to those that a conversation goes on in: from a row for each (conv_id, range), at most a row a range."""
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    several = parts.withColumn("_n", F.count("*").over(Window.partitionBy("conv_id"))).where("_n > 1")
    return several.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), *[F.coalesce(agg(c).over(before), F.lit(0)).alias(f"before_{c}") for c, agg in adds.items()])


def _carried(rows: DataFrame, parts: DataFrame, adds: dict) -> DataFrame:
    """``rows`` with ``before_<c>`` for each of ``adds``, 0 in a conversation's first range."""
    rows = rows.join(F.broadcast(_offsets(parts, adds)), F.expr("conv_id = _c AND part = _p"), "left").drop("_c", "_p")
    return rows.withColumns({f"before_{c}": F.coalesce(f"before_{c}", F.lit(0)) for c in adds})


def paths(conversations: DataFrame) -> DataFrame:
    """A row for each conversation and depth of its rebuilt turns, root included: ``base, conv_id, depth, x, y`` (the node),
    ``up_x, up_y`` (its parent), ``words`` (of its last turn), ``total`` (words down to it), ``is_end``."""
    rows = stored(turns(conversations), "trie-turns")
    who = stored(families(rows), "trie-families")
    told = rows.join(who.select("conv_id", "h", "shift"), "conv_id")
    ranged = told.repartitionByRange("conv_id", "turn", "a", "b", F.rand(0)).withColumn("part", F.spark_partition_id())  # rand: equal rows may be cut apart
    ranged = stored(ranged, "trie-ranges")
    order = Window.partitionBy("part", "conv_id").orderBy("turn", "a", "b")
    counts = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    own = _carried(ranged.withColumn("local", F.row_number().over(order)), counts, {"n": F.sum}).withColumn("pos", F.col("local") + F.col("before_n"))
    own = own.where("pos > h").withColumn("depth", F.col("pos") + F.col("shift"))
    term = {c: F.xxhash64(F.lit(i), "depth", "a", "b") for i, c in enumerate(("tx", "ty"))}
    own = stored(own.select("conv_id", "part", "depth", "words", *[t.alias(c) for c, t in term.items()]), "trie-own")
    adds = {"tx": F.bit_xor, "ty": F.bit_xor, "words": F.sum}
    sums = own.groupBy("conv_id", "part").agg(*[agg(c).alias(c) for c, agg in adds.items()])
    so_far = Window.partitionBy("part", "conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = _carried(own.withColumns({f"run_{c}": agg(c).over(so_far) for c, agg in adds.items()}), sums, adds)
    # The base's turns: what each depth down to it adds, and what all of them add to the own turns.
    step = "struct(cast(0 as int) AS depth, 0L AS x, 0L AS y, 0L AS up_x, 0L AS up_y, 0L AS words, 0L AS total)"
    grown = (
        f"aggregate(head, array({step}), (acc, t) -> concat(acc, array(named_struct('depth', t.pos, 'x', element_at(acc, -1).x ^ xxhash64(0, cast(t.pos as long), t.a, t.b),"
        " 'y', element_at(acc, -1).y ^ xxhash64(1, cast(t.pos as long), t.a, t.b), 'up_x', element_at(acc, -1).x, 'up_y', element_at(acc, -1).y, 'words', t.words,"
        " 'total', element_at(acc, -1).total + t.words))))"
    )
    prefix = who.select("base", "conv_id", F.expr(grown).alias("p"))
    last = prefix.select("base", "conv_id", F.expr("element_at(p, -1)").alias("l")).select("base", "conv_id", "l.depth", "l.x", "l.y", "l.total")
    ends = own.groupBy("conv_id").agg(F.max("depth").alias("end"))
    about = last.join(ends, "conv_id", "left").select("conv_id", "base", F.col("x").alias("hx"), F.col("y").alias("hy"), F.col("total").alias("ht"), F.coalesce("end", F.col("depth").cast("long")).alias("end"))
    x, y = (F.expr(f"h{c} ^ run_t{c} ^ before_t{c}") for c in "xy")
    mine = run.join(about, "conv_id").select(
        "base", "conv_id", F.col("depth").cast("long"), x.alias("x"), y.alias("y"), x.bitwiseXOR(F.col("tx")).alias("up_x"), y.bitwiseXOR(F.col("ty")).alias("up_y"), "words",
        F.expr("ht + run_words + before_words").alias("total"), F.expr("depth = end").alias("is_end"),
    )
    theirs = prefix.join(about.select("conv_id", "end"), "conv_id").select("base", "conv_id", "end", F.explode("p").alias("p"))
    theirs = theirs.select("base", "conv_id", F.col("p.depth").cast("long").alias("depth"), "p.x", "p.y", "p.up_x", "p.up_y", "p.words", "p.total", F.expr("p.depth = end").alias("is_end"))
    return stored(mine.unionByName(theirs), "trie-paths")


_NODE = ("x", "y")
_SAME = ("depth", "up_x", "up_y", "words", "total")  # equal for all members of a node


def family_nodes(path: DataFrame) -> DataFrame:
    """Each family's small trie: a row a node with its members in the family."""
    ends = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("is_end"), F.col("conv_id")))), lambda c: c.cast("string")), ",")
    return path.groupBy("base", *_NODE).agg(*[F.first(c).alias(c) for c in _SAME], F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), ends.alias("ends"))


def end_hashes(family: DataFrame) -> DataFrame:
    """``x, y, ends_sha256``: for nodes at which conversations end, the hash of their ids in order.  Families are disjoint
    ranges of ids, so their lists follow one another; a node's are hashed as a stream, whatever their number."""
    block = F.expr(f"base div {BLOCK} - if(base % {BLOCK} < 0, 1, 0)")
    lists = family.where("ends <> ''").groupBy(*_NODE, block.alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("base", "ends"))), lambda r: r["ends"]), ",").alias("ends"))
    bound_batches(family.sparkSession)

    def run(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for x, y, ends in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (x, y) == key:
                    state.update(b"," + ends.encode())
                else:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (x, y), hashlib.sha256(ends.encode())
            if out:
                yield _rows(out)
        if key is not None:
            yield _rows([(*key, state.hexdigest())])

    def _rows(out):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["x", "y", "ends_sha256"])

    ordered = lists.repartition(*_NODE).sortWithinPartitions(*_NODE, "block").select(*_NODE, "ends")
    return ordered.mapInArrow(run, "x long, y long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of all rebuilt conversations; see the contract of the columns in the module's head."""
    path = paths(conversations)
    family = stored(family_nodes(path), "trie-family-nodes")
    nodes = stored(family.groupBy(*_NODE).agg(*[F.first(c).alias(c) for c in _SAME], F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs")), "trie-nodes")
    children = nodes.where("depth > 0").groupBy(F.col("up_x").alias("x"), F.col("up_y").alias("y")).agg(F.count("*").alias("n_children"))
    # What each conversation owns: from which depth, the words above it, and whether its end is a leaf.
    with_children = nodes.join(children, [*_NODE], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    owned = with_children.groupBy(F.col("conv_id").alias("_c")).agg(F.min("depth").alias("a"), F.min(F.col("total") - F.col("words")).alias("above"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    # A member that does not own a node saves its words from that node down to where its own part begins (all, if it owns nothing).
    whole = path.groupBy(F.col("conv_id").alias("_w")).agg(F.max("total").alias("whole"))
    about = whole.join(owned, F.col("_w") == F.col("_c"), "left").select("_w", F.coalesce("above", "whole").alias("above"), F.coalesce("a", F.lit(1 << 62)).alias("a"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    shared = stored(path.select("base", "conv_id", *_NODE, "depth", "words", "total").join(about, F.col("conv_id") == F.col("_w")).where("depth < a OR leaf > 0").select(
        "base", *_NODE, F.expr("if(depth < a, above - total + words, 0L)").alias("saved"), "leaf"), "trie-shares")
    small = shared.groupBy("base", *_NODE).agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    sums = small.groupBy(*_NODE).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    out = with_children.join(sums, [*_NODE], "left").join(end_hashes(family), [*_NODE], "left")
    parent = nodes.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("conv_id").alias("parent_conv_id"))
    out = out.join(parent, F.expr("depth > 0 AND up_x = _x AND up_y = _y"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", zero("n_leaves"), zero("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY_SHA)).alias("ends_sha256"))
