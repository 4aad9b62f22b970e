"""Mixing sources to target weights by pivotal dependent rounding, built-in functions only.

Each source gets a target number of words; all its documents share one rate
``target / source size``.  A document's copies are the rate's whole part plus
a 0/1 that is rounded dependently: two documents at a time exchange words until
one of them is integral, the other carries on.  Groups of about ``fan_in``
documents fold in parallel, each leaving at most one residual document; the
residuals form the next level of the reduction tree, until one document per
source is left, which is rounded by chance.  So a source misses its target by
less than its largest document, and the expected copies of every document equal
its rate.  Everything random is a hash of ids: reruns agree.

A hot source spreads over as many groups as its documents need; no group, task
or driver sees a source as a whole.  Rows of equal id, size and source are
counted and numbered, so that they spread as others do.

Defined results: null text or a text without words has size 0 and takes 0
words; a null source is a source of its own (last in order); rows may repeat
(each takes part on its own); ties between equal rows are broken by their
number; a very long text is one document as any other, and its source may miss
its target by that much; further columns are ignored; an empty table gives an
empty result; targets of a mix without words are 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, word_count

WEIGHTS = (5, 2, 1)
CAP = 3
#: Documents that fold in one group, on average.
FAN_IN = 64
#: Equal rows that one row stands for, at most, when they are numbered.
REPEATS = 100_000
#: Rows (16 bytes each) up to which the counts of copies are broadcast; beyond, they are joined.
BROADCAST_ROWS = 1_000_000
SEED = 20


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """``source, source_size, ...`` (a row per source) -> the same with ``target``.

    Sources in code point order (null last) take the weights in turn and share
    the sum of all sizes; what a source would get above ``cap`` times its size
    is reshared by weight until none is above.  That is the level t at which
    sum(min(cap * size, t * weight)) equals the total: with sources sorted by
    cap * size / weight, the capped ones come first.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # a row per source, not per document
    pick = F.expr(f"element_at(array({', '.join(map(str, weights))}), cast(_k % {len(weights)} as int) + 1)").cast("double")
    one = sizes.withColumn("_k", F.row_number().over(order) - 1).withColumn("_w", pick)
    everything = Window.partitionBy(F.lit(1))
    by_ratio = Window.partitionBy(F.lit(1)).orderBy(F.expr(f"{cap} * source_size / _w"), "_k")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    two = (
        one.withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_before", F.coalesce(F.sum(F.expr(f"{cap} * source_size")).over(before), F.lit(0)))
        .withColumn("_rest", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_level", F.expr("(_total - _before) / _rest"))
        .withColumn("_free", F.expr(f"_level * _w <= {cap} * source_size"))
        # The first source that is not capped fixes the level for it and all after it.
        .withColumn("_t", F.first(F.expr("CASE WHEN _free THEN _level END"), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    return two.select(*sizes.columns, F.expr(f"least({cap} * source_size, coalesce(_t * _w, {cap} * source_size))").cast("double").alias("target"))


#: The pivotal step of the fold.  acc.r is the residual document, x the next one;
#: d words move to acc.r (up) or from it (down), just as many as make one of the
#: two integral, with chances that leave both expectations as they were.
_FOLD = """
aggregate(items, struct(cast(null as {item}) AS r, cast(array() as array<{done}>) AS done), (acc, x) ->
  CASE WHEN acc.r IS NULL THEN struct(x AS r, acc.done AS done) ELSE
  element_at(transform(transform(transform(
    array(struct(least((1 - acc.r.p) * acc.r.size, x.p * x.size) AS up,
                 least(acc.r.p * acc.r.size, (1 - x.p) * x.size) AS down,
                 (xxhash64({seed}, acc.r.h, x.h) & 1125899906842623L) / 1125899906842624D AS u)),
    z -> CASE WHEN z.u * (z.up + z.down) < z.down THEN z.up ELSE -z.down END),
    d -> struct(acc.r.p + d / acc.r.size AS i, x.p - d / x.size AS j)),
    q -> CASE WHEN abs(q.i - round(q.i)) <= abs(q.j - round(q.j))
      THEN struct(struct(x.h AS h, x.key AS key, x.size AS size, least(1D, greatest(0D, q.j)) AS p) AS r,
                  concat(acc.done, array(struct(acc.r.key AS key, acc.r.size AS size, cast(round(q.i) as int) AS up))) AS done)
      ELSE struct(struct(acc.r.h AS h, acc.r.key AS key, acc.r.size AS size, least(1D, greatest(0D, q.i)) AS p) AS r,
                  concat(acc.done, array(struct(x.key AS key, x.size AS size, cast(round(q.j) as int) AS up))) AS done) END), 1) END)
"""


def round_dependently(rows: DataFrame, count: int, fan_in: int = FAN_IN, seed: int = SEED) -> DataFrame:
    """``grp, n, key, size > 0, p`` -> ``grp, key, size, up`` with up 0 or 1.

    ``n`` is the number of rows of the group, ``count`` the largest ``n``.
    The sum of ``size * up`` of each group differs from that of ``size * p``
    by less than its largest size.
    """
    key = rows.schema["key"].dataType.simpleString()
    # Equal rows become one with a count, then each again, with a number.
    counted = rows.groupBy("grp", "n", "key", "size", "p").agg(F.count("*").alias("_m"))
    blocks = counted.withColumn("_b", F.explode(F.expr(f"sequence(0L, (_m - 1) div {REPEATS})")))
    rows = blocks.withColumn("_i", F.explode(F.expr(f"sequence(_b * {REPEATS}, least(_m, (_b + 1) * {REPEATS}) - 1)")))
    item, done = f"struct<h:bigint,key:{key},size:bigint,p:double>", f"struct<key:{key},size:bigint,up:int>"
    level = rows.select(
        "grp",
        F.greatest(F.ceil(F.col("n") / fan_in), F.lit(1)).cast("long").alias("groups"),
        F.struct(F.xxhash64(F.lit(seed), "key", "size", "_i").alias("h"), "key", "size", "p").alias("item"),
    )
    settled, left, depth = [], max(1, -(-count // fan_in)), 0
    while True:
        folded = stored(
            level.groupBy("grp", "groups", F.expr(f"pmod(xxhash64({depth}, item.h), groups)").alias("bucket"))
            .agg(F.sort_array(F.collect_list("item")).alias("items"))
            .select("grp", "groups", F.expr(_FOLD.format(item=item, done=done, seed=seed)).alias("f")),
            "mix-level",
        )
        settled.append(folded.select("grp", F.explode("f.done").alias("d")).select("grp", "d.key", "d.size", "d.up"))
        if left == 1:
            break
        level = folded.select("grp", F.expr(f"greatest(cast(ceil(groups / {fan_in}) as long), 1L)").alias("groups"), F.col("f.r").alias("item"))
        left, depth = -(-left // fan_in), depth + 1
    chance = F.expr(f"(xxhash64({seed + 1}, f.r.h) & 1125899906842623L) / 1125899906842624D")
    last = folded.select("grp", "f.r.key", "f.r.size", F.when(chance < F.col("f.r.p"), 1).otherwise(0).alias("up"))
    for part in settled:
        last = last.unionByName(part)
    return last


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, fan_in: int = FAN_IN, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken``: one row per row of ``docs``."""
    light = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    per_source = light.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n")
    )
    plan = stored(
        targets(per_source, weights, cap).select(
            F.col("source").alias("_source"),
            F.xxhash64(F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull()).alias("grp"),
            "source_size",
            "target",
            "n",
            F.expr("coalesce(try_divide(target, source_size), 0D)").alias("rate"),
        ),
        "mix-plan",
    )
    rows = light.join(plan, light["source"].eqNullSafe(plan["_source"])).select(
        "doc_id", "size", "_source", "source_size", "target", "grp", "n", "rate",
        F.expr(f"least(cast(floor(rate + 1e-12) as int), {cap})").alias("whole"),
    )
    # A document's fraction of a copy; sizes 0 have none to give.
    part = F.greatest(F.lit(0.0), F.col("rate") - F.col("whole"))
    count = plan.agg(F.max("n")).first()[0] or 0
    fixed = rows.where((F.col("size") == 0) | (part <= 1e-12)).select("doc_id", "size", "source_size", "target", F.when(F.col("size") == 0, 0).otherwise(F.col("whole")).alias("copies"))
    open_ = rows.where((F.col("size") > 0) & (part > 1e-12))
    rounded = round_dependently(open_.select("grp", "n", F.col("doc_id").alias("key"), "size", part.alias("p")), count, fan_in, seed)
    mixed = rounded.join(plan.select("grp", "source_size", "target", "rate"), "grp").select(
        F.col("key").alias("doc_id"), "size", "source_size", "target",
        (F.expr(f"least(cast(floor(rate + 1e-12) as int), {cap})") + F.col("up")).alias("copies"),
    )
    return fixed.unionByName(mixed).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, cap: int = CAP, **how) -> DataFrame:
    """The documents of the mix: each row as often as it is taken, with the columns it came with.

    Rows of equal id and text take their counts in turn; only such repeats are
    numbered.
    """
    node = F.xxhash64("doc_id", "text")
    counts = mix(docs.select(node.alias("doc_id"), "text", "source"), cap=cap, **how)
    # Of the rows with a node: how many there are, and how many are taken at least 1, 2, ... times.
    least = [F.count_if(F.col("copies") >= k).alias(f"_{k}") for k in range(1, cap + 1)]
    chosen = stored(counts.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_m"), *least).where("_1 > 0"), "mix-copies")
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    met = docs.withColumn("_node", node).join(chosen, F.col("_node") == F.col("_id"))
    times = F.lit(0)
    for k in range(1, cap + 1):
        times = times + (F.col("_turn") <= F.col(f"_{k}")).cast("int")
    turn = Window.partitionBy("_node").orderBy(F.lit(0))
    numbered = met.where("_m = 1").withColumn("_turn", F.lit(1)).unionByName(met.where("_m > 1").withColumn("_turn", F.row_number().over(turn)))
    out = numbered.withColumn("_times", times).where("_times > 0")
    return out.withColumn("_copy", F.explode(F.expr("sequence(1, _times)"))).select(*[F.col(f"`{c}`") for c in docs.columns])
