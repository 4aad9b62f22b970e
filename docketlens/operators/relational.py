"""Relational steps of entity upkeep: counts, pivots, ids, keyed replacement, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from .endpoints import cut


def counts_full_outer(a: DataFrame, b: DataFrame, keys: list[str], case: str) -> DataFrame:
    """Distinct cases by keys in either table, 0 where a side has none."""
    x = a.groupBy(*keys).agg(F.countDistinct(case).alias("n_entries"))
    y = b.groupBy(*keys).agg(F.countDistinct(case).alias("n_headers"))
    return x.join(y, keys, "full").na.fill(0, ["n_entries", "n_headers"])


def category_pivot(rows: DataFrame, entity: str, category: str, case: str, categories: list[str]) -> DataFrame:
    """Distinct cases of each entity by category, a column per listed category."""
    return rows.groupBy(entity).pivot(category, categories).agg(F.countDistinct(case)).na.fill(0)


def label_ladder(pivot: DataFrame, total: str, head: str, categories: list[str], fjc: str | None = None, ba_mag: str | None = None, prior: str | None = None) -> DataFrame:
    """A label for each entity, by the first rule that holds; ties for the largest share go to the category listed first.

    ``fjc`` and ``ba_mag`` are flags of known judges, ``prior`` an earlier id:
    an entity that has one keeps its label where the ladder would deny one.
    """
    s = reduce(lambda a, b: a + b, [F.col(c) for c in categories])
    share = {c: F.try_divide(100.0 * F.col(c), s) for c in categories}
    of = lambda c: share.get(c, F.lit(0.0))
    ranked, weak = ("Magistrate_Judge", "District_Judge", "Bankruptcy_Judge"), ("Nondescript_Judge", "No_Keywords", "Judicial_Actor")
    seen, headed = {c: F.lit(True) for c in ranked} | {"District_Judge": F.col(total) > 3}, F.col(head) > 0
    largest = lambda cs: F.array_max(F.array(*[F.struct(share[c].alias("share"), F.lit(-i).alias("i"), F.lit(c).alias("name")) for i, c in enumerate(cs)]))
    top, next_ = largest(categories)["name"], largest([c for c in categories if c != "Nondescript_Judge"])
    rules = [(F.col(flag), label) for flag, label in ((fjc, "FJC Judge"), (ba_mag, "BA-MAG Judge")) if flag]
    rules += [((F.col(total) <= 3) & ~headed, "deny - low occurence"), (of("No_Keywords") == 100, "deny - Junk")]
    rules += [(share[c] == 100, c) for c in categories]
    for c in ranked:
        rules.append((reduce(lambda a, b: a & b, [share[o] == 0 for o in categories if o != c and o not in weak], F.lit(True)) & seen[c], c))
    rules += [((of(c) >= 50) & seen[c], c) for c in ranked]
    for c in ranked:
        rules.append((reduce(lambda a, b: a & b, [of(o) < 25 for o in ranked if o != c]) & (of(c) >= 25) & seen[c], c))
    rules += [((of(c) > 5) & headed, label) for c, label in (("District_Judge", "District_Judge**"), ("Magistrate_Judge", "Magistrate_Judge"), ("Bankruptcy_Judge", "Bankruptcy_Judge**"))]
    generic = (F.col(total) >= 25) & (top == "Nondescript_Judge")
    rules += [(generic & (next_["share"] > 10), next_["name"]), (generic, "Nondescript_Judge")]
    rules.append(((top == "No_Keywords") & (of("No_Keywords") >= 90), "--- deny --- insufficient data"))
    rules.append((of("No_Keywords") + of("Judicial_Actor") > 60, "--- deny --- clerk or attorney"))
    out = F.when(F.lit(False), "")
    for holds, label in rules:
        out = out.when(holds, label)
    out = out.otherwise("Nondescript_Judge")
    if prior:
        out = F.when(F.col(prior).isNotNull() & out.contains("deny"), "Maintain Prior JEL").otherwise(out)
    return pivot.withColumn("label", out)


def frequent(rows: DataFrame, keys: list[str], case: str, least: int) -> DataFrame:
    """Rows whose group has more than ``least`` distinct cases."""
    kept = rows.groupBy(*keys).agg(F.countDistinct(case).alias("_n")).where(F.col("_n") > least).select(*keys)
    return rows.join(kept, keys, "left_semi")


def unique_container(names: DataFrame, name: str) -> DataFrame:
    """Each name with the only longer name that contains it, if there is one, else itself.

    A container holds every trigram of the name, so a name looks for its rarest one: names that begin alike do not all meet.
    """
    distinct = names.select(F.col(name).alias("n")).where("n IS NOT NULL").distinct()
    grams = "if(length(n) < 3, array(n), transform(sequence(1, length(n) - 2), i -> substring(n, i, 3)))"
    every = "array_union(" + grams + ", flatten(transform(sequence(1, 2), k -> transform(sequence(1, greatest(length(n) - k + 1, 1)), i -> substring(n, i, k)))))"
    # Names shorter than a trigram are looked for by all of themselves.
    brief = distinct.where("length(n) < 3").limit(1).count() > 0
    index = distinct.select(F.col("n").alias("l"), F.explode(F.array_distinct(F.expr(every if brief else grams))).alias("g"))
    often = index.groupBy("g").agg(F.count("*").alias("_k"))
    own = distinct.select("n", F.explode(F.array_distinct(F.expr(grams))).alias("g")).join(often, "g")
    short = own.groupBy("n").agg(F.min_by("g", F.struct("_k", "g")).alias("g"))
    hits = short.join(index, "g").where("length(l) > length(n) AND contains(l, n)").groupBy("n").agg(F.count("*").alias("k"), F.min("l").alias("l"))
    return distinct.join(hits, "n", "left").select(F.col("n").alias(name), F.when(F.col("k") == 1, F.col("l")).otherwise(F.col("n")).alias("resolved"))


def assign_ids(new: DataFrame, order: list[str], start: int = 0, prefix: str = "SJ", width: int = 6) -> DataFrame:
    """Consecutive ids in a stated order, from ``start``; entities, not rows, are numbered.

    Ranges of the order are numbered by themselves, each from the number of entities in the ranges before it (a row
    a range), so no task holds them all.  Entities that are equal in the order stand in any order.
    """
    ranged = cut(new.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1).join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    n = F.col("_local") + F.col("_before") + F.lit(start)
    return placed.withColumn("sjid", F.concat(F.lit(prefix), F.format_string(f"%0{width}d", n))).drop("_part", "_local", "_before", "_n")


def continue_ids(old: DataFrame, new: DataFrame, name: str, id_: str = "sjid", prefix: str = "SJ", width: int = 6) -> DataFrame:
    """Names of ``new`` with their id in ``old``, or the next free ids in alphabetical order; every old name stays."""
    top = old.agg(F.max(F.regexp_extract(id_, r"(\d+)$", 1).cast("long"))).first()[0]
    unknown = new.select(name).where(F.col(name).isNotNull()).distinct().join(old.select(name), name, "left_anti")
    fresh = assign_ids(unknown, [name], 0 if top is None else top + 1, prefix, width).withColumnRenamed("sjid", id_)
    return old.select(name, id_).unionByName(fresh)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Old rows, with values replaced where the null-safe key is in ``new``; new keys are not added."""
    renamed = new.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.struct(*values).alias("_v"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    joined = old.join(renamed, on, "left")
    return joined.select(*[F.when(F.col("_v").isNotNull(), F.col(f"_v.{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in old.columns])


def unpivot_appointments(wide: DataFrame, keys: list[str], groups: dict[int, list[str]], names: list[str]) -> DataFrame:
    """Numbered column groups to rows, without those that are all null."""
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("number"), *[F.col(c).alias(n) for c, n in zip(cols, names, strict=True)]) for i, cols in groups.items()]))
    long = wide.select(*keys, rows.alias("r")).select(*keys, "r.*")
    return long.where(reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in names]))


def better_label(old: str, new: str, order: list[str] | None = None):
    """The label of the better rank; unknown labels rank last."""
    order = order or P.LABEL_RANK
    place = F.create_map(*[x for i, label in enumerate(order) for x in (F.lit(label), F.lit(i))])
    rank = lambda c: F.coalesce(F.try_element_at(place, F.col(c)), F.lit(len(order)))
    return F.when(F.col(new).isNull() | (rank(old) <= rank(new)), F.col(old)).otherwise(F.col(new))
