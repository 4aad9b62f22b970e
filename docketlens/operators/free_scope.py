"""Names of all courts merged under constraints: known judges never fall together, and doubt shuts a name.

A node is a name with the number of its cases and, where known, the ids of a
life-tenured judge (``nid``), of a bankruptcy or magistrate judge
(``ba_mag_id``) and of an earlier run (``sjid``).  Rules look at names alone, so
their edges are found for distinct names by joins; names that edges link make a
component, and the order-dependent merge runs for each component by itself.

A node that meets one other merges with it unless ids forbid that.  Of several,
the only one with an id takes the others; if several have ids, or the node is a
single word, the node stays ambiguous between them and is shut.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from .anchors import anchor, bare
from .components import components
from .endpoints import cut
from .near import near_names, near_pairs
from .variants import name_variants, subset_matches

# Passes of the words rule: letters for first words, for middle words, style.
PASSES = [(False, False, "plain"), (False, True, "plain"), (False, False, "unified"), (False, False, "nicknames"), (False, True, "nicknames")]
#: Rules by number: 0 equal names, 1 near names, 2-6 words of the one in the other, 7 ends, 8 sorted words; these look at
#: later nodes only.  9 joined particles, 10 initials and 11 single letters look from the first name of an edge at all others.
WORDS, DIRECTED, LAST = range(2, 7), (9, 10, 11), 11


def _words(name: str):
    return F.split(F.col(name), " ")


def _word(name: str, i: int):
    return F.coalesce(F.try_element_at(_words(name), F.lit(i)), F.lit(""))


def _initial(word):
    return F.substring(word, 1, 1)


def _size(name: str):
    return F.size(_words(name))


def _ruled(pairs: DataFrame, rule: int) -> DataFrame:
    return pairs.select(F.lit(rule).alias("rule"), "a", "b")


def _symmetric(pairs: DataFrame) -> DataFrame:
    return pairs.where("a < b")


def words_edges(names: DataFrame, rule: int) -> DataFrame:
    """One name holds the other in a style; two-word names need a whole surname and another second word than a longer name."""
    first, middle, style = PASSES[rule - WORDS[0]]
    both = subset_matches(names.withColumn("_s", F.lit(0)), "_s", "name", first, middle, style)

    def fits(x: str, y: str):
        short = F.size(_words(x)) == 2
        return ~short | ((F.length(F.element_at(bare(F.col(x)), -1)) > 1) & ~((_size(y) > 2) & (_word(x, 2) == _word(y, 2))))

    return _ruled(both.where(fits("a", "b") & fits("b", "a")), rule)


def ends_edges(names: DataFrame, rule: int = 7) -> DataFrame:
    """First words and surnames near (85); of names of three words or more second initials agree, and suffixes if both have one.

    Near first words and near surnames are looked up among distinct words, so a frequent surname is no meeting place."""
    t = bare(F.col("name"))
    suffix = F.when(F.element_at(_words("name"), -1).isin(P.SUFFIXES), F.element_at(_words("name"), -1))
    ends = cut(names.select("name", F.element_at(t, 1).alias("f"), F.element_at(t, -1).alias("l"), F.when(_size("name") >= 3, _initial(F.try_element_at(t, F.lit(2)))).alias("i"), suffix.alias("s")))
    first, last = (_near_words(ends.select(F.col(c).alias("w"))).toDF(c, f"{c}2") for c in ("f", "l"))
    reach = ends.select("f", "l").distinct().join(first, "f").join(last, "l")
    x, y = ends.select(F.col("name").alias("a"), "f", "l", "i", "s"), ends.select(F.col("name").alias("b"), F.col("f").alias("f2"), F.col("l").alias("l2"), F.col("i").alias("i2"), F.col("s").alias("s2"))
    near = reach.join(x, ["f", "l"])
    # Long names meet long names of their initial; short ones meet all, from either side.
    long = near.where("i IS NOT NULL").join(y.where("i2 IS NOT NULL").withColumnRenamed("i2", "i"), ["f2", "l2", "i"]).where("s IS NULL OR s2 IS NULL OR s = s2").select("a", "b")
    short = near.where("i IS NULL").join(y, ["f2", "l2"]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return _ruled(_symmetric(long.unionByName(short)).distinct(), rule)


def _near_words(words: DataFrame, least: int = 85) -> DataFrame:
    """``w, v``: words with the words that are near them, both ways round, and with themselves."""
    own = words.select("w").where("w IS NOT NULL").distinct()
    near = near_pairs(own, "w", least)
    return near.toDF("w", "v").unionByName(near.select(F.col("b").alias("w"), F.col("a").alias("v"))).unionByName(own.select("w", F.col("w").alias("v")))


def _sorted(name: str = "name"):
    return F.array_join(F.array_sort(_words(name)), " ")


def _plural_ends(x: str, y: str):
    return F.element_at(bare(F.col(x)), 1) == F.concat(F.element_at(bare(F.col(y)), -1), F.lit("s"))


def sorted_edges(names: DataFrame, rule: int = 8) -> DataFrame:
    """Three words or more, the same ones in another order (98), without first words that are the other's surname with an s,
    and without two different letters in the middle of three words."""
    near = near_names(names.where(_size("name") > 2).withColumn("_t", _sorted()), "name", "_t", 98)
    letters = (_size("a") == 3) & (_size("b") == 3) & (F.length(_word("a", 2)) == 1) & (F.length(_word("b", 2)) == 1) & (_word("a", 2) != _word("b", 2))
    return _ruled(_symmetric(near).where(~_plural_ends("a", "b") & ~_plural_ends("b", "a") & ~letters), rule)


def particle_edges(names: DataFrame, rule: int = 9) -> DataFrame:
    """A name with the word ``van``, joined to the next word, against names where it is joined already: surnames near (90)."""
    vans = names.where(F.col("name").rlike("^van | van"))
    apart = F.array_contains(_words("name"), "van")
    joined = F.regexp_replace("name", r"^((?:(?!van )\S+ )*)van ", "$1van")
    new, old = vans.where(apart).select("name", anchor(joined).alias("w")), vans.where(~apart).select(F.col("name").alias("b"), anchor(F.col("name")).alias("v"))
    words = new.select("w").unionByName(old.select(F.col("v").alias("w")))
    return _ruled(new.join(_near_words(words, 90), "w").join(old, "v").select(F.col("name").alias("a"), "b").distinct(), rule)


def _initialism():
    return (_size("name") == 3) & ~_word("name", 3).isin(P.SUFFIXES) & (F.length(_word("name", 3)) == 1) & (F.length(_word("name", 1)) > 2) & (F.length(_word("name", 2)) == 1)


def initials_edges(names: DataFrame, rule: int = 10) -> DataFrame:
    """``xxx m k`` against names with that first word whose second and third, or third and fourth, words begin so."""
    short = names.where(_initialism()).select(F.col("name").alias("a"), F.col("name").alias("k"))
    key = lambda i: F.concat_ws(" ", _word("name", 1), _initial(_word("name", i)), _initial(_word("name", i + 1)))
    keys = F.when(_size("name") > 3, F.array(key(2), key(3))).otherwise(F.array(key(2)))
    long = names.where(_size("name") >= 3).select(F.col("name").alias("b"), F.explode(F.array_distinct(keys)).alias("k"))
    return _ruled(short.join(long, "k").where("a <> b").select("a", "b").distinct(), rule)


def letter_edges(names: DataFrame, rule: int = 11) -> DataFrame:
    """A name that begins with a letter, against those of equal second word and near words in any order (81), and those of equal
    surname and near initials (92), unless both second words are whole and differ."""
    t, last = bare(F.col("name")), anchor(F.col("name"))
    initials = F.array_join(F.transform(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), _initial), " ")
    suffix = F.slice(_words("name"), F.size(t) + 1, F.size(_words("name")) - F.size(t))
    told = names.select("name", (F.length(_word("name", 1)) == 1).alias("_one"), _word("name", 2).alias("second"), last.alias("last"), _sorted().alias("t"), F.concat_ws(" ", initials, last, suffix).alias("i"))
    told = cut(told.where(_size("name") >= 2))
    where = lambda c: told.join(told.where("_one").select(c).distinct(), c, "left_semi")
    words = near_names(where("second"), "name", "t", 81, ("second",))
    ends = near_names(where("last"), "name", "i", 92, ("last",))
    differ = (F.length(_word("a", 2)) > 1) & (F.length(_word("b", 2)) > 1) & (_word("a", 2) != _word("b", 2))
    return _ruled(words.unionByName(ends.where(~differ)).where(F.length(_word("a", 1)) == 1).distinct(), rule)


def _own(names: DataFrame) -> DataFrame:
    """Names of several nodes by the rules that hold between a name and itself: what equal names did not merge meets there again."""
    several = names.where("n > 1")
    lone = (_size("name") == 2) & (F.length(F.element_at(bare(F.col("name")), -1)) == 1)
    holds = {1: F.lit(True), 7: F.lit(True), 8: (_size("name") > 2) & ~_plural_ends("name", "name"), 10: _initialism(), 11: F.length(_word("name", 1)) == 1}
    holds |= {r: ~lone for r in WORDS if PASSES[r - WORDS[0]][2] != "unified"}
    rules = F.array_compact(F.array(*[F.when(h, F.lit(r)) for r, h in holds.items()]))
    out = several.select(F.explode(rules).alias("rule"), F.col("name").alias("a"), F.col("name").alias("b"))
    unified = WORDS[0] + [p[2] for p in PASSES].index("unified")
    spelled = name_variants(several.where(~lone).select("name"), "name", style="unified").select("name").distinct()
    return out.unionByName(_ruled(spelled.select(F.col("name").alias("a"), F.col("name").alias("b")), unified))


def free_edges(names: DataFrame) -> DataFrame:
    """``rule, a, b`` of ``name, n`` (distinct names of several words, and how many nodes have each)."""
    parts = [_ruled(near_pairs(names, "name", 95), 1), *(words_edges(names, r) for r in WORDS), ends_edges(names), sorted_edges(names), particle_edges(names), initials_edges(names), letter_edges(names), _own(names)]
    return reduce(DataFrame.unionByName, parts)


class Node:
    """A name while it is merged."""

    __slots__ = ("ambiguous", "ba_mag_id", "below", "name", "nid", "node", "open", "possible", "sjid", "top", "weight", "words")

    def __init__(self, node, name, weight, nid, ba_mag_id, sjid):
        self.node, self.name, self.weight, self.nid, self.ba_mag_id, self.sjid = node, name, weight, nid, ba_mag_id, sjid
        self.words, self.top, self.below, self.possible, self.open, self.ambiguous = name.split(" "), self, [], [], True, False

    def rank(self):
        """Known judges first (tenured, other, named before), then more than a word, more cases, more words, the longer name."""
        return self.nid is not None, self.ba_mag_id is not None, self.sjid is not None, len(self.words) > 1, self.weight, len(self.words), len(self.name)

    def absorb(self, other: Node) -> None:
        for c in ("nid", "ba_mag_id", "sjid"):
            if getattr(self, c) is None:
                setattr(self, c, getattr(other, c))
        for o in (other, *other.below):
            o.top, o.open = self, False
        self.below += [other, *other.below]
        other.below = []

    def meet(self, other: Node) -> None:
        """Merge the two unless that would join two judges; of equals the first absorbs the other."""
        both = lambda c: getattr(self, c) is not None and getattr(other, c) is not None
        if not (both("sjid") or both("nid") or (both("ba_mag_id") and self.ba_mag_id != other.ba_mag_id)):
            winner, loser = (self, other) if self.rank() >= other.rank() else (other, self)
            winner.absorb(loser)

    def doubt(self, others: list[Node]) -> None:
        for o in (self, *self.below):
            o.possible += others
            o.ambiguous, o.open = True, False

    def settle(self, found: list[Node]) -> None:
        if len(found) == 1:
            return self.meet(found[0])
        if len(self.words) == 1:
            return self.doubt(found)
        for id_ in ("nid", "ba_mag_id"):
            known = [o for o in found if getattr(o, id_) is not None or o.sjid is not None]
            if len(known) > 1:
                return self.doubt(known)
            if known:
                for o in found:
                    if o is not known[0]:
                        known[0].absorb(o)
                return self.meet(known[0])
        best = self
        for o in found:
            best.meet(o)
            best = best if best.open else o


def merged(nodes: list[Node], edges: dict[int, dict[str, set[str]]]) -> None:
    """The rules in their order over nodes in their order; ``edges`` gives the names that a name looks at, by rule."""
    at = {o: i for i, o in enumerate(nodes)}
    named: dict[str, list[Node]] = {}
    for o in nodes:
        named.setdefault(o.name, []).append(o)
    for rule in range(LAST + 1):
        for this in [o for o in nodes if o.open]:
            looks = (this.name,) if rule == 0 else edges.get(rule, {}).get(this.name, ())
            if not this.open or not looks:
                continue
            found = sorted((o for n in looks for o in named.get(n, ()) if o.open and o is not this and (rule in DIRECTED or at[o] > at[this])), key=at.get)
            ends = [o for o in found if o.words[-1] in P.SUFFIXES]
            if rule in WORDS and len(found) > 1 and this.words[-1] in P.SUFFIXES and ends:
                found = ends
            if found:
                this.settle(found)


def equal_names(rows: DataFrame) -> DataFrame:
    """Rule 0 over all nodes, by built-in functions: ``rows`` with ``rep``, ``open`` and ``possible``.

    Of the nodes of a name, in order, each meets all later ones.  While two or more of these have a ``nid`` or ``sjid`` it is
    shut between them; where one has, it takes the rest.  Where none has, the same holds for those with a ``ba_mag_id``;
    without these all later ones merge with the node.  So where it ends is told by the last two nodes with ids, and at most two
    nodes of a name stay open, which may still meet: ``merged`` sees to that.  ``rep`` is the node that took a node
    (itself, if none), an open node has the ids that it took, and ``possible`` (null where not shut) is a shut node's.
    """
    known, node = F.col("nid").isNotNull() | F.col("sjid").isNotNull(), F.col("node")
    ids = [F.col(c).isNotNull() for c in ("nid", "ba_mag_id", "sjid")]
    by = cut(rows.groupBy("name").agg(
        F.min("node").alias("first"), F.sort_array(F.collect_list(F.when(known, node))).alias("ks"), F.sort_array(F.collect_list(F.when(ids[1], F.struct("node", "ba_mag_id")))).alias("bs"),
        F.min_by(reduce(lambda x, y: x | y, ids), "node").alias("led"), F.max(F.struct("weight", (-node).alias("o"))).alias("most"),
    ))
    last = lambda a, i: F.try_element_at(a, F.lit(-i))
    b = F.transform("bs", lambda x: x["node"])
    # Case a: some later node has a nid or sjid; b: one has a ba_mag_id; else all merge.
    a_case, b_case = F.coalesce(last(F.col("ks"), 1) > F.col("first"), F.lit(False)), F.coalesce(last(b, 1) > F.col("first"), F.lit(False))
    by = by.select(
        F.col("name").alias("_name"), F.when(a_case, F.col("ks")).when(b_case, b).otherwise(F.array().cast("array<long>")).alias("_ids"), "first",
        F.when(~a_case & ~b_case, F.when(F.col("led"), F.col("first")).otherwise(-F.col("most.o"))).alias("_won"), F.when(a_case, F.col("bs")).alias("_bs"),
    )
    by = by.withColumns({"_taker": F.coalesce("_won", last(F.col("_ids"), 1)), "_from": F.coalesce(F.when(F.col("_won").isNull(), last(F.col("_ids"), 2)), "first")})
    by = by.withColumn("_ba", F.get(F.filter("_bs", lambda x: (x["node"] > F.col("_from")) & (x["node"] != F.col("_taker"))), F.lit(0))["ba_mag_id"])
    told = rows.join(by.drop("_bs", "first"), F.col("name") == F.col("_name"))
    shut = node < F.col("_from")
    own = shut | (node == F.col("_taker")) | (F.col("_won").isNull() & (node == F.col("_from")))
    return told.select(
        "node", "name", "weight", "nid", F.when(~shut & (node == F.col("_taker")), F.coalesce("ba_mag_id", "_ba")).otherwise(F.col("ba_mag_id")).alias("ba_mag_id"), "sjid",
        F.when(own, node).otherwise(F.col("_taker")).alias("rep"), (own & ~shut).alias("open"), F.when(shut, F.filter("_ids", lambda x: x > node)).alias("possible"),
    )


def resolve_free(nodes: DataFrame) -> DataFrame:
    """``node, name, points_to, nid, ba_mag_id, sjid, is_ambiguous, possible`` of ``node, name, weight, nid, ba_mag_id, sjid``.

    ``points_to`` is the node that a node ended in (itself, if none), the ids are that node's; ``possible`` lists the nodes that an
    ambiguous one may be, in the order in which they came up.  Nodes are taken in order of ``node``, a unique number.  Names are
    cleaned ones: words with single spaces.  Nodes without a name, or of one word or letters alone, take no part and keep
    their ids; a null weight counts as 0 and empty ids as none.  Further columns are left out.
    """
    ids = [F.nullif(F.col(c), F.lit("")).alias(c) for c in ("nid", "ba_mag_id", "sjid")]
    rows = cut(nodes.select(F.col("node").cast("long").alias("node"), "name", F.coalesce(F.col("weight").cast("long"), F.lit(0)).alias("weight"), *ids))
    fit = F.coalesce((_size("name") > 1) & F.exists(_words("name"), lambda w: F.length(w) > 1), F.lit(False))
    names = cut(rows.where(fit).groupBy("name").agg(F.count("*").alias("n")))
    edges = cut(free_edges(names))
    parts = components(edges, "a", "b")
    told = equal_names(rows.where(fit))
    # Only what is open after equal names have met goes on; the others follow the node that took them.
    placed = told.where("open").withColumnRenamed("node", "_n").join(parts, F.col("name") == parts["node"], "left").select(F.col("_n").alias("node"), "name", "weight", "nid", "ba_mag_id", "sjid", F.coalesce("component", "name").alias("component"))
    # A component of one node has nothing to merge and is not taken to Python.
    sizes = placed.groupBy("component").agg((F.count("*") > 1).alias("_many"))
    placed = cut(placed.join(sizes, "component"))
    alone = placed.where("NOT _many").drop("component", "_many", "weight")
    linked = edges.join(parts.withColumnRenamed("node", "a"), "a").select("component", "rule", "a", "b")
    schema = "node long, name string, points_to long, nid string, ba_mag_id string, sjid string, is_ambiguous boolean, possible array<long>"

    def run(key, people: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        text = lambda v: v if isinstance(v, str) else None
        own = [Node(int(r.node), r.name_, int(r.weight), text(r.nid), text(r.ba_mag_id), text(r.sjid)) for r in people.rename(columns={"name": "name_"}).sort_values("node").itertuples()]
        looks: dict[int, dict[str, set[str]]] = {}
        for rule, a, b in zip(links["rule"], links["a"], links["b"], strict=True):
            looks.setdefault(rule, {}).setdefault(a, set()).add(b)
            if rule not in DIRECTED:
                looks[rule].setdefault(b, set()).add(a)
        merged(own, looks)
        out = [(o.node, o.name, o.top.node, o.top.nid, o.top.ba_mag_id, o.top.sjid, o.ambiguous, [p.node for p in o.possible]) for o in own]
        return pd.DataFrame(out, columns=["node", "name", "points_to", "nid", "ba_mag_id", "sjid", "is_ambiguous", "possible"])

    many = placed.where("_many").drop("_many").groupBy("component").cogroup(linked.groupBy("component")).applyInPandas(run, schema)
    none = F.array().cast("array<long>")
    lone = lambda x: x.select("node", "name", F.col("node").alias("points_to"), "nid", "ba_mag_id", "sjid", F.lit(False).alias("is_ambiguous"), none.alias("possible"))
    tops = cut(many.unionByName(lone(alone))).withColumnRenamed("node", "_rep").drop("name")
    open_ = told.where("possible IS NULL").select("node", "name", "rep").join(tops, F.col("rep") == F.col("_rep")).drop("rep", "_rep")
    shut = told.where("possible IS NOT NULL").select("node", "name", F.col("node").alias("points_to"), "nid", "ba_mag_id", "sjid", F.lit(True).alias("is_ambiguous"), "possible")
    return open_.unionByName(shut).unionByName(lone(rows.where(~fit)))
