"""Rules that compare names by their anchor (the surname): three of the case scope, two of the free scope, and the
crossover of lone surnames.  Each takes pairs ``a, b`` (a stands first) and gives edges for ``resolve.fold``."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.fuzzy import similarity
from .resolve import blocked_pairs, edges_of_texts, fold, fuzzy_edges, ordered, subset_pairs, token_edges, tokens


def bare(name: Column) -> Column:
    """Words without a suffix at the end."""
    t = tokens(name)
    return F.when(F.coalesce(F.try_element_at(t, F.lit(-1)).isin(P.SUFFIXES), F.lit(False)), F.slice(t, 1, F.size(t) - 1)).otherwise(t)


def anchor(name: Column) -> Column:
    """The surname; null for a suffix alone."""
    return F.try_element_at(bare(name), F.lit(-1))


def _grams(text: Column, n: int, mark: str) -> Column:
    whole = F.array(F.concat(F.lit(mark), text))
    return F.when(F.length(text) <= n, whole).otherwise(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n)))))


def anchor_pairs(nodes: DataFrame, scope: str, name: str, keep: tuple = ()) -> DataFrame:
    """Pairs that any rule here can accept: besides trigrams and words, they may share two letters of their anchors,
    or three of their words written as one, where an anchor counts as such a word too."""
    low = F.coalesce(anchor(F.col(name)), F.lit(""))
    more = F.array_union(_grams(low, 2, "2:"), F.array_union(_grams(F.array_join(tokens(F.col(name)), ""), 3, "3:"), _grams(low, 3, "3:")))
    return blocked_pairs(nodes, scope, name, keep, more)


def _word(words: Column, i: int) -> Column:
    """A word by its place (from the end, if negative); empty if there is none."""
    return F.coalesce(F.try_element_at(words, F.lit(i)), F.lit(""))


def _near(a: Column, b: Column, least: int, measure: str = "ratio") -> Column:
    return F.coalesce(similarity(measure, a, b) >= least, F.lit(False))


def _edges(pairs: DataFrame, hit: Column, scope: str, rule: int) -> DataFrame:
    return pairs.where(F.coalesce(hit, F.lit(False))).select(scope, F.lit(rule).alias("rule"), "a_ord", "b_ord")


class _Two:
    """Columns of a pair that the rules share."""

    def __init__(self):
        names = [F.lower(c) for c in ("a", "b")]
        self.name = [F.array_join(tokens(n), " ") for n in names]
        self.words = [tokens(n) for n in names]
        self.bare = [bare(n) for n in names]
        self.anchor = [anchor(n) for n in names]
        self.fused = [F.array_join(w, "") for w in self.words]
        self.size = [F.size(w) for w in self.words]

    def ends_near(self, least: int) -> Column:
        return _near(_word(self.bare[0], 1), _word(self.bare[1], 1), least) & _near(_word(self.bare[0], -1), _word(self.bare[1], -1), least)


def surname_edges(pairs: DataFrame, scope: str, rule: int = 8) -> DataFrame:
    """Close or contained anchors of two letters or more.  Lone surnames may differ by two letters in length; of other
    names one is a prefix word with the rest within the other, or different first words stand in names that contain
    each other."""
    t = _Two()
    close = (F.length(t.anchor[0]) > 1) & (F.length(t.anchor[1]) > 1) & (_near(*t.anchor, 92) | _near(*t.anchor, 92, "partial_ratio"))
    lone = (F.size(t.bare[0]) == 1) | (F.size(t.bare[1]) == 1)
    split = reduce(lambda x, y: x | y, [(t.size[i] == 2) & _word(t.words[i], 1).isin(P.SPLIT_PREFIXES) & _near(_word(t.words[i], 2), t.name[1 - i], 92, "partial_ratio") for i in (0, 1)])
    first = [_word(w, 1) for w in t.words]
    within = (t.size[0] >= 2) & (t.size[1] >= 2) & (F.length(first[0]) > 1) & (F.length(first[1]) > 1) & (first[0] != first[1]) & _near(*t.name, 98, "partial_ratio")
    return _edges(pairs, close & F.when(lone, F.abs(F.length(t.anchor[0]) - F.length(t.anchor[1])) <= 2).otherwise(split | within), scope, rule)


def surname_or_ends_edges(pairs: DataFrame, scope: str, rule: int = 9) -> DataFrame:
    """Close anchors with the same words, or one of them alone; a stray letter that belongs to the surname; close first
    and last words unless second initials or middle words differ; two words that close the other's name."""
    t = _Two()
    same = _near(*t.anchor, 90) & (_near(*t.name, 98, "token_set_ratio") | ((t.size[0] == 1) != (t.size[1] == 1)))
    stray = (t.size[0] == 2) & ((F.length(_word(t.words[0], 1)) == 1) | (F.length(_word(t.words[0], 2)) == 1)) & _near(t.fused[0], t.anchor[1], 95)
    second = [F.substring(_word(b, 2), 1, 1) for b in t.bare]
    veto = (t.size[0] >= 3) & (t.size[1] >= 3) & (second[0] != second[1])
    middle = (F.size(t.bare[0]) == 3) & (F.size(t.bare[1]) == 3) & (_word(t.bare[0], 2) != _word(t.bare[1], 2))
    ends = (t.size[0] >= 2) & (t.size[1] >= 2) & ~veto & ~middle & t.ends_near(90)
    closing = (t.size[0] == 2) & (t.size[1] > 2) & _near(_word(t.bare[0], 1), _word(t.bare[1], -2), 90) & _near(_word(t.bare[0], 2), _word(t.bare[1], -1), 90)
    return _edges(pairs, same | stray | ends | closing, scope, rule)


def fused_name_edges(pairs: DataFrame, scope: str, rule: int = 10, header: str | None = None) -> DataFrame:
    """Close first and last words, or close names written as one word; a leading j or jude before the other's anchor;
    names joined by dots that contain each other or are close, of more than three letters and, where the second is
    one word, not from a header (``b_<header>``)."""
    t = _Two()
    many = t.size[0] >= 2
    whole = (t.size[1] >= 2) & (t.ends_near(90) | _near(*t.fused, 95))
    titled = _word(t.words[0], 1).isin("j", "jude") & _near(_word(t.words[0], 2), t.anchor[1], 92)
    dots = [F.array_join(w, ".") for w in t.words]
    from_header = F.coalesce(F.col(f"b_{header}"), F.lit(False)) if header else F.lit(False)
    joined = (F.contains(dots[0], dots[1]) | F.contains(dots[1], dots[0]) | _near(*dots, 92)) & (F.length(t.fused[0]) > 3) & (F.length(t.fused[1]) > 3) & ~((t.size[1] == 1) & from_header)
    return _edges(pairs, many & (whole | titled | joined), scope, rule)


def first_letter_edges(pairs: DataFrame, scope: str, rule: int = 11) -> DataFrame:
    """A name that begins with a letter, against one of the same words in any order (nearly) and an equal second word,
    or one with the same anchor and close initials, unless both second words are whole and differ."""
    t = _Two()
    initials = [F.concat_ws(" ", F.array_join(F.transform(F.slice(b, 1, F.greatest(F.size(b) - 1, F.lit(0))), lambda w: F.substring(w, 1, 1)), " "), F.slice(w, F.size(b) + 1, F.size(w) - F.size(b)), F.array(a)) for b, w, a in zip(t.bare, t.words, t.anchor, strict=True)]
    second = [_word(w, 2) for w in t.words]
    begins = (F.length(_word(t.words[0], 1)) == 1) | (F.length(_word(t.words[1], 1)) == 1)
    differ = (F.length(second[0]) > 1) & (F.length(second[1]) > 1) & (second[0] != second[1])
    hit = (_near(*t.name, 81, "token_sort_ratio") & (second[0] == second[1])) | (_near(*initials, 92) & (t.anchor[0] == t.anchor[1]) & ~differ)
    return _edges(pairs, (t.size[0] >= 2) & (t.size[1] >= 2) & begins & hit, scope, rule)


def crossover(nodes: DataFrame, scope: str, name: str) -> DataFrame:
    """``scope, name, points_to, is_ambiguous`` of the lone surnames that are the surname of a longer name of their
    scope up to a final s, or up to the order of letters (80 or more alike); several such names leave it ambiguous."""
    low = nodes.select(scope, name, F.size(tokens(F.col(name))).alias("_n"), F.lower(name).alias("_w"), anchor(F.col(name)).alias("_a"))
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    one = low.where("_n = 1").select(scope, name, "_w")
    long = low.where("_n > 1 AND _a IS NOT NULL").select(F.col(scope).alias("_s"), F.col(name).alias("_l"), "_a")
    here = F.col(scope) == F.col("_s")
    plural = [one.join(long, here & (F.col("_w") == F.concat("_a", F.lit("s")))), one.join(long, here & (F.col("_a") == F.concat("_w", F.lit("s"))))]
    mixed = one.withColumn("_k", letters(F.col("_w"))).join(long.withColumn("_j", letters(F.col("_a"))), here & (F.col("_k") == F.col("_j"))).where(similarity("ratio", F.col("_w"), F.col("_a")) >= 80)
    found = reduce(DataFrame.unionByName, [x.select(scope, name, "_l") for x in (*plural, mixed)])
    k = F.countDistinct("_l")
    return found.groupBy(scope, name).agg(F.when(k == 1, F.max("_l")).alias("points_to"), (k > 1).alias("is_ambiguous"))


def same_name(nodes: DataFrame, name: str, id_: str, order: str) -> DataFrame:
    """``name, points_to, is_ambiguous`` of names that stand in several nodes: the first node with an id, else the first;
    ambiguous, without a node, if they have several ids."""
    first = F.min_by(order, F.struct(F.isnull(id_), F.col(order)))
    out = nodes.groupBy(name).agg(F.count("*").alias("_n"), F.countDistinct(id_).alias("_k"), first.alias("_f")).where("_n > 1")
    return out.select(name, F.when(F.col("_k") <= 1, F.col("_f")).alias("points_to"), (F.col("_k") > 1).alias("is_ambiguous"))


#: Rules of the case scope in their order.
CASE_RULES = [surname_edges, surname_or_ends_edges, fused_name_edges]


def resolve_case(mentions: DataFrame, scope: str, name: str, case: str, least: int = 93, header: str | None = None) -> DataFrame:
    """``scope, name, points_to``: names of each scope by closeness, by ordered words, then by the anchor rules, in one fold.

    ``header`` is a flag of mentions from headers; a name is from one if any of its mentions is.  Mentions without a name or
    scope take no part; ``scope`` may be the case itself.
    """
    told = mentions.where(F.col(name).isNotNull() & F.col(scope).isNotNull())
    flags = [F.coalesce(F.max(F.col(header).cast("boolean")), F.lit(False)).alias(header)] if header else []
    nodes = ordered(told.groupBy(scope, name).agg(F.countDistinct(case).alias("weight"), *flags), scope, name)
    keep = (header,) if header else ()
    close = lambda p, s: fuzzy_edges(p, s, "ratio", least, 1)
    anchored = [partial(rule, header=header) if rule is fused_name_edges else rule for rule in CASE_RULES]
    # Pairs of the anchor rules hold all that a ratio of 93 can accept.
    found = [edges_of_texts(anchor_pairs(nodes, scope, name, keep), scope, anchored + [close] * (least >= 93), keep), edges_of_texts(subset_pairs(nodes, scope, name), scope, [token_edges])]
    if least < 93:
        found.append(edges_of_texts(blocked_pairs(nodes, scope, name, least=least), scope, [close]))
    return fold(nodes, reduce(DataFrame.unionByName, found), scope, name, "weight")
