"""Entity resolution: pairwise rules as blocked joins, then one ordered fold per scope.

Rules look only at fixed attributes of two names.  Their edges are found in
parallel; the fold then walks the edges in order (rule, then position) and lets
the winner absorb the loser unless it was absorbed before.  Names that no chain of
edges links cannot change one another, so each component of a scope is folded by itself.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions.fuzzy import similarity
from .components import components
from .endpoints import cut


#: Pairs of names that are worth a task of their own.
PAIRS_A_TASK = 1000


def _tasks(rows: DataFrame) -> int:
    """Tasks for costly rows, which are few bytes and so would be put together in a few tasks."""
    spark = rows.sparkSession
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return min(most, rows.count() // PAIRS_A_TASK + 1)


def tokens(name):
    return F.filter(F.split(F.lower(name), r"[\s.]+"), lambda t: t != "")


def ordered(nodes: DataFrame, scope: str, name: str) -> DataFrame:
    """A deterministic position within each scope: longer names, then alphabetical."""
    return nodes.withColumn("ord", F.row_number().over(Window.partitionBy(scope).orderBy(F.desc(F.length(name)), name)))


def _sides(nodes: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    return tuple(nodes.select(*[F.col(c).alias(f"{s}_{c}") for c in columns]) for s in ("a", "b"))


def _grams(low, n: int):
    return F.when(F.length(low) <= n, F.array(low)).otherwise(F.transform(F.sequence(F.lit(1), F.length(low) - (n - 1)), lambda i: F.substring(low, i, F.lit(n))))


def blocked_pairs(nodes: DataFrame, scope: str, name: str, keep: tuple = (), more=None, least: int = 93) -> DataFrame:
    """Pairs of one scope, each once, that share a stretch of a name or a word: all of a ratio of ``least`` (75 or more) are met.

    A ratio r of two names of T characters in all leaves at most (1 - r) T + 1
    equal stretches for at least r T / 2 equal characters, so one stretch has
    three characters from 93 on (T over 6; shorter names must be equal), two
    from 85 on (T over 3), and two from 75 on where T is over 8.  In shorter
    names single characters are compared.  ``more`` is an array of further
    keys, ``keep`` names columns to carry as ``a_`` and ``b_``.
    """
    if least < 75:
        raise ValueError("blocking is proven for ratios of 75 and more")
    low = F.lower(name)
    grams = _grams(low, 3 if least >= 93 else 2)
    if least < 85:
        grams = F.when(F.length(low) <= 8, F.array_union(grams, _grams(low, 1))).otherwise(grams)
    keys = F.array_union(grams, tokens(F.col(name)))
    keyed = nodes.withColumn("_g", F.explode(F.array_distinct(keys if more is None else F.array_union(keys, more))))
    a, b = _sides(keyed, [scope, name, "ord", "_g", *keep])
    on = (F.col(f"a_{scope}") == F.col(f"b_{scope}")) & (F.col("a__g") == F.col("b__g")) & (F.col("a_ord") < F.col("b_ord"))
    return a.join(b, on).select(F.col(f"a_{scope}").alias(scope), "a_ord", F.col(f"a_{name}").alias("a"), "b_ord", F.col(f"b_{name}").alias("b"), *[f"{s}_{c}" for c in keep for s in ("a", "b")]).distinct()


def edges_of_texts(pairs: DataFrame, scope: str, rules, keep: tuple = ()) -> DataFrame:
    """Edges that ``rules`` (each ``pairs, scope`` -> edges) find; every two names are compared once, however many scopes they share.

    A rule looks at the names alone (and at the columns ``keep``, carried as ``a_`` and ``b_``), so it is asked about
    distinct ones, whose verdicts then return to their pairs.  The distinct pairs are cut: else a rule's filter
    would be pushed below the distinct and compare names at every stretch that they share.
    """
    texts = cut(pairs.select("a", "b", *[f"{s}_{c}" for c in keep for s in ("a", "b")]).distinct())
    texts = cut(texts.repartition(_tasks(texts)))  # cut again, as filters are pushed below a repartition too
    own = lambda s: F.struct(s, *[f"{s}_{c}" for c in keep]).alias(f"{s}_ord")
    told = texts.select("*", F.lit(0).alias(scope), own("a"), own("b"))
    found = cut(reduce(DataFrame.unionByName, [rule(told, scope) for rule in rules]).select("rule", "a_ord.*", "b_ord.*"))
    return pairs.join(found, ["a", "b", *[f"{s}_{c}" for c in keep for s in ("a", "b")]]).select(scope, "rule", "a_ord", "b_ord")


def subset_pairs(nodes: DataFrame, scope: str, name: str) -> DataFrame:
    """Pairs that ``token_subset`` can accept: they share a word, or one has initials and the first letters of two words in order agree
    (of the only word, if both have one)."""
    words = tokens(F.col(name))
    letters = F.transform(words, lambda w: F.left(w, F.lit(1)))
    twos = F.array_distinct(F.flatten(F.transform(letters, lambda x, i: F.transform(F.slice(letters, i + 2, F.size(letters)), lambda y: F.concat(x, y)))))
    twos = F.when(F.size(letters) == 1, letters).otherwise(twos)  # a lone initial meets lone words
    initial = F.exists(words, lambda w: F.length(w) == 1)
    keyed = nodes.select(scope, name, "ord", initial.alias("_i"), F.explode(F.array_union(F.array_distinct(words), F.transform(twos, lambda k: F.concat(F.lit("\x01"), k)))).alias("_g"))
    a, b = _sides(keyed, [scope, name, "ord", "_i", "_g"])
    on = (F.col(f"a_{scope}") == F.col(f"b_{scope}")) & (F.col("a__g") == F.col("b__g")) & (F.col("a_ord") < F.col("b_ord")) & (F.col("a__i") | F.col("b__i") | ~F.col("a__g").startswith("\x01"))
    return a.join(b, on).select(F.col(f"a_{scope}").alias(scope), "a_ord", F.col(f"a_{name}").alias("a"), "b_ord", F.col(f"b_{name}").alias("b")).distinct()


def fuzzy_edges(pairs: DataFrame, scope: str, measure: str = "ratio", least: int = 93, rule: int = 1) -> DataFrame:
    """Pairs whose similarity reaches ``least``."""
    close = pairs.where(F.abs(F.length("a") - F.length("b")) * 100 <= (200 - 2 * least) * F.greatest(F.length("a"), F.length("b"))) if measure == "ratio" else pairs
    return close.where(similarity(measure, F.lower("a"), F.lower("b")) >= least).select(scope, F.lit(rule).alias("rule"), "a_ord", "b_ord")


def token_subset(a, b):
    """The shorter word list is an ordered subsequence of the longer; an initial stands for any word with it.  A single word
    is compared with the surname of several only."""
    x, y = tokens(a), tokens(b)
    short, long = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    same = lambda s, t: (s == t) | ((F.length(s) == 1) & t.startswith(s)) | ((F.length(t) == 1) & s.startswith(t))
    # Greedy: each word of the longer list may match the next open word of the shorter one.
    used = F.aggregate(long, F.lit(0), lambda k, t: F.when((k < F.size(short)) & same(F.get(short, k), t), k + 1).otherwise(k))
    surname = F.when(F.element_at(long, -1).isin(P.SUFFIXES), F.element_at(long, -2)).otherwise(F.element_at(long, -1))
    return F.when((F.size(short) == 1) & (F.size(long) > 1), F.get(short, F.lit(0)) == surname).otherwise((F.size(short) > 0) & (used == F.size(short)))


def token_edges(pairs: DataFrame, scope: str, rule: int = 2) -> DataFrame:
    return pairs.where(token_subset(F.col("a"), F.col("b"))).select(scope, F.lit(rule).alias("rule"), "a_ord", "b_ord")


def _last(name):
    """The surname: the last word that is no suffix."""
    t = F.filter(tokens(name), lambda w: ~w.isin("jr", "sr", "ii", "iii", "iv"))
    return F.coalesce(F.try_element_at(t, F.lit(-1)), F.lit(""))


def _first(name):
    return F.coalesce(F.get(tokens(name), F.lit(0)), F.lit(""))


def initialism_edges(pairs: DataFrame, scope: str, rule: int = 3) -> DataFrame:
    """``Xxx M K`` against a name of three words or more with that first word, whose next two words
    (or the two after the second) begin with the initials."""
    def fits(short, long):
        x, y = tokens(F.col(short)), tokens(F.col(long))
        begins = lambda i, j: F.substring(F.get(y, F.lit(j)), 1, 1) == F.substring(F.get(x, F.lit(i)), 1, 1)
        shaped = (F.size(x) == 3) & (F.length(F.get(x, F.lit(2))) == 1) & (F.length(F.get(x, F.lit(1))) == 1) & (F.length(F.get(x, F.lit(0))) > 2)
        return shaped & (F.size(y) >= 3) & (F.get(x, F.lit(0)) == F.get(y, F.lit(0))) & ((begins(1, 1) & begins(2, 2)) | (begins(1, 2) & begins(2, 3)))

    hit = F.coalesce(fits("a", "b"), F.lit(False)) | F.coalesce(fits("b", "a"), F.lit(False))
    return pairs.where(hit).select(scope, F.lit(rule).alias("rule"), "a_ord", "b_ord")


def single_word_edges(pairs: DataFrame, scope: str, rule: int = 4) -> DataFrame:
    """Two lone surnames that differ by a possessive s, or are close anagrams."""
    a, b = F.lower("a"), F.lower("b")
    letters = lambda c: F.array_sort(F.split(c, ""))
    lone = (F.size(tokens(F.col("a"))) == 1) & (F.size(tokens(F.col("b"))) == 1)
    possessive = (a == F.concat(b, F.lit("s"))) | (b == F.concat(a, F.lit("s")))
    anagram = (letters(a) == letters(b)) & (similarity("ratio", a, b) > 80)
    return pairs.where(lone).where(possessive | anagram).select(scope, F.lit(rule).alias("rule"), "a_ord", "b_ord")


def first_last_edges(pairs: DataFrame, scope: str, least: int = 85, rule: int = 5) -> DataFrame:
    """First words and surnames both close, unless both names have a middle word and its initials differ."""
    x, y = tokens(F.col("a")), tokens(F.col("b"))
    veto = (F.size(x) >= 3) & (F.size(y) >= 3) & (F.substring(F.get(x, F.lit(1)), 1, 1) != F.substring(F.get(y, F.lit(1)), 1, 1))
    many = pairs.where((F.size(x) > 1) & (F.size(y) > 1)).where(~F.coalesce(veto, F.lit(False)))
    close = (similarity("ratio", _first(F.col("a")), _first(F.col("b"))) >= least) & (similarity("ratio", _last(F.col("a")), _last(F.col("b"))) >= least)
    return many.where(close).select(scope, F.lit(rule).alias("rule"), "a_ord", "b_ord")


def token_sort_edges(pairs: DataFrame, scope: str, least: int = 98, rule: int = 6) -> DataFrame:
    """Names of three words or more that are the same words in another order."""
    long = pairs.where((F.size(tokens(F.col("a"))) >= 3) & (F.size(tokens(F.col("b"))) >= 3))
    return long.where(similarity("token_sort_ratio", F.col("a"), F.col("b")) >= least).select(scope, F.lit(rule).alias("rule"), "a_ord", "b_ord")


def fused(name):
    """``van x`` and the like as one word."""
    return F.regexp_replace(F.lower(name), r"\b(van|von|de|di|la|mc|o) (\w)", "$1$2")


def fused_edges(pairs: DataFrame, scope: str, least: int = 90, rule: int = 7) -> DataFrame:
    """Equal first words, and surnames that are close once particles are fused."""
    a, b = fused(F.col("a")), fused(F.col("b"))
    particle = (a != F.lower("a")) | (b != F.lower("b"))
    return pairs.where(particle & (_first(a) == _first(b)) & (similarity("ratio", _last(a), _last(b)) >= least)).select(scope, F.lit(rule).alias("rule"), "a_ord", "b_ord")


#: Rules in the order in which the fold applies them.
RULES = [fuzzy_edges, token_edges, initialism_edges, single_word_edges, first_last_edges, token_sort_edges, fused_edges]


def all_edges(pairs: DataFrame, scope: str) -> DataFrame:
    return edges_of_texts(pairs, scope, RULES)


def fold(nodes: DataFrame, edges: DataFrame, scope: str, name: str, weight: str) -> DataFrame:
    """``scope, name, points_to``: the name that absorbed it in the end.

    An edge merges two names that are both still open: a name of several words
    beats one of a single word, then the higher weight, more words, the longer
    name, and the earlier position.
    """
    schema = f"`{scope}` {nodes.schema[scope].dataType.simpleString()}, `{name}` string, points_to string"

    def run(key, people: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        people = people.sort_values("ord")
        by = {r.ord: r for r in people.itertuples()}
        names = dict(zip(people["ord"], people[name], strict=True))
        weights = dict(zip(people["ord"], people[weight], strict=True))
        parent = {o: o for o in by}
        for e in links.sort_values(["rule", "a_ord", "b_ord"]).itertuples():
            a, b = e.a_ord, e.b_ord
            if parent.get(a) != a or parent.get(b) != b:
                continue
            words = {o: len(names[o].split()) for o in (a, b)}
            rank = lambda o: (words[o] > 1 if 1 in words.values() else True, weights[o], words[o], len(names[o]), -o)  # noqa: B023, E731
            winner, loser = (a, b) if rank(a) >= rank(b) else (b, a)
            parent[loser] = winner

        def root(o):
            while parent[o] != o:
                o = parent[o]
            return o

        return pd.DataFrame({scope: people[scope], name: people[name], "points_to": [names[root(o)] for o in people["ord"]]})

    # A row in each scope and place, so that edges of all scopes make one graph.
    place = lambda o: F.struct(F.col(scope).alias("scope"), F.col(o).alias("ord"))
    edges = cut(edges.select(scope, "rule", "a_ord", "b_ord"))
    parts = components(edges.select(place("a_ord").alias("a"), place("b_ord").alias("b")), "a", "b")
    placed = cut(nodes.select(scope, name, "ord", weight, place("ord").alias("_p")).join(parts, F.col("_p") == F.col("node"), "left").select(scope, name, "ord", weight, F.to_json("component").alias("_c")))
    linked = edges.withColumn("_p", place("a_ord")).join(parts, F.col("_p") == F.col("node")).select(F.to_json("component").alias("_c"), "rule", "a_ord", "b_ord")
    alone = placed.where("_c IS NULL").select(scope, name, F.col(name).alias("points_to"))
    n = _tasks(edges)
    people, links = placed.where("_c IS NOT NULL").repartition(n, "_c"), linked.repartition(n, "_c")
    return people.groupBy("_c").cogroup(links.groupBy("_c")).applyInPandas(run, schema).unionByName(alone)


def resolve(mentions: DataFrame, scope: str, name: str, case: str, least: int = 93, rules: str = "plain") -> DataFrame:
    """Names of each scope resolved by closeness, then by ordered words; ``rules="all"`` adds the others."""
    nodes = ordered(mentions.where(F.col(name).isNotNull() & F.col(scope).isNotNull()).groupBy(scope, name).agg(F.countDistinct(case).alias("weight")), scope, name)
    pairs, subsets = blocked_pairs(nodes, scope, name, least=min(least, 93)), subset_pairs(nodes, scope, name)
    if rules == "all":
        edges = all_edges(pairs.unionByName(subsets).distinct(), scope)
    else:
        close = edges_of_texts(pairs, scope, [lambda p, s: fuzzy_edges(p, s, "ratio", least, 1)])
        edges = close.unionByName(edges_of_texts(subsets, scope, [token_edges]))
    return fold(nodes, edges, scope, name, "weight")


def drop_parties(mentions: DataFrame, parties: DataFrame, case: str, name: str, party: str, least: int = 96) -> DataFrame:
    """Mentions that are no party of their own case, exactly or closely."""
    m = mentions.select(F.col(case).alias("_c"), F.col(name).alias("_n")).distinct()
    p = parties.select(F.col(case).alias("_pc"), F.col(party).alias("_p")).distinct()
    # The ratio cannot reach the bound where the lengths differ by too much; only the rest is compared.
    fits = 200 * F.least(F.length("_n"), F.length("_p")) >= (least - 0.5) * (F.length("_n") + F.length("_p"))
    hit = m.join(p, (F.col("_c") == F.col("_pc")) & fits).where(similarity("ratio", F.lower("_n"), F.lower("_p")) >= least).select("_c", "_n").distinct()
    return mentions.join(hit, (F.col(case) == F.col("_c")) & (F.col(name) == F.col("_n")), "left_anti")


def tag(mentions: DataFrame, entities: DataFrame, name: str, entity: str, id_: str) -> DataFrame:
    """Mentions with the id of the only entity whose words they are an ordered part of."""
    e = entities.select(F.col(entity).alias("_e"), F.col(id_).alias("_id"), F.explode(F.array_distinct(tokens(F.col(entity)))).alias("_t"))
    distinct = mentions.select(name).where(F.col(name).isNotNull()).distinct().withColumn("_last", F.element_at(tokens(F.col(name)), -1))
    hits = distinct.join(e, F.col("_last") == F.col("_t")).where(token_subset(F.col(name), F.col("_e"))).groupBy(name).agg(F.countDistinct("_id").alias("_k"), F.min("_id").alias("_id"))
    label = F.when(F.col("_k") == 1, F.col("_id")).when(F.col("_k") > 1, "Ambiguous").otherwise("Inconclusive")
    return mentions.join(hits, name, "left").withColumn("sjid", label).drop("_k", "_id")
