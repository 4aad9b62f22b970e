"""Ways to write a name (letters for words, nicknames, one spelling for several), and names that hold one another in one of them.

A style is plain, with letters for the first word, the middle ones, or both; in
nicknames; or in unified spellings.  Two names match in a style if, in some of
their variants, all words of the one stand in the other in the same order; a
single word matches the surname of several words only.

Variants are bounded by the name, and lie in an inverted index (variant by
word): each variant looks for its rarest word, so no name meets all others.
"""

from __future__ import annotations

from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.court_words import SUFFIXES
from ..functions.name_tables import NICKNAMES, UNIFIED

STYLES = ("plain", "nicknames", "unified")


def written(words: list[str], first: bool = False, middle: bool = False) -> list[list[str]]:
    """A name with letters for its first word, its middle words, or both; hyphens also as spaces.

    Up to two middle words are cut; of two, both or either.  A suffix stays; the only word of a name is never cut.
    """
    suffix = words[-1:] if words[-1] in SUFFIXES else []
    split = [w for w in " ".join(words).replace("-", " ").split(" ") if w]
    out = []
    for tokens in [words] + [split] * any("-" in w for w in words):
        n = len(tokens)
        own = [words[0]]
        head = [words[0][0]] if first else own
        if n == 1 or (n == 2 and suffix):
            out.append(own + (suffix if n == 2 else []))
        elif n == 2:
            out.append(head + tokens[1:] if first else tokens)
        elif n == 3 and suffix:
            out.append(head + tokens[1:2] + suffix)
        elif n == 3 or (n == 4 and suffix):
            out.append(head + [tokens[1][0] if middle else tokens[1], tokens[2]] + suffix)
        else:
            a, b = tokens[1:3]
            rest = (tokens[3:-1] if suffix else tokens[3:]) + suffix
            middles = [(a[0], b[0]), (a, b[0]), (a[0], b)] if middle else [(a, b)]
            out += [head + list(m) + rest for m in middles]
    return out


def nicknamed(words: list[str]) -> list[list[str]]:
    """With nicknames for one or more of the words before the last, three at most; none if there are none."""
    given = min(3, len(words) - 1)
    choices = [[w, *NICKNAMES.get(w, [])] for w in words[:given]]
    picks = list(product(*(range(len(c)) for c in choices)))[1:]
    return [[c[i] for c, i in zip(choices, p, strict=True)] + words[given:] for p in picks]


def unified(words: list[str]) -> list[list[str]]:
    return [[UNIFIED.get(w, w) for w in words]] if any(w in UNIFIED for w in words) else []


def variants(name: str, first: bool = False, middle: bool = False, style: str = "plain") -> list[list[str]]:
    """The distinct variants of a cleaned name in a style."""
    words = name.split()
    if not words:
        return []
    plain = written(words, first, middle)
    more = {"plain": lambda w: [], "nicknames": nicknamed, "unified": unified}[style]
    out = [v for w in plain for v in more(w)]
    out = plain + out if style != "unified" else out
    return [list(v) for v in dict.fromkeys(map(tuple, out))]


def name_variants(names: DataFrame, name: str, keep: tuple = (), first: bool = False, middle: bool = False, style: str = "plain") -> DataFrame:
    """A row for each variant of each name: ``keep`` columns, ``name`` and ``words``."""
    rows = names.select(*keep, name)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    columns, width = [*rows.columns, "words"], len(keep)

    def run(batches):
        for batch in batches:
            told = [variants(n, first, middle, style) if n else [] for n in batch.column(width).to_pylist()]
            at = pa.array([i for i, v in enumerate(told) for _ in v], pa.int64())
            yield pa.RecordBatch.from_arrays([*[c.take(at) for c in batch.columns], pa.array([w for v in told for w in v], pa.list_(pa.string()))], names=columns)

    return rows.mapInArrow(run, f"{ddl}, words array<string>")


#: The k-th time that a word of s comes up is the k-th place where l has it; all places must be there, and ascend.
_PLACES = "transform(s, (t, j) -> get(filter(transform(l, (y, i) -> if(y = t, i, -1)), p -> p >= 0), size(filter(slice(s, 1, j + 1), x -> x = t)) - 1))"
_ORDERED = f"aggregate({_PLACES}, named_struct('last', -1, 'ok', true), (a, p) -> named_struct('last', coalesce(p, -1), 'ok', a.ok AND p IS NOT NULL AND p > a.last), a -> a.ok)"
_SUFFIXES = ", ".join(f"'{s}'" for s in SUFFIXES)
_SURNAME = f"if(element_at(l, -1) IN ({_SUFFIXES}), try_element_at(l, -2), element_at(l, -1))"
HELD = f"CASE WHEN size(s) = 1 AND size(l) > 1 THEN coalesce(element_at(s, 1) = {_SURNAME}, false) ELSE {_ORDERED} END"


def subset_matches(names: DataFrame, scope: str, name: str, first: bool = False, middle: bool = False, style: str = "plain") -> DataFrame:
    """Pairs ``scope, a, b`` (a before b) of different names of a scope, one of which is held by the other in a style."""
    every = name_variants(names.select(scope, name).where(F.col(name).isNotNull() & F.col(scope).isNotNull()).distinct(), name, (scope,), first, middle, style)
    index = every.select(F.col(scope).alias("sc"), F.col(name).alias("long"), F.col("words").alias("l"), F.explode(F.array_distinct("words")).alias("w"))
    often = index.groupBy("sc", "w").agg(F.count("*").alias("n"))
    # A variant looks for its rarest word; ties go to the first in order.
    own = index.select("sc", F.col("long").alias("short"), F.col("l").alias("s"), "w").join(often, ["sc", "w"])
    rarest = own.groupBy("sc", "short", "s").agg(F.min(F.struct("n", "w")).alias("r")).select("sc", "short", "s", F.col("r.w").alias("w"))
    met = rarest.join(index, ["sc", "w"]).where((F.col("short") != F.col("long")) & (F.size("s") <= F.size("l"))).where(F.expr(HELD))
    return met.select(F.col("sc").alias(scope), F.least("short", "long").alias("a"), F.greatest("short", "long").alias("b")).distinct()
