"""Keywords of several categories in texts: one automaton, longest match at word borders, any case, with spans."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import court_words as W

_WORD = re.compile("[0-9A-Za-z_]+")
_IN_WORD = frozenset("0123456789abcdefghijklmnopqrstuvwxyz_")


def _lowered(text: str) -> str:
    """Lower case of equal length, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Keywords:
    """All categories' keywords in one tree of characters.

    A keyword begins where a word begins and ends where one ends.  From each
    beginning the longest keyword of each category counts; a category goes on
    behind its match, and where it has none with the next word.
    """

    def __init__(self, categories: dict[str, list[str]]):
        self.names = list(categories)
        self.root: dict = {}
        for number, words in enumerate(categories.values()):
            for word in words:
                node = self.root
                for c in word.lower():
                    node = node.setdefault(c, {})
                node.setdefault("ends", []).append(number)

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """``category, start, end`` by start and category, code points, ends exclusive."""
        out: list[tuple[str, int, int]] = []
        low = _lowered(text or "")
        reached = [0] * len(self.names)
        for m in _WORD.finditer(low):
            node, at, longest = self.root, m.start(), {}
            while at < len(low) and (node := node.get(low[at])) is not None:
                at += 1
                if "ends" in node and (at == len(low) or low[at] not in _IN_WORD):
                    longest.update(dict.fromkeys(node["ends"], at))
            for number in sorted(longest):
                if reached[number] <= m.start():
                    out.append((self.names[number], m.start(), longest[number]))
                    reached[number] = longest[number]
        return out


_SPANS = pa.list_(pa.struct([("category", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))


def with_spans(rows: DataFrame, text: str, categories: dict[str, list[str]] | None = None, name: str = "keywords") -> DataFrame:
    """``rows`` with an array of ``category, start, stop``: every category's keywords in a text column.  Equal texts of a
    batch are searched once; the tree is built once a task."""
    kept = rows.columns
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    categories, at = categories or W.KEYWORDS, kept.index(text)

    def run(batches):
        tree = Keywords(categories)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = {t: [{"category": c, "start": a, "stop": b} for c, a, b in tree.spans(t)] for t in set(texts)}
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([found[t] for t in texts], _SPANS)], names=[*kept, name])

    return rows.mapInArrow(run, f"{ddl}, `{name}` array<struct<category: string, start: int, stop: int>>")


def keyword_spans(rows: DataFrame, key: str, text: str, categories: dict[str, list[str]] | None = None) -> DataFrame:
    """``key, category, keyword, start, stop, is_last``: a row a keyword found; the last of each category in a text is the one nearest to what follows."""
    last = "k.stop = array_max(transform(filter(keywords, x -> x.category = k.category), x -> x.stop))"
    found = with_spans(rows.select(key, text), text, categories).select(key, text, "keywords", F.explode("keywords").alias("k")).withColumn("is_last", F.expr(last))
    return found.select(key, "k.category", F.lower(F.substring(text, F.col("k.start") + 1, F.col("k.stop") - F.col("k.start"))).alias("keyword"), "k.start", "k.stop", "is_last")


def category(text: Column, categories: dict[str, list[str]] | None = None) -> Column:
    """The first category with a keyword in the text, else ``No_Keywords``; categories' own names stay.  Built-in functions
    only: whether there is a match does not depend on which of several is the longest."""
    out = F.when(text.isin(W.OWN_CATEGORIES), text)
    low = F.lower(text)
    for name, words in (categories or W.KEYWORDS).items():
        out = out.when(low.rlike("(^|[^a-z0-9_])(?:" + "|".join(re.escape(w) for w in words) + ")(?![a-z0-9_])"), name)
    return out.otherwise("No_Keywords")


class Phrases:
    """One list of phrases, which may begin with a mark.  The text is read once from the left: where a word begins, and at a
    mark that no word comes before, the longest phrase that ends with a word counts; the character behind a match or a word
    without one begins nothing."""

    def __init__(self, phrases):
        self.root: dict = {}
        for phrase in filter(None, phrases):
            node = self.root
            for c in phrase.lower():
                node = node.setdefault(c, {})
            node["end"] = True

    def spans(self, text: str) -> list[tuple[int, int]]:
        low, out, at = _lowered(text), [], 0
        while at < len(low):
            node, here, end = self.root, at, None
            while here < len(low) and (node := node.get(low[here])) is not None:
                here += 1
                if "end" in node and (here == len(low) or low[here] not in _IN_WORD):
                    end = here
            if end is not None:
                out.append((at, end))
                at = end + 1
            elif low[at] in _IN_WORD:
                while at < len(low) and low[at] in _IN_WORD:
                    at += 1
                at += 1
            else:
                at += 1
        return out
