"""Similarity of names, 0 to 100, from matching blocks of characters.

``ratio`` is 200 * matched / (len(a) + len(b)), matched by difflib's longest
blocks; the token forms sort or compare the words first.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F


def ratio(a: str, b: str) -> int:
    return round(100 * SequenceMatcher(None, a, b, autojunk=False).ratio())


def partial_ratio(a: str, b: str) -> int:
    """The best ratio of the shorter string against stretches of the longer one of its length."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100 if not long else 0
    starts = {max(0, y - x) for x, y, n in SequenceMatcher(None, short, long, autojunk=False).get_matching_blocks()}
    return max(ratio(short, long[s : s + len(short)]) for s in starts)


def token_sort_ratio(a: str, b: str) -> int:
    return ratio(" ".join(sorted(a.lower().split())), " ".join(sorted(b.lower().split())))


def token_set_ratio(a: str, b: str) -> int:
    """The best of: shared words alone, and shared words with either side's own ones."""
    x, y = set(a.lower().split()), set(b.lower().split())
    both = " ".join(sorted(x & y))
    one, two = (" ".join([both, *sorted(z)]).strip() for z in (x - y, y - x))
    return max(ratio(both, one) if both else 0, ratio(both, two) if both else 0, ratio(one, two))


MEASURES = {f.__name__: f for f in (ratio, partial_ratio, token_sort_ratio, token_set_ratio)}


def similarity(measure: str, a, b):
    """Column of a measure, Arrow-batched; null if either side is."""
    f = MEASURES[measure]

    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else f(p, q) for p, q in zip(x, y, strict=True)], dtype="Int32")

    return run(a, b)
