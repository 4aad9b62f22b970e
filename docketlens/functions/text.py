"""Text columns: cleaners, gates, ordered classifiers, indicators.  Built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def blank_if_null(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("string")


def contains_any(text: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(text).contains(p) for p in phrases])


def outcome(text: Column) -> Column:
    """1 granted, -1 denied, -999 not an outcome, -10 dismissed, 0 none of these; null for null."""
    low = F.lower(text)
    out = F.when(text.isNull(), F.lit(None)).when(contains_any(text, P.OUTCOME_EXCLUSIONS), 0)
    for value, group in P.OUTCOME_GROUPS.items():
        out = out.when(low.rlike("|".join(f"(?:{p})" for p in group)), value)
    return out.otherwise(0).cast("int")


def indicators(text: Column) -> list[Column]:
    """The matrix of sealing flags, false for null."""
    low = F.coalesce(F.lower(text), F.lit(""))
    return [low.rlike(p).alias(name) for name, p in P.INDICATORS.items()]


def entry_type(text: Column) -> Column:
    """Leading capitals of an entry, reduced to the first known keyword."""
    caps = F.split(text, "[a-z]")[0]
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for word in P.ENTRY_KINDS:
        out = out.when(caps.contains(word), word)
    return out


def sentences(text: Column) -> Column:
    """A line's sentences: joints between clauses end one, and a stop after a whole word and before a capital."""
    return F.split(text, P.SENTENCE_END)


def clean_name(name: Column) -> Column:
    """Accents, titles, digits, punctuation, possessives and runs of spaces out of a name; suffixes in one spelling; lower case."""
    out = F.translate(name, *P.ACCENTS)
    for pattern, new in P.NAME_STEPS:
        out = F.regexp_replace(out, pattern, new)
    return F.trim(F.regexp_replace(F.lower(out), r"\s+", " "))


def presentable(name: Column) -> Column:
    """First letter of every word in upper case, the rest as it is; roman numerals whole."""
    def word(w):
        return F.when(w.rlike("^(ii|iii|iv|v)$"), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))

    return F.array_join(F.transform(F.split(name, " "), word), " ")


def keyed_hash(value: Column, key: str) -> Column:
    """A pseudonym that only the key's holder can recompute."""
    return F.sha2(F.concat(F.lit(key), F.lit("\x1f"), value), 256)


def is_prisoner(nos: Column, case_type: Column) -> Column:
    return F.coalesce((case_type == "cr") | F.regexp_extract(nos, r"\d+", 0).isin([str(x) for x in P.PRISONER_NOS]), F.lit(False)).cast("int")


def clean_case_id(case: Column) -> Column:
    """``16cv123...`` -> ``16-cv-123...``."""
    return F.regexp_replace(F.lower(case), r"^(\d+:)?(\d{2})-?(cv|cr)-?", "$1$2-$3-")
