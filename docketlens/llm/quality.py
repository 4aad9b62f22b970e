"""Quality rules as a bitmask ledger, built-in functions only.

Every rule is evaluated once per document.  The ledger keeps the measurements
and one bit per failed rule; versioned policies are then plain masks over the
bits, and what each rule costs (alone, or in addition to the others) is read
off the same ledger by bitwise aggregation, without touching a text again.

Defined results: a null or empty text has no words and fails ``few_words``;
repeated rows give one ledger row each; equal lines or windows count from the
second or the first on, as the rule says, whatever their order; a very long
text is one row's arrays in memory, a few times its size; an empty table gives
an empty ledger; further columns of the input are ignored, or kept as they are
by ``kept_documents``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_PATTERN

#: Measurements, in the order of the ledger's columns.
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps"]

#: name -> condition under which the rule fails; the position is the rule's bit.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "capitals": "2 * n_caps > n_words",
}
BIT = {name: i for i, name in enumerate(RULES)}
BASE = ("few_words", "repeated_words")

#: version -> rules whose failure rejects a document.
POLICIES = {
    "base-1": BASE,
    "web-1": tuple(RULES),
    "lenient-1": ("few_words", "repeated_words", "symbols"),
}


def mask(rules) -> int:
    """The bits of some rules."""
    return sum(1 << BIT[r] for r in rules)


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and the measurements of ``text``, one row per row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    first = docs.select(
        *keep,
        F.array_remove(F.split(text, SPACE_PATTERN), "").alias("_words"),
        lines.alias("_lines"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("\\p{Lu}\\p{Lu}+")).cast("long").alias("n_caps"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, SPACE_PATTERN, ""))).cast("long").alias("_spaces"),
        F.char_length(text).cast("long").alias("_chars"),
    )
    # A 3-word window is its 64-bit hash; equal windows share it.
    second = first.select(
        *keep,
        "n_symbols",
        "n_caps",
        F.size("_words").cast("long").alias("n_words"),
        (F.col("_chars") - F.col("_spaces")).alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "transform(slice(_words, 1, greatest(size(_words) - 2, 0)),"
            " (w, i) -> xxhash64(w, get(_words, i + 1), get(_words, i + 2)))"
        ).alias("_h"),
    )
    plain = [*keep, "n_symbols", "n_caps", "n_words", "word_chars", "n_lines", "n_dup_lines"]
    # Only documents with a repeated window sort theirs with positions.
    third = second.select(
        *plain,
        F.expr(
            "CASE WHEN size(array_distinct(_h)) < size(_h) THEN sort_array(transform(_h, (x, i) -> struct(x AS h, i AS p))) END"
        ).alias("_s"),
    )
    fourth = third.select(
        *plain,
        F.expr(
            "sort_array(filter(transform(_s, (x, i) -> CASE WHEN get(_s, i - 1).h = x.h OR get(_s, i + 1).h = x.h THEN x.p END), p -> p IS NOT NULL))"
        ).alias("_p"),
    )
    measured = fourth.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.expr(
            "CASE WHEN _p IS NULL THEN 0L ELSE aggregate(_p, struct(0L AS n, -3 AS last),"
            " (a, p) -> struct(a.n + least(3, p - a.last) AS n, p AS last), a -> a.n) END"
        ).alias("n_repeat_words"),
        "n_lines",
        "n_caps",
        F.rand(0).alias("_barrier"),
    )
    # A later filter on a measurement must not be pushed below the steps above: it would
    # inline their arrays into one another's lambdas.  Spark pushes none past a random column.
    return measured.where("_barrier >= 0").drop("_barrier")


def ledger(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default ``doc_id``), the measurements, and ``fail_bits``: bit i is set where rule i fails."""
    keep = keep or ["doc_id"]
    bits = F.lit(0).cast("long")
    for name, condition in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << BIT[name])).otherwise(F.lit(0)).cast("long"))
    return measure(docs, keep).select(*keep, *MEASURES, bits.alias("fail_bits"))


def passes(policy: str = "web-1"):
    """Column: the ledger row passes a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def ablations(led: DataFrame, policy: str = "web-1") -> DataFrame:
    """One row per rule of the policy: documents that fail it (``failed``), fail only it
    (``only``), and that the policy keeps with all rules (``kept``) or without this one (``kept_without``)."""
    all_bits = mask(POLICIES[policy])
    held = F.col("fail_bits").bitwiseAND(F.lit(all_bits).cast("long"))
    counts = led.select(held.alias("b")).groupBy("b").agg(F.count("*").alias("n"))  # at most 2^rules rows
    rules = led.sparkSession.createDataFrame([(r, 1 << BIT[r]) for r in POLICIES[policy]], "rule string, bit long")
    return (
        F.broadcast(rules)
        .join(counts, F.lit(True), "left")
        .groupBy("rule", "bit")
        .agg(
            F.coalesce(F.sum(F.when(F.expr("b & bit <> 0"), F.col("n"))), F.lit(0)).alias("failed"),
            F.coalesce(F.sum(F.when(F.expr("b = bit"), F.col("n"))), F.lit(0)).alias("only"),
            F.coalesce(F.sum(F.when(F.expr("b = 0"), F.col("n"))), F.lit(0)).alias("kept"),
            F.coalesce(F.sum(F.when(F.expr("b & ~bit = 0"), F.col("n"))), F.lit(0)).alias("kept_without"),
        )
    )


def kept_documents(docs: DataFrame, policy: str = "web-1") -> DataFrame:
    """The rows that pass a policy, with the columns they came with."""
    # The row travels as one column: no name of its own meets a name of the ledger.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "text")
    return ledger(whole, ["_doc"]).where(passes(policy)).select("_doc.*")
