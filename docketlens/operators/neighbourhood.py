"""Names that were extracted too short, widened by the words around them.

Names seen more than ``FREQUENT`` times are known.  A name of one or two words
that stands inside a known longer one may have lost what comes before or behind
it there; if these words, spelt in one of a few ways, are next to the name in
its line, the name takes them in.  "Will" before a verb is no name.

The dictionary is not one vocabulary: each short name has phrases of its own.
Short names meet the known names that hold them by an equi-join on the known
names' pieces, each such pair gives its phrases by itself, and phrases and rows
of one name meet in a sorted stream: a task holds one name's phrases, whatever
the number of its rows, and names with many rows are split.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.court_words import SUFFIXES
from ..functions.keywords import Phrases

FREQUENT = 25
#: Rows of one name in a part; names with more are split.
PART_ROWS = 50_000

# Known names that extraction always misses, by court; words behind "will" that make it a verb; what follows
# a name and is none of it; words that are no name.
OVERRIDES = {
    "gud": ["joaquin ve manibusan jr", "joaquin v e manibusan jr"], "insd": ["joseph s van bokkelen"], "flmd": ["mark l van valkenburgh"],
    "kyed": ["gregory f van tatenhove", "gregory f vantatenhove"], "txed": ["james van valkenberg"],
}
WILL = (
    r"(?i)will(\s|\b)+(address|adjust|adopt|appear|appoint|be |consider|continue|convene|coordinate|decide|defer|determine|either|enter|establish|extend|further|handle|have|hear |hold |issue|make|necessarily|not |"
    r"preside|promptly|recommend|rely|remain|review|rule|save|schedule(d)?|set|sign|take|the|upon|update)"
)
NO_FOLLOWERS = ["as", "by", "from", "to", "presentence", "standing"]
NO_NAMES = ["re", "us", "n/a", "as", "to", "from", "by", ""]


def pre_clean(name: Column) -> Column:
    """A name in lower case and single spaces, without stops, commas, hyphens, and what hangs on its ends; null where no name is left."""
    out = F.regexp_replace(name, r"^(\s*)(\.+)(\s*)", "")
    out = F.regexp_replace(out, r"(?i)^(\s*)(by|to|from)(\s+|\b)", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)([.\\'\-]+)$|('s)$", ""), r"^[.\\'\-]+", "")
    out = F.trim(F.regexp_replace(F.replace(F.replace(F.replace(F.lower(out), F.lit("."), F.lit("")), F.lit("-"), F.lit(" ")), F.lit(","), F.lit("")), r"\s+", " "))
    return F.when(~out.isin(NO_NAMES), out)


def _words(name) -> Column:
    return F.size(F.split(name, " "))


def known_names(cleaned: DataFrame) -> DataFrame:
    """``known``: frequent names and the overrides, of several words and without a title."""
    often = cleaned.where("clean IS NOT NULL").groupBy("clean").agg(F.count("*").alias("n")).where(F.col("n") > FREQUENT).select(F.col("clean").alias("known"))
    fixed = cleaned.sparkSession.createDataFrame([(n,) for names in OVERRIDES.values() for n in names], "known string")
    return often.unionByName(fixed).distinct().where((_words("known") >= 2) & ~F.contains("known", F.lit("judge")) & ~F.contains("known", F.lit("magistrate")))


def holders(short: DataFrame, known: DataFrame) -> DataFrame:
    """``clean, known``: every short name and the known names that it is a piece of, by an equi-join on their pieces."""
    piece = F.expr("flatten(transform(sequence(1, length(known) - 1), i -> transform(sequence(2, length(known) - i + 1), n -> substring(known, i, n))))")
    pieces = known.select("known", F.explode(F.array_distinct(piece)).alias("clean")).where("clean <> known")
    return pieces.join(short, "clean")


def searches(name: str, known: str) -> list[tuple[str, str]]:
    """What a known name has before (``pre``) and behind (``post``) a name in it."""
    if known.endswith(name):
        return [("pre", known[: -len(name)])]
    if known.startswith(name):
        rest = known[len(name) :]
        none = rest.strip() in NO_FOLLOWERS or (name[-1] == "s" and rest.startswith("' ")) or rest.startswith(("s ", "as ", "by ", "to ", "'s "))
        return [] if none else [("post", rest)]
    tail, last = name.split()[-1], known.split()[-1]
    if tail in last and tail != last:  # the plural or possessive of a surname
        return []
    at = known.index(name)
    before, behind = known[:at], known[at + len(name) :]
    return [("pre", before)] * before.endswith(" ") + [("post", behind)] * behind.startswith(" ")


def spellings(name: str, side: str, search: str) -> set[str]:
    """The ways in which a line may spell the words beside a name: stops behind letters, letters joined, letters left out,
    commas and stops of suffixes."""
    plain = search.strip()
    words = plain.split()
    if not words:
        return set()
    stops = " ".join(f"{w}." if len(w) == 1 else w for w in words)
    out = [stops, re.sub(r"(?i)(?<=\s[a-z]\.)\s(?=[a-z]\.)", "", stops), re.sub(r"(?i)(?<=\s[a-z])\s(?=[a-z]\s)", "", plain)]
    if not (side == "post" and name == "will" and search.startswith("iam ")):
        out.append(plain)
        if len(words) > 1:
            long = lambda part: " ".join(w for w in part if len(w) > 1)
            out.append(f"{words[0]} {long(words[1:])}" if side == "pre" else f"{long(words[:-1])} {words[-1]} ")
        if side == "post":
            if words[0] in SUFFIXES:
                out += [f", {plain}", f", {plain}."]
            if words[-1] in SUFFIXES:
                rest = " ".join(words[:-1])
                out += [f"{plain}.", f"{rest}, {words[-1]}", f"{rest}, {words[-1]}."]
    if name in SUFFIXES:
        out += [f"{p}," for p in out]
    return {p.strip() for p in out} - {""}


def phrases(pairs: DataFrame) -> DataFrame:
    """``clean, side, phrase`` for each short name, from ``clean, known``; every pair by itself."""

    def run(batches):
        for batch in batches:
            out = [(n, side, p) for n, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for side, search in searches(n, k) for p in spellings(n, side, search)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(3)], names=["clean", "side", "phrase"])

    return pairs.select("clean", "known").mapInArrow(run, "clean string, side string, phrase string").distinct()


def widen(text: str, start: int, first: int, stop: int, pre: str, post: str, before: Phrases, behind: Phrases):
    """New ``start, stop, pre, entity, post`` of a name, None where nothing beside it is known.  ``start`` is the place of
    ``text`` in the line, ``first`` and ``stop`` the name's."""
    found = [s for s in before.spans(pre) if s[1] >= len(pre) - 2]
    new = None
    if found:
        at = max(found, key=lambda s: s[1])[0]
        new, first = (start + at, stop, text[:at], text[at : stop - start], post), start + at
        pre = text[:at]
    found = [s for s in behind.spans(post) if s[0] <= 2]
    if found:
        end = stop + max(found, key=lambda s: s[1])[1] + 1  # the text behind a name is told without the space before it
        new = (first, end, pre, text[first - start : end - start], text[end - start :])
    return new


_NEW = [("start", pa.int32()), ("stop", pa.int32()), ("pre", pa.string()), ("entity", pa.string()), ("post", pa.string())]


def reextracted(rows: DataFrame) -> DataFrame:
    """``rows`` (``schemas.ENTRY_ENTITY``) with names widened where the words beside them are known, and ``was_widened``.

    Spans, and the texts before and behind, follow; "will" before a verb becomes empty.  Null names and names
    of more than two words stay.  Names that only an earlier entity list knows change nothing: they are looked
    for, but not frequent here, so nothing is widened to them.
    """
    cleaned = rows.withColumn("_clean", pre_clean(F.col("extracted_entity")))
    names = cleaned.select(F.col("_clean").alias("clean"))
    counts = names.where("clean IS NOT NULL").groupBy("clean").agg(F.count("*").alias("n"))
    short = counts.where((_words("clean") <= 2) & (F.length("clean") > 1) & ~F.col("clean").rlike(r"^\d+$"))
    known = phrases(holders(short.select("clean"), known_names(names)))
    useful = known.select("clean").unionByName(short.where("clean = 'will'").select("clean")).distinct()
    parts = short.join(useful, "clean", "left_semi").select(F.col("clean").alias("_c"), F.ceil(F.col("n") / PART_ROWS).cast("int").alias("_parts"))
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    of_name = cleaned.join(parts, F.col("_clean") == F.col("_c"), "left").select(
        F.when(F.col("_c").isNotNull(), F.col("_clean")).alias("clean"), F.when(F.col("_c").isNotNull(), F.pmod(F.xxhash64(row), F.col("_parts"))).cast("int").alias("part"), F.lit(1).alias("kind"),
        F.lit(None).cast("string").alias("side"), F.lit(None).cast("string").alias("phrase"), row.alias("row"),
    )
    looked = of_name.where("clean IS NOT NULL")
    spread = known.join(parts, F.col("clean") == F.col("_c")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    of_phrase = spread.select("clean", "part", F.lit(0).alias("kind"), "side", "phrase", F.lit(None).cast(looked.schema["row"].dataType).alias("row"))
    stream = looked.unionByName(of_phrase).repartition("clean", "part").sortWithinPartitions("clean", "part", "kind")
    kind = looked.schema["row"].dataType.simpleString()
    field = {c: i for i, c in enumerate(rows.columns)}
    need = [field[c] for c in ("original_text", "full_span_start", "Ent_span_start", "Ent_span_end", "extracted_pre_5", "extracted_post_5")]

    def run(batches):
        at, told, both = None, {"pre": set(), "post": set()}, None
        for batch in batches:
            keep, new = [], []
            clean, part, what, side, phrase = (batch.column(i).to_pylist() for i in range(5))
            values = [batch.column(5).field(i).to_pylist() for i in need]
            for i in range(len(clean)):
                if (clean[i], part[i]) != at:
                    at, told, both = (clean[i], part[i]), {"pre": set(), "post": set()}, None
                if what[i] == 0:
                    told[side[i]].add(phrase[i])
                    continue
                both = both or (Phrases(told["pre"]), Phrases(told["post"]))
                text, start, first, stop, pre, post = (v[i] for v in values)
                found = None
                if text is not None and None not in (start, first, stop):
                    if clean[i] == "will" and re.search(WILL, f"will {text[stop - start :]}"):
                        found = (first, stop, pre, "", post)
                    else:
                        found = widen(text, start, first, stop, pre or "", post or "", *both)
                keep.append(i)
                new.append(found and dict(zip((n for n, _ in _NEW), found, strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(5).take(pa.array(keep, pa.int64())), pa.array(new, pa.struct(_NEW))], names=["row", "new"])

    met = stream.mapInArrow(run, f"row {kind}, new struct<start: int, stop: int, pre: string, entity: string, post: string>")
    rest = of_name.where("clean IS NULL").select("row", F.lit(None).cast(met.schema["new"].dataType).alias("new"))
    out = met.unionByName(rest)
    changed = {"Ent_span_start": "start", "Ent_span_end": "stop", "extracted_pre_5": "pre", "extracted_entity": "entity", "extracted_post_5": "post"}
    types = {f.name: f.dataType for f in rows.schema}
    pick = lambda c: F.when(F.col("new").isNotNull(), F.col(f"new.{changed[c]}").cast(types[c])).otherwise(F.col(f"row.`{c}`")).alias(c) if c in changed else F.col(f"row.`{c}`").alias(c)
    return out.select(*[pick(c) for c in rows.columns], F.col("new").isNotNull().alias("was_widened"))
