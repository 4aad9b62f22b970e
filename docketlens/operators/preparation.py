"""Extracted names made ready for resolution: eligible, trimmed in place, spanned anew, exceptions taken apart, prefixes categorised.

Rows are those of ``schemas.ENTRY_ENTITY``: a piece of a docket line
(``original_text``, beginning at ``full_span_start``), and the name in it with
its span in the line.  Spans are code points, ends exclusive.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import court_words as W
from ..functions import keywords
from ..functions.trimming import trim
from .mentions import eligibility

_TRIMMED = pa.struct([("entity", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("is_exception", pa.bool_())])


def with_trimmed(rows: DataFrame, entity: str = "extracted_entity", name: str = "trimmed") -> DataFrame:
    """``rows`` with a struct: what is left of the name, where it stands in it (the first place, if it is there twice), and
    whether a title stands inside; without entity where nothing is left.  Equal names of a batch are trimmed once."""
    kept, at = rows.columns, rows.columns.index(entity)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def one(text: str | None):
        if text is None:
            return None
        start, stop, exception = trim(text)
        if start is None:
            return {"entity": None, "start": None, "length": None, "is_exception": exception}
        left = text[start:stop]
        return {"entity": left, "start": text.find(left), "length": len(left), "is_exception": exception}

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = {t: one(t) for t in set(texts)}
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([found[t] for t in texts], _TRIMMED)], names=[*kept, name])

    return rows.mapInArrow(run, f"{ddl}, `{name}` struct<entity: string, start: int, length: int, is_exception: boolean>")


def cleaned(rows: DataFrame) -> DataFrame:
    """``Respanned_Entity``, ``Respanned_Start``, ``Respanned_Length``: trimmed names, and exceptions whole; ``is_exception``
    is set where trimming finds one.  Rows that are not eligible, or exceptions already, are not trimmed."""
    names = rows.withColumn("_name", F.when(F.col("eligible") & ~F.col("is_exception"), F.col("extracted_entity")))
    out = with_trimmed(names, "_name", "_trimmed").withColumn("is_exception", F.col("is_exception") | F.coalesce("_trimmed.is_exception", F.lit(False)))
    whole = F.col("eligible") & F.col("is_exception")
    pick = lambda w, c: F.when(whole, w).otherwise(F.col(f"_trimmed.{c}"))
    return out.withColumns({
        "Respanned_Entity": pick(F.col("extracted_entity"), "entity"), "Respanned_Start": pick(F.lit(0), "start"), "Respanned_Length": pick(F.length("extracted_entity"), "length"),
    }).drop("_name", "_trimmed")


def respanned(rows: DataFrame, is_header: bool = False) -> DataFrame:
    """Eligible rows with ``New_Span_Start``, ``New_Span_End`` in the line, and the text before (``New_Pre_Tokens``), of
    (``New_Entity``) and behind the name (``New_Post_Tokens``).  Headers' pieces begin at 0."""
    if is_header:
        zero = {c: F.coalesce(c, F.lit(0)) for c in ("Ent_span_start", "Ent_span_end", "Pre_span_start", "Pre_span_end")}
        rows = rows.withColumns(zero).withColumns({"full_span_start": F.lit(0), "full_span_end": F.greatest("Ent_span_end", "Pre_span_end")})
    start = F.col("Ent_span_start") + F.col("Respanned_Start")
    out = rows.where(F.col("eligible")).withColumns({"New_Span_Start": start.cast("int"), "New_Span_End": (start + F.col("Respanned_Length")).cast("int")})
    at, to = F.col("New_Span_Start") - F.col("full_span_start"), F.col("New_Span_End") - F.col("full_span_start")
    text = F.col("original_text")
    return out.withColumns({"New_Pre_Tokens": F.left(text, at), "New_Entity": F.substring(text, at + 1, to - at), "New_Post_Tokens": F.substring(text, to + 1, F.length(text))})


def _pieces(name: Column, pattern: str) -> Column:
    """``piece, offset, mark`` of a name cut at a pattern: each piece with its place and the mark behind it (the last one's is
    the last mark); none without a mark, and no empty last piece."""
    parts, marks = F.split(name, pattern), F.regexp_extract_all(name, F.lit(pattern), F.lit(0))
    sized = F.transform(parts, lambda p, i: F.struct(p.alias("piece"), (F.length(p) + F.coalesce(F.length(F.get(marks, i)), F.lit(0))).alias("size"), F.coalesce(F.get(marks, i), F.element_at(marks, -1)).alias("mark")))
    placed = F.transform(sized, lambda p, i: F.struct(
        p["piece"].alias("piece"), F.aggregate(F.slice(sized, F.lit(1), i), F.lit(0), lambda a, q: a + q["size"]).alias("offset"), p["mark"].alias("mark"), (i == F.size(parts) - 1).alias("last")
    ))
    return F.when(F.size(marks) > 0, F.filter(placed, lambda p: ~(p["last"] & (p["piece"] == ""))))


def exploded_exceptions(rows: DataFrame) -> DataFrame:
    """A row for each name in an eligible exception, with its own span.

    Names led by known words begin behind "Judge"; known names with a title
    inside stay whole and exceptions; known pairs are cut at commas; all others
    at titles, each part with the title behind it as its prefix (the last one
    with the last title).  An exception without any of these gives no row.
    """
    name = F.col("extracted_entity")
    led = F.exists(F.array(*[F.lit(x) for x in W.LED_NAMES]), lambda x: F.contains(name, x))
    at = F.instr(name, "Judge") + 5  # characters before what follows "Judge "
    whole = lambda piece, offset, mark: F.array(F.struct(piece.alias("piece"), offset.cast("int").alias("offset"), mark.alias("mark")))
    plain = lambda c: F.transform(c, lambda p: F.struct(p["piece"].alias("piece"), p["offset"].cast("int").alias("offset"), p["mark"].alias("mark")))
    kind = F.when(led, "led").when(name.isin(W.SPECIAL_NAMES), "special").when(name.isin(W.PAIRED_NAMES), "pair").otherwise("title")
    marked = rows.where(F.col("is_exception") & F.col("eligible")).withColumn("_kind", kind)
    parts = (
        F.when(F.col("_kind") == "led", whole(F.substring(name, at + 1, F.length(name)), at, F.lit("Judge")))
        .when(F.col("_kind") == "special", whole(name, F.lit(0), F.col("extracted_pre_5")))
        .when(F.col("_kind") == "pair", F.transform(plain(_pieces(name, r",\s*")), lambda p: F.struct(p["piece"].alias("piece"), p["offset"].alias("offset"), F.col("extracted_pre_5").alias("mark"))))
        .otherwise(plain(_pieces(name, W.TITLE_BETWEEN)))
    )
    each = marked.withColumn("_part", F.explode(parts)).withColumn("_at", F.col("Ent_span_start") + F.col("_part.offset"))
    return each.withColumns({
        "is_exception": F.col("_kind") == "special", "extracted_entity": F.col("_part.piece"), "extracted_pre_5": F.col("_part.mark"), "extracted_post_5": F.lit("<-?->"),
        "Ent_span_start": F.col("_at"), "Ent_span_end": F.col("_at") + F.length("_part.piece"), "Entity_Extraction_Method": F.lit("SPACY_EXCEPTION_HANDLING"),
    }).drop("_kind", "_part", "_at")


_TRANSFER = r"(?i)[\x08\s^](transferred|(re)?assigned)( (to|from))[\x08$\s]"


def categorised(rows: DataFrame, is_header: bool = False) -> DataFrame:
    """``Transferred_Flag`` and ``Prefix_Categories`` by the text before the name; headers without any take their method."""
    if is_header:
        rows = rows.withColumn("New_Pre_Tokens", F.coalesce(F.nullif(F.col("New_Pre_Tokens"), F.lit("")), F.col("Entity_Extraction_Method")))
    pre = F.coalesce("New_Pre_Tokens", F.lit(""))
    return rows.withColumns({"Transferred_Flag": pre.rlike(_TRANSFER), "Prefix_Categories": keywords.category(pre)})


def prepared(rows: DataFrame, is_header: bool = False) -> DataFrame:
    """All steps: names eligible and no exceptions as they are trimmed, exceptions taken apart, trimmed and spanned in turn."""
    first = cleaned(eligibility(rows, "extracted_entity", "extracted_pre_5"))
    # Once set, an exception stays one, and what is not eligible stays so.
    again = eligibility(first.withColumns({"_eligible": F.col("eligible"), "_exception": F.col("is_exception")}), "Respanned_Entity")
    again = again.withColumns({"eligible": F.col("eligible") & F.col("_eligible"), "is_exception": F.col("is_exception") | F.col("_exception")}).drop("_eligible", "_exception")
    normal = respanned(again.where(~F.col("is_exception")), is_header)
    parts = cleaned(exploded_exceptions(again.drop("Respanned_Entity", "Respanned_Start", "Respanned_Length")))
    parts = parts.withColumns({"is_exception": F.lit(False), "eligible": F.col("eligible") & (F.coalesce("Respanned_Entity", F.lit("")) != "")})
    return categorised(normal.unionByName(respanned(parts, is_header)), is_header)
