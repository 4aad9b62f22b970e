"""Queries of the preparation of names, and their SQL.

An order stands in for a docket line with a name in it: the text before the
name, the name as extracted and the text behind it are chosen by its key.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keywords
from ..operators import neighbourhood, preparation
from ..sources.readers import table

_BEFORE = [
    "ordered by Magistrate Judge ", "BANKRUPTCY JUDGE ", "before U.S.D.J. ", "Chief Justice ", "the ninth circuit judges ", "signed by U.S. District Judge ", "reassigned to ", "motions referred to the honorable ",
    "Hon. ", "court jusge ", "hearing held; ", "prejudge ", "magistrates ", "us b.j. ", "d.c.j. ", "MAG JUDGE ", "usm j. ", "visiting judges ", "Federal Court Judge ", "chief magistrate ", "reassigned to: ",
    "assigned_judge", "transferred to ", "x_judge ", "u s bankruptcy court ", "",
]
_BETWEEN = ["", "and ", "us magistrate judge ", "(district court judge) ", "J. ", "order by ", "mag.m j ", "-judge-", "judges "]
_NAMES = [
    "John A. Smith", "Magistrate Judge Ann Poe on 10/12/2015", "Edward M. Chen: re motion", "Elaine E. MagJud Bucklo", "MARY B. ROE. Signed", "Jones, USDJ", "Robert C. Chambers", "12345", "Lee", "Doe, Jr.", "..Ruth Poe",
    "Hawkins Judge Smith", "Cassady, Bivens", "f Judge David Nuffer", "x", "Jr", "Thomas re", "William Alsup, District Judge", "Ann Honorable Judge Lee MJ Poe", "Naomi R. (Magistrate) Buchwald on 1/", "Poe Hon. ", "", "Kim's chambers",
]
_BEHIND = [" on the motion", ".", "", ", and others", " (ab)"]


def _sql(words: list[str], k: str) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + f"][CAST(({k}) % {len(words)} AS BIGINT) + 1]"


def _pick(words: list[str], k: str):
    return F.get(F.array(*[F.lit(w) for w in words]), F.expr(f"cast(({k}) % {len(words)} as int)"))


TEXTS = f"texts AS (SELECT o_orderkey AS id, {_sql(_BEFORE, 'o_orderkey')} || {_sql(_BETWEEN, 'o_orderkey // 26')} || {_sql(_BEFORE, 'o_orderkey // 7')} AS t FROM orders)"


def _texts(spark, d):
    text = F.concat(_pick(_BEFORE, "o_orderkey"), _pick(_BETWEEN, "o_orderkey div 26"), _pick(_BEFORE, "o_orderkey div 7"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.alias("t"))


_ROWS = f"""chosen AS (
  SELECT o_orderkey AS id, {_sql(_BEFORE, 'o_orderkey')} AS pre, {_sql(_NAMES, 'o_orderkey // 3')} AS name, {_sql(_BEHIND, 'o_orderkey // 5')} AS post, CAST(o_orderkey % 1000 AS INTEGER) AS place FROM orders)"""


def _rows(spark, d):
    """Lines with a name, as the extraction gives them."""
    chosen = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), _pick(_BEFORE, "o_orderkey").alias("extracted_pre_5"), _pick(_NAMES, "o_orderkey div 3").alias("extracted_entity"), _pick(_BEHIND, "o_orderkey div 5").alias("extracted_post_5"),
        F.expr("cast(o_orderkey % 1000 as int)").alias("full_span_start"), F.lit("SPACY").alias("Entity_Extraction_Method"),
    )
    start = F.col("full_span_start") + F.length("extracted_pre_5")
    return chosen.withColumns({"original_text": F.concat("extracted_pre_5", "extracted_entity", "extracted_post_5"), "Ent_span_start": start, "Ent_span_end": start + F.length("extracted_entity")})


#: The titles again, written out as products of words.
_VOCABULARY = """circuits AS (
  SELECT unnest(['', 'first ', 'second ', 'third ', 'fourth ', 'fifth ', 'sixth ', 'seventh ', 'eighth ', 'ninth ', 'tenth ', 'eleventh ']) AS c
), court AS (
  SELECT p || w AS w FROM (SELECT unnest(['court ', '']) AS p), (SELECT unnest(['judge', 'judges', 'jusge', 'jusges']) AS w) UNION ALL SELECT unnest(['cj', 'c.j.', 'j', 'j.'])
), vocabulary AS (
  SELECT 1 AS o, 'Bankruptcy_Judge' AS category, unnest(['bankruptcy judge', 'bankruptcy judgesbankruptcy chief judge', 'bankruptcy chief judges', 'bankruptcy case judge', 'bankruptcy case judges',
    'bankruptcy court judge', 'bankruptcy court judges', 'u s bankruptcy', 'us bankruptcy', 'usbj', 'u.s.b.j.', 'us b.j.', 'us bj']) AS k
  UNION ALL SELECT 2, 'Circuit_Appeals', r || ' ' || j FROM (SELECT unnest(['chief', 'senior', 'associate', 'junior']) AS r), (SELECT unnest(['justice', 'justices']) AS j)
  UNION ALL SELECT 2, 'Circuit_Appeals', c || j FROM circuits, (SELECT unnest(['circuit judge', 'circuit judges', 'circuit j']) AS j)
  UNION ALL SELECT 2, 'Circuit_Appeals', unnest(['appellate judge', 'appellate judges', 'justices'])
  UNION ALL SELECT 3, 'District_Judge', p || ' ' || w FROM (SELECT unnest(['district', 'dist', 'dist.d', 'd.', 'usd', 'u.s.d.']) AS p), court
  UNION ALL SELECT 3, 'District_Judge', p || j FROM (SELECT unnest(['d', 'd.', 'usd', 'u.s.d.']) AS p), (SELECT unnest(['cj', 'c.j.', 'j', 'j.']) AS j)
  UNION ALL SELECT 3, 'District_Judge', unnest(['u.s.district court judge', 'u.s.district court judges'])
  UNION ALL SELECT 4, 'Magistrate_Judge', p || ' ' || w FROM (SELECT unnest(['magistrate', 'mag', 'mag.m', 'm.', 'usm', 'u.s.m.']) AS p), court WHERE NOT starts_with(w, 'court')
  UNION ALL SELECT 4, 'Magistrate_Judge', p || j FROM (SELECT unnest(['m', 'm.', 'usm', 'u.s.m.']) AS p), (SELECT unnest(['j', 'j.']) AS j)
  UNION ALL SELECT 4, 'Magistrate_Judge', 'chief magistrate'
  UNION ALL SELECT 5, 'Nondescript_Judge', p || w FROM (SELECT unnest(['federal ', 'us ', 'u.s. ', 'united states ', '']) AS p), court WHERE p || w NOT IN ('j', 'cj')
  UNION ALL SELECT 5, 'Nondescript_Judge', unnest(['visiting judge', 'visiting judges', 'honorable judge', 'honorable judges', 'judge honorable', 'hon judge', 'hon j', 'judge hon', 'honorable', 'hon', 'jud'])
  UNION ALL SELECT 6, 'Judicial_Actor', unnest(['judgment signed by', 'order signed byentry before', 'motions referred to', 'hereby ordered', 'proceedings before', 'order signed by', 'before', 'assigned to',
    'referred to', 'order by', 'ordered by', 'motion before', 'proceed before', 'transferred to', 'refer to', 'transfer to', 'held before', 'reassigned to', 'to chambers', 'chambers'])
), lowered AS (
  SELECT DISTINCT t, lower(t) AS low FROM texts
), places AS (
  SELECT DISTINCT t, low, o, category, k, unnest(generate_series(1, len(low) - len(k) + 1)) AS p FROM lowered, vocabulary WHERE contains(low, k)
), met AS (
  SELECT t, o, category, p, max(p + len(k)) AS e FROM places
  WHERE substr(low, p, len(k)) = k AND NOT regexp_matches(substr(' ' || low, p, 1), '[0-9a-z_]') AND NOT regexp_matches(substr(low || ' ', p + len(k), 1), '[0-9a-z_]') GROUP BY t, o, category, p
)"""

_SPANS_SQL = f"""
WITH RECURSIVE {TEXTS}, {_VOCABULARY}, taken AS (
  SELECT m.t, m.category, m.p, m.e FROM met m WHERE m.p = (SELECT min(n.p) FROM met n WHERE n.t = m.t AND n.category = m.category)
  UNION ALL
  SELECT * FROM (
    SELECT m.t, m.category, min(m.p) AS p, arg_min(m.e, m.p) AS e FROM taken x JOIN met m ON m.t = x.t AND m.category = x.category AND m.p >= x.e GROUP BY m.t, m.category, x.p)
)
SELECT id, category, lower(substr(t, p, e - p)) AS keyword, CAST(p - 1 AS INTEGER) AS start, CAST(e - 1 AS INTEGER) AS stop, e = max(e) OVER (PARTITION BY id, category) AS is_last
FROM texts JOIN taken USING (t)
"""


def keyword_spans(spark, d):
    return keywords.keyword_spans(_texts(spark, d), "id", "t")


def prefix_category(spark, d):
    return _texts(spark, d).select("id", "t", keywords.category(F.col("t")).alias("category"))


_CATEGORY_SQL = f"""
WITH {TEXTS}, {_VOCABULARY}, first AS (SELECT t, arg_min(category, o) AS category FROM met GROUP BY t)
SELECT id, t, CASE WHEN t IN ('assigned_judge', 'referred_judges') THEN t ELSE coalesce(category, 'No_Keywords') END AS category FROM texts LEFT JOIN first USING (t)
"""


def trimmed_entities(spark, d):
    """Its steps look ahead and behind, which the SQL has not: tested on names worked out by hand and by its invariant."""
    out = preparation.with_trimmed(_rows(spark, d).select("id", "extracted_entity"))
    return out.select("id", "extracted_entity", "trimmed.entity", "trimmed.start", (F.col("trimmed.start") + F.col("trimmed.length")).alias("stop"), "trimmed.is_exception")


def _exceptions(spark, d):
    name = F.when(F.col("id") % 7 == 3, F.concat(F.lit("Roe, Doe, "), "extracted_entity")).otherwise(F.col("extracted_entity"))
    return _rows(spark, d).withColumns({"extracted_entity": name, "eligible": F.col("id") % 11 != 0, "is_exception": F.col("id") % 13 != 0})


def exploded_exceptions(spark, d):
    return preparation.exploded_exceptions(_exceptions(spark, d)).select("id", "extracted_entity", "extracted_pre_5", "Ent_span_start", "Ent_span_end", "is_exception")


_EXPLODED_SQL = rf"""
WITH {_ROWS}, e AS (
  SELECT id, pre, place + len(pre) AS s, CASE WHEN id % 7 = 3 THEN 'Roe, Doe, ' || name ELSE name END AS n FROM chosen WHERE id % 11 <> 0 AND id % 13 <> 0
), k AS (
  SELECT *, CASE WHEN contains(n, 'f Judge David Nuffer') THEN 1 WHEN n = 'Naomi R. (Magistrate) Buchwald on 1/' THEN 2 WHEN n = 'Cassady, Bivens' THEN 3 ELSE 4 END AS kind FROM e
), cut AS (
  SELECT *, regexp_split_to_array(n, '(?i)\s*(honorable judge|magistrate judge|mj|b judge|judge|honorable|hon)\.*\s*') AS parts,
         regexp_extract_all(n, '(?i)\s*(honorable judge|magistrate judge|mj|b judge|judge|honorable|hon)\.*\s*') AS marks FROM k
), pieces AS (
  SELECT *, unnest(generate_series(1, len(parts))) AS i FROM cut WHERE kind = 4 AND len(marks) > 0
), titled AS (
  SELECT id, parts[i] AS extracted_entity, coalesce(marks[i], marks[len(marks)]) AS extracted_pre_5,
         s + coalesce(list_sum(list_transform(parts[1 : i - 1], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(marks[1 : i - 1], lambda x: len(x))), 0) AS a, false AS is_exception
  FROM pieces WHERE NOT (i = len(parts) AND parts[i] = '')
), every AS (
  SELECT * FROM titled
  UNION ALL SELECT id, substr(n, instr(n, 'Judge') + 6), 'Judge', s + instr(n, 'Judge') + 5, false FROM k WHERE kind = 1
  UNION ALL SELECT id, n, pre, s, true FROM k WHERE kind = 2
  UNION ALL SELECT id, split_part(n, ', ', 1), pre, s, false FROM k WHERE kind = 3
  UNION ALL SELECT id, split_part(n, ', ', 2), pre, s + len(split_part(n, ', ', 1)) + 2, false FROM k WHERE kind = 3
)
SELECT id, extracted_entity, extracted_pre_5, CAST(a AS INTEGER) AS Ent_span_start, CAST(a + len(extracted_entity) AS INTEGER) AS Ent_span_end, is_exception FROM every
"""


def respanned_entities(spark, d):
    """Respanning alone: here the words of a name behind its first are what is left."""
    left = F.regexp_replace("extracted_entity", "^[^ ]* ?", "")
    rows = _rows(spark, d).withColumns({"Respanned_Start": F.length("extracted_entity") - F.length(left), "Respanned_Length": F.length(left), "eligible": F.col("id") % 3 != 0})
    return preparation.respanned(rows).select("id", "New_Span_Start", "New_Span_End", "New_Pre_Tokens", "New_Entity", "New_Post_Tokens")


_RESPANNED_SQL = f"""
WITH {_ROWS}, c AS (SELECT *, CASE WHEN contains(name, ' ') THEN instr(name, ' ') ELSE len(name) END AS o FROM chosen WHERE id % 3 <> 0)
SELECT id, CAST(place + len(pre) + o AS INTEGER) AS New_Span_Start, CAST(place + len(pre) + len(name) AS INTEGER) AS New_Span_End, pre || substr(name, 1, o) AS New_Pre_Tokens, substr(name, o + 1) AS New_Entity, post AS New_Post_Tokens FROM c
"""


def prepared_mentions(spark, d):
    """The whole preparation; its trimming has no SQL."""
    out = preparation.prepared(_rows(spark, d))
    return out.select("id", "New_Span_Start", "New_Span_End", "New_Pre_Tokens", "New_Entity", "New_Post_Tokens", "Prefix_Categories", "Transferred_Flag", "Entity_Extraction_Method")


_WIDE = ["", "Ann ", "J.R. ", "Mary B. ", "J R ", "judge "]
_SHORT = ["Poe", "Ruth Poe", "Poe", "Will", "J. Roe", "Roe", "Smithson", "123", "Ann B. Van Dyke", "Dyke", "Smith"]
_TAIL = [" Jr.", ", Jr. on", " Smithson", "", " will rule", " appear", " III", "'s order"]


def reextracted_names(spark, d):
    """Names widened by the words beside them; compared with a plain loop in the tests."""
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), _pick(_WIDE, "o_orderkey").alias("a"), _pick(_SHORT, "o_orderkey div 5").alias("n"), _pick(_TAIL, "o_orderkey div 3").alias("z"), F.expr("cast(o_orderkey % 100 as int)").alias("full_span_start"),
    )
    # Every fourth name was extracted with what stands before it, every ninth with what follows.
    long = F.col("id") % 4 == 0
    pre, name = F.when(long, "").otherwise(F.col("a")), F.when(long, F.concat("a", "n")).otherwise(F.col("n"))
    tail = F.col("id") % 9 == 0
    name, post = F.when(tail, F.concat(name, "z")).otherwise(name), F.when(tail, "").otherwise(F.ltrim("z"))
    told = rows.select("id", "full_span_start", pre.alias("extracted_pre_5"), name.alias("extracted_entity"), post.alias("extracted_post_5"), F.concat("a", "n", "z").alias("original_text"))
    start = F.col("full_span_start") + F.length("extracted_pre_5")
    told = told.withColumns({"Ent_span_start": start, "Ent_span_end": start + F.length("extracted_entity")})
    return neighbourhood.reextracted(told).select("id", "extracted_pre_5", "extracted_entity", "extracted_post_5", "Ent_span_start", "Ent_span_end", "was_widened")


QUERIES = {f.__name__: f for f in (keyword_spans, prefix_category, trimmed_entities, exploded_exceptions, respanned_entities, prepared_mentions, reextracted_names)}
ORACLES = {"keyword_spans": _SPANS_SQL, "prefix_category": _CATEGORY_SQL, "exploded_exceptions": _EXPLODED_SQL, "respanned_entities": _RESPANNED_SQL}
