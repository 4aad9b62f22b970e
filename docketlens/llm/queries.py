"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ann, jaccard, lang_id, mixing, packing, pii, quality, queries_text_graphs, token_files, toxicity, warc
from .common import table
from .tokenizing import vocabulary


def op1_language_id(spark, sf_dir):
    return lang_id.languages(table(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"))


def op3_token_files(spark, sf_dir):
    return token_files.token_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


def op4_quality_rules(spark, sf_dir):
    base = F.col("fail_bits").bitwiseAND(F.lit(quality.mask(quality.BASE)).cast("long")) != 0
    return quality.ledger(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), quality.passes("web-1").alias("kept")
    )


def op4_quality_ablations(spark, sf_dir):
    return quality.ablations(quality.ledger(table(spark, sf_dir, "documents")))


def op5_packing(spark, sf_dir):
    return packing.packed_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=1)


def op6_warc(spark, sf_dir):
    return warc.archived(table(spark, sf_dir, "pages"))


def op7_personal_data(spark, sf_dir):
    return pii.private(table(spark, sf_dir, "documents"), ["doc_id"])


def op8_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_ngram_jaccard(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard_links(spark, sf_dir):
    return jaccard.linked_documents(table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_token_files": op3_token_files,
    "op4_quality_rules": op4_quality_rules,
    "op4_quality_ablations": op4_quality_ablations,
    "op5_packing": op5_packing,
    "op6_warc": op6_warc,
    "op7_personal_data": op7_personal_data,
    "op8_mixing": op8_mixing,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op9_ngram_jaccard_links": op9_ngram_jaccard_links,
    "op10_toxicity": op10_toxicity,
    **queries_text_graphs.QUERIES,
}

_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

ORACLES = {
    **queries_text_graphs.ORACLES,
    "op9_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[p : p + 4], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS p FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)
""",
    "op4_quality_rules": rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), windows AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 2)) AS p, w FROM base WHERE len(w) > 2
), keyed AS (
  SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS k FROM windows
), twice AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS n FROM keyed) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p + o) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS v(o) GROUP BY doc_id
), m AS (
  SELECT b.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         len(regexp_extract_all(t, '\p{{Lu}}\p{{Lu}}+')) AS n_caps
  FROM base b LEFT JOIN covered c USING (doc_id)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * n_caps > n_words) AS kept
FROM f
""",
    "op6_warc": """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), q AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> f THEN f END AS refers_to,
       '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-8' || h[18:20] || '-' || h[21:32] || '>' AS record_id
FROM (SELECT *, sha256('docketlens-record:' || CAST(page_id AS VARCHAR)) AS h FROM q)
""",
}

_RULES_SQL = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "capitals": "2 * n_caps > n_words",
}
_MEASURED = ORACLES["op4_quality_rules"].split("SELECT doc_id, n_words, word_chars")[0].rstrip()
ORACLES["op4_quality_ablations"] = f"""{_MEASURED}, r AS (
  SELECT {', '.join(f'{sql} AS {name}' for name, sql in _RULES_SQL.items())} FROM f
), x AS (SELECT *, {' + '.join(f'CAST({name} AS INTEGER)' for name in _RULES_SQL)} AS fails FROM r)
""" + " UNION ALL ".join(
    f"""SELECT '{name}' AS rule, CAST({1 << i} AS BIGINT) AS bit, count(*) FILTER ({name}) AS failed, count(*) FILTER ({name} AND fails = 1) AS "only", count(*) FILTER (fails = 0) AS kept, count(*) FILTER (fails = 0 OR ({name} AND fails = 1)) AS kept_without FROM x"""
    for i, name in enumerate(_RULES_SQL)
)

_LINKS, _COMPONENTS = ORACLES["op9_ngram_jaccard"].split("SELECT d.doc_id, ")
ORACLES["op9_ngram_jaccard_links"] = f"""{_LINKS}SELECT k.n_links, d.doc_id, {_COMPONENTS}
JOIN (SELECT d.doc_id, count(l.b) AS n_links FROM documents d LEFT JOIN links l ON l.a = d.doc_id GROUP BY d.doc_id) k USING (doc_id)
"""
