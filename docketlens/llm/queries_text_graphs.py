"""Registered queries of spelling variants, the conversation trie and decontamination, and their SQL."""

from __future__ import annotations

from . import decontamination, prefix_trie, spelling
from .common import table


def op11_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_decontamination(spark, sf_dir):
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return decontamination.digests(found).select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


QUERIES = {"op11_spelling_variants": op11_spelling_variants, "op12_prefix_trie": op12_prefix_trie, "op13_decontamination": op13_decontamination}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The table of the usual crc32, and the crc of a list of bytes.
_CRC_TABLE = """tab AS (
  SELECT list(list_reduce(list_prepend(CAST(n AS UBIGINT), list_transform(range(8), lambda x: CAST(x AS UBIGINT))),
    lambda c, i: xor(c >> 1, CASE WHEN c % 2 = 1 THEN CAST(3988292384 AS UBIGINT) ELSE CAST(0 AS UBIGINT) END)) ORDER BY n) AS t
  FROM range(256) r(n)
)"""


def _crc(bytes_sql: str) -> str:
    step = "lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & CAST(255 AS UBIGINT) AS BIGINT) + 1])"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), {bytes_sql}), {step}), CAST(4294967295 AS UBIGINT))"


_BYTES = "list_transform(range(CAST(length(x) // 2 AS BIGINT)), lambda i: CAST(16 * (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) + instr('0123456789ABCDEF', x[2 * i + 2]) - 1 AS UBIGINT))"

ORACLES = {
    "op11_spelling_variants": rf"""
WITH RECURSIVE {_CRC_TABLE}, runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array({_LOW}, '[^A-Za-z\x{{C0}}-\x{{FF}}]+'), lambda w: length(w) >= 6)) AS run FROM documents) GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, {_crc(_BYTES)} AS h FROM (SELECT *, hex(encode(CAST(doc_id AS VARCHAR) || ':' || run)) AS x FROM runs), tab
), changed AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM changed WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(generate_series(1, length(word))) AS i FROM words)
), shorter AS (
  SELECT DISTINCT c.word, c.n, w.word AS near, w.n AS near_n FROM cut c JOIN words w ON w.word = c.rest
), pairs AS (
  SELECT * FROM shorter
  UNION ALL SELECT near, near_n, word, n FROM shorter
  UNION ALL SELECT a.word, a.n, b.word, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 5 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 5 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)
), follow AS (
  SELECT word, word AS here, 0 AS d FROM formed
  UNION ALL SELECT f.word, g.form, d + 1 FROM follow f JOIN formed g ON g.word = f.here WHERE g.form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, arg_max(here, d) AS root FROM follow GROUP BY word) USING (word)
""",
    "op12_prefix_trie": rf"""
WITH {_CRC_TABLE}, told AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT DISTINCT conv_id, hex(encode(CAST(conv_id AS VARCHAR))) AS x FROM told
), hs AS (
  SELECT conv_id, {_crc(_BYTES)} % 4 AS h FROM ids, tab
), rebuilt AS (
  SELECT hs.conv_id, 0 AS part, t.pos, t.role, t.text FROM hs JOIN told t ON t.conv_id = hs.conv_id - hs.conv_id % 20 AND t.pos <= hs.h
  UNION ALL
  SELECT hs.conv_id, 1, t.pos, t.role, t.text FROM hs JOIN told t ON t.conv_id = hs.conv_id AND t.pos > hs.h
), numbered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, role, text,
         CAST(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS words, sha256(sha256(role) || sha256(text)) AS turn
  FROM rebuilt
), paths AS (
  SELECT conv_id, 0 AS depth, CAST([] AS VARCHAR[]) AS path, CAST(0 AS BIGINT) AS words FROM ids
  UNION ALL
  SELECT conv_id, depth, list(turn) OVER (PARTITION BY conv_id ORDER BY depth), words FROM numbered
), lengths AS (
  SELECT conv_id, max(depth) AS length FROM paths GROUP BY conv_id
), nodes AS (
  SELECT path, depth, words, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(CASE WHEN depth = length THEN conv_id END AS VARCHAR), ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM paths JOIN lengths USING (conv_id) GROUP BY path, depth, words
), children AS (
  SELECT path[1 : depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), full_nodes AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (path)
), below AS (
  SELECT path[1 : d] AS path, n_children, n_convs, words FROM (SELECT *, unnest(generate_series(0, depth)) AS d FROM full_nodes)
), sums AS (
  SELECT path, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens FROM below GROUP BY path
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1 : n.depth - 1]
""",
    "op13_decontamination": rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row, list_filter(regexp_split_to_array({_LOW}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array({_LOW}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, l, array_to_string(w[p : p + l - 1], ' ') AS k
  FROM (SELECT item_id, w, least(10, len(w)) AS l, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS p FROM b WHERE len(w) > 0)
), lengths AS (
  SELECT DISTINCT l FROM windows
), places AS (
  SELECT row, w, l, unnest(generate_series(1, len(w) - l + 1)) AS p FROM d, lengths WHERE len(w) >= l
), found AS (
  SELECT row, p, x.l, item_id FROM (SELECT row, l, p, array_to_string(w[p : p + l - 1], ' ') AS k FROM places) x JOIN windows y ON x.l = y.l AND x.k = y.k
), hit AS (
  SELECT row, count(DISTINCT p + o) AS n_hit FROM (SELECT row, p, unnest(generate_series(0, l - 1)) AS o FROM found) GROUP BY row
), items AS (
  SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS id FROM found WHERE item_id IS NOT NULL) GROUP BY row
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (row) LEFT JOIN items USING (row)
""",
}
