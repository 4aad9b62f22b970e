"""Queries of pointers and of the last look at unresolved names, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components as graph
from ..operators import anchors, crosscheck, free_scope, near, variants
from ..operators import endpoints as ends
from ..sources.readers import table

# Orders in chains of 1,000, each pointing at the one before it; every hundred and first has no pointer.
_POINTERS = "pointers AS (SELECT o_orderkey AS node, CASE WHEN o_orderkey % 1000 = 0 OR o_orderkey % 1013 = 7 THEN NULL ELSE o_orderkey - 1 END AS target FROM orders)"
_ENDS = """follow AS (
  SELECT p.node, p.node AS target FROM pointers p WHERE p.target IS NULL
  UNION ALL SELECT p.node, f.target FROM follow f JOIN pointers p ON p.target = f.node
)"""


def endpoints(spark, d):
    target = F.expr("CASE WHEN o_orderkey % 1000 = 0 OR o_orderkey % 1013 = 7 THEN NULL ELSE o_orderkey - 1 END")
    return ends.endpoints(table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), target.alias("target")), "node", "target")


def chained_endpoints(spark, d):
    """Three levels: tens within a case, hundreds within a court, thousands everywhere."""
    k = F.col("o_orderkey")
    orders = table(spark, d, "orders")
    levels = [orders.where(k % (10**i) == 0).select(k.alias("node"), F.when(k % (10 ** (i + 1)) != 0, k - 10**i).alias("target")) for i in range(3)]
    return ends.chained(levels, "node", "target")


_NAMES = """mentions AS (
  SELECT l_orderkey AS case_id, l_linenumber AS n, CASE WHEN l_partkey % 3 = 0 THEN regexp_extract(p_name, '\\w+$') WHEN l_partkey % 7 = 0 THEN regexp_extract(p_name, '^\\w+') ELSE p_name END AS name,
         CASE WHEN l_partkey % 3 = 0 OR l_partkey % 7 = 0 THEN 'Inconclusive' ELSE 'SJ' || length(p_name) END AS sjid
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def final_crosscheck(spark, d):
    items = table(spark, d, "lineitem").join(table(spark, d, "part"), F.expr("l_partkey = p_partkey"))
    name = F.when(F.expr("l_partkey % 3 = 0"), F.regexp_extract("p_name", r"\w+$", 0)).when(F.expr("l_partkey % 7 = 0"), F.regexp_extract("p_name", r"^\w+", 0)).otherwise(F.col("p_name"))
    sjid = F.when(F.expr("l_partkey % 3 = 0 OR l_partkey % 7 = 0"), "Inconclusive").otherwise(F.concat(F.lit("SJ"), F.length("p_name")))
    rows = items.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("n"), name.alias("name"), name.alias("points_to"), sjid.alias("sjid"))
    return crosscheck.final_crosscheck(rows, "case_id", "name", "points_to", "sjid")


_FORMS = """forms AS (
  SELECT DISTINCT p_size AS scope, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN regexp_replace(p_name, '^(\\w)\\w* ', '\\1 ') WHEN 2 THEN regexp_extract(p_name, '\\w+$')
    WHEN 3 THEN regexp_replace(p_name, ' ', ' ' || chr(97 + CAST(p_partkey % 5 AS INTEGER)) || 'nn ') WHEN 4 THEN regexp_replace(p_name, ' ', ' ' || chr(97 + CAST(p_partkey % 5 AS INTEGER)) || ' ') ELSE p_name || ' jr' END AS name
  FROM part)"""


def _forms(spark, d, *more):
    letter = F.expr("chr(97 + p_partkey % 5)")
    k, name = F.col("p_partkey") % 6, F.col("p_name")
    form = (
        F.when(k == 0, name).when(k == 1, F.regexp_replace(name, r"^(\w)\w* ", "$1 ")).when(k == 2, F.regexp_extract(name, r"\w+$", 0)).when(k == 3, F.replace(name, F.lit(" "), F.concat(F.lit(" "), letter, F.lit("nn "))))
        .when(k == 4, F.replace(name, F.lit(" "), F.concat(F.lit(" "), letter, F.lit(" ")))).otherwise(F.concat(name, F.lit(" jr")))
    )
    return table(spark, d, "part").select(*(more or [F.col("p_size").alias("scope")]), form.alias("name")).distinct()


def name_variants(spark, d):
    """Letters for first and middle words."""
    return variants.name_variants(_forms(spark, d), "name", ("scope",), first=True, middle=True).select("scope", "name", F.array_join("words", " ").alias("variant"))


def variant_subset_pairs(spark, d):
    """Names that hold one another once their middle words are letters."""
    return variants.subset_matches(_forms(spark, d), "scope", "name", middle=True)


def resolve_free(spark, d):
    """Each part a node: its form of a name, its size as weight, a few with ids."""
    k = F.col("p_partkey")
    named = _forms(spark, d, k.alias("node"), F.col("p_size").alias("weight"))
    ids = {c: F.when(F.col("node") % n == 0, F.concat(F.lit(p), (F.col("node") % 9973).cast("string"))) for c, n, p in (("nid", 97, "N"), ("ba_mag_id", 89, "B"), ("sjid", 211, "SJ"))}
    return free_scope.resolve_free(named.withColumns(ids))


def near_name_pairs(spark, d):
    """Names of the parts of a size that are alike by 90 or more."""
    return near.near_pairs(table(spark, d, "part").select(F.col("p_size").alias("scope"), "p_name"), "p_name", 90, ("scope",))


def name_components(spark, d):
    """Orders linked with another of their 64 keys."""
    o = F.col("o_orderkey")
    orders = table(spark, d, "orders")
    links = orders.where(o % 7 != 0).select(o.alias("a"), (o - o % 64 + (o * 5) % 64).alias("b")).where("a % 3 <> 0")
    return graph.components(links, "a", "b")


def resolve_case_rules(spark, d):
    """The forms of the parts' names by all rules of a case, each size a scope."""
    return anchors.resolve_case(_forms(spark, d, F.col("p_size").alias("scope"), F.col("p_partkey").alias("case_id")), "scope", "name", "case_id")


QUERIES = {f.__name__: f for f in (endpoints, chained_endpoints, final_crosscheck, name_variants, variant_subset_pairs, resolve_free, near_name_pairs, name_components, resolve_case_rules)}
# These names have at most one middle word, and only the suffix jr behind two words.
_CUT = """w AS (SELECT scope, name, string_split(name, ' ') AS t FROM forms), v AS (
  SELECT *, CASE WHEN len(t) = 3 AND t[3] <> 'jr' THEN [t[1], t[2][1], t[3]] ELSE t END AS m FROM w)"""
ORACLES = {
    "name_components": """WITH RECURSIVE links AS (
  SELECT o_orderkey AS a, o_orderkey - o_orderkey % 64 + (o_orderkey * 5) % 64 AS b FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 0
), pairs AS (SELECT a, b FROM links UNION SELECT b, a FROM links UNION SELECT a, a FROM links UNION SELECT b, b FROM links),
reach AS (SELECT a, b FROM pairs UNION SELECT r.a, e.b FROM reach r JOIN pairs e ON r.b = e.a)
SELECT a AS node, min(b) AS component FROM reach GROUP BY a""",
    "name_variants": f"""WITH {_FORMS}, {_CUT} SELECT scope, name, CASE WHEN len(m) = 1 THEN m[1] ELSE m[1][1] || ' ' || array_to_string(m[2:], ' ') END AS variant FROM v""",
    "variant_subset_pairs": f"""WITH {_FORMS}, {_CUT}, p AS (
  SELECT a.scope, a.name AS x, b.name AS y, a.m AS s, b.m AS l FROM v a JOIN v b ON a.scope = b.scope AND a.name <> b.name AND len(a.m) <= len(b.m)
), g AS (
  SELECT *, CASE WHEN len(s) = 1 AND len(l) > 1 THEN s[1] = CASE WHEN l[len(l)] = 'jr' THEN l[len(l) - 1] ELSE l[len(l)] END
    ELSE len(list_filter(range(1, len(s) + 1), lambda i: list_contains(l, s[i]) AND (i = 1 OR list_position(l, s[i]) > list_position(l, s[i - 1])))) = len(s) END AS held FROM p)
SELECT DISTINCT scope, least(x, y) AS a, greatest(x, y) AS b FROM g WHERE held""",
    "endpoints": f"WITH RECURSIVE {_POINTERS}, {_ENDS} SELECT node, target FROM follow",
    "chained_endpoints": "SELECT o_orderkey AS node, o_orderkey - o_orderkey % 1000 AS target FROM orders",
    # The names of the parts are close only where one contains the other.
    "final_crosscheck": f"""WITH {_NAMES}, forms AS (SELECT DISTINCT case_id, name, sjid FROM mentions), hits AS (
  SELECT b.case_id, b.name, count(*) AS n, min(g.name) AS new_name, min(g.sjid) AS new_id
  FROM forms b JOIN forms g ON g.case_id = b.case_id AND b.sjid = 'Inconclusive' AND g.sjid <> 'Inconclusive' AND contains(g.name, b.name) GROUP BY 1, 2)
SELECT m.case_id, m.n, m.name, coalesce(h.new_name, m.name) AS points_to, coalesce(h.new_id, m.sjid) AS sjid FROM mentions m LEFT JOIN hits h ON h.case_id = m.case_id AND h.name = m.name AND h.n = 1""",
}
