"""Queries of known judges' nodes and of cases brought up to date, and their SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..operators import court_nodes, report
from ..operators.endpoints import shared_folder
from ..sources.readers import table
from ..streaming import updates

# Three orders of a customer's number are three seats of a judge; a judge's name goes by the number.
_SEATS = [
    "concat('nid', o_custkey) AS nid",
    "CASE o_custkey % 4 WHEN 0 THEN concat('A[nn] Q. No-', chr(97 + o_custkey % 26)) WHEN 1 THEN concat('José ', chr(97 + o_custkey % 26), 'oe, Jr.') WHEN 2 THEN concat('Tom O', chr(39), ' ', chr(97 + o_custkey % 26), 'ay') END AS FullName",
    """CASE o_orderkey % 9 WHEN 0 THEN 'U.S. District Court for the Northern District of Illinois' WHEN 1 THEN 'U.S. District Court for the District of Massachusetts' WHEN 2 THEN 'U.S. Court of Appeals for the District of Columbia Circuit'
      WHEN 3 THEN 'U.S. Bankruptcy Court, Western District of Virginia' WHEN 4 THEN 'U.S. District Court for the Southern District of West Virginia' WHEN 5 THEN 'Supreme Court of the United States'
      WHEN 6 THEN 'U.S. District Court for the District of Columbia' WHEN 7 THEN NULL ELSE 'U.S. District Court for the District of the Northern Mariana Islands' END AS court_name""",
]


def tenured_nodes(spark, d):
    nodes = court_nodes.tenured_nodes(table(spark, d, "orders").selectExpr(*_SEATS))
    return nodes.select("court", "name", F.array_join("forms", "|").alias("forms"), "nid", F.array_join("courts", ",").alias("courts"))


def reduced_nodes(spark, d):
    """A node for each order; customers' ids are judges' ids for some."""
    rows = table(spark, d, "orders").selectExpr(
        "o_orderkey AS node", "CASE WHEN o_custkey % 3 = 0 THEN cast(o_custkey AS string) END AS nid", "CASE WHEN o_custkey % 2 = 0 THEN cast(o_custkey % 50 AS string) END AS ba_mag_id",
        "CASE WHEN o_orderkey % 11 > 0 THEN array(o_orderpriority, o_orderstatus) END AS courts",
    )
    out = court_nodes.reduced(rows)
    return out.select("node", "points_to", F.array_join("courts", ",").alias("courts"))


_SJID = "concat('SJ', l_suppkey)"


def _lines(rows, judge: str, sjid: str):
    return rows.selectExpr(
        "concat('c', l_orderkey % 5) AS court", "lpad(cast(year(l_shipdate) % 100 AS string), 2, '0') AS yy", "cast(l_orderkey AS string) AS ucid", f"cast({judge} AS bigint) AS judge_enum",
        "cast(NULL AS double) AS party_enum", "cast(l_partkey AS bigint) AS docket_index", "cast(l_suppkey AS bigint) AS full_span_start", f"{sjid} AS SJID",
    )


def case_updates(spark, d):
    """Cases on file, then a stream of lines: late answers for open ones, mentions that no case on file has, and new cases."""
    path = f"{shared_folder(spark)}/cases-{uuid4().hex}"
    items = table(spark, d, "lineitem")
    old = _lines(items.where("l_orderkey % 4 <> 0"), "l_linenumber", f"if(l_linestatus = 'O', 'Inconclusive', {_SJID})")
    updates.write_cases(old, f"{path}/cases")
    stream = spark.readStream.schema(items.schema).option("pathGlobFilter", "lineitem.parquet").parquet(d)
    new = _lines(stream.where("l_orderkey % 4 = 0 OR (l_linestatus = 'O' AND l_partkey % 2 = 0)"), "l_linenumber + if(l_orderkey % 4 <> 0 AND l_partkey % 10 = 2, 100, 0)", f"concat('new ', {_SJID})")
    updates.update_stream(new, f"{path}/cases", f"{path}/staging", f"{path}/state")
    return updates.read_cases(spark, f"{path}/cases", old.schema).select("ucid", "court", "yy", "judge_enum", "docket_index", "full_span_start", "SJID")


def _outcomes(spark, d):
    """Orders as cases: a customer is the judge, the status the resolution, and some have no application."""
    return table(spark, d, "orders").selectExpr(
        "concat('u', o_orderkey) AS ucid", "CASE o_orderkey % 4 WHEN 0 THEN 'ilnd' WHEN 1 THEN 'nmid' WHEN 2 THEN 'dcd' ELSE 'xx' END AS court", "concat('1:16-', if(o_orderkey % 10 = 0, 'cr', 'cv'), '-', o_orderkey) AS case_id",
        "CASE o_orderkey % 6 WHEN 0 THEN 555 WHEN 1 THEN 440 WHEN 2 THEN 510 END AS nos_code", "CASE WHEN o_custkey % 17 = 0 THEN 'Void' WHEN o_custkey % 19 = 0 THEN NULL ELSE concat('J', o_custkey % 400) END AS judge_name",
        "date_format(o_orderdate, 'M/d/yyyy') AS filedate", "if(o_orderkey % 5 > 0, named_struct('line', o_orderkey % 7, 'action', 'application'), NULL) AS application",
        "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE named_struct('line', o_orderkey % 9, 'action', CASE o_orderstatus WHEN 'F' THEN 'grant' WHEN 'O' THEN 'deny' ELSE 'other' END) END AS resolution",
    )


def living_report(spark, d):
    told = _outcomes(spark, d)
    hand = told.where("judge_name LIKE 'J%7'").select("ucid", F.lit("grant").alias("category"))
    return report.living_report(report.kept_cases(told, by_hand=hand), "key", ("J13",))


def validation_table(spark, d):
    told = _outcomes(spark, d)
    return report.validation_table(told.where("court <> 'xx'"), told.select("ucid", F.concat(F.lit("data/"), "ucid", F.lit(".json")).alias("fpath")), "/cases/")


QUERIES = {f.__name__: f for f in (tenured_nodes, reduced_nodes, case_updates, living_report, validation_table)}
_OUTCOMES = """o AS (SELECT 'u' || o_orderkey AS ucid, o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'ilnd' WHEN 1 THEN 'nmid' WHEN 2 THEN 'dcd' ELSE 'xx' END AS court, CASE o_orderkey % 4 WHEN 0 THEN '7' WHEN 1 THEN '9' WHEN 2 THEN 'DC' END AS circuit,
  CASE WHEN o_orderkey % 10 = 0 THEN 'cr' ELSE 'cv' END AS case_type, CASE WHEN o_custkey % 17 = 0 THEN 'Void' WHEN o_custkey % 19 = 0 THEN NULL ELSE 'J' || o_custkey % 400 END AS judge, CAST(year(o_orderdate) AS INTEGER) AS year,
  CASE WHEN o_orderkey % 5 > 0 THEN 'application on line ' || o_orderkey % 7 END AS app, CASE WHEN o_orderkey % 11 > 0 THEN CASE o_orderstatus WHEN 'F' THEN 'grant' WHEN 'O' THEN 'deny' ELSE 'other' END END AS res FROM orders)"""
ORACLES = {
    "living_report": f"""WITH {_OUTCOMES}, c AS (
  SELECT *, CASE WHEN judge LIKE 'J%7' THEN 'grant' ELSE coalesce(res, 'no_resolution') END AS category FROM o WHERE (app IS NOT NULL OR res IS NOT NULL) AND judge IS DISTINCT FROM 'Void'
), r AS (SELECT *, CASE category WHEN 'grant' THEN 1 WHEN 'deny' THEN -1 ELSE 0 END AS resolution FROM c WHERE category <> 'other')
SELECT court, sha256('key' || chr(31) || '1:16-' || case_type || '-' || k) AS case_id, CASE WHEN judge = 'J13' THEN judge ELSE sha256('key' || chr(31) || judge) END AS judge_name, CAST(resolution AS INTEGER) AS resolution, year, case_type,
  CAST(case_type = 'cr' OR k % 6 IN (0, 2) AS INTEGER) AS nature_of_suit_prisoner, circuit,
  CASE WHEN judge IS NOT NULL THEN count(*) OVER j END AS case_total, CASE WHEN judge IS NOT NULL THEN count(*) FILTER (resolution <> 0) OVER j END AS decision_total, CASE WHEN judge IS NOT NULL THEN count(*) FILTER (resolution = 1) OVER j / count(*) OVER j END AS decision_average,
  CASE WHEN judge IS NOT NULL THEN count(*) OVER y END AS ycase_total, CASE WHEN judge IS NOT NULL THEN count(*) FILTER (resolution <> 0) OVER y END AS ydecision_total, CASE WHEN judge IS NOT NULL THEN count(*) FILTER (resolution = 1) OVER y / count(*) OVER y END AS ydecision_average
FROM r WINDOW j AS (PARTITION BY judge), y AS (PARTITION BY judge, year)""",
    "validation_table": f"""WITH {_OUTCOMES}
SELECT ucid, '/cases/data/' || ucid || '.html' AS fpath, '/cases/data/' || ucid || '.json' AS jpath, CASE WHEN court = 'xx' THEN 'none' ELSE coalesce(app, 'none') END AS app, CASE WHEN court = 'xx' THEN 'none' ELSE coalesce(res || ' on line ' || k % 9, 'none') END AS res FROM o""",
    "tenured_nodes": """WITH seats AS (
  SELECT o_custkey AS k, CASE o_orderkey % 9 WHEN 0 THEN 'ilnd' WHEN 1 THEN 'mad' WHEN 3 THEN 'vawd' WHEN 4 THEN 'wvsd' WHEN 6 THEN 'dcd' WHEN 8 THEN 'nmid' END AS court FROM orders WHERE o_custkey % 4 < 3
), people AS (
  SELECT k, coalesce(string_agg(DISTINCT court, ',' ORDER BY court), '') AS courts, chr(CAST(97 + k % 26 AS INTEGER)) AS x FROM seats GROUP BY k
), named AS (
  SELECT *, CASE k % 4 WHEN 0 THEN 'a q no-' || x WHEN 1 THEN 'jose ' || x || 'oe jr' ELSE 'tom o ' || x || 'ay' END AS name FROM people)
SELECT unnest(CASE WHEN courts = '' THEN ['Unallocated'] ELSE string_split(courts, ',') END) AS court, name, CASE WHEN k % 4 = 0 THEN name || '|ann q no-' || x ELSE name END AS forms, 'nid' || k AS nid, courts FROM named""",
    "reduced_nodes": """WITH n AS (
  SELECT o_orderkey AS node, CASE WHEN o_custkey % 3 = 0 THEN 'n' || o_custkey WHEN o_custkey % 2 = 0 THEN 'b' || o_custkey % 50 END AS k, CASE WHEN o_orderkey % 11 > 0 THEN [o_orderpriority, o_orderstatus] END AS courts FROM orders
), f AS (SELECT k, min(node) AS points_to FROM n WHERE k IS NOT NULL GROUP BY k),
c AS (SELECT k, string_agg(DISTINCT court, ',' ORDER BY court) AS every FROM (SELECT k, unnest(courts) AS court FROM n WHERE k IS NOT NULL) GROUP BY k)
SELECT node, coalesce(points_to, node) AS points_to, CASE WHEN points_to = node THEN coalesce(every, '') ELSE array_to_string(courts, ',') END AS courts FROM n LEFT JOIN f ON n.k = f.k LEFT JOIN c ON n.k = c.k""",
    "case_updates": """WITH r AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS ucid, 'c' || l_orderkey % 5 AS court, lpad(CAST(year(l_shipdate) % 100 AS VARCHAR), 2, '0') AS yy, CAST(l_linenumber AS BIGINT) AS judge_enum, CAST(l_partkey AS BIGINT) AS docket_index,
    CAST(l_suppkey AS BIGINT) AS full_span_start, 'SJ' || l_suppkey AS sj, l_orderkey % 4 = 0 AS fresh, l_linestatus FROM lineitem
), u AS (SELECT ucid, judge_enum, docket_index, full_span_start, max(yy) AS new_yy FROM r WHERE NOT fresh AND l_linestatus = 'O' AND docket_index % 2 = 0 AND docket_index % 10 <> 2 GROUP BY ALL)
SELECT r.ucid, r.court, coalesce(new_yy, yy) AS yy, r.judge_enum, r.docket_index, r.full_span_start, CASE WHEN fresh OR new_yy IS NOT NULL THEN 'new ' || sj WHEN l_linestatus = 'O' THEN 'Inconclusive' ELSE sj END AS "SJID"
FROM r LEFT JOIN u ON r.ucid = u.ucid AND r.judge_enum = u.judge_enum AND r.docket_index = u.docket_index AND r.full_span_start = u.full_span_start AND NOT r.fresh""",
}
