"""Every registered query of the engine and, where SQL can express it, its SQL.

The driver's tables stand in for dockets: customers are judges, nations are
courts, orders are cases; users of ``events`` are cases too, and an event's
type gives its docket text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import keywords
from ..functions import patterns as P
from ..functions import text as T
from ..functions.court_words import KEYWORDS
from ..operators import anchors, cases, dockets, ground_truth, relational, resolve, sealed, statistics, statuses
from ..operators import mentions as mention_ops
from ..operators.endpoints import shared_folder
from ..sources.readers import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- stand-ins ---------------------------------------------------------------

DECISIONS = """decisions AS (
  SELECT o_orderkey AS case_id, o_custkey AS judge, n_name AS court, CAST(year(o_orderdate) AS INTEGER) AS yr,
         CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END AS outcome,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS g
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

TEXTS = {
    "signup": "MOTION for leave to proceed in forma pauperis",
    "purchase": "ORDER granting motion to proceed in forma pauperis",
    "error": "ORDER denying motion to proceed in forma pauperis",
    "click": "NOTICE OF APPEAL",
    "view": "MOTION to seal document",
}
ACTIONS = {"signup": "application", "purchase": "grant", "error": "deny", "click": "other"}
_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TEXTS.items())
LINES = f"""lines AS (
  SELECT user_id AS case_id, event_id AS idx, ts, value, event_type, CASE event_type {_CASE} ELSE 'OTHER entry' END AS txt FROM events)"""


def decisions(spark, d):
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    joined = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return joined.select(
        F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("judge"), F.col("n_name").alias("court"), F.year("o_orderdate").alias("yr"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", -1).otherwise(0).alias("outcome"),
        (F.col("o_orderstatus") == "F").cast("int").alias("g"),
    )


def lines(spark, d):
    text = F.lit("OTHER entry")
    for k, v in TEXTS.items():
        text = F.when(F.col("event_type") == k, v).otherwise(text)
    return table(spark, d, "events").select(F.col("user_id").alias("case_id"), F.col("event_id").alias("idx"), "ts", "value", "event_type", text.alias("txt"))


def rounded(df, *columns):
    return df.select(*[F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns])


# --- statistics --------------------------------------------------------------


@query(f"""WITH {DECISIONS}
SELECT case_id, judge, outcome, count(*) OVER w AS case_total, count(*) FILTER (outcome <> 0) OVER w AS decision_total,
       round(avg(CASE WHEN outcome = 1 THEN 1.0 ELSE 0.0 END) OVER w, 6) AS decision_average
FROM decisions WINDOW w AS (PARTITION BY judge)""")
def judge_totals(spark, d):
    return rounded(statistics.totals(decisions(spark, d).select("case_id", "judge", "outcome"), ["judge"], "outcome"), "decision_average")


@query(f"""WITH {DECISIONS}
SELECT judge, yr, count(*) AS case_total, count(*) FILTER (outcome <> 0) AS decision_total, round(avg(CASE WHEN outcome = 1 THEN 1.0 ELSE 0.0 END), 6) AS decision_average
FROM decisions GROUP BY judge, yr""")
def judge_year_totals(spark, d):
    out = decisions(spark, d).groupBy("judge", "yr").agg(
        F.count("*").alias("case_total"), F.count_if(F.col("outcome") != 0).alias("decision_total"), F.avg((F.col("outcome") == 1).cast("double")).alias("decision_average")
    )
    return rounded(out, "decision_average")


_MOMENTS = f"""{DECISIONS}, j AS (
  SELECT court, judge, count(*) AS n, CAST(sum(g) AS DOUBLE) AS s FROM decisions GROUP BY court, judge
), m AS (
  SELECT *, sum(n) OVER c - n AS no, sum(s) OVER c - s AS so FROM j WINDOW c AS (PARTITION BY court)
), v AS (
  SELECT court, judge, n, no, s / n AS mj, so / nullif(no, 0) AS mo FROM m
), x AS (
  SELECT *, greatest(mj - mj * mj, 0) AS vj, greatest(mo - mo * mo, 0) AS vo FROM v
)"""


@query(f"""WITH {_MOMENTS}, y AS (SELECT *, vj / n AS a, vo / no AS b FROM x WHERE n > 5 AND no > 0)
SELECT court, judge, CAST(n AS BIGINT) AS n_judge, CAST(no AS BIGINT) AS n_other, round(mj, 6) AS mean_judge, round(mo, 6) AS mean_other,
       round(vj, 6) AS var_judge, round(vo, 6) AS var_other, round(mj - mo, 6) AS diff, round(sqrt(a + b), 6) AS se,
       round((a + b) * (a + b) / nullif(a * a / (n - 1) + b * b / nullif(no - 1, 0), 0), 4) AS df
FROM y""")
def leave_one_out_diff(spark, d):
    out = statistics.leave_one_out(decisions(spark, d), "judge", "court", "g")
    return rounded(out, "mean_judge", "mean_other", "var_judge", "var_other", "diff", "se").withColumn("df", F.round("df", 4))


@query()
def welch_intervals(spark, d):
    return statistics.welch_intervals(decisions(spark, d), "judge", "court", "g").select("court", "judge", "diff", "lb", "ub", "sig")


@query(f"""WITH {_MOMENTS}
SELECT court, judge, CAST(n AS BIGINT) AS n_judge, CAST(no AS BIGINT) AS n_other, round(mj - mo, 6) AS diff,
       round(sqrt((vj * n + vo * no) / (n + no - 2) * (1.0 / n + 1.0 / no)), 6) AS se, CAST(n + no - 2 AS BIGINT) AS df
FROM x WHERE no > 0 AND n + no > 2""")
def pooled_ttest_diff(spark, d):
    out = statistics.pooled(decisions(spark, d), "judge", "court", "g")
    return rounded(out, "diff", "se").select("court", "judge", "n_judge", "n_other", "diff", "se", "df")


# The share of Student's distribution within t is an integral over the angle: Simpson's rule on 400 steps.
_SIG = f"""WITH {DECISIONS}, d AS (
  SELECT judge, court, g, o_orderpriority = '1-URGENT' AS prisoner, avg(g) OVER (PARTITION BY judge) AS average FROM decisions JOIN orders ON o_orderkey = case_id
), runs AS (
  SELECT court, judge, g, 'none' AS excl FROM d UNION ALL SELECT court, judge, g, 'prisoners and outliers' FROM d WHERE NOT prisoner AND average BETWEEN 0.05 AND 0.95
), j AS (
  SELECT excl, court, judge, count(*) AS n, CAST(sum(g) AS DOUBLE) AS s FROM runs GROUP BY ALL
), m AS (
  SELECT *, sum(n) OVER c - n AS no, sum(s) OVER c - s AS so FROM j WINDOW c AS (PARTITION BY excl, court)
), v AS (
  SELECT excl, court, judge, n, no, s / n AS mj, so / no AS mo FROM m WHERE n > 5 AND no > 0
), y AS (
  SELECT *, greatest(mj - mj * mj, 0) / n AS a, greatest(mo - mo * mo, 0) / no AS b FROM v
), z AS (
  SELECT excl, court, judge, (a + b) * (a + b) / nullif(a * a / (n - 1) + b * b / nullif(no - 1, 0), 0) AS df, abs(mj - mo) / nullif(sqrt(a + b), 0) AS t FROM y
), steps AS (
  SELECT z.*, k, atan(t / sqrt(df)) AS u FROM z, generate_series(0, 400) AS g(k)
), within AS (
  SELECT excl, court, judge, sum((CASE WHEN k IN (0, 400) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(u * k / 400), df - 1)) * max(u) / 1200
         * 2 / exp(lgamma(0.5) + lgamma(max(df) / 2) - lgamma((max(df) + 1) / 2)) AS p FROM steps GROUP BY ALL
), f AS (SELECT court, excl, CASE WHEN p > 0.95 THEN 1 ELSE 0 END AS sig FROM within)"""


@query(f"""{_SIG}
SELECT court, excl, CAST(sum(sig) AS BIGINT) AS jsum, count(*) AS jcount, round(avg(sig), 6) AS jmean, avg(sig) > 0.05 AS is_sig FROM f GROUP BY court, excl""")
def sig_lookup(spark, d):
    """All decisions, and those without prisoners' cases and judges at the extremes."""
    rows = decisions(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), (F.col("o_orderpriority") == "1-URGENT").alias("prisoner")), "case_id")
    told = statistics.totals(rows, ["judge"], "outcome")
    fewer = statistics.without_prisoners(statistics.trim_outliers(told, "decision_average", 0.1), "prisoner")
    runs = [(name, statistics.welch_intervals(x, "judge", "court", "g")) for name, x in (("none", rows), ("prisoners and outliers", fewer))]
    return rounded(statistics.significance_table(runs, "court"), "jmean")


@query("""WITH j AS (SELECT l_suppkey AS judge, count(*) AS n, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS rate FROM lineitem GROUP BY 1 HAVING count(*) >= 35)
SELECT judge, n, round(rate, 6) AS rate, row_number() OVER (ORDER BY rate, judge) AS place, round(100.0 * row_number() OVER (ORDER BY rate, judge) / count(*) OVER (), 6) AS percentile FROM j""")
def judge_percentile_rank(spark, d):
    j = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("judge")).agg(F.count("*").alias("n"), F.avg((F.col("l_returnflag") == "R").cast("double")).alias("rate"))
    return rounded(statistics.percentile_rank(j.where("n >= 35"), "rate", "judge"), "rate", "percentile")


# --- docket lines ------------------------------------------------------------

_OUT = "CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END"


@query(f"""WITH {LINES}, o AS (SELECT case_id, idx, {_OUT} AS outcome FROM lines), r AS (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY CASE outcome WHEN 1 THEN 0 WHEN -1 THEN 1 ELSE 4 END, idx) AS k FROM o)
SELECT case_id, idx, outcome AS resolution FROM r WHERE k = 1""")
def outcome_priority(spark, d):
    return dockets.outcome_priority(lines(spark, d).withColumn("outcome", T.outcome(F.col("txt"))), "case_id", "idx", "outcome")


def _statuses(spark, d):
    action = F.lit(None).cast("string")
    for k, v in ACTIONS.items():
        action = F.when(F.col("event_type") == k, v).otherwise(action)
    text = F.when(F.expr("idx % 7 = 0"), F.concat(F.lit("MINUTE "), "txt")).when(F.expr("idx % 7 = 1"), F.concat("txt", F.lit(" after an appeal"))).otherwise(F.col("txt"))
    return lines(spark, d).withColumn("txt", text).withColumn("action", action).where("action IS NOT NULL").withColumn("kind", T.entry_type(F.col("txt")))


@query(f"""WITH {LINES}, s AS (
  SELECT case_id, idx, CASE event_type WHEN 'purchase' THEN 'grant' WHEN 'error' THEN 'deny' ELSE 'other' END AS action,
         CASE WHEN idx % 7 = 0 THEN 'MINUTE ' || txt WHEN idx % 7 = 1 THEN txt || ' after an appeal' ELSE txt END AS txt FROM lines WHERE event_type IN ('purchase', 'error', 'click')
), c AS (
  SELECT *, (CASE WHEN txt LIKE 'ORDER%' THEN 1.0 ELSE 0 END) + (CASE WHEN idx = max(idx) OVER (PARTITION BY case_id) THEN 0.5 ELSE 0 END) + 1.0
         + (CASE WHEN txt LIKE '%NOTICE OF APPEAL%' THEN 0 ELSE 1.0 END) + (CASE action WHEN 'grant' THEN 1.5 WHEN 'deny' THEN 1.0 ELSE 0 END) AS score FROM s
), r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, idx) AS k FROM c)
SELECT case_id, idx, action, CAST(score AS DOUBLE) AS score FROM r WHERE k = 1""")
def status_score_argmax(spark, d):
    return dockets.status_argmax(_statuses(spark, d), "case_id", "idx", "idx", "action", "kind", "txt").select("case_id", "idx", "action", "score")


@query(f"""WITH {LINES}, w AS (SELECT case_id, idx AS s, idx + 500 AS e FROM lines WHERE event_type = 'click')
SELECT l.case_id, l.idx, l.event_type FROM lines l WHERE l.event_type IN ('purchase', 'error') AND NOT EXISTS (SELECT 1 FROM w WHERE w.case_id = l.case_id AND w.s <= l.idx AND l.idx < w.e)""")
def appeal_window_anti(spark, d):
    all_ = lines(spark, d)
    windows = all_.where("event_type = 'click'").select("case_id", F.col("idx").alias("start"), (F.col("idx") + 500).alias("end"))
    return dockets.outside_windows(all_.where("event_type IN ('purchase', 'error')"), windows, "case_id", "idx").select("case_id", "idx", "event_type")


@query(f"""WITH {LINES}, t AS (SELECT case_id, idx, event_type = 'error' AS t FROM lines), b AS (
  SELECT *, coalesce(sum(CASE WHEN t THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS own FROM t)
SELECT case_id, idx, CAST(own AS BIGINT) AS block FROM b UNION ALL SELECT case_id, idx, CAST(own + 1 AS BIGINT) FROM b WHERE t""")
def transfer_blocks(spark, d):
    return dockets.transfer_blocks(lines(spark, d).select("case_id", "idx", "event_type"), "case_id", "idx", F.col("event_type") == "error").select("case_id", "idx", "block")


@query(f"""WITH {LINES}, a AS (SELECT case_id, min(idx) AS first FROM lines WHERE event_type = 'signup' GROUP BY 1),
  b AS (SELECT case_id, first, min(idx) AS last FROM lines JOIN a USING (case_id) WHERE event_type = 'purchase' AND idx > first GROUP BY 1, 2),
  c AS (SELECT case_id, event_type, count(*) AS n FROM lines JOIN b USING (case_id) WHERE idx BETWEEN first AND last GROUP BY 1, 2), m AS (SELECT *, max(n) OVER (PARTITION BY case_id) AS x FROM c)
SELECT case_id, CASE WHEN count(*) = 1 THEN min(event_type) END AS event_type, max(n) AS n FROM m WHERE n = x GROUP BY case_id""")
def unique_mode_between(spark, d):
    """From each case's first application to its first resolution after that."""
    between = dockets.between_lines(lines(spark, d), "case_id", "idx", F.col("event_type") == "signup", F.col("event_type") == "purchase")
    return dockets.unique_mode(between, "case_id", "event_type")


@query(f"""WITH {LINES}, c AS (SELECT case_id, event_type, count(*) AS n, min(idx) AS f FROM lines GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, f) AS k FROM c)
SELECT case_id, event_type, n FROM r WHERE k = 1""")
def first_seen_mode(spark, d):
    return dockets.first_seen_mode(lines(spark, d), "case_id", "event_type", "idx")


@query(f"""WITH {LINES}, a AS (SELECT case_id, idx FROM lines WHERE event_type = 'purchase'), v AS (SELECT case_id, idx, round(value, 6) AS value FROM lines WHERE event_type = 'view'), r AS (
  SELECT a.case_id, a.idx, v.idx AS found_at, v.value, row_number() OVER (PARTITION BY a.case_id, a.idx ORDER BY CASE WHEN v.idx < a.idx THEN 0 ELSE 1 END, abs(v.idx - a.idx)) AS k
  FROM a LEFT JOIN v ON a.case_id = v.case_id)
SELECT case_id, idx, found_at, value FROM r WHERE k = 1""")
def nearest_line_probe(spark, d):
    all_ = lines(spark, d).withColumn("value", F.round("value", 6))
    return dockets.nearest_line(all_.where("event_type = 'purchase'"), all_.where("event_type = 'view'"), "case_id", "idx", "value")


# Seven cases a user; a line's number counts from 0 in its case.
_CASES = """li AS (
  SELECT user_id * 100 + event_id % 7 AS case_id, event_id AS e, event_type, row_number() OVER (PARTITION BY user_id, event_id % 7 ORDER BY event_id) - 1 AS idx FROM events
), st AS (
  SELECT case_id, idx, CASE event_type WHEN 'signup' THEN 'application' WHEN 'purchase' THEN 'grant' ELSE 'deny' END AS action, e % 10 AS s_start, e % 10 + 9 AS s_end, 2 * e AS seq
  FROM li WHERE event_type IN ('signup', 'purchase', 'error') UNION ALL
  SELECT case_id, idx, 'application', 0, 8, 2 * e + 1 FROM li WHERE e % 6 = 0
), me AS (
  SELECT case_id, idx, e % 17 AS "start", e % 17 + 5 AS "end", CASE WHEN e % 3 = 0 THEN NULL WHEN case_id % 5 = 0 THEN 'SJ0' ELSE 'SJ' || (e % 5) END AS sjid, 'text' AS method, 2 * e AS seq
  FROM li WHERE CASE case_id % 7 WHEN 3 THEN event_type IN ('view', 'click') AND e % 6 <> 0 WHEN 5 THEN false ELSE e % 5 < 2 END UNION ALL
  SELECT case_id, idx, e % 13, e % 13 + 4, 'SJ' || (e % 7), 'text', 2 * e + 1 FROM li WHERE e % 4 = 0 AND case_id % 5 <> 0 AND case_id % 7 NOT IN (3, 5) UNION ALL
  SELECT DISTINCT case_id, -1, 0, 5, 'SJ' || (case_id % 9), CASE WHEN case_id % 2 = 0 THEN 'assigned_judge' ELSE 'referred_judges' END, case_id FROM li WHERE case_id % 3 = 0
), ca AS (
  SELECT case_id, arg_min(CASE WHEN action = 'application' THEN [idx, s_start, s_end] END, seq) FILTER (action = 'application') AS app,
         CASE WHEN case_id % 4 = 2 THEN NULL WHEN case_id % 4 = 0 THEN arg_min([idx, s_start, s_end], seq) FILTER (action <> 'application')
              ELSE arg_max([idx, s_start, s_end], seq) FILTER (action <> 'application') END AS res
  FROM st GROUP BY case_id
)"""


def _case_lines(spark, d):
    li = table(spark, d, "events").select((F.col("user_id") * 100 + F.col("event_id") % 7).alias("case_id"), F.col("event_id").alias("e"), "event_type")
    return li.withColumn("idx", (F.row_number().over(Window.partitionBy("case_id").orderBy("e")) - 1).cast("long"))


def _cases(spark, d):
    """Cases with their chosen application and resolution, statuses, and mentions of judges."""
    li = _case_lines(spark, d)
    action = F.when(F.col("event_type") == "signup", "application").when(F.col("event_type") == "purchase", "grant").otherwise("deny")
    st = li.where("event_type IN ('signup', 'purchase', 'error')").select("case_id", "idx", action.alias("action"), F.expr("e % 10 AS s_start"), F.expr("e % 10 + 9 AS s_end"), F.expr("2 * e AS seq"))
    st = st.unionByName(li.where("e % 6 = 0").selectExpr("case_id", "idx", "'application' AS action", "0L AS s_start", "8L AS s_end", "2 * e + 1 AS seq"))
    judge = F.when(F.expr("e % 3 = 0"), None).when(F.expr("case_id % 5 = 0"), "SJ0").otherwise(F.concat(F.lit("SJ"), F.expr("e % 5")))
    where = "CASE case_id % 7 WHEN 3 THEN event_type IN ('view', 'click') AND e % 6 <> 0 WHEN 5 THEN false ELSE e % 5 < 2 END"
    me = li.where(where).select("case_id", "idx", F.expr("e % 17 AS start"), F.expr("e % 17 + 5 AS end"), judge.alias("sjid"), F.lit("text").alias("method"), F.expr("2 * e AS seq"))
    me = me.unionByName(li.where("e % 4 = 0 AND case_id % 5 <> 0 AND case_id % 7 NOT IN (3, 5)").selectExpr("case_id", "idx", "e % 13 AS start", "e % 13 + 4 AS end", "concat('SJ', e % 7) AS sjid", "'text' AS method", "2 * e + 1 AS seq"))
    heads = li.where("case_id % 3 = 0").select("case_id").distinct()
    me = me.unionByName(heads.selectExpr("case_id", "-1L AS idx", "0L AS start", "5L AS end", "concat('SJ', case_id % 9) AS sjid", "CASE WHEN case_id % 2 = 0 THEN 'assigned_judge' ELSE 'referred_judges' END AS method", "case_id AS seq"))
    spot, ends = F.struct("idx", "s_start", "s_end"), F.col("action") != "application"
    first, last = F.min_by(spot, F.when(ends, F.col("seq"))), F.max_by(spot, F.when(ends, F.col("seq")))
    ca = st.groupBy("case_id").agg(F.min_by(spot, F.when(~ends, F.col("seq"))).alias("a"), F.when(F.expr("case_id % 4 = 2"), None).when(F.expr("case_id % 4 = 0"), first).otherwise(last).alias("r"))
    names = [("idx", "line"), ("s_start", "start"), ("s_end", "end")]
    return ca.select("case_id", *[F.col(f"{s}.{c}").alias(f"{p}_{n}") for s, p in (("a", "app"), ("r", "res")) for c, n in names]), st, me


@query(f"""WITH {_CASES}, aim AS (
  SELECT case_id, app, res, coalesce(res, app) AS t, (SELECT min(idx) FROM st WHERE st.case_id = ca.case_id) AS lo, (SELECT max(idx) FROM st WHERE st.case_id = ca.case_id) AS hi,
         EXISTS (SELECT 1 FROM st WHERE st.case_id = ca.case_id AND idx = 0 AND action = 'application') AS asked FROM ca
), ex AS (
  SELECT st.case_id, st.idx, st.s_start, st.s_end, min(st.seq) AS q, count(DISTINCT sjid) AS k, max(sjid) AS one,
         count(DISTINCT me.seq) FILTER (me.start BETWEEN s_start AND s_end OR me."end" BETWEEN s_start AND s_end) AS n,
         max(sjid) FILTER (me.start BETWEEN s_start AND s_end OR me."end" BETWEEN s_start AND s_end) AS ins
  FROM st JOIN me ON me.case_id = st.case_id AND me.idx = st.idx GROUP BY 1, 2, 3, 4
), hit AS (
  SELECT case_id, idx, s_start, s_end, q, CASE WHEN k = 1 THEN one WHEN n = 1 THEN ins END AS j FROM ex WHERE k = 1 OR (k > 1 AND n = 1 AND ins IS NOT NULL)
), near AS (
  SELECT case_id, j FROM (SELECT h.case_id, j, row_number() OVER (PARTITION BY h.case_id ORDER BY CASE WHEN (h.idx < t[1]) = (res IS NOT NULL) THEN 0 ELSE 1 END, abs(h.idx - t[1]), q) AS r
  FROM hit h JOIN aim USING (case_id) WHERE h.idx <> t[1]) WHERE r = 1
), tally AS (
  SELECT case_id, sjid, count(*) AS c FROM me JOIN aim USING (case_id) WHERE sjid IS NOT NULL
    AND idx BETWEEN CASE WHEN res[1] <> 0 THEN app[1] ELSE lo END AND CASE WHEN res[1] <> 0 THEN res[1] ELSE hi END GROUP BY 1, 2
), mode AS (
  SELECT case_id, min(sjid) AS j FROM tally t WHERE c = (SELECT max(c) FROM tally u WHERE u.case_id = t.case_id) GROUP BY 1 HAVING count(*) = 1
), steps AS (
  SELECT case_id, res[1] = 0 AND NOT asked AS void,
         (SELECT CASE WHEN count(DISTINCT sjid) = 1 THEN max(sjid) END FROM me WHERE me.case_id = aim.case_id) AS s1,
         (SELECT max(j) FROM hit h WHERE h.case_id = aim.case_id AND h.idx = t[1] AND h.s_start = t[2] AND h.s_end = t[3]) AS s2, near.j AS s3, mode.j AS s4,
         (SELECT max(sjid) FROM me WHERE me.case_id = aim.case_id AND idx = -1) AS s5
  FROM aim LEFT JOIN near USING (case_id) LEFT JOIN mode USING (case_id)
)
SELECT case_id, CASE WHEN void THEN NULL ELSE coalesce(s1, s2, s3, s4, s5) END AS attributed,
       CASE WHEN void THEN 'void' WHEN s1 IS NOT NULL THEN 'single' WHEN s2 IS NOT NULL THEN 'direct' WHEN s3 IS NOT NULL THEN 'neighbour' WHEN s4 IS NOT NULL THEN 'mode'
            WHEN s5 IS NOT NULL THEN 'header' ELSE 'not_found' END AS method FROM steps""")
def attribution_cascade(spark, d):
    return statuses.attributed(*_cases(spark, d), "case_id", "idx")


# Lines of several sentences; sentences are joined by "; " and " and " only, which the SQL can split at.
SAID = [
    "MOTION for leave to proceed in forma pauperis", "ORDER  granting motion to proceed in forma pauperis", "ORDER denying application to proceed IFP", "order of service for ifp", "request to proceed without prepaying fees",
    "motion to proceed without the payment of costs", "allows plaintiff to proceed in forma pauperis", "request for ifp is denied as moot", "Notice of voluntary dismissal", "nothing of the kind",
    "IFP application granted in part", "Case transferred to the Eastern District", "motion to proceed in forma pauperis on appeal", "plaintiff may proceed IFP", "waive filing fee denied.", "reduced filing fee procedure",
    "denies leave to proceed under 28 USC 1915",
]
_SAID = ", ".join(f"'{x}'" for x in SAID)
_SAID_LINES = f"""t AS (SELECT user_id AS case_id, event_id AS idx, [{_SAID}] AS s FROM events), l AS (
  SELECT case_id, idx, s[idx % 17 + 1] || '; ' || s[idx % 13 + 1] || CASE WHEN idx % 2 = 0 THEN ' and ' || s[idx % 11 + 1] ELSE '' END AS txt FROM t)"""


def _said(spark, d):
    said = F.array(*[F.lit(x) for x in SAID])
    at = lambda k: F.get(said, (F.col("idx") % k).cast("int"))
    text = F.concat(at(17), F.lit("; "), at(13), F.when(F.col("idx") % 2 == 0, F.concat(F.lit(" and "), at(11))).otherwise(""))
    return lines(spark, d).select("case_id", "idx").withColumn("txt", text)


# What the sentences say, read from the patterns by hand; each says one thing at most.
@query(f"""WITH {_SAID_LINES}, said(low, action, hit) AS (VALUES
  ('motion for leave to proceed in forma pauperis', 'application', 'motion for leave to proceed in forma pauperis'), ('order granting motion to proceed in forma pauperis', 'grant', 'granting motion to proceed in forma pauperis'),
  ('order denying application to proceed ifp', 'deny', 'denying application to proceed ifp'), ('request to proceed without prepaying fees', 'application', 'request to proceed without prepay'),
  ('motion to proceed without the payment of costs', 'application', 'motion to proceed without the pay'), ('allows plaintiff to proceed in forma pauperis', 'grant', 'allows plaintiff to proceed in forma pauperis'),
  ('request for ifp is denied as moot', 'other', 'ifp is denied as moot'), ('notice of voluntary dismissal', 'other', 'notice of voluntary dismissal'), ('ifp application granted in part', 'other', 'granted in part'),
  ('case transferred to the eastern district', 'other', 'transferred to the eastern district'), ('plaintiff may proceed ifp', 'grant', 'may proceed ifp'), ('waive filing fee denied.', 'deny', 'waive filing fee denied.'),
  ('reduced filing fee procedure', 'other', 'reduced filing fee procedure'), ('denies leave to proceed under 28 usc 1915', 'deny', 'denies leave to proceed under 28 usc 1915')
), p AS (SELECT case_id, idx, txt, unnest(regexp_split_to_array(txt, ' and |;')) AS s, generate_subscripts(regexp_split_to_array(txt, ' and |;'), 1) AS n FROM l
), m AS (SELECT *, trim(regexp_replace(lower(s), '\\s+', ' ', 'g')) AS low FROM p)
SELECT case_id, idx, action, CAST(strpos(txt, s) + strpos(low, hit) - 2 AS INTEGER) AS s_start, CAST(strpos(txt, s) + strpos(low, hit) - 2 + length(hit) AS INTEGER) AS s_end,
       CAST(row_number() OVER (PARTITION BY case_id ORDER BY idx, n) AS INTEGER) AS seq FROM m JOIN said USING (low)""")
def status_spans(spark, d):
    return statuses.status_spans(_said(spark, d), "case_id", "idx", "txt")


@query(f"""WITH {_CASES}, x AS (
  SELECT *, CASE WHEN seq % 3 = 0 THEN 1.0 ELSE 0.0 END + CASE WHEN idx = max(idx) OVER (PARTITION BY case_id) THEN 0.5 ELSE 0.0 END + CASE WHEN seq % 4 = 0 THEN 0.0 ELSE 1.0 END AS score
  FROM st WHERE action = 'application')
SELECT case_id, idx, seq, CAST(score AS DOUBLE) AS score FROM x WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY score DESC, seq) = 1""")
def application_score_argmax(spark, d):
    _, st, _ = _cases(spark, d)
    st = st.withColumns({"kind": F.when(F.expr("seq % 3 = 0"), "MOTION").otherwise("NOTICE"), "text": F.when(F.expr("seq % 4 = 0"), "Pending NOTICE of Appeal").otherwise("Motion on appeal")})
    return statuses.best_application(st, "case_id", "idx", "seq", "kind", "text").select("case_id", "idx", "seq", "score")


_EDGES = f"""{_CASES}, ed AS (
  SELECT case_id, idx AS source, idx - 3 AS target FROM li WHERE case_id % 2 = 0 AND e % 5 = 0 AND idx > 2 UNION SELECT case_id, idx, idx // 2 FROM li WHERE case_id % 2 = 0 AND e % 3 = 0)"""


def _edges(spark, d):
    li = _case_lines(spark, d).where("case_id % 2 = 0")
    return li.where("e % 5 = 0 AND idx > 2").selectExpr("case_id", "idx AS source", "idx - 3 AS target").union(li.where("e % 3 = 0").selectExpr("case_id", "idx", "idx div 2")).distinct()


@query(f"""WITH {_EDGES}, hit AS (SELECT st.*, action <> 'application' AND EXISTS (SELECT 1 FROM ed JOIN ca ON ca.case_id = ed.case_id WHERE ed.case_id = st.case_id AND source = st.idx AND target = app[1]) AS h FROM st)
SELECT case_id, idx, action, seq FROM hit t WHERE h OR NOT EXISTS (SELECT 1 FROM hit u WHERE u.case_id = t.case_id AND u.h)""")
def statuses_by_edges(spark, d):
    ca, st, _ = _cases(spark, d)
    chosen = ca.where("app_line IS NOT NULL").select("case_id", F.col("app_line").alias("idx"))
    return statuses.answering(st, _edges(spark, d), chosen, "case_id", "idx").select("case_id", "idx", "action", "seq")


@query(f"""WITH {_EDGES}, tx AS (
  SELECT case_id, idx, CAST(idx + 1 AS VARCHAR) AS no, CASE WHEN event_type = 'click' THEN 'NOTICE of appeal as to ' || idx WHEN e % 4 = 0 THEN 'ORDER on ' || (idx - 1) || ' Notice of  Appeal'
         WHEN e % 4 = 1 THEN 'Letter, see Docket No. ' || (idx - 2) || '.' WHEN e % 4 = 2 THEN 'Fee for notice of appeal (no. ' || (idx - 3) || ')' WHEN idx % 5 = 0 THEN 'Appeal fee ' || idx ELSE 'MOTION ' || idx END AS txt FROM li
), op AS (SELECT case_id, idx, no FROM tx WHERE starts_with(lower(txt), 'notice of appeal'))
SELECT case_id, idx AS start, CAST(CASE WHEN EXISTS (SELECT 1 FROM ed WHERE ed.case_id = op.case_id)
         THEN coalesce((SELECT max(source) FROM ed WHERE ed.case_id = op.case_id AND target = op.idx), (SELECT count(*) FROM tx WHERE tx.case_id = op.case_id))
         ELSE coalesce((SELECT max(tx.idx) FROM tx WHERE tx.case_id = op.case_id AND tx.idx > op.idx AND regexp_matches(regexp_replace(lower(txt), '\\s+', ' ', 'g'),
           '(^|[^0-9])' || op.no || '[.)\\]]? ?notice ?of ?appeal|notice ?of ?appeal ?[(\\[]? ?(no ?\\.?|#)? ?' || op.no || '[.)\\] ]|(dkt|docket) ?(no ?\\.?|#)? ?' || op.no || '[.)\\] ]')), op.idx) END + 1 AS BIGINT) AS "end" FROM op""")
def appeal_windows(spark, d):
    near = lambda before, k, after: F.concat(F.lit(before), (F.col("idx") - k).cast("string"), F.lit(after))
    text = (
        F.when(F.col("event_type") == "click", near("NOTICE of appeal as to ", 0, "")).when(F.expr("e % 4 = 0"), near("ORDER on ", 1, " Notice of  Appeal"))
        .when(F.expr("e % 4 = 1"), near("Letter, see Docket No. ", 2, ".")).when(F.expr("e % 4 = 2"), near("Fee for notice of appeal (no. ", 3, ")")).when(F.expr("idx % 5 = 0"), near("Appeal fee ", 0, "")).otherwise(near("MOTION ", 0, ""))
    )
    li = _case_lines(spark, d).withColumn("txt", text).withColumn("no", F.col("idx") + 1)
    return statuses.appeal_windows(li, _edges(spark, d), "case_id", "idx", "no", "txt")


@query(f"""WITH {LINES}, r AS (SELECT case_id, ts, max(round(value, 6)) AS label FROM lines WHERE event_type = 'signup' GROUP BY 1, 2)
SELECT l.case_id, l.idx, (SELECT arg_max(r.label, r.ts) FROM r WHERE r.case_id = l.case_id AND r.ts <= l.ts) AS label FROM lines l WHERE l.event_type = 'purchase'""")
def asof_label(spark, d):
    all_ = lines(spark, d)
    right = all_.where("event_type = 'signup'").select("case_id", "ts", F.round("value", 6).alias("label"))
    left = all_.where("event_type = 'purchase'").select("case_id", "idx", "ts")
    return dockets.asof(left, right, "case_id", "ts", "label").select("case_id", "idx", "label")


def _alternation(group):
    return "|".join(f"(?:{p})" for p in group).replace("'", "''")


_OUTCOME_SQL = "CASE WHEN t LIKE '%order of service%' THEN 0 " + " ".join(f"WHEN regexp_matches(t, '{_alternation(g)}') THEN {v}" for v, g in P.OUTCOME_GROUPS.items()) + " ELSE 0 END"


@query(f"""WITH {LINES}, u AS (SELECT idx, lower(txt) AS t FROM lines) SELECT idx, CAST({_OUTCOME_SQL} AS INTEGER) AS outcome FROM u""")
def regex_outcome(spark, d):
    return lines(spark, d).select("idx", T.outcome(F.col("txt")).alias("outcome"))


# A third of the cases has only lines that select, but do not admit.
@query(f"""WITH {_SAID_LINES}, v AS (SELECT case_id, idx, CASE WHEN case_id % 3 = 0 THEN s[[8, 9, 11, 15][idx % 4 + 1] + 1] || ' by remand' WHEN idx % 4 = 0 THEN s[10] ELSE txt END AS txt FROM l JOIN t USING (case_id, idx)
), a AS (SELECT DISTINCT case_id FROM v WHERE regexp_matches(lower(txt), 'pauperis|ifp|without prepay|without the pay|without pay|1915'))
SELECT case_id, idx, txt FROM v SEMI JOIN a USING (case_id)
WHERE regexp_matches(lower(txt), 'pauperis|ifp|without prepay|without the pay|without pay|1915|consolidate|transfer|remand|dismiss|no longer pending|reduced filing fee procedure')""")
def phrase_gate(spark, d):
    said = F.array(*[F.lit(x) for x in SAID])
    late = F.concat(F.get(said, F.get(F.array(*[F.lit(x) for x in (8, 9, 11, 15)]), (F.col("idx") % 4).cast("int"))), F.lit(" by remand"))
    text = F.when(F.expr("case_id % 3 = 0"), late).when(F.expr("idx % 4 = 0"), SAID[9]).otherwise(F.col("txt"))
    return dockets.phrase_gate(_said(spark, d).withColumn("txt", text), "case_id", "txt").select("case_id", "idx", "txt")


# --- sealing -----------------------------------------------------------------

# For each flag lines that have it and lines that nearly do; every event is one of them.
SEAL_LINES = [
    "MOTION to Seal Document by Acme Corp", "Motion for leave to file document under seal", "ORDER by J. R. Doe to seal", "order sealing the exhibits", "motions to seal", "MOTION to Unseal Case", "order unsealing the indictment",
    "Unsealing of the affidavit", "motion by Mary Ann to unseal", "ORDER granting 12 Motion to Seal", "granting (7) motion for leave to file exhibit under seal", "granting motion to strike", "granting in part 9 motion to seal",
    "denying 7 motion to seal", "denying as moot motion to seal", "denying without prejudice 33 motion for leave to seal", "denying in part (12) motion to seal", "denying in full motion to seal", "granting 4 motion to unseal",
    "granting in part motion to unseal", "denying without prejudice motion to unseal", "denying in part 8 motion to unseal", "motion granted, in part and denied in part as to the seal", "granting in part and denying in part motion to unseal",
    "Granting / Denying in part motion to seal", "granting/denying in part the request to unseal", "(Sealed) Exhibit A", "Notice (sealed document) filed", "(sealed brief)", "Case unsealed as to John Doe", "(Case unsealed per order) motion granted",
    "SYSTEM ENTRY - Docket Entry 12 restricted", "see system entry", "Sealed Documents received", "if there are sealed documents file them", "sealed brief", "sealed vesrion of the reply", "sealed attachment to 5", "E-Government notice",
    "e government notice", "REDACTION of transcript", "unredacted exhibits filed", "notice of redaction", "Agreed Motion for Protective Order", "Notice of motion by all parties for a hearing and protective order", "Protective order entered",
    "order on protective order", "*Restricted* by court", "order restricted to counsel", "restricted declaration", "filing (restricted)", "unrestricted access", "Stipulated protective order", "stipulation for docket control order",
    "Unopposed sealed motion for entry of an agreed discovery control", "joint motion docket control order", "joint request for discovery control", "motion to unseal is GRANTED", "motion is granted", "motion to unseal denied",
    "request denied", "denied if there are sealed items to unseal", "granted in part and denied in part", "hearing set", "", "Sealed Order granting 3 motion to seal", "redacted image", "motion to seal and motion to unseal",
]
_SEAL_SQL = "seal_lines AS (SELECT event_id AS idx, lower([" + ", ".join("'" + x.replace("'", "''") + "'" for x in SEAL_LINES) + f"][event_id % {len(SEAL_LINES)} + 1]) AS t FROM events)"


def seal_lines(spark, d):
    text = F.get(F.array(*[F.lit(x) for x in SEAL_LINES]), F.col("event_id") % len(SEAL_LINES))
    return table(spark, d, "events").select(F.col("event_id").alias("idx"), text.alias("txt"))


# By hand: no pattern here looks behind, so what must not stand before a word is taken out with it first.
_ART = "(motion|order|document|reply|response|affidavit|attachment|transcript|declaration|image|exhibit|indictment|judgement|vesrion)s?"
_NUM, _TO_SEAL = "([(]?[0-9]{1,4}[)]? )?motion( for leave)? to ", "(seal|file ([a-z0-9_]+ )?under seal)"
_FLAG_SQL = {
    "seal_motion": f"regexp_matches(t, '(motion( for leave)?|order) (by ([^ ]+ ){{1,15}})?(to {_TO_SEAL}|sealing)')",
    "unseal_motion": "contains(t, 'unsealing') OR regexp_matches(t, '(motion( for leave)?|order) (by ([^ ]+ ){1,15})?to unseal')",
    "seal_grant": f"regexp_matches(t, 'granting {_NUM}{_TO_SEAL}')",
    "seal_grant_p": f"regexp_matches(t, 'granting in part {_NUM}{_TO_SEAL}')",
    "seal_deny": f"regexp_matches(t, 'denying (as moot |without prejudice )?{_NUM}{_TO_SEAL}')",
    "seal_deny_p": f"regexp_matches(t, 'denying in part {_NUM}{_TO_SEAL}')",
    "unseal_grant": f"regexp_matches(t, 'granting {_NUM}unseal')",
    "unseal_grant_p": f"regexp_matches(t, 'granting in part {_NUM}unseal')",
    "unseal_deny": f"regexp_matches(t, 'denying (as moot |without prejudice )?{_NUM}unseal')",
    "unseal_deny_p": f"regexp_matches(t, 'denying in part {_NUM}unseal')",
    "part_grant_deny": "regexp_matches(t, 'grant(ed|ing),? in part and den(ied|ying) in part') OR regexp_matches(t, 'granting ?/ ?denying in part')",
    "parenthesis": f"regexp_matches(t, '[(]sealed( {_ART})?[)]')",
    "case_unsealed": "contains(t, 'case unsealed')",
    "system_entry": "starts_with(t, 'system entry')",
    "sealed_article": f"regexp_matches(replace(t, 'if there are sealed', '#'), 'sealed {_ART}')",
    "e_gov": "contains(t, 'e-government')",
    "redacted": f"starts_with(t, 'redaction') OR regexp_matches(t, 'redacted {_ART}')",
    "protective": "starts_with(t, 'protective order') OR regexp_matches(t, '^(agreed |joint )?(motion for )?protective order') OR regexp_matches(t, '^notice of motion.{1,55}(motion for )?protective order')",
    "restricted": f"starts_with(t, 'restrict') OR starts_with(t, '*restrict') OR contains(t, '(restricted)') OR regexp_matches(t, 'restricted {_ART}') OR regexp_matches(t, '{_ART} restricted')",
    "discovery_control": "regexp_matches(t, '(stipulated|stipulation for|(agreed|joint|unopposed)( sealed)? motion .{1,100}) (protective order|discovery control|docket control order)')",
}
_FLAGS = ", ".join(f"{sql} AS {name}" for name, sql in _FLAG_SQL.items())


@query(f"""WITH {_SEAL_SQL} SELECT idx, {_FLAGS} FROM seal_lines""")
def indicator_matrix(spark, d):
    return sealed.matrix(seal_lines(spark, d), "txt", ["idx"]).drop("text")


_TIDY = f"""WITH {_SEAL_SQL}, m AS (SELECT idx, t, contains(t, 'unseal') AS un, contains(replace(t, '(case unseal', '#'), 'unseal') AS says, {_FLAGS} FROM seal_lines), n AS (
  SELECT *, system_entry OR parenthesis AS sealed_without_motion, part_grant_deny AND un AS unseal_grant_deny, part_grant_deny AND NOT un AS seal_grant_deny FROM m
), o AS (SELECT * REPLACE (
  unseal_grant OR (unseal_grant_p AND NOT part_grant_deny) OR (contains(t, 'granted') AND says AND NOT unseal_grant_deny) AS unseal_grant,
  seal_grant OR (seal_grant_p AND NOT part_grant_deny) OR (contains(t, 'granted') AND NOT says AND NOT seal_grant_deny) AS seal_grant,
  unseal_deny OR (unseal_deny_p AND NOT part_grant_deny) OR (contains(t, 'denied') AND says AND NOT unseal_grant_deny AND NOT contains(t, 'if there are sealed')) AS unseal_deny,
  seal_deny OR (seal_deny_p AND NOT part_grant_deny) OR (contains(t, 'denied') AND NOT says AND NOT unseal_grant_deny) AS seal_deny) FROM n
), p AS (SELECT *, seal_grant OR seal_grant_p OR seal_deny OR seal_deny_p OR unseal_grant OR unseal_grant_p OR unseal_deny OR unseal_deny_p OR part_grant_deny OR parenthesis OR case_unsealed OR system_entry OR sealed_article OR e_gov
  OR redacted OR protective OR restricted OR discovery_control AS other FROM o
), q AS (SELECT * REPLACE (seal_motion AND NOT unseal_motion AND NOT other AS seal_motion) FROM p
), r AS (SELECT * REPLACE (unseal_motion AND NOT seal_motion AND NOT other AS unseal_motion) FROM q)"""
_KEPT = "idx, seal_motion, unseal_motion, seal_grant, seal_deny, unseal_grant, unseal_deny, case_unsealed, sealed_article, e_gov, redacted, protective, restricted, discovery_control, sealed_without_motion, unseal_grant_deny, seal_grant_deny"


@query(f"{_TIDY} SELECT {_KEPT} FROM r")
def indicator_tidy(spark, d):
    return sealed.tidy(sealed.matrix(seal_lines(spark, d), "txt", ["idx"])).drop("text")


@query(f"{_TIDY} SELECT idx, sealed_article OR (restricted AND NOT (seal_motion OR unseal_motion OR seal_grant OR unseal_grant OR unseal_deny OR seal_grant_deny OR unseal_grant_deny)) AS sealed_item FROM r")
def sealed_item(spark, d):
    return sealed.tidy(sealed.matrix(seal_lines(spark, d), "txt", ["idx"])).select("idx", sealed.sealed_item().alias("sealed_item"))


@query("""SELECT n_name AS court, count(DISTINCT l_orderkey) AS case_count, count(*) AS docket_lines, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS sealed_article,
  CAST(sum(CASE WHEN l_linestatus = 'F' AND l_quantity > 49 THEN 1 ELSE 0 END) AS BIGINT) AS seal_motion,
  round(sum(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END) / nullif(sum(CASE WHEN l_linestatus = 'F' AND l_quantity > 49 THEN 1.0 ELSE 0 END), 0), 6) AS ratio
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""")
def sealed_quotient(spark, d):
    li, s, n = table(spark, d, "lineitem"), table(spark, d, "supplier"), table(spark, d, "nation")
    rows = li.join(s, li["l_suppkey"] == s["s_suppkey"]).join(n, s["s_nationkey"] == n["n_nationkey"]).select(
        F.col("n_name").alias("court"), F.col("l_orderkey").alias("ucid"), (F.col("l_returnflag") == "R").alias("article"), ((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 49)).alias("motion")
    )
    return rounded(sealed.quotients(rows, "court", "ucid", "article", "motion"), "ratio")


@query("""SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(max(l_shipdate) AS DATE)) AS INTEGER) AS days FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate""")
def case_duration(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("start"), F.lit(None).cast("timestamp").alias("end"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    return dockets.durations(o, li, "o_orderkey", "start", "end", "l_shipdate")


@query(f"""WITH {LINES}, f AS (SELECT *, min(CASE WHEN event_type = 'error' THEN idx END) OVER (PARTITION BY case_id) AS first FROM lines)
SELECT case_id, idx, CASE WHEN first IS NULL THEN 'none' WHEN idx < first THEN 'before' WHEN idx = first THEN 'protective' ELSE 'after' END AS timeframe FROM f""")
def protective_timeframe(spark, d):
    flagged = lines(spark, d).withColumn("flag", F.col("event_type") == "error")
    return sealed.timeframe(flagged, "case_id", "idx", "flag").select("case_id", "idx", "timeframe")


# --- names and entities ------------------------------------------------------

_PREFIXES = ["Bankruptcy Judge ", "signed by U.S. District Judge ", "MAGISTRATE JUDGE ", "Hon. ", "filed by ", "Circuit Judge "]
_PREFIX_SQL = "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PREFIXES)) + " END || p_name"
_CATEGORY_SQL = """CASE WHEN lower(t) LIKE 'bankruptcy judge %' THEN 'Bankruptcy_Judge' WHEN lower(t) LIKE 'circuit judge %' THEN 'Circuit_Appeals' WHEN lower(t) LIKE '% district judge %' THEN 'District_Judge'
  WHEN lower(t) LIKE 'magistrate judge %' THEN 'Magistrate_Judge' WHEN lower(t) LIKE 'hon. %' THEN 'Nondescript_Judge' ELSE 'No_Keywords' END"""
MENTIONS = f"mentions AS (SELECT p_partkey AS case_id, p_name AS name, p_brand AS court, {_PREFIX_SQL} AS t FROM part), tagged AS (SELECT *, {_CATEGORY_SQL} AS category FROM mentions)"


def mentions(spark, d):
    prefix = F.element_at(F.array(*[F.lit(p) for p in _PREFIXES]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("case_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("court"), F.concat(prefix, "p_name").alias("t")).withColumn(
        "category", keywords.category(F.col("t"))
    )


@query()
def name_clean(spark, d):
    """Its steps look ahead and behind, which the SQL has not: tested on names worked out by hand."""
    return mentions(spark, d).select("case_id", T.clean_name(F.col("t")).alias("clean"))


@query(f"""WITH {MENTIONS}, a AS (SELECT name, court, count(DISTINCT case_id) AS n_entries FROM tagged WHERE case_id % 3 <> 1 GROUP BY 1, 2), b AS (SELECT name, court, count(DISTINCT case_id) AS n_headers FROM tagged WHERE case_id % 3 = 1 GROUP BY 1, 2)
SELECT coalesce(a.name, b.name) AS name, coalesce(a.court, b.court) AS court, coalesce(n_entries, 0) AS n_entries, coalesce(n_headers, 0) AS n_headers FROM a FULL JOIN b ON a.name = b.name AND a.court = b.court""")
def ucid_counts_full_outer(spark, d):
    m = mentions(spark, d)
    return relational.counts_full_outer(m.where("case_id % 3 <> 1"), m.where("case_id % 3 = 1"), ["name", "court"], "case_id")


CATEGORIES = [*KEYWORDS, "No_Keywords"]
_PIVOT = ", ".join(f"count(DISTINCT CASE WHEN category = '{c}' THEN case_id END) AS {c}" for c in CATEGORIES)


@query(f"WITH {MENTIONS} SELECT name, {_PIVOT} FROM tagged GROUP BY name")
def category_pivot(spark, d):
    return relational.category_pivot(mentions(spark, d), "name", "category", "case_id", CATEGORIES)


_LADDER = f"""WITH k AS (
  SELECT 'e' || p_size AS entity, p_partkey AS case_id, p_partkey % 4 = 0 AND p_size % 3 = 0 AS headed, (p_size * p_size + p_partkey % (1 + p_size % 5) + p_partkey % 2) % 7 AS pos, {CATEGORIES}[pos + 1] AS category FROM part
), s AS (
  SELECT *, 100.0 * n / sum(n) OVER (PARTITION BY entity) AS share FROM (SELECT entity, category, pos, count(DISTINCT case_id) AS n FROM k GROUP BY ALL)
), w AS (
  SELECT entity, list(category ORDER BY share DESC, pos)[1] AS top, list(category ORDER BY share DESC, pos) FILTER (category <> 'Nondescript_Judge') AS others, list(share ORDER BY share DESC, pos) FILTER (category <> 'Nondescript_Judge') AS other_shares,
    max(CASE category WHEN 'Magistrate_Judge' THEN share ELSE 0 END) AS m, max(CASE category WHEN 'District_Judge' THEN share ELSE 0 END) AS d, max(CASE category WHEN 'Bankruptcy_Judge' THEN share ELSE 0 END) AS b,
    max(CASE category WHEN 'Circuit_Appeals' THEN share ELSE 0 END) AS c, max(CASE category WHEN 'No_Keywords' THEN share ELSE 0 END) AS nk, max(CASE category WHEN 'Judicial_Actor' THEN share ELSE 0 END) AS ja, max(share) AS most FROM s GROUP BY entity
), t AS (SELECT entity, count(DISTINCT case_id) AS total, count(DISTINCT CASE WHEN headed THEN case_id END) AS head FROM k GROUP BY entity)
SELECT entity, total, head, CASE
  WHEN total <= 3 AND head = 0 THEN 'deny - low occurence' WHEN nk = 100 THEN 'deny - Junk' WHEN most = 100 THEN top
  WHEN d + b + c = 0 THEN 'Magistrate_Judge' WHEN m + b + c = 0 AND total > 3 THEN 'District_Judge' WHEN m + d + c = 0 THEN 'Bankruptcy_Judge'
  WHEN m >= 50 THEN 'Magistrate_Judge' WHEN d >= 50 AND total > 3 THEN 'District_Judge' WHEN b >= 50 THEN 'Bankruptcy_Judge'
  WHEN m >= 25 AND d < 25 AND b < 25 THEN 'Magistrate_Judge' WHEN d >= 25 AND m < 25 AND b < 25 AND total > 3 THEN 'District_Judge' WHEN b >= 25 AND m < 25 AND d < 25 THEN 'Bankruptcy_Judge'
  WHEN d > 5 AND head > 0 THEN 'District_Judge**' WHEN m > 5 AND head > 0 THEN 'Magistrate_Judge' WHEN b > 5 AND head > 0 THEN 'Bankruptcy_Judge**'
  WHEN total >= 25 AND top = 'Nondescript_Judge' AND other_shares[1] > 10 THEN others[1] WHEN total >= 25 AND top = 'Nondescript_Judge' THEN 'Nondescript_Judge'
  WHEN top = 'No_Keywords' AND nk >= 90 THEN '--- deny --- insufficient data' WHEN nk + ja > 60 THEN '--- deny --- clerk or attorney' ELSE 'Nondescript_Judge' END AS label
FROM w JOIN t USING (entity)"""


@query(_LADDER)
def label_ladder(spark, d):
    pos = F.expr("cast((p_size * p_size + p_partkey % (1 + p_size % 5) + p_partkey % 2) % 7 as int)")
    m = table(spark, d, "part").select(
        F.concat(F.lit("e"), "p_size").alias("entity"), F.col("p_partkey").alias("case_id"), F.expr("p_partkey % 4 = 0 AND p_size % 3 = 0").alias("headed"),
        F.get(F.array(*[F.lit(c) for c in CATEGORIES]), pos).alias("category"),
    )
    pivot = relational.category_pivot(m, "entity", "category", "case_id", CATEGORIES)
    totals = m.groupBy("entity").agg(F.countDistinct("case_id").alias("total"), F.countDistinct(F.when(F.col("headed"), F.col("case_id"))).alias("head"))
    return relational.label_ladder(pivot.join(totals, "entity"), "total", "head", CATEGORIES).select("entity", "total", "head", "label")


@query(f"""WITH {MENTIONS} SELECT case_id, name, court FROM tagged SEMI JOIN (SELECT name, court FROM tagged GROUP BY 1, 2 HAVING count(DISTINCT case_id) > 2) AS x USING (name, court)""")
def frequency_ignore(spark, d):
    return relational.frequent(mentions(spark, d), ["name", "court"], "case_id", 2).select("case_id", "name", "court")


@query(f"""WITH {MENTIONS}, p AS (SELECT DISTINCT court AS pc, name AS pn FROM tagged WHERE case_id % 5 = 0) SELECT case_id, name, court FROM tagged WHERE NOT EXISTS (SELECT 1 FROM p WHERE pc = court AND pn = name)""")
def party_anti_join(spark, d):
    m = mentions(spark, d)
    parties = m.where("case_id % 5 = 0").select("court", F.col("name").alias("party"))
    return resolve.drop_parties(m, parties, "court", "name", "party", least=100).select("case_id", "name", "court")


_WORDS = "words AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS n FROM part UNION SELECT DISTINCT p_name FROM part)"


@query(f"""WITH {_WORDS} SELECT a.n AS name, CASE WHEN count(b.n) = 1 THEN min(b.n) ELSE a.n END AS resolved FROM words a LEFT JOIN words b ON length(b.n) > length(a.n) AND contains(b.n, a.n) GROUP BY a.n""")
def substring_unique_match(spark, d):
    part = table(spark, d, "part")
    names = part.select(F.explode(F.split("p_name", " ")).alias("name")).union(part.select("p_name"))
    return relational.unique_container(names, "name")


def _name_nodes(spark, d):
    return resolve.ordered(table(spark, d, "part").select(F.lit("all").alias("scope"), F.col("p_name").alias("name")).distinct(), "scope", "name")


@query("""WITH n AS (SELECT DISTINCT regexp_replace(p_name, '^(\\w)\\w* ', '\\1 ') AS name FROM part UNION SELECT p_name FROM part UNION SELECT regexp_extract(p_name, '\\w+$') FROM part WHERE p_partkey % 5 = 0 UNION SELECT regexp_extract(p_name, '^\\w+') FROM part WHERE p_partkey % 7 = 0
), o AS (SELECT name, row_number() OVER (ORDER BY length(name) DESC, name) AS ord, list_filter(regexp_split_to_array(lower(name), '[\\s.]+'), lambda w: w <> '') AS w FROM n
), p AS (SELECT a.ord AS a_ord, b.ord AS b_ord, CASE WHEN len(a.w) <= len(b.w) THEN a.w ELSE b.w END AS s, CASE WHEN len(a.w) <= len(b.w) THEN b.w ELSE a.w END AS l FROM o a JOIN o b ON a.ord < b.ord
), g AS (
  SELECT *, CAST(list_reduce(l, lambda k, t: CASE WHEN CAST(k AS INTEGER) < len(s) AND (s[CAST(k AS INTEGER) + 1] = t OR (length(s[CAST(k AS INTEGER) + 1]) = 1 AND starts_with(t, s[CAST(k AS INTEGER) + 1]))
    OR (length(t) = 1 AND starts_with(s[CAST(k AS INTEGER) + 1], t))) THEN CAST(CAST(k AS INTEGER) + 1 AS VARCHAR) ELSE k END, '0') AS INTEGER) AS used FROM p)
SELECT 'all' AS scope, 2 AS rule, CAST(a_ord AS INTEGER) AS a_ord, CAST(b_ord AS INTEGER) AS b_ord FROM g WHERE CASE WHEN len(s) = 1 AND len(l) > 1 THEN s[1] = l[len(l)] ELSE used = len(s) END""")
def token_subset_pairs(spark, d):
    part = table(spark, d, "part")
    short, last, first = F.regexp_replace("p_name", r"^(\w)\w* ", "$1 "), F.regexp_extract("p_name", r"\w+$", 0), F.regexp_extract("p_name", r"^\w+", 0)
    names = part.select(short.alias("name")).union(part.select("p_name")).union(part.where("p_partkey % 5 = 0").select(last)).union(part.where("p_partkey % 7 = 0").select(first)).distinct()
    nodes = resolve.ordered(names.select(F.lit("all").alias("scope"), "name"), "scope", "name")
    return resolve.token_edges(resolve.subset_pairs(nodes, "scope", "name"), "scope")


@query()
def fuzzy_pairs(spark, d):
    return resolve.fuzzy_edges(resolve.blocked_pairs(_name_nodes(spark, d), "scope", "name", least=75), "scope", "ratio", 75)


def _surname_nodes(spark, d):
    """Words of a part's name by size as scope: two-word names, some with a letter before them, and lone last words."""
    w = F.split("p_name", " ")
    part = table(spark, d, "part").select(F.col("p_size").alias("scope"), F.element_at(w, 1).alias("x"), F.element_at(w, 2).alias("y"), "p_partkey")
    long = part.select("scope", F.concat_ws(" ", F.when(F.expr("p_partkey % 2 = 0"), F.substring("x", 1, 1)).otherwise(F.col("x")), F.col("y")).alias("name"))
    return long.union(part.where("p_partkey % 3 = 0").select("scope", F.concat(F.col("x"), F.lit("s")))).union(part.where("p_partkey % 3 = 1").select("scope", "y")).distinct()


@query()
def anchor_edges(spark, d):
    pairs = anchors.anchor_pairs(resolve.ordered(_surname_nodes(spark, d), "scope", "name"), "scope", "name")
    return reduce(DataFrame.unionByName, [rule(pairs, "scope") for rule in anchors.CASE_RULES])


@query()
def first_letter_edges(spark, d):
    return anchors.first_letter_edges(anchors.anchor_pairs(resolve.ordered(_surname_nodes(spark, d), "scope", "name"), "scope", "name"), "scope")


@query("""WITH p AS (SELECT p_size AS scope, string_split(p_name, ' ')[1] AS x, string_split(p_name, ' ')[2] AS y, p_partkey FROM part), n AS (
  SELECT DISTINCT scope, CASE WHEN p_partkey % 2 = 0 THEN x[1] ELSE x END || ' ' || y AS l, y FROM p
), s AS (SELECT scope, x || 's' AS w FROM p WHERE p_partkey % 3 = 0 UNION SELECT scope, y FROM p WHERE p_partkey % 3 = 1
), m AS (SELECT s.scope, w, l FROM s JOIN n ON n.scope = s.scope AND (w = y OR w = y || 's' OR y = w || 's' OR (length(w) > 5 AND list_sort(string_split(w, '')) = list_sort(string_split(y, '')))))
SELECT scope, w AS name, CASE WHEN count(DISTINCT l) = 1 THEN max(l) END AS points_to, count(DISTINCT l) > 1 AS is_ambiguous FROM m GROUP BY 1, 2""")
def surname_crossover(spark, d):
    return anchors.crossover(_surname_nodes(spark, d), "scope", "name")


@query("""WITH n AS (SELECT p_partkey AS k, string_split(p_name, ' ')[1] AS name, CASE WHEN p_size % 10 = 0 THEN p_brand END AS id FROM part)
SELECT name, CASE WHEN count(DISTINCT id) <= 1 THEN coalesce(min(k) FILTER (id IS NOT NULL), min(k)) END AS points_to, count(DISTINCT id) > 1 AS is_ambiguous FROM n GROUP BY name HAVING count(*) > 1""")
def same_name(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.element_at(F.split("p_name", " "), 1).alias("name"), F.when(F.expr("p_size % 10 = 0"), F.col("p_brand")).alias("id"))
    return anchors.same_name(nodes, "name", "id", "k")


@query()
def resolve_within_group(spark, d):
    return resolve.resolve(mentions(spark, d), "court", "name", "case_id")


@query()
def resolve_all_rules(spark, d):
    return resolve.resolve(mentions(spark, d).withColumn("name", F.regexp_replace("name", r"^(\w)\w* ", "$1 ")), "court", "name", "case_id", rules="all")


@query(f"""WITH {LINES}, h AS (SELECT DISTINCT case_id AS sjid, ts AS start, CASE WHEN event_id % 2 = 0 THEN 'Article III' ELSE 'Bankruptcy-Magistrate' END AS source FROM (SELECT case_id, ts, idx AS event_id FROM lines WHERE event_type = 'signup'))
SELECT l.case_id AS sjid, l.idx, CASE arg_max(h.source, (h.start, h.source)) WHEN 'Article III' THEN 'District Judge' WHEN 'Bankruptcy-Magistrate' THEN 'Magistrate Judge' ELSE 'some label' END AS label_at_date
FROM lines l LEFT JOIN h ON h.sjid = l.case_id AND h.start <= l.ts WHERE l.event_type = 'purchase' GROUP BY l.case_id, l.idx""")
def back_annotation(spark, d):
    all_ = lines(spark, d)
    held = all_.where("event_type = 'signup'").select(F.col("case_id").alias("sjid"), F.col("ts").alias("start"), F.when(F.col("idx") % 2 == 0, "Article III").otherwise("Bankruptcy-Magistrate").alias("source"), F.lit("U.S. District Court").alias("court_type"))
    m = all_.where("event_type = 'purchase'").select(F.col("case_id").alias("sjid"), "idx", F.col("ts").alias("date"))
    own = all_.select(F.col("case_id").alias("sjid"), F.lit("some_label").alias("label")).distinct()
    return ground_truth.back_annotate(m, held, own).select("sjid", "idx", "label_at_date")


@query(f"""WITH {LINES} SELECT case_id, bool_or((contains(txt, 'assigned') AND contains(txt, 'in error')) OR contains(txt, 'clerical error') OR contains(txt, 'shall not be used for any other proceeding')) AS wrong
FROM (SELECT case_id, CASE WHEN idx % 97 = 0 THEN txt || ' assigned in error' ELSE txt END AS txt FROM lines) GROUP BY case_id""")
def wrong_assignment(spark, d):
    marked = lines(spark, d).withColumn("txt", F.when(F.col("idx") % 97 == 0, F.concat("txt", F.lit(" assigned in error"))).otherwise(F.col("txt")))
    return dockets.wrong_assignment(marked, "case_id", "txt")


@query()
def tag_new_cases(spark, d):
    m = mentions(spark, d)
    known = relational.assign_ids(m.where("case_id % 2 = 0").select("name").distinct(), ["name"])
    new = m.where("case_id % 2 = 1").select("case_id", F.regexp_replace("name", r"^(\w)\w* ", "$1 ").alias("name"))
    return resolve.tag(new, known, "name", "name", "sjid")


@query("""SELECT name, 'SJ' || lpad(CAST(row_number() OVER (ORDER BY name) - 1 + 100 AS VARCHAR), 6, '0') AS sjid FROM (SELECT DISTINCT p_name AS name FROM part)""")
def sjid_assign(spark, d):
    return relational.assign_ids(table(spark, d, "part").select(F.col("p_name").alias("name")).distinct(), ["name"], start=100)


@query("""WITH o AS (SELECT name, 'SJ' || lpad(CAST(row_number() OVER (ORDER BY name) - 1 AS VARCHAR), 6, '0') AS sjid FROM (SELECT DISTINCT p_name AS name FROM part WHERE p_size <= 2)), m AS (SELECT count(*) AS n FROM o)
SELECT * FROM o UNION ALL SELECT name, 'SJ' || lpad(CAST(m.n + row_number() OVER (ORDER BY name) - 1 AS VARCHAR), 6, '0') FROM (SELECT DISTINCT p_name AS name FROM part WHERE p_name NOT IN (SELECT name FROM o)), m""")
def sjid_continue(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("name"), "p_size")
    old = relational.assign_ids(names.where("p_size <= 2").select("name").distinct(), ["name"])
    return relational.continue_ids(old, names, "name")


@query("""WITH n AS (SELECT c_custkey AS k, c_nationkey AS j, 'new' AS label FROM customer WHERE c_custkey % 3 = 0)
SELECT c_custkey, c_nationkey, coalesce(n.label, c_mktsegment) AS label FROM customer LEFT JOIN n ON c_custkey IS NOT DISTINCT FROM k AND c_nationkey IS NOT DISTINCT FROM j""")
def upsert_by_key(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("label"))
    new = old.where("c_custkey % 3 = 0").select("c_custkey", "c_nationkey", F.lit("new").alias("label"))
    return relational.upsert(old, new, ["c_custkey", "c_nationkey"], ["label"])


@query("""SELECT p_partkey, 1 AS number, p_brand AS title, p_type AS place FROM part UNION ALL SELECT p_partkey, 2, CASE WHEN p_size > 25 THEN p_name END, CASE WHEN p_size > 25 THEN p_brand END FROM part WHERE p_size > 25""")
def appointments_unpivot(spark, d):
    wide = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("t1"), F.col("p_type").alias("l1"), F.when(F.col("p_size") > 25, F.col("p_name")).alias("t2"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("l2"))
    return relational.unpivot_appointments(wide, ["p_partkey"], {1: ["t1", "l1"], 2: ["t2", "l2"]}, ["title", "place"])


_RANKS = " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(P.LABEL_RANK))


@query(f"""WITH {MENTIONS}, p AS (SELECT a.case_id, a.category AS old, b.category AS new FROM tagged a LEFT JOIN tagged b ON b.case_id = a.case_id + 1)
SELECT case_id, CASE WHEN new IS NULL OR (CASE old {_RANKS} ELSE 8 END) <= (CASE new {_RANKS} ELSE 8 END) THEN old ELSE new END AS label FROM p""")
def rank_order_label(spark, d):
    m = mentions(spark, d).select("case_id", F.col("category").alias("old"))
    n = m.select((F.col("case_id") - 1).alias("k"), F.col("old").alias("new"))
    return m.join(n, F.col("case_id") == F.col("k"), "left").select("case_id", relational.better_label("old", "new").alias("label"))


# --- relational basics -------------------------------------------------------


@query("""WITH t AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1) SELECT c_custkey FROM customer LEFT JOIN t ON c_custkey = o_custkey WHERE last IS NULL OR last >= TIMESTAMP '2000-01-01'""")
def active_filter(spark, d):
    last = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    return table(spark, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").where("last IS NULL OR last >= TIMESTAMP '2000-01-01'").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def semi_isin(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer").where("c_acctbal < 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_notin(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_name AS name, 'customer' AS kind FROM customer UNION ALL SELECT s_name, 'supplier' FROM supplier")
def union_all(spark, d):
    return table(spark, d, "customer").select(F.col("c_name").alias("name"), F.lit("customer").alias("kind")).unionByName(table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.lit("supplier").alias("kind")))


@query("SELECT DISTINCT l_returnflag, l_linestatus, CAST(year(l_shipdate) AS INTEGER) AS yr FROM lineitem")
def distinct_rows(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.year("l_shipdate").alias("yr")).distinct()


@query("""SELECT event_id, e.user_id AS "user", coalesce(label, 'Inconclusive') AS label
FROM events e LEFT JOIN (SELECT user_id, arg_min(event_type, event_id) AS label FROM events WHERE event_id IS NOT NULL GROUP BY user_id) k ON e.user_id = k.user_id""")
def events_tag_stream(spark, d):
    """The events as a stream, tagged with their user's first type, until all are read."""
    from uuid import uuid4

    from ..streaming.tagging import run_once, tagged_stream

    events = table(spark, d, "events")
    known = events.groupBy(F.col("user_id").alias("user")).agg(F.min_by("event_type", "event_id").alias("label"))
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    out = tagged_stream(stream.select("event_id", F.col("user_id").alias("user")), known, "user", "label")
    path = f"{shared_folder(spark)}/stream-{uuid4().hex}"
    run_once(out, f"{path}/rows", f"{path}/state")
    return spark.read.schema(out.schema).parquet(f"{path}/rows")


# --- cases and mentions ------------------------------------------------------

_FILES = """files AS (SELECT 'mdd;;1:' || lpad(CAST(o_orderkey % 30 AS VARCHAR), 2, '0') || '-cv-' || o_orderkey AS ucid, CAST(year(o_orderdate) AS INTEGER) AS year, CASE o_orderkey % 4 WHEN 0 THEN 'txed' WHEN 1 THEN 'cand' WHEN 2 THEN 'alnd' ELSE 'nysd' END AS court,
  CASE o_orderpriority WHEN '1-URGENT' THEN '830: patent' WHEN '2-HIGH' THEN '83' WHEN '3-MEDIUM' THEN NULL ELSE '440' END AS nature_suit, CASE WHEN o_orderkey % 5 = 0 THEN 'cr' ELSE 'cv' END AS case_type,
  CASE o_orderkey % 7 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS is_multi, CASE o_orderstatus WHEN 'O' THEN 'open' ELSE 'closed' END AS status, CAST(o_orderdate AS DATE) AS filing_date FROM orders)"""


def files(spark, d):
    return table(spark, d, "orders").selectExpr(
        "concat('mdd;;1:', lpad(cast(o_orderkey % 30 as string), 2, '0'), '-cv-', o_orderkey) AS ucid", "year(o_orderdate) AS year", "CASE o_orderkey % 4 WHEN 0 THEN 'txed' WHEN 1 THEN 'cand' WHEN 2 THEN 'alnd' ELSE 'nysd' END AS court",
        "CASE o_orderpriority WHEN '1-URGENT' THEN '830: patent' WHEN '2-HIGH' THEN '83' WHEN '3-MEDIUM' THEN NULL ELSE '440' END AS nature_suit", "CASE WHEN o_orderkey % 5 = 0 THEN 'cr' ELSE 'cv' END AS case_type",
        "CASE o_orderkey % 7 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS is_multi", "CASE o_orderstatus WHEN 'O' THEN 'open' ELSE 'closed' END AS status", "cast(o_orderdate AS date) AS filing_date",
    )


@query(f"WITH {_FILES} SELECT ucid, court, year, nature_suit FROM files WHERE year = 1996 AND court = 'txed' AND nature_suit LIKE '83%'")
def case_filters(spark, d):
    return cases.select_cases(files(spark, d), year=1996, court="txed", nos="83").select("ucid", "court", "year", "nature_suit")


@query(f"WITH {_FILES} SELECT ucid, CASE WHEN case_type = 'cr' THEN 'criminal' ELSE nature_suit END AS nature_suit FROM files WHERE is_multi IS NOT TRUE")
def single_criminal_cases(spark, d):
    return cases.single_cases(files(spark, d)).select("ucid", "nature_suit")


@query(f"WITH {_FILES} SELECT ucid, 'sel/' || court || '/' || ucid[8:9] || '/' || replace(replace(ucid, ';;', '-'), ':', '-') || '.jsonl' AS path, 'sel/' || court || '/' || ucid[8:9] || '/_updates/' || replace(replace(ucid, ';;', '-'), ':', '-') || '_U.jsonl' AS update_path FROM files")
def case_paths(spark, d):
    return files(spark, d).select("ucid", mention_ops.case_path("sel", F.col("ucid"), F.col("court")).alias("path"), mention_ops.case_path("sel", F.col("ucid"), F.col("court"), update=True).alias("update_path"))


_DATED = f"""dated AS (SELECT event_id, user_id AS case_id, CASE WHEN event_id % 11 <> 0 THEN CAST(ts AS DATE) END AS date_filed, DATE '2024-01-03' AS filing_date, [{", ".join("'" + x.replace("'", "''") + "'" for x in SEAL_LINES)}][event_id % {len(SEAL_LINES)} + 1] AS t FROM events),
  long_lines AS (SELECT *, CASE WHEN event_id % 13 = 0 THEN repeat('docket text ', 30) || t || repeat(' more', 40) ELSE t || repeat(' of the parties', 30) END AS text FROM dated)"""


def _long_lines(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", "user_id AS case_id", "CASE WHEN event_id % 11 <> 0 THEN cast(ts AS date) END AS date_filed", "DATE '2024-01-03' AS filing_date")
    t = F.get(F.array(*[F.lit(x) for x in SEAL_LINES]), F.col("event_id") % len(SEAL_LINES))
    return e.withColumn("text", F.when(F.col("event_id") % 13 == 0, F.concat(F.repeat(F.lit("docket text "), 30), t, F.repeat(F.lit(" more"), 40))).otherwise(F.concat(t, F.repeat(F.lit(" of the parties"), 30))))


@query(f"""WITH {_DATED}, s AS (SELECT *, lower(text[1:200]) AS b, date_diff('day', filing_date, date_filed) AS days FROM long_lines)
SELECT event_id, text[1:400] AS text, CAST(days AS INTEGER) AS days_from_filing, regexp_matches(b, 'granting {_NUM}{_TO_SEAL}') AS seal_grant, contains(b, 'e-government') AS e_gov FROM s
WHERE (days IS NULL OR days >= 0) AND (contains(b, 'seal') OR contains(b, 'restrict') OR contains(b, 'redact') OR contains(b, 'protective'))""")
def sealing_docket_lines(spark, d):
    return cases.sealing_lines(_long_lines(spark, d)).select("event_id", "text", "days_from_filing", "seal_grant", "e_gov")


@query(f"{_TIDY} SELECT idx FROM r WHERE sealed_article OR restricted OR redacted OR protective OR seal_motion")
def lines_with_flags(spark, d):
    tidy = sealed.tidy(sealed.matrix(seal_lines(spark, d), "txt", ["idx"]))
    return cases.with_any_flag(tidy, ["sealed_article", "restricted", "redacted", "protective", "seal_motion"]).select("idx")


@query(f"""WITH {LINES}, t AS (SELECT case_id, idx, lower(CASE WHEN idx % 3 = 0 THEN 'Order of Service: ' || txt ELSE txt END) AS t FROM lines), f AS (SELECT case_id, min(idx) AS i FROM t WHERE contains(t, 'forma pauperis') AND NOT contains(t, 'order of service') GROUP BY 1)
SELECT case_id, coalesce(i, 9999) AS first_line, CASE WHEN i IS NULL THEN 0 ELSE 1 END AS is_found FROM (SELECT DISTINCT case_id FROM t) LEFT JOIN f USING (case_id)""")
def first_phrase_line(spark, d):
    marked = lines(spark, d).withColumn("txt", F.when(F.col("idx") % 3 == 0, F.concat(F.lit("Order of Service: "), "txt")).otherwise(F.col("txt")))
    return cases.first_phrase_line(marked, "case_id", "idx", "txt")


@query(f"""WITH {DECISIONS} SELECT judge, count(*) AS total_cases, count(*) FILTER (outcome <> 0) AS total_decisions, round(sum(g) / nullif(count(*) FILTER (outcome <> 0), 0), 6) AS decision_average FROM decisions GROUP BY judge""")
def decided_totals(spark, d):
    return rounded(cases.decided_share(decisions(spark, d), ["judge"], "outcome"), "decision_average")


@query(f"""WITH {LINES} SELECT idx, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 WHEN 'view' THEN 0 END AS resolution FROM lines""")
def resolution_map(spark, d):
    action = F.when(F.col("event_type") == "purchase", "grant").when(F.col("event_type") == "error", "deny").when(F.col("event_type") == "view", "none").otherwise("other")
    return lines(spark, d).select("idx", cases.resolution(action).alias("resolution"))


_ODD_NAMES = ["Smith", "x", "Jr", " sr ", "Doe, John Lee", "Doe, Jr.", "Ann Lee Judge Park", "Bo Kim - MagJud Ho", "", "Mary Ann Ross, III", "Ann B. Hon. Poe", "McD", "Ann Hon. Poe"]
_PRE = ["before Judges ", "by Judge ", "signed", None]


def _odd_mentions(spark, d):
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.get(F.array(*[F.lit(x) for x in [*_ODD_NAMES, None]]), F.col("p_partkey") % 14).alias("entity"), F.get(F.array(*[F.lit(x) for x in _PRE]), F.col("p_partkey") % 4).alias("pre")
    )


_ODD_SQL = "odd AS (SELECT p_partkey AS id, [" + ", ".join(f"'{x}'" for x in _ODD_NAMES) + ", NULL][p_partkey % 14 + 1] AS entity, ['before Judges ', 'by Judge ', 'signed', NULL][p_partkey % 4 + 1] AS pre FROM part)"


@query(f"""WITH {_ODD_SQL}, f AS (SELECT *, coalesce(contains(lower(pre), 'judges') AND entity = 'Doe, John Lee', false) AS listed FROM odd)
SELECT id, NOT ((entity IS NULL AND NOT listed) OR coalesce(entity IN ('x', '', 'Jr', ' sr '), false)) AS eligible, listed OR coalesce(entity IN ('Ann Lee Judge Park', 'Bo Kim - MagJud Ho', 'Ann B. Hon. Poe'), false) AS is_exception FROM f""")
def mention_eligibility(spark, d):
    return mention_ops.eligibility(_odd_mentions(spark, d), "entity", "pre").select("id", "eligible", "is_exception")


@query(f"""WITH {_ODD_SQL} SELECT id, coalesce(length(entity) < 4 AND regexp_matches(lower(entity), '^[^aeiouy]+$') AND regexp_matches(lower(entity), '^[a-z]+$'), false) AS short_consonants,
  CASE entity WHEN 'Doe, Jr.' THEN true ELSE NOT contains(trim(entity), ' ') AND entity <> '' END AS is_single FROM odd WHERE entity IS NOT NULL""")
def name_kinds(spark, d):
    named = mention_ops.with_words(_odd_mentions(spark, d).where("entity IS NOT NULL"), "entity")
    return named.select("id", mention_ops.is_short_consonants(F.col("entity")).alias("short_consonants"), "is_single")


@query(f"WITH {_ODD_SQL} SELECT id, entity FROM odd WHERE entity IN ('Doe, John Lee', 'Doe, Jr.', 'Ann Lee Judge Park', 'Bo Kim - MagJud Ho', 'Mary Ann Ross, III', 'Ann B. Hon. Poe', 'Ann Hon. Poe') AND id % 3 <> 0 AND id % 5 <> 0")
def free_match_candidates(spark, d):
    nodes = _odd_mentions(spark, d).where("entity IS NOT NULL").withColumns({"ok": F.col("id") % 3 != 0, "twice": F.col("id") % 5 == 0})
    return mention_ops.free_candidates(nodes, "entity", "ok", "twice").select("id", "entity")


@query(f"""WITH {MENTIONS}, k AS (SELECT CASE WHEN case_id % 2 = 0 THEN string_split(name, ' ')[1] ELSE name END AS entity, court, case_id, category FROM tagged)
SELECT entity, court, count(DISTINCT case_id) AS n_ucids, count(*) FILTER (category <> 'No_Keywords') AS titled, count(DISTINCT case_id) <= 3 AND NOT contains(entity, ' ') AND count(*) FILTER (category <> 'No_Keywords') = 0 AS ignore FROM k GROUP BY entity, court""")
def court_layer_ignore(spark, d):
    m = mentions(spark, d).withColumn("entity", F.when(F.col("case_id") % 2 == 0, F.split("name", " ")[0]).otherwise(F.col("name")))
    return mention_ops.court_ignored(m, "entity", "court", "case_id", "category")


@query(f"""WITH {MENTIONS} SELECT case_id, name, court, EXISTS (SELECT 1 FROM tagged h WHERE h.category = 'District_Judge' AND h.name = t.name AND h.court = t.court) AS was_header FROM tagged t""")
def header_flag(spark, d):
    m = mentions(spark, d)
    return mention_ops.with_header_flag(m, m.where("category = 'District_Judge'"), ["name", "court"]).select("case_id", "name", "court", "was_header")


@query("""SELECT p_partkey AS case_id, p_name AS name, CASE WHEN p_size > 40 THEN upper(p_name) ELSE p_name END AS points_to FROM part WHERE NOT (p_size BETWEEN 30 AND 35)""")
def remap_without_parties(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("case_id"), F.col("p_name").alias("name"), "p_size")
    remap = part.where("p_size > 40 OR p_size BETWEEN 30 AND 35").select("case_id", "name", F.when(F.col("p_size") > 40, F.upper("name")).alias("points_to"), F.col("p_size").between(30, 35).alias("is_party"))
    return mention_ops.repointed(part, remap, ["case_id", "name"], "name").select("case_id", "name", "points_to")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_returnflag = 'A' THEN upper(l_linestatus) || '!' ELSE l_linestatus END AS entity, CASE WHEN l_returnflag IN ('A', 'R') THEN -l_suppkey ELSE l_suppkey END AS span FROM lineitem""")
def mention_overwrite(spark, d):
    old = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.col("l_linestatus").alias("entity"), F.col("l_suppkey").alias("span"), "l_returnflag")
    new = old.where("l_returnflag IN ('A', 'R')").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.when(F.col("l_returnflag") == "A", F.concat(F.upper("entity"), F.lit("!"))).alias("entity"), (-F.col("span")).alias("span"))
    return mention_ops.overwritten(old, new, ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], ["entity", "span"]).select("l_orderkey", "l_linenumber", "entity", "span")


@query("""SELECT k AS sjid, CAST(sum(h) AS BIGINT) AS head, CAST(sum(t) AS BIGINT) AS total FROM (SELECT o_custkey AS k, count(*) FILTER (o_orderstatus = 'F') AS h, count(*) AS t FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' GROUP BY 1
  UNION ALL SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F'), count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1994-01-01' GROUP BY 1) GROUP BY 1""")
def merged_counts(spark, d):
    counts = lambda rows: rows.groupBy(F.col("o_custkey").alias("sjid")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("head"), F.count("*").alias("total"))
    o = table(spark, d, "orders")
    return mention_ops.added_counts([counts(o.where("o_orderdate < '1995-01-01'")), counts(o.where("o_orderdate >= '1994-01-01'"))], "sjid", ["head", "total"])


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS k, CAST(l_quantity AS BIGINT) AS s_start, CAST(l_quantity + 6 AS BIGINT) AS s_end FROM lineitem WHERE l_linenumber = 1), p AS (SELECT l_orderkey AS k, CAST(l_quantity - l_linenumber AS BIGINT) AS b, CAST(l_quantity + 4 AS BIGINT) AS e FROM lineitem WHERE l_linenumber > 1),
  i AS (SELECT s.k, s_start, s_end, count(*) AS n, min(b) AS b, min(e) AS e FROM s JOIN p ON s.k = p.k AND (b BETWEEN s_start AND s_end OR e BETWEEN s_start AND s_end) GROUP BY 1, 2, 3)
SELECT k, s_start, s_end, CASE WHEN n = 1 THEN b END AS start, CASE WHEN n = 1 THEN e END AS "end" FROM s LEFT JOIN i USING (k, s_start, s_end)""")
def span_overlap(spark, d):
    li = table(spark, d, "lineitem")
    statuses = li.where("l_linenumber = 1").selectExpr("l_orderkey AS k", "cast(l_quantity AS long) AS s_start", "cast(l_quantity + 6 AS long) AS s_end")
    spans = li.where("l_linenumber > 1").selectExpr("l_orderkey AS k", "cast(l_quantity - l_linenumber AS long) AS start", "cast(l_quantity + 4 AS long) AS end")
    return mention_ops.only_overlap(statuses, spans, "k")


_SPANS = f"""WITH {_FILES.replace("'mdd;;1:' || lpad(CAST(o_orderkey % 30 AS VARCHAR), 2, '0') || '-cv-' || o_orderkey AS ucid", "o_orderkey AS ucid, o_orderdate + INTERVAL 90 DAY AS ended")}, told AS (
  SELECT l_orderkey AS ucid, l_returnflag = 'R' AS sealed_article, l_linestatus = 'F' AND l_quantity > 40 AS seal_motion, l_returnflag = 'A' AND l_quantity > 45 AS restricted, l_quantity < 10 AS about FROM lineitem WHERE l_returnflag <> 'N' OR l_quantity < 10
), spans AS (
  SELECT ucid, court, status, CAST(date_diff('day', filing_date, CAST(greatest(CAST(ended AS DATE), (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem WHERE l_orderkey = ucid)) AS DATE)) AS INTEGER) AS days, (SELECT count(*) FROM lineitem WHERE l_orderkey = ucid) AS n_lines,
    EXISTS (SELECT 1 FROM told WHERE told.ucid = files.ucid) AS sealed, EXISTS (SELECT 1 FROM told WHERE told.ucid = files.ucid AND about) AS discovery
  FROM files WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = ucid))"""


def _case_spans(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date(F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")).alias("ended"))
    f = files(spark, d).withColumn("ucid", F.split("ucid", "-cv-")[1].cast("long"))
    f = f.join(o, F.col("ucid") == F.col("o_orderkey"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ucid"), F.to_date("l_shipdate").alias("entered"), "l_returnflag", "l_linestatus", "l_quantity")
    told = li.where("l_returnflag <> 'N' OR l_quantity < 10").selectExpr(
        "ucid", "l_returnflag = 'R' AS sealed_article", "l_linestatus = 'F' AND l_quantity > 40 AS seal_motion", "l_returnflag = 'A' AND l_quantity > 45 AS restricted", "l_quantity < 10 AS about",
        *[f"false AS {c}" for c in ("unseal_motion", "seal_grant", "unseal_grant", "unseal_deny", "seal_grant_deny", "unseal_grant_deny")],
    )
    return cases.case_spans(f, li, told, "ucid", "filing_date", "ended", "entered", F.col("about")), told, f


@query(f"{_SPANS} SELECT ucid, days, n_lines, sealed, discovery FROM spans")
def case_span_flags(spark, d):
    return _case_spans(spark, d)[0].select("ucid", "days", "n_lines", "sealed", "discovery")


@query(f"""{_SPANS}, x AS (SELECT told.*, court, sealed_article OR (restricted AND NOT seal_motion) AS item FROM told JOIN spans USING (ucid) WHERE status = 'closed' AND discovery)
SELECT court, count(DISTINCT ucid) AS case_count, count(*) AS docket_lines, count(*) FILTER (sealed_article) AS sealed_article, count(*) FILTER (seal_motion) AS seal_motion, count(*) FILTER (item) AS sealed_item,
  round(count(*) FILTER (sealed_article) / nullif(count(*) FILTER (seal_motion), 0), 6) AS articles_motions, round(count(*) FILTER (item) / nullif(count(*) FILTER (seal_motion), 0), 6) AS items_motions, court <> 'alnd' AS plr, CASE court WHEN 'txed' THEN 'txed' ELSE 'other' END AS is_txed
FROM x GROUP BY court""")
def court_quotients(spark, d):
    spans, told, f = _case_spans(spark, d)
    return rounded(cases.court_quotients(told.join(f.select("ucid", "court"), "ucid"), spans), "articles_motions", "items_motions")


# --- names made ready ----------------------------------------------------------

from . import linking as _linking  # noqa: E402  their queries stand on their own
from . import preparation as _preparation  # noqa: E402
from . import upkeep as _upkeep  # noqa: E402

QUERIES |= _preparation.QUERIES | _linking.QUERIES | _upkeep.QUERIES
ORACLES |= _preparation.ORACLES | _linking.ORACLES | _upkeep.ORACLES
