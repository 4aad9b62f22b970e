"""Decision statistics of judges against their courts.

Everything about "the rest of the court" is the court's totals minus the
judge's own, so no judge is ever paired with other judges' rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.student import t_critical


def totals(rows: DataFrame, keys: list[str], outcome: str, prefix: str = "") -> DataFrame:
    """Every row with its group's rows, decisions (1 or -1) and share of grants among all rows."""
    group = Window.partitionBy(*keys)
    return rows.select(
        "*",
        F.count("*").over(group).alias(f"{prefix}case_total"),
        F.count_if(F.col(outcome).isin(1, -1)).over(group).alias(f"{prefix}decision_total"),
        F.avg((F.col(outcome) == 1).cast("double")).over(group).alias(f"{prefix}decision_average"),
    )


def moments(rows: DataFrame, judge: str, court: str, value: str) -> DataFrame:
    """A row per judge and court: n, mean and population variance of the judge and of the rest of the court."""
    one = (
        rows.where(F.col(judge).isNotNull() & F.col(court).isNotNull())
        .groupBy(court, judge)
        .agg(F.count("*").alias("n"), F.sum(value).cast("double").alias("s"), F.sum(F.col(value) * F.col(value)).cast("double").alias("q"))
    )
    all_ = Window.partitionBy(court)
    two = one.select("*", *[(F.sum(c).over(all_) - F.col(c)).alias(f"{c}_o") for c in ("n", "s", "q")])
    mean, mean_o = F.col("s") / F.col("n"), F.try_divide("s_o", "n_o")
    return two.select(
        court,
        judge,
        F.col("n").alias("n_judge"),
        F.col("n_o").alias("n_other"),
        mean.alias("mean_judge"),
        mean_o.alias("mean_other"),
        F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean).alias("var_judge"),
        F.greatest(F.lit(0.0), F.try_divide("q_o", "n_o") - mean_o * mean_o).alias("var_other"),
    )


def leave_one_out(rows: DataFrame, judge: str, court: str, value: str, min_cases: int = 5) -> DataFrame:
    """Difference of means with its standard error and Satterthwaite degrees of freedom; judges
    with more than ``min_cases`` rows and someone to compare with."""
    a, b = F.col("var_judge") / F.col("n_judge"), F.col("var_other") / F.col("n_other")
    return moments(rows, judge, court, value).where((F.col("n_judge") > min_cases) & (F.col("n_other") > 0)).select(
        "*",
        (F.col("mean_judge") - F.col("mean_other")).alias("diff"),
        F.sqrt(a + b).alias("se"),
        F.try_divide((a + b) * (a + b), a * a / (F.col("n_judge") - 1) + F.try_divide(b * b, F.col("n_other") - 1)).alias("df"),
    )


def welch_intervals(rows: DataFrame, judge: str, court: str, value: str, level: float = 0.95, min_cases: int = 5) -> DataFrame:
    """``leave_one_out`` with ``lb, ub`` at the level and ``sig``: the interval excludes zero.  Without degrees of
    freedom (no variance, or a single other row) there is no interval, and nothing is significant."""
    t = t_critical(0.5 + level / 2, F.col("df"))
    out = leave_one_out(rows, judge, court, value, min_cases).withColumn("_t", t)
    return (
        out.withColumn("lb", F.col("diff") - F.col("_t") * F.col("se"))
        .withColumn("ub", F.col("diff") + F.col("_t") * F.col("se"))
        .withColumn("sig", F.coalesce(F.signum("lb") == F.signum("ub"), F.lit(False)))
        .drop("_t")
    )


def pooled(rows: DataFrame, judge: str, court: str, value: str, min_cases: int = 0) -> DataFrame:
    """Difference of means with pooled sample variance, n1 + n2 - 2 degrees of freedom."""
    m = moments(rows, judge, court, value).where((F.col("n_judge") > min_cases) & (F.col("n_judge") + F.col("n_other") > 2) & (F.col("n_other") > 0))
    sp = (F.col("var_judge") * F.col("n_judge") + F.col("var_other") * F.col("n_other")) / (F.col("n_judge") + F.col("n_other") - 2)
    return m.select(
        "*", (F.col("mean_judge") - F.col("mean_other")).alias("diff"), F.sqrt(sp * (1 / F.col("n_judge") + 1 / F.col("n_other"))).alias("se"), (F.col("n_judge") + F.col("n_other") - 2).alias("df")
    )


def trim_outliers(rows: DataFrame, average: str, share: float) -> DataFrame:
    """Rows whose average lies in [share / 2, 1 - share / 2]."""
    return rows.where(F.col(average).between(share / 2, 1 - share / 2))


def without_prisoners(rows: DataFrame, prisoner: str) -> DataFrame:
    return rows.where(~F.coalesce(F.col(prisoner), F.lit(False)))


def significance_table(runs: list[tuple[str, DataFrame]], court: str, level: float = 0.05, left_out: tuple[str, ...] = ("nmid",)) -> DataFrame:
    """Runs of ``welch_intervals`` unioned; by court and run: judges whose interval excludes zero, judges, their
    share, and whether the share passes ``level``.  Courts in ``left_out`` are not compared."""
    parts = [run.select(court, F.col("sig").cast("int").alias("sig"), F.lit(name).alias("excl")) for name, run in runs]
    out = reduce(DataFrame.unionByName, parts).where(~F.col(court).isin(*left_out))
    return out.groupBy(court, "excl").agg(F.sum("sig").alias("jsum"), F.count("sig").alias("jcount"), F.avg("sig").alias("jmean")).withColumn("is_sig", F.col("jmean") > level)


def percentile_rank(rows: DataFrame, value: str, tie: str) -> DataFrame:
    """Place in ascending order and 100 * place / rows.  Each range of values is ranked on its
    own and offset by the ranges before it, so no task holds all rows."""
    runs = rows.withColumn("_part", F.floor(F.col(value) * 64))
    sizes = runs.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most one row per range
    total = Window.partitionBy()
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(total).alias("_all"))
    place = Window.partitionBy("_part").orderBy(value, tie)
    return (
        runs.join(offsets, "_part").withColumn("place", F.col("_base") + F.row_number().over(place))
        .withColumn("percentile", 100.0 * F.col("place") / F.col("_all")).drop("_part", "_base", "_all")
    )
