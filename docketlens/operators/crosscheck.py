"""The last look at a case's unresolved names: one that fits exactly one resolved name of the case takes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fuzzy import similarity
from .endpoints import cut

UNRESOLVED, CLOSE = "Inconclusive", 90
#: Pairs of a case up to which no keys are made.
FEW = 256


def _keys(final: Column, raw: Column, single: str, letter: str) -> Column:
    """Keys of a name's forms: their characters two by two; of a form of one character this (marked ``single``), and all
    characters, marked ``letter``, for such forms on the other side."""
    names = F.array(F.coalesce(final, F.lit("")), F.coalesce(raw, F.lit("")))
    twos = F.flatten(F.transform(names, lambda n: F.when(F.length(n) > 1, F.transform(F.sequence(F.lit(1), F.length(n) - 1), lambda i: F.substring(n, i, F.lit(2)))).otherwise(F.array())))
    ones = F.transform(F.filter(names, lambda n: F.length(n) == 1), lambda n: F.concat(F.lit(single), n))
    letters = F.transform(F.flatten(F.transform(names, lambda n: F.filter(F.split(n, ""), lambda c: c != ""))), lambda c: F.concat(F.lit(letter), c))
    return F.array_distinct(F.concat(twos, ones, letters))


def final_crosscheck(mentions: DataFrame, case: str, name: str, points_to: str, sjid: str) -> DataFrame:
    """``mentions`` with ``points_to`` and ``sjid`` of unresolved names replaced where exactly one resolved name of the case is
    close (partial ratio of ``CLOSE`` or more, by its final or its extracted form) and exactly one contains the unresolved one.

    Both counts are over distinct (final name, extracted name, id).  Names of a case meet by shared stretches of
    characters, by built-in functions: names of two characters or more that contain each other or reach the ratio share two
    (at most 0.2 m + 1 stretches make up 0.9 of the shorter name's m characters), single characters meet all names of
    their case with them; in a case of ``FEW`` pairs or less all meet.  Only pairs of names that pass the count of containing
    ones are measured.  Should forms of one name in a case be sent to different ones, the first in order counts.
    """
    forms = mentions.select(F.col(case).alias("c"), F.col(points_to).alias("f"), F.col(name).alias("r"), F.col(sjid).alias("i"))
    forms = forms.where("c IS NOT NULL AND f <> '' AND i IS NOT NULL").repartition("c").distinct()
    # Where a case has few pairs they meet as they are; only in larger ones by keys.
    here, found = Window.partitionBy("c"), F.col("i") != UNRESOLVED
    forms = forms.withColumn("k", F.count_if(found).over(here) * F.count_if(~found).over(here)).where("k > 0")
    good = forms.where(found).select(*[F.col(x).alias(f"g_{x}") for x in "cfrik"])
    bad = forms.where(~found).select("c", "f", "r", "k")
    few = bad.where(f"k <= {FEW}").join(good.where(f"g_k <= {FEW}"), F.col("c") == F.col("g_c")).drop("k", "g_k", "g_c")
    keyed = bad.where(f"k > {FEW}").withColumn("k", F.explode(_keys(F.col("f"), F.col("r"), "\x01", "\x02")))
    other = good.where(f"g_k > {FEW}").withColumn("g_k", F.explode(_keys(F.col("g_f"), F.col("g_r"), "\x02", "\x01")))
    met = few.unionByName(keyed.join(other, (F.col("c") == F.col("g_c")) & (F.col("k") == F.col("g_k"))).drop("k", "g_k", "g_c").distinct())
    holding = F.count_if(F.contains("g_f", F.col("f"))).over(Window.partitionBy("c", "f", "r"))
    looked = cut(met.withColumn("n", holding).where("n = 1").drop("n"))
    # Names are measured once, however many cases they share; cut, else the filter would be pushed below the distinct.
    texts = cut(looked.select("f", "g_f", "r", "g_r").distinct())
    close = (similarity("partial_ratio", F.col("f"), F.col("g_f")) >= CLOSE) | F.coalesce(similarity("partial_ratio", F.col("r"), F.col("g_r")) >= CLOSE, F.lit(False))
    near = cut(texts.where(close)).toDF("t_f", "t_gf", "t_r", "t_gr")
    same = F.expr("f = t_f AND g_f = t_gf AND r <=> t_r AND g_r <=> t_gr")
    fits = looked.join(near, same, "left_semi").groupBy("c", "f", "r").agg(F.count("*").alias("n"), F.min(F.struct("g_f", "g_i")).alias("g")).where("n = 1")
    new = fits.groupBy(F.col("c").alias("_c"), F.col("f").alias("_f")).agg(F.min("g").alias("_g"))
    out = mentions.join(new, (F.col(case) == F.col("_c")) & (F.col(points_to) == F.col("_f")), "left")
    return out.withColumns({points_to: F.coalesce("_g.g_f", points_to), sjid: F.coalesce("_g.g_i", sjid)}).drop("_c", "_f", "_g")
