"""Are a study's p-values uniform? And which study is a typical example?"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsift.functions.stats import kolmogorov_p


def uniform_test(comparisons: DataFrame, least: int = 1) -> DataFrame:
    """(pmcid, n, d, p_uniform): Kolmogorov's distance of a study's p-values from uniform, for studies of ``least`` or more."""
    w = Window.partitionBy("pmcid")
    p = comparisons.filter("p IS NOT NULL").select("pmcid", "p")
    ranked = p.withColumns({"i": F.row_number().over(w.orderBy("p")), "n": F.count(F.lit(1)).over(w)})
    gap = F.greatest(F.col("i") / F.col("n") - F.col("p"), F.col("p") - (F.col("i") - 1) / F.col("n"))
    d = ranked.groupBy("pmcid").agg(F.max("n").alias("n"), F.max(gap).alias("d")).filter(F.col("n") >= least)
    return d.withColumn("p_uniform", kolmogorov_p(F.col("d"), F.col("n")))


def typical(comparisons: DataFrame, groups: DataFrame, least: int = 30) -> DataFrame:
    """The study of each group whose mean and sd of t are nearest to the group's averages, among those of ``least`` rows or more.

    ``groups`` has (pmcid, group). Returns (group, pmcid, n, mean_t, sd_t, distance); ties go to the least id.
    """
    per = comparisons.groupBy("pmcid").agg(F.count(F.lit(1)).alias("n"), F.avg("t").alias("mean_t"), F.stddev_samp("t").alias("sd_t")).filter(F.col("n") >= least).join(groups, "pmcid")
    w = Window.partitionBy("group")
    far = F.pow(F.col("mean_t") - F.avg("mean_t").over(w), 2) + F.pow(F.col("sd_t") - F.avg("sd_t").over(w), 2)
    ranked = per.withColumn("distance", F.sqrt(far)).withColumn("k", F.row_number().over(w.orderBy("distance", "pmcid")))
    return ranked.filter("k = 1").drop("k")
