"""How the evidence on a series of trials grows with each of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsift.operators.posterior import posterior


def prefixes(trials: DataFrame, series: str, order: list[str]) -> DataFrame:
    """Each trial's rows once for every step at or after it: rows with (series, step, trial_num).

    A triangular join on the trial's number; series are short, and their rows
    stay together by series.
    """
    distinct = trials.select(series, "pmcid", *order).distinct()
    number = distinct.withColumn("trial_num", F.row_number().over(Window.partitionBy(series).orderBy(*order, "pmcid"))).select(series, "pmcid", "trial_num")
    steps = number.select(series, F.col("trial_num").alias("step"))
    return trials.join(number, [series, "pmcid"]).join(steps, series).filter(F.col("trial_num") <= F.col("step"))


def cumulative(comparisons: DataFrame, series: str, order: list[str], statistics: list[str] | None = None) -> DataFrame:
    """posterior() of the first trial, the first two, and so on, each prefix pooled as one study: (series, step, ...)."""
    kept = comparisons.filter(F.col("statistic").isin(statistics)) if statistics else comparisons
    key = F.concat_ws("|", F.col(series).cast("string"), F.col("step").cast("string"))
    pooled = prefixes(kept, series, order).withColumn("pmcid", key)
    cut = F.split("pmcid", r"\|")
    return posterior(pooled).withColumns({series: cut[0], "step": cut[1].cast("int")}).drop("pmcid")


def neaten(summaries: DataFrame, type_: str) -> DataFrame:
    """(mean, lower, upper, var, n_table_rows, type) of posterior summaries, one row for each quantity."""
    return summaries.select("mean", "lower", "upper", F.col("variable").alias("var"), F.col("n").alias("n_table_rows"), F.lit(type_).alias("type"))
