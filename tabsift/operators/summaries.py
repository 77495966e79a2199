"""From raw rows to the long table of summary statistics, one row per (study, row, group).

Columns: pmcid, row, column, statistic, stat1 to stat4, dp1, dp2, sample_size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TABLE = "pmcid string, row double, column int, statistic string, stat1 double, stat2 double, stat3 double, stat4 double, dp1 int, dp2 int, sample_size double"


def _empty(kind: str) -> Column:
    return F.lit(None).cast(kind)


def continuous_table(df: DataFrame, study: Column, group: Column, values: list[str]) -> DataFrame:
    """Mean, standard deviation and size of each value by study and group.

    Values are aggregated side by side in one shuffle, and unpivoted only then.
    """
    aggs = [f(F.col(v)).alias(f"{k}{i}") for i, v in enumerate(values) for k, f in (("m", F.avg), ("s", F.stddev_samp), ("n", F.count))]
    wide = df.groupBy(study.cast("string").alias("pmcid"), group.alias("g")).agg(*aggs)
    wide = wide.withColumn("column", F.dense_rank().over(Window.partitionBy("pmcid").orderBy("g")))
    cells = F.array(*[F.struct(F.lit(float(i + 1)).alias("row"), F.col(f"m{i}").alias("stat1"), F.col(f"s{i}").alias("stat2"), F.col(f"n{i}").cast("double").alias("sample_size")) for i in range(len(values))])
    long = wide.select("pmcid", "column", F.explode(cells).alias("c"))
    return long.select("pmcid", "c.row", "column", F.lit("continuous").alias("statistic"), "c.stat1", "c.stat2", _empty("double").alias("stat3"), _empty("double").alias("stat4"), F.lit(1).alias("dp1"), F.lit(1).alias("dp2"), "c.sample_size")


def count_table(df: DataFrame, study: Column, group: Column, level: Column) -> DataFrame:
    """Counts of each level, with the percentage of the group, by study and group."""
    counts = df.groupBy(study.cast("string").alias("pmcid"), group.alias("g"), level.alias("v")).agg(F.count(F.lit(1)).alias("k"))
    in_study = Window.partitionBy("pmcid")
    out = counts.withColumns(
        {
            "sample_size": F.sum("k").over(Window.partitionBy("pmcid", "g")).cast("double"),
            "row": F.dense_rank().over(in_study.orderBy("v")).cast("double"),
            "column": F.dense_rank().over(in_study.orderBy("g")),
        }
    )
    return out.select("pmcid", "row", "column", F.lit("percent").alias("statistic"), F.col("k").cast("double").alias("stat1"), (100 * F.col("k") / F.col("sample_size")).alias("stat2"), _empty("double").alias("stat3"), _empty("double").alias("stat4"), F.lit(0).alias("dp1"), F.lit(1).alias("dp2"), "sample_size")


def round_table(table: DataFrame, digits: int) -> DataFrame:
    """Statistics as they would be printed, rounded half to even, with their decimal places."""
    rounded = {c: F.bround(c, digits) for c in ("stat1", "stat2", "stat3", "stat4")}
    return table.withColumns(rounded | {"dp1": F.lit(digits), "dp2": F.lit(digits)})
