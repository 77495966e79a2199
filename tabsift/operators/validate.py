"""What an algorithm extracted against what was entered by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsift.operators.relational import same_shape_merge


def exclusions(algorithm: DataFrame, hand: DataFrame) -> DataFrame:
    """(algorithm, hand, n): papers by whether either excluded them; inputs have (pmcid, excluded)."""
    a, h = algorithm.select("pmcid", F.col("excluded").alias("algorithm")), hand.select("pmcid", F.col("excluded").alias("hand"))
    return a.join(h, "pmcid", "full").groupBy("algorithm", "hand").agg(F.count(F.lit(1)).alias("n"))


def dimensions(algorithm: DataFrame, hand: DataFrame) -> DataFrame:
    """(pmcid, rows and columns of both, differences)."""
    size = lambda df, s: df.groupBy("pmcid").agg(F.max("row").alias(f"rows_{s}"), F.max("column").alias(f"columns_{s}"))
    both = size(algorithm, "a").join(size(hand, "h"), "pmcid")
    return both.withColumns({"row_diff": F.col("rows_a") - F.col("rows_h"), "column_diff": F.col("columns_a") - F.col("columns_h")})


def kinds(algorithm: DataFrame, hand: DataFrame) -> DataFrame:
    """(algorithm, hand, n): statistic types of the rows of studies of equal height."""
    pick = lambda df, s: df.select("pmcid", "row", F.col("statistic").alias(s)).distinct()
    return same_shape_merge(pick(algorithm, "algorithm"), pick(hand, "hand"), ["pmcid", "row"]).groupBy("algorithm", "hand").agg(F.count(F.lit(1)).alias("n"))


def close(a: Column, b: Column, absolute: float = 0.01, relative: float = 0.01) -> Column:
    return (F.abs(a - b) <= absolute) | (F.abs(a - b) <= relative * F.abs(b))


def numbers(algorithm: DataFrame, hand: DataFrame) -> DataFrame:
    """(statistic, n, match1, match2): share of cells whose first and second numbers agree within 0.01 or 1%; each is judged by its own match."""
    pick = lambda df, s: df.select("pmcid", "row", "column", *[F.col(c).alias(f"{c}_{s}") for c in ("statistic", "stat1", "stat2")])
    both = same_shape_merge(pick(algorithm, "a"), pick(hand, "h"), ["pmcid", "row", "column"]).filter("statistic_a IS NOT NULL AND statistic_h IS NOT NULL")
    share = lambda k: F.avg(close(F.col(f"stat{k}_a"), F.col(f"stat{k}_h")).cast("double")).alias(f"match{k}")
    return both.groupBy(F.col("statistic_h").alias("statistic")).agg(F.count(F.lit(1)).alias("n"), share(1), share(2))


def sample_sizes(algorithm: DataFrame, hand: DataFrame) -> DataFrame:
    """(pmcid, column, size_a, size_h, difference)."""
    pick = lambda df, s: df.groupBy("pmcid", "column").agg(F.max("sample_size").alias(f"size_{s}"))
    return pick(algorithm, "a").join(pick(hand, "h"), ["pmcid", "column"], "full").withColumn("difference", F.col("size_a") - F.col("size_h"))


def total_sizes(table: DataFrame, known: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """(pmid, total, num_randomized, within): totals against a list of known ones."""
    total = table.select("pmid", "column", "sample_size").distinct().groupBy("pmid").agg(F.sum("sample_size").alias("total"))
    return total.join(known, "pmid").withColumn("within", F.abs(F.col("total") / F.col("num_randomized") - 1) <= tolerance)
