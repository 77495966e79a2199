"""Relational tables as tables of summary statistics: suppliers, customers, users and text sources are the studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsift.operators.summaries import continuous_table, count_table
from tabsift.plans.registry import read

VALUES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lineitem_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies are suppliers, groups are return flags, rows are four measures."""
    return continuous_table(read(spark, sf_dir, "lineitem"), F.col("l_suppkey"), F.col("l_returnflag"), VALUES)


def orders_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies are customers modulo 50, groups are order states, rows are priorities."""
    return count_table(read(spark, sf_dir, "orders"), F.pmod("o_custkey", F.lit(50)), F.col("o_orderstatus"), F.col("o_orderpriority"))


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies are users modulo 40, groups are even and odd events, rows are the values."""
    return continuous_table(read(spark, sf_dir, "events"), F.pmod("user_id", F.lit(40)), F.pmod("event_id", F.lit(2)), ["value"])


def documents_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies are sources, groups are languages, rows are lengths and counts of digits."""
    docs = read(spark, sf_dir, "documents").select("source", "lang", "n_chars", F.regexp_count("text", F.lit("[0-9]")).alias("digits"))
    return continuous_table(docs, F.col("source"), F.col("lang"), ["n_chars", "digits"])


def mixed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of suppliers and counts of customers in one table; ids don't clash."""
    counts = orders_table(spark, sf_dir).withColumn("pmcid", F.concat(F.lit("c"), "pmcid"))
    return lineitem_table(spark, sf_dir).unionByName(counts)


def _continuous_sql(source: str, study: str, group: str, values: list[str]) -> str:
    parts = [f"SELECT CAST({study} AS VARCHAR) AS pmcid, {group} AS g, CAST({i + 1} AS DOUBLE) AS r, {v} AS v FROM {source}" for i, v in enumerate(values)]
    return f"""SELECT pmcid, r AS "row", CAST(dense_rank() OVER (PARTITION BY pmcid ORDER BY g) AS INTEGER) AS "column", 'continuous' AS statistic,
        avg(v) AS stat1, stddev_samp(v) AS stat2, NULL::DOUBLE AS stat3, NULL::DOUBLE AS stat4, 1 AS dp1, 1 AS dp2, CAST(count(v) AS DOUBLE) AS sample_size
        FROM ({' UNION ALL '.join(parts)}) GROUP BY pmcid, g, r"""


LINEITEM_SQL = _continuous_sql("lineitem", "l_suppkey", "l_returnflag", VALUES)
EVENTS_SQL = _continuous_sql("events", "user_id % 40", "event_id % 2", ["value"])
DOCUMENTS_SQL = _continuous_sql("(SELECT source, lang, n_chars, len(regexp_extract_all(text, '[0-9]')) AS digits FROM documents)", "source", "lang", ["n_chars", "digits"])
ORDERS_SQL = """SELECT pmcid, CAST(dense_rank() OVER (PARTITION BY pmcid ORDER BY v) AS DOUBLE) AS "row", CAST(dense_rank() OVER (PARTITION BY pmcid ORDER BY g) AS INTEGER) AS "column",
    'percent' AS statistic, CAST(k AS DOUBLE) AS stat1, 100 * k / CAST(sum(k) OVER (PARTITION BY pmcid, g) AS DOUBLE) AS stat2, NULL::DOUBLE AS stat3, NULL::DOUBLE AS stat4,
    0 AS dp1, 1 AS dp2, CAST(sum(k) OVER (PARTITION BY pmcid, g) AS DOUBLE) AS sample_size
    FROM (SELECT CAST(o_custkey % 50 AS VARCHAR) AS pmcid, o_orderstatus AS g, o_orderpriority AS v, count(*) AS k FROM orders GROUP BY 1, 2, 3)"""
MIXED_SQL = f"SELECT * FROM ({LINEITEM_SQL}) UNION ALL SELECT * REPLACE ('c' || pmcid AS pmcid) FROM ({ORDERS_SQL})"


def compare_sql(table: str, p: bool = False) -> str:
    """operators.comparisons.compare for DuckDB."""
    from tabsift.functions.stats import t_two_sided_sql

    clamp = lambda x, n: f"(CASE WHEN {x} = 0 THEN 0.5 / {n} WHEN {x} = {n} THEN ({n} - 0.5) / {n} ELSE {x} / {n} END)"
    p1, p2 = clamp("a.stat1", "a.sample_size"), clamp("b.stat1", "b.sample_size")
    n1, n2 = "a.sample_size", "b.sample_size"
    p_out = f", {t_two_sided_sql('mdiff / nullif(sem, 0)', 'size - 2')} AS p" if p else ""
    return f"""
    SELECT pmcid, "row", statistic, size, mdiff, sem, mdiff / nullif(sem, 0) AS t{p_out}, sem * sem AS sem2 FROM (
      SELECT a.pmcid, a."row" + ((a."column" - 1) * a.k - a."column" * (a."column" - 1) / 2.0 + (b."column" - a."column" - 1)) / (a.k * (a.k - 1) / 2.0) AS "row",
        a.statistic, {n1} + {n2} AS size,
        CASE WHEN a.statistic IN ('ci', 'continuous') THEN a.stat1 - b.stat1 ELSE {p1} - {p2} END AS mdiff,
        CASE WHEN a.statistic IN ('ci', 'continuous')
          THEN sqrt((1 / {n1} + 1 / {n2}) * (({n1} - 1) * a.stat2 * a.stat2 + ({n2} - 1) * b.stat2 * b.stat2) / nullif({n1} + {n2} - 2, 0))
          ELSE sqrt((({n1} - 1) * {p1} * (1 - {p1}) + ({n2} - 1) * {p2} * (1 - {p2})) / nullif({n1} + {n2} - 2, 0)) * sqrt(1 / {n1} + 1 / {n2}) END AS sem
      FROM (SELECT *, max("column") OVER (PARTITION BY pmcid) AS k FROM ({table}) WHERE statistic IN ('ci', 'continuous', 'percent', 'numbers')) a
      JOIN ({table}) b ON a.pmcid = b.pmcid AND a."row" = b."row" AND a.statistic = b.statistic AND a."column" < b."column"
      WHERE a.k > 1 AND (a.statistic IN ('ci', 'continuous') OR (a.stat1 >= 0 AND b.stat1 >= 0 AND a.sample_size >= a.stat1 AND b.sample_size >= b.stat1)))
    WHERE mdiff IS NOT NULL AND sem IS NOT NULL AND (statistic IN ('ci', 'continuous') OR sem > 0)"""
