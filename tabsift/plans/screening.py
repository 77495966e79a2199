"""Queries of the core: summaries, comparisons, rules, posteriors, uniformity, evidence, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsift.operators import comparisons, posterior, rules
from tabsift.operators.summaries import round_table
from tabsift.plans import bridge
from tabsift.plans.registry import query, rounded, rounded_sql

_TABLE = ["pmcid", "row", "column", "statistic", "stat1", "stat2", "sample_size"]
_FLOATS = ["row", "stat1", "stat2", "stat3", "sample_size"]
_COMPARED = ["pmcid", "row", "statistic", "size", "mdiff", "sem", "t", "sem2"]
_CF = ["row", "mdiff", "sem", "t", "sem2", "p"]


def _table_sql(sql: str, digits: int = 6) -> str:
    return rounded_sql(sql, _TABLE, _FLOATS, digits)


@query(_table_sql(bridge.LINEITEM_SQL))
def m33_summary_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bridge.lineitem_table(spark, sf_dir).select(*_TABLE))


@query(_table_sql(bridge.ORDERS_SQL))
def m33_summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bridge.orders_table(spark, sf_dir).select(*_TABLE))


@query(_table_sql(bridge.DOCUMENTS_SQL, 4))
def m33_summary_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bridge.documents_table(spark, sf_dir).select(*_TABLE), 4)


@query(rounded_sql(bridge.compare_sql(bridge.LINEITEM_SQL), _COMPARED, _CF))
def m2_continuous_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(comparisons.compare(bridge.lineitem_table(spark, sf_dir), p_values=False).select(*_COMPARED))


@query(rounded_sql(bridge.compare_sql(bridge.ORDERS_SQL), _COMPARED, _CF))
def m3_binomial_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(comparisons.compare(bridge.orders_table(spark, sf_dir), p_values=False).select(*_COMPARED))


@query(rounded_sql(bridge.compare_sql(bridge.MIXED_SQL, p=True), ["pmcid", "row", "statistic", "t", "p"], _CF))
def f26_t_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(comparisons.compare(bridge.mixed_table(spark, sf_dir)).select("pmcid", "row", "statistic", "t", "p"))


@query(
    f"""SELECT a.pmcid, round(a."row" + ((a."column" - 1) * k - a."column" * (a."column" - 1) / 2.0 + (b."column" - a."column" - 1)) / (k * (k - 1) / 2.0), 6) AS "row", a."column" AS column_a, b."column" AS column_b
    FROM (SELECT *, max("column") OVER (PARTITION BY pmcid) AS k FROM ({bridge.LINEITEM_SQL})) a JOIN ({bridge.LINEITEM_SQL}) b
    ON a.pmcid = b.pmcid AND a."row" = b."row" AND a."column" < b."column" """
)
def m1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(comparisons.pairs(bridge.lineitem_table(spark, sf_dir)).select("pmcid", "row", F.col("a.column").alias("column_a"), F.col("b.column").alias("column_b")))


@query(f"""SELECT pmcid, round("row", 6) AS "row", round(t, 6) AS t, CAST(dense_rank() OVER (ORDER BY pmcid) AS INTEGER) AS study FROM ({bridge.compare_sql(bridge.MIXED_SQL)})""")
def m4_study_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(comparisons.numbered(comparisons.compare(bridge.mixed_table(spark, sf_dir), p_values=False)).select("pmcid", "row", "t", "study"))


@query(
    f"""SELECT pmcid, round("row", 6) AS "row", round(CASE WHEN row_number() OVER (ORDER BY pmcid, t, "row") % 2 = 1 THEN abs(t) ELSE -abs(t) END, 6) AS t FROM ({bridge.compare_sql(bridge.LINEITEM_SQL)})"""
)
def m5_symmetrize(spark: SparkSession, sf_dir: str) -> DataFrame:
    flipped = comparisons.symmetrize(comparisons.compare(bridge.lineitem_table(spark, sf_dir), p_values=False))
    # F.round() makes 0 of -0 and of small negative numbers, DuckDB's round -0: the sign is given back after it
    return flipped.select("pmcid", F.round("row", 6).alias("row"), (F.round(F.abs("t"), 6) * F.signum("t")).alias("t"))


_TWO = """SELECT pmcid, "row", "column", 'percent' AS statistic, x AS stat1, 100 * x / n AS stat2, NULL::DOUBLE AS stat3, NULL::DOUBLE AS stat4, 0 AS dp1, 0 AS dp2, n AS sample_size FROM (
    SELECT CAST(c_nationkey AS VARCHAR) AS pmcid, r AS "row", CAST(1 + c_custkey % 2 AS INTEGER) AS "column", CAST(count(*) FILTER (WHERE (c_acctbal > 4000) = (r = 1)) AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS n
    FROM customer, (VALUES (1.0::DOUBLE), (2.0::DOUBLE)) v(r) GROUP BY 1, 2, 3)"""


def _two_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers above and below a balance: the second row mirrors the first."""
    from tabsift.plans.registry import read

    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("pmcid"), (1 + F.pmod("c_custkey", F.lit(2))).cast("int").alias("column"), (F.col("c_acctbal") > 4000).cast("double").alias("up"))
    g = c.groupBy("pmcid", "column").agg(F.sum("up").alias("up"), F.count(F.lit(1)).cast("double").alias("sample_size"))
    x = F.explode(F.array(F.struct(F.lit(1.0).alias("row"), F.col("up").alias("stat1")), F.struct(F.lit(2.0).alias("row"), (F.col("sample_size") - F.col("up")).alias("stat1"))))
    long = g.select("pmcid", "column", "sample_size", x.alias("x")).select("pmcid", "x.row", "column", F.lit("percent").alias("statistic"), "x.stat1", "sample_size")
    return long.withColumn("stat2", 100 * F.col("stat1") / F.col("sample_size"))


@query(
    f"""SELECT pmcid, round("row", 6) AS "row", round(t, 6) AS t FROM (SELECT *, lag(t) OVER (PARTITION BY pmcid, statistic IN ('percent', 'numbers') ORDER BY "row") AS p FROM ({bridge.compare_sql(_TWO)}))
    WHERE NOT coalesce(statistic IN ('percent', 'numbers') AND abs(p + t) < 0.001 AND t <> 0 AND "row" = floor("row"), FALSE)"""
)
def m6_drop_mirrors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(comparisons.drop_mirrors(comparisons.compare(_two_rows(spark, sf_dir), p_values=False)).select("pmcid", "row", "t"))


@query(
    f"""SELECT coalesce(e.pmcid, f.pmcid) AS pmcid, coalesce(expected, 0) AS expected, coalesce(found, 0) AS found, coalesce(expected, 0) = coalesce(found, 0) AS matches FROM
    (SELECT pmcid, CAST(sum(k * (k - 1) / 2) AS BIGINT) AS expected FROM (SELECT pmcid, "row", max("column") AS k FROM ({bridge.MIXED_SQL}) GROUP BY 1, 2) GROUP BY 1) e
    FULL JOIN (SELECT pmcid, count(*) AS found FROM ({bridge.compare_sql(bridge.MIXED_SQL)}) GROUP BY 1) f ON e.pmcid = f.pmcid"""
)
def m7_check_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = bridge.mixed_table(spark, sf_dir)
    return comparisons.check_pairs(table, comparisons.compare(table, p_values=False))


@query(rounded_sql(bridge.compare_sql(f"SELECT * REPLACE (round_even(stat1, 1) AS stat1, round_even(stat2, 1) AS stat2) FROM ({bridge.LINEITEM_SQL})"), ["pmcid", "row", "t"], _CF, 4))
def m34_rounding_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(comparisons.compare(round_table(bridge.lineitem_table(spark, sf_dir), 1), p_values=False).select("pmcid", "row", "t"), 4)


#: A table in which every rule finds something: cells of suppliers and customers, disturbed by remainders of their numbers.
_DIRTY_COLUMNS = {
    "statistic": """CASE WHEN statistic = 'percent' THEN CASE WHEN q % 7 = 0 THEN 'numbers' WHEN q % 7 = 1 THEN 'continuous' ELSE 'percent' END
        ELSE CASE WHEN q % 6 = 0 THEN 'ci' WHEN q % 6 = 1 THEN 'median' WHEN q % 6 = 2 THEN 'min_max' ELSE 'continuous' END END""",
    "stat1": "CASE WHEN q % 11 = 3 AND statistic = 'percent' THEN stat2 WHEN q % 13 = 4 THEN -stat1 WHEN q % 17 = 2 THEN round(stat1, 0) ELSE stat1 END",
    "stat2": "CASE WHEN q % 11 = 3 AND statistic = 'percent' THEN stat1 WHEN q % 19 = 5 THEN NULL WHEN q % 23 = 6 THEN 0 WHEN q % 29 = 7 THEN -stat2 WHEN q % 6 = 0 AND statistic <> 'percent' THEN stat1 - 1 ELSE stat2 END",
    "stat3": "CASE WHEN q % 6 = 0 AND q % 5 = 0 THEN stat1 - 2 WHEN q % 6 < 2 THEN stat1 + 1 WHEN q % 5 = 1 THEN 100 * stat1 / nullif(stat2, 0) ELSE NULL END",
    "stat4": "CASE WHEN q % 31 = 8 THEN 1 ELSE NULL END",
    "dp1": "CASE WHEN q % 17 = 2 THEN 0 WHEN q % 37 = 9 THEN 1 ELSE dp1 END",
    "dp2": "CASE WHEN q % 11 = 3 THEN 0 ELSE dp2 END",
    "sample_size": "CASE WHEN s % 41 = 10 AND r = 1 THEN sample_size + 0.5 WHEN s % 43 = 11 AND r = 1 THEN 2 ELSE sample_size END",
}


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = bridge.mixed_table(spark, sf_dir)
    t = t.withColumns({"s": F.expr("cast(replace(pmcid, 'c', '') as int)"), "r": F.expr("cast(`row` as int)")}).withColumn("q", F.expr("s * 3 + r * 5"))
    return t.select("pmcid", "row", "column", *[F.expr(x).alias(c) for c, x in _DIRTY_COLUMNS.items()])


_DIRTY_SQL = "SELECT pmcid, \"row\", \"column\", {} FROM (SELECT *, s * 3 + r * 5 AS q FROM (SELECT *, CAST(replace(pmcid, 'c', '') AS INTEGER) AS s, CAST(\"row\" AS INTEGER) AS r FROM ({})))".format(", ".join(f"{x} AS {c}" for c, x in _DIRTY_COLUMNS.items()), bridge.MIXED_SQL)
_CLEAN = ["pmcid", "row", "column", "statistic", "stat1", "stat2", "stat3", "dp1", "sample_size", "changed"]


@query(rounded_sql(rules.clean_sql(_DIRTY_SQL), _CLEAN, _FLOATS, 4))
def rules_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rules.clean(_dirty(spark, sf_dir)).select(*_CLEAN), 4)


@query(
    f"""SELECT dropped AS reason, dropped_unit AS unit, CASE dropped_unit WHEN 'study' THEN count(DISTINCT pmcid) WHEN 'row' THEN count(DISTINCT (pmcid, "row")) ELSE count(*) END AS count
    FROM ({rules.clean_sql(_DIRTY_SQL, dropped=True)}) WHERE dropped IS NOT NULL GROUP BY 1, 2"""
)
def rules_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.audit(rules.mark(_dirty(spark, sf_dir)))


def _studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posterior.posterior(comparisons.compare(bridge.lineitem_table(spark, sf_dir), p_values=False))


_POSTERIOR_SQL = posterior.posterior_sql(bridge.compare_sql(bridge.LINEITEM_SQL))


@query(f"SELECT pmcid, n_rows, round(log_bf, 4) AS log_bf, round(p_flag, 5) AS p_flag, round(slab_mean, 4) AS slab_mean FROM ({_POSTERIOR_SQL})")
def m8_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _studies(spark, sf_dir).select("pmcid", "n_rows", F.round("log_bf", 4).alias("log_bf"), F.round("p_flag", 5).alias("p_flag"), F.round("slab_mean", 4).alias("slab_mean"))


_GRID_SQL = "SELECT id / 200.0::DOUBLE AS p FROM range(1, 200) r(id)"
_SHARED_SQL = f"""WITH s AS MATERIALIZED ({_POSTERIOR_SQL}), g AS ({_GRID_SQL}),
    l AS (SELECT p, sum(greatest(log_bf, 0) + ln((1 - p) * exp(-greatest(log_bf, 0)) + p * exp(log_bf - greatest(log_bf, 0)))) AS l FROM s, g GROUP BY p),
    w AS (SELECT p, exp(l - (SELECT max(l) FROM l)) AS w FROM l), v AS (SELECT p, w / (SELECT sum(w) FROM w) AS weight FROM w)"""


@query(f"{_SHARED_SQL} SELECT round(p, 6) AS p, round(weight, 6) AS weight FROM v")
def m9_shared_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(posterior.shared_prior(_studies(spark, sf_dir)))


@query(f"{_SHARED_SQL} SELECT pmcid, round(sum(weight / (1 + exp(-(log_bf + ln(p / (1 - p)))))), 5) AS p_shared FROM s, v GROUP BY pmcid")
def m9_posterior_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(posterior.with_shared_prior(_studies(spark, sf_dir)).select("pmcid", "p_shared"), 5)


@query(f"SELECT pmcid, round((1 + p_flag) / 3, 5) AS theta_mean FROM ({_POSTERIOR_SQL})")
def m10_own_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(posterior.with_own_prior(_studies(spark, sf_dir)).select("pmcid", "theta_mean"), 5)


@query(
    f"""SELECT part, issue, n, round(100.0 * n / sum(n) OVER (PARTITION BY part), 6) AS percent FROM (SELECT CAST(length(pmcid) AS INTEGER) AS part,
    CASE WHEN p_flag < 0.5 THEN 'No issue' WHEN p_flag * slab_mean <= 0 THEN 'Over-dispersed' ELSE 'Under-dispersed' END AS issue, count(*) AS n FROM ({_POSTERIOR_SQL}) GROUP BY 1, 2)"""
)
def m16_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    classified = posterior.classify(_studies(spark, sf_dir), 0.5).withColumn("part", F.length("pmcid"))
    return rounded(posterior.count_issues(classified, "part"))
