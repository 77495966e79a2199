"""Queries of text functions, features, tests and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsift.functions import stats
from tabsift.functions import text as T
from tabsift.operators import comparisons, documents, evidence, features, posterior, uniformity, validate
from tabsift.plans import bridge
from tabsift.plans.registry import query, read, rounded, rounded_sql
from tabsift.plans.screening import _POSTERIOR_SQL, _studies


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents")


@query("SELECT doc_id, regexp_matches(text, '[0-9]{4,}') AS long_number, len(regexp_extract_all(text, '[0-9]')) AS digits FROM documents")
def f1_f2_detect_count(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.col("text").rlike("[0-9]{4,}").alias("long_number"), F.regexp_count("text", F.lit("[0-9]")).cast("bigint").alias("digits"))


@query("SELECT doc_id, regexp_replace(source, '[0-9]+', '#', 'g') AS source, regexp_replace(lang, '^e', '') AS lang FROM documents")
def f3_replace(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.regexp_replace("source", "[0-9]+", "#").alias("source"), F.regexp_replace("lang", "^e", "").alias("lang"))


@query("SELECT doc_id, regexp_extract_all(text, '[0-9]+')[-1] AS last_number FROM documents")
def f4_last_match(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit("([0-9]+)"), F.lit(1))
    return _docs(spark, d).select("doc_id", F.when(F.size(found) > 0, F.element_at(found, -1)).alias("last_number"))


@query("SELECT p_partkey, upper(left(p_name, 1)) || lower(substr(p_name, 2)) AS sentence, length(p_name) AS n, substr(p_name, 3, 4) AS part FROM part")
def f5_case(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", T.sentence_case(F.col("p_name")).alias("sentence"), F.length("p_name").cast("bigint").alias("n"), F.substring("p_name", 3, 4).alias("part"))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS squished FROM documents")
def f6_squish(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(T.squish(F.col("text"))).alias("squished"))


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), '; ' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1")
def f8_paste_collapse(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), "; ").alias("orders"))


@query("SELECT p_partkey, CASE WHEN strpos(x, '.') > 0 THEN length(split_part(x, '.', 2)) ELSE 0 END AS dp FROM (SELECT p_partkey, printf('%.2f', p_retailprice) AS x FROM part)")
def f9_decimal_places(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", T.decimal_places(F.format_string("%.2f", "p_retailprice")).cast("bigint").alias("dp"))


@query(r"SELECT doc_id, md5(regexp_replace(lower(regexp_replace(text, '[(),]', ' (', 'g')), '[^a-z0-9| .·%–\-±/:=!]', '', 'g')) AS plain FROM documents")
def f11_f12_plain_cells(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(T.keep_allowed(F.lower(T.space_brackets(F.col("text"))))).alias("plain"))


@query("SELECT l_orderkey, l_linenumber, CAST(nullif(substr(regexp_replace(CAST(CAST(l_extendedprice AS DECIMAL(38, 10)) AS VARCHAR), '[^1-9]', '', 'g'), 1, 1), '') AS INTEGER) AS digit FROM lineitem")
def f18_first_digit(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", features.first_digit(F.col("l_extendedprice")).alias("digit"))


@query("SELECT o_orderkey, make_date(year(o_orderdate), coalesce(nullif(month(o_orderdate), 3), 6), coalesce(nullif(day(o_orderdate), 7), 15)) AS published FROM orders WHERE NOT (month(o_orderdate) = 3 AND day(o_orderdate) = 31)")
def f21_dates(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").filter("NOT (month(o_orderdate) = 3 AND day(o_orderdate) = 31)")
    m, k = F.nullif(F.month("o_orderdate"), F.lit(3)), F.nullif(F.day("o_orderdate"), F.lit(7))
    return o.select("o_orderkey", T.publication_date(F.year("o_orderdate"), m, k).alias("published"))


@query("SELECT o_orderstatus, DATE '1970-01-01' + CAST(floor(quantile_cont(epoch(CAST(o_orderdate AS DATE)) / 86400, 0.25)) AS INTEGER) AS q1 FROM orders GROUP BY 1")
def f23_date_quantile(spark: SparkSession, d: str) -> DataFrame:
    days = F.unix_date(F.col("o_orderdate").cast("date"))
    q = read(spark, d, "orders").groupBy("o_orderstatus").agg(F.percentile(days, F.lit(0.25)).alias("q"))
    return q.select("o_orderstatus", F.date_from_unix_date(F.floor("q").cast("int")).alias("q1"))


@query("SELECT o_orderkey, round(ln(o_totalprice), 6) AS a, round(log2(o_totalprice), 6) AS b, round(sqrt(o_totalprice), 6) AS c, round_even(o_totalprice / 1000, 0) AS e FROM orders")
def f24_math(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_totalprice")
    return read(spark, d, "orders").select("o_orderkey", F.round(F.log(p), 6).alias("a"), F.round(F.log2(p), 6).alias("b"), F.round(F.sqrt(p), 6).alias("c"), F.bround(p / 1000, 0).alias("e"))


@query("SELECT doc_id, coalesce(len(regexp_extract_all(text, '[0-9]')) / nullif(len(regexp_extract_all(text, '[a-z]')), 0) >= 0.1, length(text) > 0) AS enough FROM documents")
def t5_enough_numbers(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", documents.enough_numbers(F.col("text")).alias("enough"))


_P_SQL = bridge.compare_sql(bridge.LINEITEM_SQL, p=True)
_D_SQL = f"SELECT pmcid, max(n) AS n, max(greatest(i / n - p, p - (i - 1) / n)) AS d FROM (SELECT pmcid, p, row_number() OVER (PARTITION BY pmcid ORDER BY p) AS i, count(*) OVER (PARTITION BY pmcid) AS n FROM ({_P_SQL})) GROUP BY pmcid"


@query(f"SELECT pmcid, n, round(d, 6) AS d, round({stats.kolmogorov_p_sql('d', 'n')}, 6) AS p_uniform FROM ({_D_SQL})")
def m19_uniform_test(spark: SparkSession, d: str) -> DataFrame:
    return rounded(uniformity.uniform_test(comparisons.compare(bridge.lineitem_table(spark, d))))


@query(
    f"""SELECT grp AS "group", pmcid, n, round(mean_t, 5) AS mean_t, round(sd_t, 5) AS sd_t FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY far, pmcid) AS k FROM (SELECT *, pow(mean_t - avg(mean_t) OVER (PARTITION BY grp), 2) + pow(sd_t - avg(sd_t) OVER (PARTITION BY grp), 2) AS far
    FROM (SELECT pmcid, length(pmcid) AS grp, count(*) AS n, avg(t) AS mean_t, stddev_samp(t) AS sd_t FROM ({bridge.compare_sql(bridge.MIXED_SQL)}) GROUP BY 1 HAVING count(*) >= 10))) WHERE k = 1"""
)
def m20_typical(spark: SparkSession, d: str) -> DataFrame:
    c = comparisons.compare(bridge.mixed_table(spark, d), p_values=False)
    groups = c.select("pmcid", F.length("pmcid").cast("bigint").alias("group")).distinct()
    return rounded(uniformity.typical(c, groups, 10).select("group", "pmcid", "n", "mean_t", "sd_t"), 5)


@query(
    f"""WITH c AS (SELECT *, CAST(pmcid AS INTEGER) % 5 AS series FROM ({bridge.compare_sql(bridge.LINEITEM_SQL)}) WHERE CAST(pmcid AS INTEGER) < 20),
    n AS (SELECT series, pmcid, row_number() OVER (PARTITION BY series ORDER BY CAST(pmcid AS INTEGER)) AS trial FROM (SELECT DISTINCT series, pmcid FROM c)),
    x AS (SELECT c.series || '|' || s.trial AS pmcid, c.t, c.size FROM c JOIN n ON c.pmcid = n.pmcid JOIN n s ON s.series = c.series AND n.trial <= s.trial)
    SELECT CAST(split_part(pmcid, '|', 1) AS INTEGER) AS series, CAST(split_part(pmcid, '|', 2) AS INTEGER) AS step, n_rows, round(p_flag, 5) AS p_flag FROM ({posterior.posterior_sql("SELECT * FROM x")})"""
)
def m21_cumulative(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("pmcid").cast("int")
    c = comparisons.compare(bridge.lineitem_table(spark, d), p_values=False).filter(k < 20).withColumn("series", F.pmod(k, F.lit(5))).withColumn("year", k)
    return rounded(evidence.cumulative(c, "series", ["year"]).select(F.col("series").cast("int").alias("series"), "step", "n_rows", "p_flag"), 5)


_DIGITS = f"SELECT pmcid, CAST(nullif(substr(regexp_replace(CAST(CAST(abs(stat1) AS DECIMAL(38, 10)) AS VARCHAR), '[^1-9]', '', 'g'), 1, 1), '') AS INTEGER) AS digit FROM ({bridge.ORDERS_SQL})"


def _benford_sql(weight: str) -> str:
    return f"""WITH x AS (SELECT * FROM ({_DIGITS}) WHERE digit IS NOT NULL), n AS (SELECT pmcid, digit, CAST(sum({weight}) AS DOUBLE) AS n FROM x GROUP BY 1, 2),
    g AS (SELECT p.pmcid, k.digit, log10(1 + 1.0::DOUBLE / k.digit) AS share, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT pmcid FROM x) p CROSS JOIN (SELECT unnest(range(1, 10)) AS digit) k LEFT JOIN n ON n.pmcid = p.pmcid AND n.digit = k.digit)
    SELECT pmcid, round(sum(pow(n - share * total, 2) / (share * total)) / CAST({stats.chi_square_median(8)} AS DOUBLE), 6) AS score FROM (SELECT *, sum(n) OVER (PARTITION BY pmcid) AS total FROM g) GROUP BY 1"""


@query(_benford_sql("digit"))
def m23_digit_score(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.benford(bridge.orders_table(spark, d)))


@query(_benford_sql("1"))
def m23_digit_score_unweighted(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.benford(bridge.orders_table(spark, d), weighted=False))


@query(
    f"""SELECT a.pmcid, round(coalesce(sd_size, 0), 4) AS sd_size, n_rows, n_stats, round(sd_t, 5) AS sd_t FROM (SELECT pmcid, stddev_samp(sample_size) AS sd_size, count(DISTINCT "row") AS n_rows, count(DISTINCT statistic) AS n_stats FROM ({bridge.LINEITEM_SQL}) GROUP BY 1 HAVING count(DISTINCT "row") >= 3) a
    LEFT JOIN (SELECT pmcid, coalesce(stddev_samp(t), 0) AS sd_t FROM ({bridge.compare_sql(bridge.LINEITEM_SQL)}) GROUP BY 1) b ON a.pmcid = b.pmcid"""
)
def m24_paper_features(spark: SparkSession, d: str) -> DataFrame:
    t = bridge.lineitem_table(spark, d)
    f = features.paper_features(t, comparisons.compare(t, p_values=False))
    return f.select("pmcid", F.round("sd_size", 4).alias("sd_size"), "n_rows", "n_stats", F.round("sd_t", 5).alias("sd_t"))


@query(
    f"""SELECT a.pmcid, round(coalesce(sd_size, 0), 5) AS sd_size, n_rows, n_stats, round(mean_dp, 5) AS mean_dp, round(sd_t, 5) AS sd_t, round(log_size, 5) AS log_size, 'percent' AS statistic, round(score, 5) AS score, round(ln(n_rows), 5) AS log_rows, round(ln(coalesce(sd_size, 0) + 1), 5) AS log_sd_size
    FROM (SELECT pmcid, stddev_samp(sample_size) AS sd_size, count(DISTINCT "row") AS n_rows, count(DISTINCT statistic) AS n_stats, avg(dp1) AS mean_dp FROM ({bridge.ORDERS_SQL}) GROUP BY 1 HAVING count(DISTINCT "row") >= 3) a
    LEFT JOIN (SELECT pmcid, coalesce(stddev_samp(t), 0) AS sd_t, ln(avg(size)) AS log_size FROM ({bridge.compare_sql(bridge.ORDERS_SQL)}) GROUP BY 1) b ON a.pmcid = b.pmcid LEFT JOIN ({_benford_sql("digit")}) c ON a.pmcid = c.pmcid"""
)
def m24_paper_features_of_counts(spark: SparkSession, d: str) -> DataFrame:
    t = bridge.orders_table(spark, d)
    return rounded(features.paper_features(t, comparisons.compare(t, p_values=False)), 5)


@query(
    f"""SELECT pmcid, ncol, nrow, round(spread, 6) AS size_spread, round(log2(med), 6) AS log2_size, round(p, 6) AS p_continuous, round(dp, 6) AS mean_dp, CASE WHEN lo = hi THEN 'Equal' WHEN spread < 0.1 THEN 'Small' ELSE 'Large' END AS size_class FROM
    (SELECT pmcid, count(DISTINCT "column") AS ncol, count(DISTINCT "row") AS nrow, (max(sample_size) - min(sample_size)) / median(sample_size) AS spread, median(sample_size) AS med, avg(CASE WHEN statistic = 'continuous' THEN 1.0 ELSE 0 END) AS p, avg(dp1) AS dp, min(sample_size) AS lo, max(sample_size) AS hi FROM ({bridge.MIXED_SQL}) GROUP BY 1)"""
)
def m25_p14_table_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.table_features(bridge.mixed_table(spark, d)))


@query("SELECT c_custkey, CASE WHEN count(*) OVER (PARTITION BY c_nationkey) < 60 THEN 'Other' ELSE CAST(c_nationkey AS VARCHAR) END AS nation FROM customer")
def m26_collapse_rare(spark: SparkSession, d: str) -> DataFrame:
    return features.collapse_rare(read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation")), "nation", 60)


_TWO_BY_TWO = "SELECT c_nationkey AS k, count(*) FILTER (WHERE c_custkey % 2 = 0 AND c_acctbal > 4000) AS a, count(*) FILTER (WHERE c_custkey % 2 = 1 AND c_acctbal > 4000) AS b, count(*) FILTER (WHERE c_custkey % 2 = 0 AND c_acctbal <= 4000) AS c, count(*) FILTER (WHERE c_custkey % 2 = 1 AND c_acctbal <= 4000) AS d FROM customer GROUP BY 1"


def _two_by_two(spark: SparkSession, d: str) -> DataFrame:
    even, high = F.col("c_custkey") % 2 == 0, F.col("c_acctbal") > 4000
    n = lambda t, name: F.count_if(t).alias(name)
    return read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(n(even & high, "a"), n(~even & high, "b"), n(even & ~high, "c"), n(~even & ~high, "d"))


@query(f"SELECT k, round({stats.chi_square_yates_sql('a', 'b', 'c', 'd')}, 6) AS chi FROM ({_TWO_BY_TWO})")
def m29_chi_square(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_two_by_two(spark, d).select("k", stats.chi_square_yates(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("chi")))


@query(
    f"""SELECT v AS any_difference, f AS flagged, count(*) AS n FROM (SELECT pmcid, coalesce(var_samp(sample_size), 0) > 0 AS v FROM ({bridge.LINEITEM_SQL}) GROUP BY 1) a
    LEFT JOIN (SELECT pmcid, p_flag >= 0.5 AS f FROM ({_POSTERIOR_SQL})) b ON a.pmcid = b.pmcid GROUP BY ROLLUP (v, f)"""
)
def m31_sizes_by_flag(spark: SparkSession, d: str) -> DataFrame:
    return features.size_variance_by_flag(bridge.lineitem_table(spark, d), _studies(spark, d).select("pmcid", (F.col("p_flag") >= 0.5).alias("flagged")))


@query(f"SELECT p.pmcid, s_name AS name FROM ({_POSTERIOR_SQL}) p LEFT JOIN supplier ON CAST(s_suppkey AS VARCHAR) = p.pmcid WHERE p_flag > 0.3")
def m32_repeat_offenders(spark: SparkSession, d: str) -> DataFrame:
    known = read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("pmcid"), F.col("s_name").alias("name"))
    return posterior.repeat_offenders(_studies(spark, d), known, 0.3).select("pmcid", "name")


@query(
    f"""SELECT a.statistic, count(*) AS n, round(avg(CASE WHEN abs(a.stat1 - b.stat1) <= 0.01 OR abs(a.stat1 - b.stat1) <= 0.01 * abs(b.stat1) THEN 1.0 ELSE 0.0 END), 6) AS match1,
    round(avg(CASE WHEN abs(a.stat2 - b.stat2) <= 0.01 OR abs(a.stat2 - b.stat2) <= 0.01 * abs(b.stat2) THEN 1.0 ELSE 0.0 END), 6) AS match2 FROM ({bridge.MIXED_SQL}) a JOIN (SELECT * REPLACE (stat1 * 1.02 AS stat1, stat2 * CASE WHEN "column" = 1 THEN 1.5 ELSE 1 END AS stat2) FROM ({bridge.MIXED_SQL})) b
    ON a.pmcid = b.pmcid AND a."row" = b."row" AND a."column" = b."column" GROUP BY 1"""
)
def j13_validation_numbers(spark: SparkSession, d: str) -> DataFrame:
    t = bridge.mixed_table(spark, d)
    hand = t.withColumns({"stat1": F.col("stat1") * 1.02, "stat2": F.col("stat2") * F.when(F.col("column") == 1, 1.5).otherwise(1.0)})
    return rounded(validate.numbers(t, hand))
