"""Queries over landed sample files, made rows and simulated papers; their SQL lists the rows expected, or what holds of them."""

from __future__ import annotations

import math
import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsift.functions import stats
from tabsift.functions import text as T
from tabsift.functions.storage import shared_path
from tabsift.operators import comparisons, evidence, features, posterior, rules, simulate, validate
from tabsift.plans import bridge
from tabsift.plans.golden import listed, values
from tabsift.plans.registry import query, read, rounded
from tabsift.plans.screening import _POSTERIOR_SQL, _studies
from tabsift.sources import readers, registry

SAMPLES = os.path.join(os.path.dirname(os.path.abspath(readers.__file__)), "samples")


def sample(name: str) -> str:
    return f"file://{SAMPLES}/{name}"


def text_rows(name: str, f: Callable[[Column], Column], rows: list[tuple[str, object]], kind: str = "string") -> None:
    """A function of texts over made texts."""
    listed(name, "x, y", rows, lambda spark: spark.createDataFrame([(r[0],) for r in rows], "x string").select("x", f(F.col("x")).cast(kind).alias("y")))


# sources

listed("s1_search_results", 'pmid, "Letter", "Clinical Trial"', [(1, 1, 1), (2, 0, 1)], lambda spark: readers.search_results(spark.createDataFrame([(1, "Letter"), (1, "Clinical Trial"), (1, "Letter"), (2, "Clinical Trial"), (2, "Review")], "pmid int, type string"), ["Letter", "Clinical Trial"]))
listed("s2_open_access_list", "pmcid, pmid", [("PMC101", 201), ("PMC103", 203)], lambda spark: readers.open_access_list(spark, sample("open_access.csv")))
listed("s3_summaries", "pmid, title, source, date, doi, pmc", [(201, "A trial", "Trials", "2019-03-01", "10.1/a", "PMC101"), (202, "No identifiers", "Trials", None, None, None), (None, "No number", None, "2021-12-31", None, "PMC103")], lambda spark: readers.summaries(spark, sample("summaries.json")).withColumn("date", F.col("date").cast("string")))
listed("s4_papers", "pmcid, xml", [("PMC101", "<article><body>\n<p>One</p></body></article>\n"), ("PMC102", None)], lambda spark: readers.papers(spark, sample("papers")))
listed("s6_converted_ids", "pmcid, pmid, doi", [("PMC101", 201, "10.1/a"), ("PMC102", None, "10.1/b"), ("PMC103", 203, None)], lambda spark: readers.converted_ids(spark, sample("ids")))
_LINKS = 'x <a href="https://a.org/1.csv?d=1">one</a> href=/local/2.csv <a href="https://a.org/page">p</a> <a href="https://a.org/3.csv">'
listed("s7_csv_links", "page, url", [(1, "https://a.org/1.csv"), (1, 'https://a.org/page">p</a> <a href="https://a.org/3.csv'), (1, "https://a.org/3.csv")], lambda spark: readers.csv_links(spark.createDataFrame([(1, _LINKS), (2, 'href="https://a.org/' + "x" * 300 + '.csv"'), (3, "none")], "page int, html string")))
listed("s8_trial_list", "pmid, doi, num_randomized", [(201, "10.1/a", 40.0), (202, "10.1/b", None), (201, None, 40.0), (203, None, 55.5)], lambda spark: readers.trial_list(spark, [sample("trials_2019.csv"), sample("trials_2020.csv")]))
listed(
    "s9_means_by_trial",
    'pmcid, "row", "column", statistic, stat1, stat2, dp1, dp2, sample_size, journal',
    [("JAMA1", 1.0, 1, "continuous", 50.5, 10.1, 1, 1, 20.0, "JAMA"), ("JAMA1", 1.0, 2, "continuous", 51.0, 9.9, 0, 1, 21.0, "JAMA"), ("NEJM1", 1.0, 1, "continuous", 7.25, 1.5, 2, 1, 30.0, "NEJM"), ("NEJM1", 1.0, 2, "continuous", 7.5, None, 1, 1, 31.0, "NEJM")],
    lambda spark: readers.means_by_trial(spark, {j: sample(f"carlisle/{j}.csv") for j in ("JAMA", "NEJM")}).drop("stat3", "stat4"),
)
_RESULTS = [("saitoh1", 1, 1.0, "continuous", 40.5, 3.0, 15.0), ("saitoh1", 2, 1.0, "continuous", 41.0, 4.0, 16.0), ("saitoh1", 1, 2.0, "numbers", 10.0, 5.0, 15.0), ("saitoh1", 1, 2.0, "numbers", 10.0, 5.0, 15.0), ("saitoh2", 1, 1.0, "continuous", 1.0, 2.0, None)]
listed("s10_s11_results_with_sizes", 'pmcid, "column", "row", statistic, stat1, stat2, sample_size', _RESULTS, lambda spark: readers.results_with_sizes(spark, sample("results.csv"), sample("sizes.csv")).select("pmcid", "column", "row", "statistic", "stat1", "stat2", "sample_size"))
listed("s10_repeated_keys", 'pmcid, "row", "column", n', [("saitoh1", 2.0, 1, 2)], lambda spark: readers.repeated_keys(readers.results_with_sizes(spark, sample("results.csv"), sample("sizes.csv"))))
listed("s12_hand_tables", '"row", statistic, stat1, dp1, sample_size', [(1.0, "continuous", 40.5, 1, 40.0), (2.0, "percent", 10.0, 0, 40.0), (3.0, "min_max", 1.0, 0, 40.0), (4.0, None, 1.0, None, 40.0)], lambda spark: readers.hand_tables(spark, sample("hand_results.csv"), sample("hand_sizes.csv")).select("row", "statistic", "stat1", "dp1", "sample_size"))
listed("s13_lookup_table", "email, country", [(".uk", "United Kingdom"), (".fr", "France")], lambda spark: readers.lookup_table(spark.read.text(sample("lookups.html"), wholetext=True).select(F.lit("p").alias("page"), F.col("value").alias("html")), 2, {"Name[7]": "email", "Entity": "country"}).drop("page"))
listed("s13_lookup_without_heading", "a, b", [("Name[7]", "Notes"), (".uk", "both"), (".fr", "both")], lambda spark: readers.lookup_table(spark.read.text(sample("lookups.html"), wholetext=True).select(F.lit("p").alias("page"), F.col("value").alias("html")), 2, {"c0": "a", "c2": "b"}, header=False).drop("page"))
listed("s14_inline_tables", "a, b", [("x", "1"), ("y z", "2")], lambda spark: registry.parse_inline(spark, "x ! 1\n\n y z!2 ", ["a", "b"]))
listed("s14_publication_types", "include, n", [(0, 13), (1, 10)], lambda spark: registry.publication_types(spark).groupBy("include").agg(F.count(F.lit(1)).alias("n")))
listed("s14_excluded_by_hand", "pmcid, reason", [("PMC1", "Not a trial")], lambda spark: registry.excluded_by_hand(spark, [("PMC1", "Not a trial")]))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def s15_saved_stage(spark: SparkSession, d: str) -> DataFrame:
    return readers.save_stage(read(spark, d, "orders").filter("o_totalprice > 100000").select("o_orderkey", "o_totalprice"), shared_path(spark))


@query("SELECT year(o_orderdate) AS y, count(*) AS n FROM orders WHERE year(o_orderdate) IN (1995, 1996) GROUP BY 1")
def s18_yearly_files(spark: SparkSession, d: str) -> DataFrame:
    root = shared_path(spark)
    for y in (1995, 1996):
        read(spark, d, "orders").filter(F.year("o_orderdate") == y).write.parquet(f"{root}/year{y}.parquet")
    return readers.yearly(spark, f"{root}/year*.parquet").groupBy(F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))


listed(
    "s16_registry",
    "name, path, exclude_non_trials, renumber_columns",
    [("carlisle", "/data/carlisle/processed.parquet", False, False), ("saitoh", "/data/saitoh/processed.parquet", False, False), ("trialstreamer", "/data/trialstreamer/processed.parquet", True, True), ("simulations", "/data/simulations/processed.parquet", False, True)],
    lambda spark: spark.createDataFrame([(s.name, s.path("/data/", "processed"), s.exclude_non_trials, s.renumber_columns) for s in (registry.SOURCES[n] for n in ("carlisle", "saitoh", "trialstreamer", "simulations"))], "name string, path string, exclude_non_trials boolean, renumber_columns boolean"),
)

# texts

text_rows("f10_printable", T.printable, [("a\tb", "a b"), ("é ± ü", "é ± ü"), ("x\u0000y", "x y"), (None, None)])
text_rows("f13_add_percent", T.add_percent, [("12 (34.5)", "12 (34.5%)"), ("12 (34)", "12 (34%)"), ("12 (100.25)", "12 (100.25%)"), ("12(34)", "12(34)"), ("12 (34, 5)", "12 (34, 5)"), ("5 (6) 7 (8)", "5 (6%) 7 (8%)"), (None, None)])
text_rows("f14_flag_median", T.flag_median, [("56 (45–67)", "56  !!! 45–67)"), ("5.5 (4.5 to 6.7)", "5.5  !!! 4.5 to 6.7)"), ("5 (4, 6)", "5  !!! 4, 6)"), ("12 (34)", "12 (34)"), (None, None)])
text_rows("f15_sample_size", T.sample_size_in, [("group a (n = 79)", 79.0), ("A, N=1234", 1234.0), ("n = 5 of n = 6", 6.0), ("drug", None), (None, None)], "double")
text_rows(
    "f16_repairs",
    T.repair_numbers,
    [("(87,105)", "(87 105)"), ("(20-30)", "(20 30)"), ("12,345", "12345"), ("5 000", "5000"), ("1·5", "1.5"), ("−3", "-3"), ("N/A", " "), ("22- 33", "22 33"), ("2,5", "2,5"), ('a<break/>b<italic toggle="yes">c</italic>', "abc"), (None, None)],
)
text_rows("f16_f22_dates", T.dates_to_numbers, [("on 12/31/2019 and", "on 12/31/2019 and"), ("on 31/12/2019 and", "on 18261 and"), ("on 1-2-1970 x", "on 1 x"), ("on 1/2-2019 x", "on 1/2-2019 x"), ("on 01/02/70 x", "on 1 x"), ("on 1/2/68 x", "on 35795 x"), ("on 13/2/99 x", "on 10635 x"), ("1/2/2019", "1/2/2019"), ("a 5/5/1970 5/5/1971 b", "a 124 489 b")])
listed("f17_roman", "n, r", [(n, r) for n, r in ((1, "i"), (4, "iv"), (9, "ix"), (14, "xiv"), (19, "xix"), (20, "xx"))], lambda spark: spark.createDataFrame([(n, T.roman(n)) for n in (1, 4, 9, 14, 19, 20)], "n int, r string"))
text_rows("f20_country_name", T.country_name, [("Dept, London, England", "UK"), ("Seoul, Korea", "South Korea"), ("Beijing, P.R. China", "China"), ("New York", "USA"), ("Paris, France", "France"), (None, None)])


def _countries(spark: SparkSession) -> DataFrame:
    make = spark.createDataFrame
    papers = make(
        [
            ("1 tag", "Paris, France", "Spain"),
            ("2 first named", "Niger and France", None),
            ("3 longest", "Clinic, Nigeria", None),
            ("4 mail", "Clinic, x@b.ac.uk", None),
            ("5 state", "Columbus, Ohio 43", None),
            ("6 capital", "Clinic, Paris", None),
            ("7 part of a word", "Parisian clinic, Ohioan", None),
            ("8 none", "Somewhere", None),
            ("9 null", None, None),
        ],
        "pmcid string, aff string, tag string",
    )
    names = make([("France",), ("Niger",), ("Nigeria",), (None,)], "country string")
    return T.find_country(papers, "pmcid", "aff", names, make([("uk", "UK")], "tld string, country string"), make([("Ohio",)], "state string"), make([("Paris", "France")], "city string, country string"), "tag")


listed("f19_country", "pmcid, country", [("1 tag", "Spain"), ("2 first named", "Niger"), ("3 longest", "Nigeria"), ("4 mail", "UK"), ("5 state", "USA"), ("6 capital", "France"), ("7 part of a word", None), ("8 none", None), ("9 null", None)], _countries)


@query("SELECT s_suppkey AS pmcid, n_name AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def f19_country_of_suppliers(spark: SparkSession, d: str) -> DataFrame:
    nation, make = read(spark, d, "nation"), spark.createDataFrame
    papers = read(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("pmcid"), F.concat(F.lit("Department of Trials, "), F.col("n_name")).alias("aff"))
    return T.find_country(papers, "pmcid", "aff", nation.select(F.col("n_name").alias("country")), make([], "tld string, country string"), make([], "state string"), make([], "city string, country string"))


# statistics


def _interval(spark: SparkSession) -> DataFrame:
    @F.pandas_udf("lower double, upper double")
    def interval(x: pd.Series, n: pd.Series) -> pd.DataFrame:
        lo, hi = stats.exact_binomial_interval(x.to_numpy(), n.to_numpy())
        return pd.DataFrame({"lower": lo, "upper": hi})

    t = spark.createDataFrame([(0, 10), (10, 10), (5, 10), (1, 1), (0, 1), (19, 20)], "x int, n int")
    return rounded(t.select("x", "n", interval("x", "n").alias("ci")).select("x", "n", "ci.lower", "ci.upper"), 5)


_edge = lambda n: round(0.025 ** (1 / n), 5)
listed(
    "a16_exact_interval",
    "x, n, lower, upper",
    [(0, 10, 0.0, round(1 - 0.025**0.1, 5)), (10, 10, _edge(10), 1.0), (5, 10, 0.18709, 0.81291), (1, 1, 0.025, 1.0), (0, 1, 0.0, 0.975), (19, 20, 0.75127, round(0.975 ** (1 / 20), 5))],
    _interval,
)


@query("SELECT round(avg(o_totalprice), 2) AS mean, round(avg(ln(o_totalprice)), 5) AS mean_log FROM orders")
def a17_gamma_fit(spark: SparkSession, d: str) -> DataFrame:
    """What the fitted distribution has for its means is what the data have: the equations of greatest likelihood."""
    m = read(spark, d, "orders").agg(F.avg("o_totalprice").alias("m"), F.avg(F.log("o_totalprice")).alias("l")).first()
    k, rate = stats.gamma_fit(m["m"], m["l"])
    digamma = (math.lgamma(k + 1e-4) - math.lgamma(k - 1e-4)) / 2e-4
    return spark.createDataFrame([(round(k / rate, 2), round(digamma - math.log(rate), 5))], "mean double, mean_log double")


_TWO = "SELECT c_nationkey AS k, count(*) FILTER (WHERE c_custkey % 2 = 0 AND c_acctbal > 4000) AS a, count(*) FILTER (WHERE c_custkey % 2 = 1 AND c_acctbal > 4000) AS b, count(*) FILTER (WHERE c_custkey % 2 = 0 AND c_acctbal <= 4000) AS c, count(*) FILTER (WHERE c_custkey % 2 = 1 AND c_acctbal <= 4000) AS d FROM customer GROUP BY 1"
_CHOOSE = "lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1)"
_LOGP = f"{_CHOOSE.format('r', 'i')} + {_CHOOSE.format('(n - r)', '(col - i)')} - ({_CHOOSE.format('n', 'col')})"


@query(
    f"""WITH t AS (SELECT k, a, a + b AS r, a + c AS col, a + b + c + d AS n FROM ({_TWO})), x AS (SELECT k, a, r, col, n, unnest(range(greatest(0, col - (n - r)), least(r, col) + 1)) AS i FROM t),
    l AS (SELECT k, a, i, {_LOGP} AS lp FROM x), m AS (SELECT k, max(lp) FILTER (WHERE i = a) AS own FROM l GROUP BY 1) SELECT l.k, round(least(1.0, sum(exp(lp)) FILTER (WHERE lp <= own + 1e-7)), 6) AS p FROM l JOIN m ON l.k = m.k GROUP BY 1"""
)
def m30_fisher(spark: SparkSession, d: str) -> DataFrame:
    even, high = F.col("c_custkey") % 2 == 0, F.col("c_acctbal") > 4000
    n = lambda t, name: F.count_if(t).alias(name)
    cells = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(n(even & high, "a"), n(~even & high, "b"), n(even & ~high, "c"), n(~even & ~high, "d"))
    return rounded(cells.select("k", stats.fisher("a", "b", "c", "d").alias("p")))


@query("SELECT o_orderstatus, least(5, count(*)) AS n, true AS known, true AS again FROM orders GROUP BY 1")
def o3_random_sample(spark: SparkSession, d: str) -> DataFrame:
    """Five orders of each status at random: how many, all of that status, and the same ones from a shuffled table."""
    orders = read(spark, d, "orders")
    pick = lambda df: features.sample_per_group(df, "o_orderstatus", "o_orderkey", 5, 17).select("o_orderstatus", "o_orderkey")
    one, two = pick(orders), pick(orders.repartition(7)).withColumn("again", F.lit(True))
    return one.join(two, ["o_orderstatus", "o_orderkey"], "left").join(orders.select("o_orderkey", F.col("o_orderstatus").alias("s")), "o_orderkey").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("s") == F.col("o_orderstatus")).alias("known"), F.coalesce(F.bool_and("again"), F.lit(False)).alias("again"))


@query(
    """WITH n AS (SELECT o_custkey AS series, o_orderkey AS pmcid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders WHERE o_custkey < 50)
    SELECT a.series, s.k AS step, count(*) AS n_rows, CAST(sum(a.pmcid) AS BIGINT) AS keys FROM n a JOIN n s ON a.series = s.series AND a.k <= s.k GROUP BY 1, 2"""
)
def j11_prefixes(spark: SparkSession, d: str) -> DataFrame:
    trials = read(spark, d, "orders").filter("o_custkey < 50").select(F.col("o_custkey").alias("series"), F.col("o_orderkey").alias("pmcid"), "o_orderdate")
    return evidence.prefixes(trials, "series", ["o_orderdate"]).groupBy("series", "step").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("pmcid").alias("keys"))


_FLAG = lambda q: f"CASE WHEN p_flag > {1 - q} THEN 1.0 ELSE 0.0 END"


@query(
    f"""SELECT pmcid, 'mu.var' AS variable, n_rows AS n, round(p_flag * slab_mean, 4) AS mean, CAST(NULL AS DOUBLE) AS median, CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper FROM ({_POSTERIOR_SQL})
    UNION ALL SELECT pmcid, 'var.flag', n_rows, round(p_flag, 4), {_FLAG(0.5)}, {_FLAG(0.025)}, {_FLAG(0.975)} FROM ({_POSTERIOR_SQL})"""
)
def m15_posterior_summaries(spark: SparkSession, d: str) -> DataFrame:
    s = posterior.summarise(_studies(spark, d))
    flag = F.col("nicevar") == "Precision flag"
    return s.select("pmcid", "variable", "n", F.round("mean", 4).alias("mean"), *[F.when(flag, F.col(c)).alias(c) for c in ("median", "lower", "upper")])


def _made_posterior(spark: SparkSession) -> DataFrame:
    rows = [("a", 60.0, 5, 0.99, 2.0, 1.9, -0.5, 4.0), ("b", 60.0, 4, 0.2, -0.1, 0.0, -1.0, 1.0), ("c", 60.0, 3, 0.8, -3.0, -3.1, -5.0, 0.1), ("d", 60.0, 9, 1.0, 20.0, 20.0, 15.0, 25.0)]
    return spark.createDataFrame(rows, "pmcid string, size double, n_rows bigint, p_flag double, mean double, median double, lower double, upper double")


listed("m17_precision_of_flagged", "pmcid, mean, facet, truncated", [("a", 2.0, "Under-dispersed", False), ("c", -3.0, "Over-dispersed", False), ("d", 20.0, "Under-dispersed", True)], lambda spark: posterior.flagged_precision(posterior.summarise(_made_posterior(spark))).select("pmcid", "mean", "facet", "truncated"))
listed(
    "m22_neat_results",
    "mean, lower, upper, var, n_table_rows, type",
    [(2.0, -0.5, 4.0, "mu.var", 5, "all"), (0.99, 1.0, 1.0, "var.flag", 5, "all"), (-3.0, -5.0, 0.1, "mu.var", 3, "all"), (0.8, 0.0, 1.0, "var.flag", 3, "all")],
    lambda spark: evidence.neaten(posterior.summarise(_made_posterior(spark).filter("pmcid IN ('a', 'c')")), "all"),
)


@query(f"""SELECT 'flagged' AS "group", pmcid, 1 AS n FROM (SELECT * FROM ({_POSTERIOR_SQL}) WHERE p_flag >= 0.3 AND n_rows > 2 ORDER BY abs(p_flag * slab_mean) DESC, pmcid LIMIT 3) UNION ALL SELECT 'random', NULL, CAST(least(3, count(*)) AS INTEGER) FROM ({_POSTERIOR_SQL}) WHERE p_flag < 0.3""")
def m18_extreme_papers(spark: SparkSession, d: str) -> DataFrame:
    chosen = posterior.extreme_and_random(posterior.classify(_studies(spark, d), 0.3), 3, 5)
    ok = F.when(F.col("group") == "flagged", F.col("pmcid"))
    return chosen.filter((F.col("group") == "flagged") | (F.col("issue") == "No issue")).groupBy("group", ok.alias("pmcid")).agg(F.count(F.lit(1)).cast("int").alias("n"))


@query(values("better_than_majority, scored, depth_ok", [(True, True, True)]))
def m27_flag_tree(spark: SparkSession, d: str) -> DataFrame:
    """A tree fits what it was fitted to no worse than the commoner class would, and is four deep at most."""
    f = features.table_features(bridge.mixed_table(spark, d)).join(comparisons.compare(bridge.mixed_table(spark, d), p_values=False).groupBy("pmcid").agg((F.avg("t") > 0).cast("double").alias("y")), "pmcid")
    model, got = features.flag_tree(f, "y", ["ncol", "nrow", "size_spread", "log2_size"])
    share = got.agg(F.avg((F.col("y") == F.col("prediction")).cast("double")).alias("right"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))
    return share.select((F.col("right") >= F.greatest("y", 1 - F.col("y"))).alias("better_than_majority"), (F.col("n") > 0).alias("scored"), F.lit(model.depth <= 4).alias("depth_ok"))


@query(values("term, sign, inside", [("words", 1, True)]))
def m28_elastic_net(spark: SparkSession, d: str) -> DataFrame:
    """A text's characters follow from its words, and not from its number: what the penalty keeps, and the intervals of it."""
    x = read(spark, d, "documents").select(F.log2(F.col("n_chars") + 1).alias("y"), F.log2(F.regexp_count("text", F.lit(r"\S+")) + 1).alias("words"), F.pmod("doc_id", F.lit(7)).cast("double").alias("remainder"))
    kept, coefficients, ci = features.elastic_net(x, "y", ["words", "remainder"])
    return spark.createDataFrame([(k, 1 if b > 0 else -1, bool(lo <= b <= hi)) for k, b, (lo, hi) in zip(kept, coefficients, ci)], "term string, sign int, inside boolean")


# validation


def _two_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    schema = "pmcid string, row int, column int, statistic string, stat1 double, stat2 double, sample_size double"
    a = [("A", 1, 1, "continuous", 10.0, 2.0, 20.0), ("A", 1, 2, "continuous", 11.0, 2.0, 21.0), ("A", 2, 1, "percent", 5.0, 25.0, 20.0), ("A", 2, 2, "percent", 6.0, 30.0, 21.0), ("B", 1, 1, "median", 1.0, 2.0, 9.0), ("C", 1, 1, "ci", 1.0, 2.0, 8.0)]
    h = [("A", 1, 1, "continuous", 10.05, 2.0, 20.0), ("A", 1, 2, "continuous", 11.0, 3.0, 22.0), ("A", 2, 1, "numbers", 5.0, 25.0, 20.0), ("A", 2, 2, "numbers", 6.5, 30.0, 22.0), ("B", 1, 1, "median", 1.0, 2.0, 9.0), ("B", 2, 1, "median", 1.0, 2.0, 9.0)]
    return spark.createDataFrame(a, schema), spark.createDataFrame(h, schema)


listed("j13_dimensions", "pmcid, rows_a, columns_a, rows_h, columns_h, row_diff, column_diff", [("A", 2, 2, 2, 2, 0, 0), ("B", 1, 1, 2, 1, -1, 0)], lambda spark: validate.dimensions(*_two_tables(spark)))
listed("j13_kinds", "algorithm, hand, n", [("continuous", "continuous", 1), ("percent", "numbers", 1)], lambda spark: validate.kinds(*_two_tables(spark)))
listed("j13_numbers", "statistic, n, match1, match2", [("continuous", 2, 1.0, 0.5), ("numbers", 2, 0.5, 1.0)], lambda spark: validate.numbers(*_two_tables(spark)))
listed("j13_sample_sizes", 'pmcid, "column", size_a, size_h, difference', [("A", 1, 20.0, 20.0, 0.0), ("A", 2, 21.0, 22.0, -1.0), ("B", 1, 9.0, 9.0, 0.0), ("C", 1, 8.0, None, None)], lambda spark: validate.sample_sizes(*_two_tables(spark)))
listed("j13_total_sizes", "pmid, total, num_randomized, within", [(1, 41.0, 45.0, True), (2, 9.0, 20.0, False)], lambda spark: validate.total_sizes(_two_tables(spark)[0].filter("pmcid < 'C'").withColumn("pmid", F.when(F.col("pmcid") == "A", 1).otherwise(2)), spark.createDataFrame([(1, 45.0), (2, 20.0), (3, 5.0)], "pmid int, num_randomized double")))
listed("j5_exclusions", "algorithm, hand, n", [(True, True, 1), (False, True, 1), (False, False, 1), (None, False, 1)], lambda spark: validate.exclusions(spark.createDataFrame([("A", True), ("B", False), ("C", False)], "pmcid string, excluded boolean"), spark.createDataFrame([("A", True), ("B", True), ("C", False), ("D", False)], "pmcid string, excluded boolean")))

# rules: a study for each, of two groups of 50 unless it says otherwise

_KEEPS = [("continuous", 40.0, 5.0, None, None, 1, 1), ("continuous", 41.0, 5.0, None, None, 1, 1)]
#: Of each rule: the cells of its row as (statistic, stat1..stat4, dp1, dp2[, size]), and what is left of them as (statistic, stat1, stat2, stat3), or the reason they went.
_RULES: dict[str, tuple[list[tuple], list[tuple] | str]] = {
    "0": ([("continuous", 40.0, 5.0, None, None, 1, 1, 2.0), ("continuous", 41.0, 5.0, None, None, 1, 1)], "Trials with sample size under three"),
    "a": ([("continuous", 40.0, 5.0, None, None, 1, 1, 50.5), ("continuous", 41.0, 5.0, None, None, 1, 1)], "Trials with non-integer sample size"),
    "b": ([("numbers", 10.0, 20.0, None, None, 0, 1), ("numbers", 20.0, 40.0, None, None, 0, 0)], [("percent", 10.0, 20.0, None), ("percent", 20.0, 40.0, None)]),
    "c": ([("continuous", 10.0, 50.0, 20.0, None, 0, 0), ("continuous", 20.0, 50.0, 40.0, None, 0, 0)], [("percent", 10.0, 20.0, 20.0), ("percent", 20.0, 40.0, 40.0)]),
    "d": ([("continuous", 55.5, 50.0, 60.0, None, 1, 0), ("continuous", 56.5, 50.0, 61.0, None, 1, 0)], [("median", 55.5, 50.0, 60.0), ("median", 56.5, 50.0, 61.0)]),
    "e": ([("median", 55.5, 5.0, None, None, 1, 1), ("median", 56.5, 5.5, None, None, 1, 1)], [("continuous", 55.5, 5.0, None), ("continuous", 56.5, 5.5, None)]),
    "f": ([("continuous", 10.0, None, None, None, 0, None), ("continuous", 12.0, None, None, None, 0, None)], [("percent", 10.0, None, None), ("percent", 12.0, None, None)]),
    "g": ([("percent", 20.5, None, None, None, 1, None), ("percent", 41.5, None, None, None, 1, None)], [("percent", 10.0, None, None), ("percent", 21.0, None, None)]),
    "h1a": ([("percent", 20.0, 10.0, None, None, 0, 0), ("percent", 40.0, 20.0, None, None, 0, 0)], [("percent", 10.0, 20.0, None), ("percent", 20.0, 40.0, None)]),
    "h1b": ([("median", 20.0, 10.0, None, None, 0, 0), ("median", 40.0, 20.0, None, None, 0, 0)], [("percent", 10.0, 20.0, None), ("percent", 20.0, 40.0, None)]),
    "h2": ([("percent", 10.5, 21.0, None, None, 1, 0), ("percent", 20.0, 40.0, None, None, 0, 0)], "Numbers that are not integers"),
    "k": ([("percent", 10.0, 25.0, None, None, 0, 0), ("percent", 20.0, 40.0, None, None, 0, 0)], "Not a percent"),
    "l": ([("min_max", 10.0, 21.0, None, None, 0, 0), ("min_max", 20.0, 40.0, None, None, 0, 0)], [("percent", 10.0, 21.0, None), ("percent", 20.0, 40.0, None)]),
    "m1": ([("continuous", 60.0, None, None, None, 0, None), ("continuous", 70.0, None, None, None, 0, None)], "No second statistic for continuous/median (results)"),
    "m2": ([("percent", 60.0, None, None, None, 0, None), ("percent", 20.0, None, None, None, 0, None)], "Guessed percent but n > sample size (rows)"),
    "p": ([("continuous", 40.5, 0.0, None, None, 1, 0), ("continuous", 41.0, 5.0, None, None, 1, 1)], [("continuous", 40.5, 0.405001, None), ("continuous", 41.0, 5.0, None)]),
    "q2": ([("ci", 70.5, 50.0, 60.0, None, 1, 0), ("ci", 56.5, 50.0, 61.0, None, 1, 0)], [("continuous", 70.5, 50.0, 60.0), ("continuous", 56.5, 50.0, 61.0)]),
    "q3": ([("ci", 55.5, 50.0, 60.0, None, 1, 0), ("ci", 56.5, 50.0, 61.0, None, 1, 0)], [("ci", 55.5, round(math.sqrt(50) * 10 / (2 * 1.959963984540054), 6), None), ("ci", 56.5, round(math.sqrt(50) * 11 / (2 * 1.959963984540054), 6), None)]),
    "r": ([("percent", 20.0, 15.0, 60.0, None, 0, 0), ("percent", 20.0, 19.0, 61.0, None, 0, 0)], "Not a percent"),
    "z": ([("median", 10.0, None, 4.0, None, 0, None), ("median", 12.0, None, 4.0, None, 0, None)], [("percent", 10.0, None, 4.0), ("percent", 12.0, None, 4.0)]),
    "w": ([("continuous", 40.0, -5.0, None, None, 1, 1), ("continuous", 41.0, 5.0, None, None, 1, 1)], "Rows with negative standard deviation"),
    "b2": ([("numbers", 20.5, None, None, None, 1, None), ("numbers", 40.0, None, None, None, 0, None)], [("numbers", 10.0, None, None), ("numbers", 40.0, None, None)]),
    "none": (_KEEPS, [("continuous", 40.0, 5.0, None), ("continuous", 41.0, 5.0, None)]),
    "last": ([_KEEPS[0]], "Only one result per row"),
}
_RULES["r"] = ([("percent", 20.0, None, None, None, 0, 0), ("percent", 25.0, 49.5, 60.0, None, 0, 0)], [("percent", 20.0, None, None), ("percent", 25.0, 49.5, 60.0)])
_BY_CELL = {"o": ("percent", -3.0, None, None, None, 0, None, "Negative percent"), "q1": ("ci", 55.0, 60.0, 50.0, None, 1, 0, "Upper CI interval less than lower (results)"), "i": ("min_max", 55.5, None, 4.0, None, 1, None, "No second statistic for continuous/median (results)")}


def _rule_rows(spark: SparkSession) -> DataFrame:
    out: list[tuple] = []
    for key, (cells, _) in _RULES.items():
        for k, c in enumerate(cells):
            out.append((key, 1.0, k + 1, *c[:7], c[7] if len(c) > 7 else 50.0))
    for key, c in _BY_CELL.items():
        kind = c[0]
        others = {"percent": ("percent", 20.0, None, None, None, 0, None), "ci": ("ci", 55.0, 50.0, 60.0, None, 1, 0), "min_max": ("min_max", 55.5, 3.0, None, None, 1, 1)}[kind]
        out += [(key, 1.0, 1, *c[:7], 50.0), (key, 1.0, 2, *others, 50.0), (key, 1.0, 3, *others, 50.0)]
    out += [("pre", 1.0, k + 1, *_KEEPS[0], 50.0) for k in range(8)] + [("pre of seven", 1.0, k + 1, *_KEEPS[0], 50.0) for k in range(7)]
    return spark.createDataFrame(out, "pmcid string, row double, column int, statistic string, stat1 double, stat2 double, stat3 double, stat4 double, dp1 int, dp2 int, sample_size double")


def _rule_result(spark: SparkSession) -> DataFrame:
    marked = rules.mark(_rule_rows(spark))
    gone = F.col("dropped").isNotNull()
    show = lambda c: F.when(~gone, F.round(c, 6) if c.startswith("stat") and c != "statistic" else F.col(c)).alias(c)
    return marked.select(F.col("pmcid").alias("rule"), "column", *[show(c) for c in ("statistic", "stat1", "stat2", "stat3")], "dropped")


def _rule_expected() -> list[tuple]:
    out: list[tuple] = []
    for key, (cells, want) in _RULES.items():
        for k in range(len(cells)):
            out.append((key, k + 1, None, None, None, None, want) if isinstance(want, str) else (key, k + 1, *want[k], None))
    z = 1.959963984540054
    stays = {"o": ("percent", 20.0, None, None), "q1": ("ci", 55.0, round(math.sqrt(50) * 10 / (2 * z), 6), None), "i": ("min_max", 55.5, 3.0, None)}
    for key, c in _BY_CELL.items():
        out += [(key, 1, None, None, None, None, c[7]), *((key, k, *stays[key], None) for k in (2, 3))]
    out += [("pre", k + 1, None, None, None, None, "Trials with eight or more columns") for k in range(8)] + [("pre of seven", k + 1, "continuous", 40.0, 5.0, None, None) for k in range(7)]
    return out


listed("rules_one_by_one", 'rule, "column", statistic, stat1, stat2, stat3, dropped', _rule_expected(), _rule_result)
listed("rule_n_and_pvals", "check_name, n", [("percent outside 0 to 100", 2), ("p values kept", 2)], lambda spark: rules.counted(spark.createDataFrame([("percent", 150.0, None), ("percent", -1.0, None), ("percent", 100.0, None), ("percent", None, None), ("pvals", 0.5, None), ("pvals", 1.5, None), ("pvals", 1.0, None), ("continuous", 200.0, 1.0)], "statistic string, stat1 double, stat2 double")))

# simulations: what holds of the draws of a seed


def _near(x: Column, value: float, within: float) -> Column:
    return F.abs(x - value) <= within


def _holds(name: str, columns: list[str], run: Callable[[SparkSession], DataFrame], keys: list[tuple] = [()], key_names: str = "") -> None:
    listed(name, ", ".join([*([key_names] if key_names else []), *columns]), [(*k, *[True] * len(columns)) for k in keys], run)


def _by_issue(df: DataFrame, *checks: Column) -> DataFrame:
    return df.groupBy("issue").agg(*checks)


def _g1(spark: SparkSession) -> DataFrame:
    t = simulate.first_scenarios(spark, 3, 150, 80, 80)
    c = comparisons.compare(t, p_values=False).join(t.select("pmcid", "issue").distinct(), "pmcid")
    wanted = F.when(F.col("issue") == "none", 1.0).when(F.col("issue") == "too variable", 1.9).otherwise(0.1)
    spread = c.groupBy("issue").agg((F.abs(F.var_samp("t") / F.first(wanted) - 1) < 0.2).alias("variance_of_t"))
    shape = _by_issue(t, (F.countDistinct("pmcid") >= 80).alias("papers"), F.bool_and(F.col("statistic") == "continuous").alias("means_only"), (F.min("sample_size") >= 4).alias("least_size"), F.bool_and(F.bround("stat1", 1) == F.col("stat1")).alias("digits"))
    rows = t.groupBy("issue", "pmcid").agg(F.max("row").alias("r"), F.countDistinct("sample_size").alias("s"), F.countDistinct("column").alias("c")).groupBy("issue").agg(((F.min("r") >= 3) & (F.max("s") == 1) & (F.min("c") == 2)).alias("tables"))
    return shape.join(spread, "issue").join(rows, "issue")


_ISSUES = [("none",), ("too variable",), ("too precise",)]
_holds("g1_correlated_groups", ["papers", "means_only", "least_size", "digits", "variance_of_t", "tables"], _g1, _ISSUES, "issue")


def _pairs(df: DataFrame) -> DataFrame:
    """Both groups of a row of two side by side."""
    return df.groupBy("issue", "pmcid", "row", "statistic").agg(*[F.max(F.when(F.col("column") == k, F.col(c))).alias(f"{c}_{k}") for k in (1, 2) for c in ("stat1", "stat2")], F.max("sample_size").alias("n"))


def _g1_counts(spark: SparkSession) -> DataFrame:
    t = simulate.table1(spark, 60, "none", 5).unionByName(simulate.table1(spark, 60, "too precise", 6, rho=0.9))
    p = _pairs(t).withColumn("off", F.abs(F.col("stat1_1") - F.col("stat1_2")))
    counts, precise = F.col("statistic") == "percent", F.col("issue") == "too precise"
    return _by_issue(p, _near(F.avg(counts.cast("double")), 0.67, 0.05).alias("share_of_counts"), F.bool_and(~counts | (F.col("stat1_2").between(0, F.col("n")) & F.col("stat2_2").isNull())).alias("possible"), F.bool_and(~(counts & precise) | (F.col("off") <= 2)).alias("two_apart"))


_holds("g1_counts", ["share_of_counts", "possible", "two_apart"], _g1_counts, [("none",), ("too precise",)], "issue")


def _g2(spark: SparkSession) -> DataFrame:
    t = simulate._union([simulate.moved(spark, 80, i[0], 7 + k) for k, i in enumerate(_ISSUES)])
    p = _pairs(t).withColumn("off", F.abs(F.col("stat1_1") - F.col("stat1_2")))
    counts = F.col("statistic") == "percent"
    step = F.when(F.col("issue") == "too variable", (F.col("off") == 0) | (F.col("off") == F.col("n") / 2) | F.col("stat1_2").isin(0) | (F.col("stat1_2") == F.col("n"))).when(F.col("issue") == "too precise", F.col("off") <= 2).otherwise(True)
    # all means of a table step alike, but for their rounding
    spread = p.filter(~counts).groupBy("issue", "pmcid").agg((F.max(F.col("stat1_2") - F.col("stat1_1")) - F.min(F.col("stat1_2") - F.col("stat1_1"))).alias("w")).groupBy("issue").agg(((F.first("issue") == "none") | (F.max("w") < 0.21)).alias("means_alike"))
    return _by_issue(p, F.bool_or(counts).alias("has_counts"), F.bool_or(~counts).alias("has_means"), F.bool_and(~counts | (step & F.col("stat1_2").between(0, F.col("n")))).alias("steps")).join(spread, "issue")


_holds("g2_moved_groups", ["has_counts", "has_means", "steps", "means_alike"], _g2, _ISSUES, "issue")


def _g3(spark: SparkSession) -> DataFrame:
    t = simulate.categorical(spark, 80, 11)
    v = t.withColumn("v", F.floor((F.col("row") - 1) / 3)).groupBy("pmcid", "v", "column").agg(F.sum("stat1").alias("total"), F.max("sample_size").alias("n"), F.count(F.lit(1)).alias("k"), F.max(F.when(F.pmod("row", F.lit(3.0)) == 0, F.col("stat1"))).alias("third"))
    return v.agg(F.bool_and(F.col("total") == F.col("n")).alias("adds_up"), F.bool_and(F.col("k") == 3).alias("three_rows"), _near(F.sum("third") / F.sum("n"), 28 / 42, 0.04).alias("third_share"), (F.countDistinct("pmcid") == 80).alias("papers"))


_holds("g3_categories", ["adds_up", "three_rows", "third_share", "papers"], _g3)


def _g4(spark: SparkSession) -> DataFrame:
    t = simulate._union([simulate.copied(spark, 80, i[0], 13 + k, simulate.Shape(p_continuous=0.5, digits=6)) for k, i in enumerate(_ISSUES)])
    p = _pairs(t).withColumn("same", F.col("stat1_1") == F.col("stat1_2"))
    w = p.groupBy("issue", "pmcid", "statistic").agg(F.count(F.lit(1)).alias("k"), F.count_if("same").alias("same"), F.count_if(F.col("stat2_1") == F.col("stat2_2")).alias("same_sd"), F.min(F.when(F.col("same"), F.col("row"))).alias("first"), F.min("row").alias("top"))
    copied = F.when(F.col("statistic") == "continuous", F.col("same") == F.greatest(F.bround(F.col("k") / 2), F.lit(1))).otherwise(F.col("same") >= F.bround(F.col("k") / 2))
    precise = F.col("issue") == "too precise"
    return _by_issue(w, F.bool_and(~precise | copied).alias("share_copied"), F.bool_and(~precise | F.col("first").isNull() | (F.col("first") == F.col("top"))).alias("from_the_first"), F.bool_and((F.col("statistic") != "continuous") | (F.col("same_sd") == 0)).alias("deviations_differ"), F.bool_or(F.col("statistic") == "percent").alias("has_counts"))


_holds("g4_copied_results", ["share_copied", "from_the_first", "deviations_differ", "has_counts"], _g4, _ISSUES, "issue")


def _g5(spark: SparkSession) -> DataFrame:
    """The t of different rows of a paper correlate as the variables do."""
    t = simulate.correlated(spark, 250, "Correlated 0.6", 17, 0.6, simulate.Shape(digits=4))
    c = comparisons.compare(t, p_values=False)
    two = c.groupBy("pmcid").agg(F.max(F.when(F.col("row") == 1, F.col("t"))).alias("a"), F.max(F.when(F.col("row") == 2, F.col("t"))).alias("b"))
    return two.agg(_near(F.corr("a", "b"), 0.6, 0.12).alias("correlation"), _near(F.var_samp("a"), 1.0, 0.25).alias("variance"))


_holds("g5_correlated_variables", ["correlation", "variance"], _g5)


def _g6(spark: SparkSession) -> DataFrame:
    t = simulate.three_arms(spark, 60, 19)
    c = comparisons.compare(t, p_values=False)
    return t.agg((F.max("column") == 3).alias("three"), _near(F.avg((F.col("statistic") == "percent").cast("double")), 0.5, 0.06).alias("half_counts")).crossJoin(c.agg(_near(F.var_samp("t"), 1.0, 0.2).alias("variance"), (F.count(F.lit(1)) == t.count()).alias("three_pairs")))


_holds("g6_three_arms", ["three", "half_counts", "variance", "three_pairs"], _g6)
_holds("g7_blocking", ["simple", "blocked", "n"], lambda spark: simulate.blocking(spark, 400, 3).agg(_near(F.stddev_samp("simple"), 1.0, 0.12).alias("simple"), _near(F.stddev_samp("blocked"), 1.0, 0.15).alias("blocked"), (F.count(F.lit(1)) == 400).alias("n")))


def _g8(spark: SparkSession) -> DataFrame:
    c = comparisons.compare(simulate.mirrored_gender(spark, 200, 23), p_values=False).groupBy("pmcid").agg(F.max(F.when(F.col("row") == 1, F.col("t"))).alias("a"), F.max(F.when(F.col("row") == 2, F.col("t"))).alias("b"))
    return c.agg((F.corr("a", "b") < -0.99).alias("mirrored"))


_holds("g8_mirrored_gender", ["mirrored"], _g8)


def _g9(spark: SparkSession) -> DataFrame:
    t = simulate.scenarios(spark, 30, 29).unionByName(simulate.extra_scenarios(spark, 30, 41))
    flags = posterior.classify(posterior.posterior(comparisons.compare(t, p_values=False))).join(t.select("pmcid", "issue").distinct().withColumnRenamed("issue", "scenario"), "pmcid")
    n = flags.groupBy("scenario").agg(F.avg((F.col("issue") == "Under-dispersed").cast("double")).alias("under"), F.avg((F.col("issue") == "Over-dispersed").cast("double")).alias("over"), F.countDistinct("pmcid").alias("papers"))
    expected = F.when(F.col("scenario") == "too variable", F.col("over") > 0.6).when(F.col("scenario") == "too precise", F.col("under") > 0.15).when(F.col("scenario").startswith("Correlated") | (F.col("scenario") == "categorical"), F.lit(True)).otherwise(F.col("under") + F.col("over") < 0.25)
    return n.select("scenario", expected.alias("flags_as_known"), (F.col("papers") == 30).alias("papers"))


_SCENARIOS = ["small binary", "large binary", "skewed", "none", "rounded", "too precise", "too variable", "categorical", "none continuous", "Correlated 0.2", "Correlated 0.6", "3arms"]
_holds("g9_scenarios", ["flags_as_known", "papers"], _g9, [(s,) for s in _SCENARIOS], "scenario")


def _g9_sweeps(spark: SparkSession) -> DataFrame:
    rows = simulate.by_rows(spark, 20, 51).groupBy("issue", "size").agg(F.countDistinct("pmcid").alias("papers"), F.max("row").cast("int").alias("most_rows"), F.round(F.avg("sample_size")).cast("int").alias("group_size"))
    sizes = simulate.by_size(spark, 20, 52).filter("issue LIKE 'too precise%'").groupBy("issue", "size").agg(F.countDistinct("pmcid").alias("papers"), F.lit(None).cast("int").alias("most_rows"), F.round(F.avg("sample_size")).cast("int").alias("group_size"))
    return rows.unionByName(sizes)


listed(
    "g9_size_sweeps",
    "issue, size, papers, most_rows, group_size",
    [(f"too precise, size = {k + 1}", float(k + 1), 20, n, 60) for k, n in enumerate((14, 28, 56))] + [("none", 99.0, 20, 14, 60), ("too variable", 99.0, 20, 14, 60)] + [(f"too precise, size = {n}", float(n), 20, None, n) for n in (60, 120, 240)],
    _g9_sweeps,
)
