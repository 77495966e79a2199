"""Readers of landed files. Nothing is fetched: searches and downloads are expected as files in a folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsift.functions.na import as_number
from tabsift.operators.relational import clean_names, indicators

OPEN_ACCESS = "file string, citation string, accession_id string, last_updated string, pmid string, license string"


def open_access_list(spark: SparkSession, path: str) -> DataFrame:
    """(pmcid, pmid) of the list of open-access papers, a CSV file with a header."""
    raw = spark.read.schema(OPEN_ACCESS).option("header", True).csv(path)
    return raw.select(F.col("accession_id").alias("pmcid"), F.col("pmid").try_cast("bigint").alias("pmid")).filter("pmid IS NOT NULL")


SUMMARY = "uid string, title string, source string, sortpubdate string, articleids array<struct<idtype string, value string>>, pubtypes array<string>"


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """S3: (pmid, title, source, date, doi, pmc) of landed JSON summaries; ids are picked from their nested list."""
    raw = spark.read.schema(SUMMARY).json(path)
    pick = lambda kind: F.get(F.filter("articleids", lambda x: x["idtype"] == kind), F.lit(0))["value"]
    return raw.select(F.col("uid").try_cast("bigint").alias("pmid"), "title", "source", F.try_to_timestamp("sortpubdate", F.lit("yyyy/MM/dd HH:mm")).cast("date").alias("date"), pick("doi").alias("doi"), pick("pmc").alias("pmc"))


def search_results(found: DataFrame, types: list[str]) -> DataFrame:
    """(pmid, one 0/1 column per publication type) of landed rows (pmid, type)."""
    return indicators(found, "pmid", "type", types)


def papers(spark: SparkSession, path: str) -> DataFrame:
    """(pmcid, xml) of a folder of XML files named by id; an empty file is an unavailable paper."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"(PMC[0-9]+)", 1).alias("pmcid"), F.col("value").alias("xml"))
    return raw.withColumn("xml", F.when(F.col("xml").rlike(r"\S"), F.col("xml")))


def converted_ids(spark: SparkSession, path: str) -> DataFrame:
    """(pmcid, pmid, doi) of replies of an id converter; every record of every batch, the first and the last too."""
    schema = "_pmcid string, _pmid string, _doi string"
    raw = spark.read.format("xml").option("rowTag", "record").schema(schema).load(path)
    return raw.select(F.col("_pmcid").alias("pmcid"), F.col("_pmid").try_cast("bigint").alias("pmid"), F.col("_doi").alias("doi")).distinct()


def csv_links(pages: DataFrame, most: int = 200) -> DataFrame:
    """(page, url) of the full addresses of CSV files on a link page: from each href to the closest .csv after it, ``most`` characters at most."""
    after = F.slice(F.split("html", "href="), F.lit(2), F.size(F.split("html", "href=")))
    # up to the closest .csv, which may lie beyond the next href
    rest = F.transform(after, lambda x, i: F.array_join(F.slice(after, i + 1, F.size(after)), "href="))
    url = F.transform(rest, lambda x: F.regexp_extract(x, r"(?s)^(.*?\.csv)", 1))
    found = F.filter(F.transform(url, lambda u: F.regexp_replace(u, "^[\"']", "")), lambda u: F.startswith(u, F.lit("https")))
    return pages.select("page", F.explode(found).alias("url")).filter(F.length("url") < most).distinct()


def html_tables(pages: DataFrame) -> DataFrame:
    """(page, table_no, r, c, text): the cells of every table of (page, html), tables counted from 1."""
    from tabsift.operators import tables

    one = pages.select("page", F.posexplode(F.split("html", "(?i)(?=<table)")).alias("table_no", "wrap")).filter("table_no > 0")
    packed = one.select(F.to_json(F.struct("page", "table_no")).alias("pmcid"), "wrap")
    key = F.from_json("pmcid", "page string, table_no int")
    return tables.cells(packed).select(key["page"].alias("page"), key["table_no"].alias("table_no"), "r", "c", "text")


def lookup_table(pages: DataFrame, table_no: int, columns: dict[str, str], header: bool = True) -> DataFrame:
    """A lookup of the n-th table of a page: ``columns`` maps headings, or c0, c1 and so on without ``header``, to names."""
    cells = html_tables(pages).filter(F.col("table_no") == table_no)
    head = cells.filter("r = 0").select("page", "c", F.col("text").alias("heading")) if header else cells.select("page", "c", F.concat(F.lit("c"), F.col("c").cast("string")).alias("heading")).distinct()
    body = cells.filter(F.col("r") >= int(header)).join(head, ["page", "c"])
    wide = body.groupBy("page", "r").agg(*[F.max(F.when(F.col("heading") == k, F.col("text"))).alias(v) for k, v in columns.items()])
    return wide.select("page", *columns.values())


TRIALSTREAMER = ["pmid", "doi", "num_randomized"]


def trial_list(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(pmid, doi, num_randomized) of files whose headings differ in style; equal rows once."""
    one = lambda p: clean_names(spark.read.option("header", True).csv(p))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [one(p) for p in paths])
    for c in TRIALSTREAMER:
        if c not in both.columns:
            both = both.withColumn(c, F.lit(None).cast("string"))
    return both.select(F.col("pmid").try_cast("bigint").alias("pmid"), "doi", as_number(F.col("num_randomized")).alias("num_randomized")).distinct()


def _sheet(spark: SparkSession, path: str) -> DataFrame:
    return clean_names(spark.read.option("header", True).csv(path))


def _number(df: DataFrame, *names: str) -> Column:
    """The first of several headings that a sheet has, as a number."""
    have = [n for n in names if n in df.columns]
    return as_number(F.col(have[0])) if have else F.lit(None).cast("double")


def means_by_trial(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Sheets of means by trial, one CSV file for each journal, as a table of summary statistics with ``journal``.

    Trials are numbered by journal; those of which there is one group only go.
    """
    parts = []
    for journal, path in sorted(paths.items()):
        s = _sheet(spark, path)
        parts.append(
            s.select(
                F.concat(F.lit(journal), F.col("trial")).alias("pmcid"),
                _number(s, "measure").alias("row"),
                _number(s, "group").cast("int").alias("column"),
                F.lit("continuous").alias("statistic"),
                _number(s, "mean").alias("stat1"),
                _number(s, "sd").alias("stat2"),
                F.lit(None).cast("double").alias("stat3"),
                F.lit(None).cast("double").alias("stat4"),
                _number(s, "dec_m", "decm", "dec_mean").cast("int").alias("dp1"),
                _number(s, "decsd", "dec_sd").cast("int").alias("dp2"),
                _number(s, "number_in_group", "number", "n").alias("sample_size"),
                F.lit(journal).alias("journal"),
            )
        )
    last = F.max("column").over(Window.partitionBy("pmcid"))
    return reduce(DataFrame.unionByName, parts).withColumn("last", last).filter("last > 1").drop("last")


def results_with_sizes(spark: SparkSession, results: str, sizes: str) -> DataFrame:
    """A sheet of results joined with a sheet of sample sizes, as a table of summary statistics."""
    r, n = _sheet(spark, results), _sheet(spark, sizes)
    keys = [F.col("pmcid"), _number(r, "column").cast("int").alias("column")]
    kind = F.when(F.col("statistic") == "number", "numbers").otherwise(F.col("statistic"))
    dp = lambda c: F.lit(None).cast("int") if c not in r.columns else as_number(F.col(c)).cast("int")
    left = r.select(*keys, _number(r, "row").alias("row"), kind.alias("statistic"), *[_number(r, f"stat{i}").alias(f"stat{i}") for i in (1, 2, 3, 4)], dp("dp1").alias("dp1"), dp("dp2").alias("dp2"))
    return left.join(n.select("pmcid", _number(n, "column").cast("int").alias("column"), _number(n, "sample_size", "n").alias("sample_size")), ["pmcid", "column"], "left")


def repeated_keys(table: DataFrame) -> DataFrame:
    """Cells that are there more than once; a good sheet has none."""
    return table.groupBy("pmcid", "row", "column").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


HAND_KINDS = {"n": "numbers", "number": "numbers", "mean": "continuous", "continuous": "continuous", "mean sd": "continuous", "percent": "percent", "n %": "percent", "%": "percent", "median": "median", "min max": "min_max", "range": "min_max", "ci": "ci", "p": "pvals"}


def hand_tables(spark: SparkSession, results: str, sizes: str) -> DataFrame:
    """Hand-entered results; types in free wording are recoded, and unknown ones are null."""
    t = results_with_sizes(spark, results, sizes)
    plain = F.trim(F.regexp_replace(F.lower("statistic"), r"[^a-z%]+", " "))
    known = F.create_map(*[F.lit(x) for kv in HAND_KINDS.items() for x in kv])
    return t.withColumn("statistic", known[plain])


def yearly(spark: SparkSession, pattern: str) -> DataFrame:
    """All years' Parquet files as one table."""
    return spark.read.parquet(pattern)


def save_stage(df: DataFrame, path: str) -> DataFrame:
    """A stage's result as Parquet, read back for the next."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
