"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabsift.llm import htmlpaths, linededup, mixing, ngram_lm, packing, quality, secretscan, simhash, syncmers, tokencount

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, duplicate_of) for every document that near-dedup removes."""
    return simhash.near_duplicates(_documents(spark, sf_dir))


QUERIES["op1_simhash"] = op1_simhash


def op2_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_kmers, positions, hashes) of every document."""
    return syncmers.fingerprints(_documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens) of every document."""
    return tokencount.token_counts(_documents(spark, sf_dir))


QUERIES["op2_syncmers"] = op2_syncmers
QUERIES["op10_token_counts"] = op10_token_counts


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source) of the documents that no rule rejects."""
    return quality.keep_good(_documents(spark, sf_dir)).select("doc_id", "lang", "source")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a first scan, at every path."""
    return secretscan.scan_documents(_documents(spark, sf_dir))[0]


QUERIES["op6_quality"] = op6_quality
ORACLE["op6_quality"] = f"SELECT doc_id, lang, source FROM documents WHERE {quality.keep_sql()}"
QUERIES["op8_secrets"] = op8_secrets
ORACLE["op8_secrets"] = secretscan.report_sql()


def op3_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, removed) of the documents that keep a word; removed has runs of words, (lo, stop)."""
    return linededup.drop_repeated_lines(_documents(spark, sf_dir), removed="removed").select("doc_id", "text", "removed")


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, log_prob, perplexity) of every document, by a model of all documents."""
    docs = _documents(spark, sf_dir)
    return ngram_lm.score(docs, ngram_lm.train(docs))


QUERIES["op3_linededup"] = op3_linededup
QUERIES["op5_lm_scores"] = op5_lm_scores


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bin_id, doc_id, piece, start_word, n_words) of every piece of every document."""
    return packing.pack_documents(_documents(spark, sf_dir))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, text, n_nodes, n_kept) of every page."""
    return htmlpaths.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES["op4_packing"] = op4_packing
QUERIES["op9_html"] = op9_html


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, p_good, p_toxic, p_poor, rate) of every document."""
    return mixing.document_rates(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES["op7_mixing"] = op7_mixing
