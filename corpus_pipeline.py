"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns of docs. The defined results
for nulls, empty and long texts, ties and repeated rows are those of the stages'
operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabsift.llm import linededup, mixing, packing, quality, simhash
from tabsift.llm.common import shared_dir, stash

#: After the quality rules little poor text is left to mix in.
TARGETS = {"good": 0.97, "toxic": 0.02, "poor": 0.01}
#: No document is taken more often; what of the targets this puts out of reach is warned of.
MOST_TIMES = 4.0


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later runs of words that repeat earlier ones go; so do documents of which they are more than half: what would be left of them are the edits of a near copy."""
    return linededup.drop_repeated_lines(docs, least_left=0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, MOST_TIMES at most, or go so that the domains' words come near their targets."""
    return mixing.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), TARGETS, most=MOST_TIMES)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(bin_id, doc_id, piece, start_word, n_words): documents packed into sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack),
]

#: Near-dedup, mixing and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"{shared_dir(spark)}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
