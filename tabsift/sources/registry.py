"""Inline tables, and which files and settings belong to a stage of a data source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Types that a trial may or may not have; 1 keeps a paper in the search.
PUBLICATION_TYPES = {
    "Adaptive Clinical Trial": 1,
    "Case Reports": 0,
    "Clinical Study": 0,
    "Clinical Trial": 1,
    "Clinical Trial Protocol": 0,
    "Clinical Trial, Phase II": 1,
    "Clinical Trial, Phase III": 1,
    "Clinical Trial, Phase IV": 1,
    "Comment": 0,
    "Controlled Clinical Trial": 1,
    "Editorial": 0,
    "Equivalence Trial": 1,
    "Letter": 0,
    "Meta-Analysis": 0,
    "Multicenter Study": 1,
    "Observational Study": 0,
    "Pragmatic Clinical Trial": 1,
    "Published Erratum": 0,
    "Randomized Controlled Trial": 1,
    "Retracted Publication": 0,
    "Retraction of Publication": 0,
    "Review": 0,
    "Systematic Review": 0,
}


def publication_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(PUBLICATION_TYPES.items()), "type string, include int")


def excluded_by_hand(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """(pmcid, reason) of papers that a reader took out."""
    return spark.createDataFrame(rows, "pmcid string, reason string")


def parse_inline(spark: SparkSession, text: str, names: list[str], separator: str = "!") -> DataFrame:
    """An inline table of strings, a line for each row."""
    rows = [tuple(x.strip() for x in line.split(separator)) for line in text.strip().splitlines() if line.strip()]
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


@dataclass(frozen=True)
class Source:
    """Where a data source's stages lie below a root folder, and how it is treated."""

    name: str
    exclude_non_trials: bool = True
    renumber_columns: bool = True
    has_design: bool = True

    def path(self, root: str, stage: str) -> str:
        if stage not in STAGES:
            raise ValueError(f"unknown stage {stage}")
        return f"{root.rstrip('/')}/{self.name}/{stage}.parquet"


STAGES = ("ids", "papers", "extracted", "processed", "compared", "posterior")
SOURCES = {
    s.name: s
    for s in (
        Source("trialstreamer"),
        Source("search"),
        Source("validation"),
        Source("hand", renumber_columns=False),
        Source("carlisle", exclude_non_trials=False, renumber_columns=False, has_design=False),
        Source("saitoh", exclude_non_trials=False, renumber_columns=False, has_design=False),
        Source("retracted", exclude_non_trials=False, has_design=False),
        Source("simulations", exclude_non_trials=False, has_design=False),
    )
}
