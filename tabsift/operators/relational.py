"""Joins and reshapes that Spark has no single verb for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, by: list[str], at: str, other_at: str, take: list[str], backward: bool = True) -> DataFrame:
    """As-of join: each left row with ``take`` of the closest right row at or before it (or at or after it).

    Both sides are merged in order of position and the last right row seen is
    carried along, one sort per key instead of a product; a right row wins a tie
    with a left one at the same place, and of equal right rows the greatest.
    """
    packed = F.struct(F.col(other_at).alias("__at"), *take)
    l = left.select(*[F.col(k).alias(f"__{k}") for k in by], F.col(at).alias("__pos"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(packed.alias("s")).schema["s"].dataType).alias("__r"))
    r = right.filter(F.col(other_at).isNotNull()).select(*[F.col(k).alias(f"__{k}") for k in by], F.col(other_at).alias("__pos"), F.lit(0).alias("__side"), F.lit(None).cast(l.schema["__l"].dataType).alias("__l"), packed.alias("__r"))
    pos = F.col("__pos").asc() if backward else F.col("__pos").desc()
    w = Window.partitionBy(*[f"__{k}" for k in by]).orderBy(pos, "__side", "__r").rowsBetween(Window.unboundedPreceding, 0)
    seen = l.unionByName(r).withColumn("__hit", F.last("__r", ignorenulls=True).over(w)).filter("__side = 1")
    hit = F.when(F.col("__pos").isNotNull(), F.col("__hit"))
    return seen.select("__l.*", *[hit.getField(c).alias(c) for c in take], hit.getField("__at").alias(f"{other_at}_found"))


def same_shape_merge(a: DataFrame, b: DataFrame, by: list[str], study: str = "pmcid", row: str = "row") -> DataFrame:
    """Full join of the studies whose greatest row is the same on both sides; other studies aren't returned."""
    top = lambda df, n: df.groupBy(study).agg(F.max(row).alias(n))
    same = top(a, "__a").join(top(b, "__b"), study).filter(F.col("__a") == F.col("__b")).select(study)
    return a.join(same, study, "left_semi").join(b.join(same, study, "left_semi"), by, "full")


def merge_all(frames: list[DataFrame], by: list[str], how: str = "left") -> DataFrame:
    return reduce(lambda x, y: x.join(y, by, how), frames)


def cross_tab(df: DataFrame, row: str, column: str, levels: list) -> DataFrame:
    """Counts of row by the given levels of column, with totals of both; the row of totals has a null key."""
    counts = [F.sum((F.col(column) == v).cast("bigint")).alias(str(v)) for v in levels]
    return df.rollup(row).agg(*counts, F.count(F.lit(1)).alias("total"))


def duplicates(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """With ``duplicated``: true from the second row on of those that agree in the keys."""
    return df.withColumn("duplicated", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def segments(df: DataFrame, keys: list[str], position: str, gap: int = 1) -> DataFrame:
    """With ``segment``, numbered from 0: a new one begins where positions jump by more than ``gap``."""
    w = Window.partitionBy(*keys).orderBy(position)
    jump = F.coalesce((F.col(position) - F.lag(position).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("__jump", jump).withColumn("segment", F.sum("__jump").over(w)).drop("__jump")


def indicators(df: DataFrame, key: str, label: str, levels: list[str]) -> DataFrame:
    """One row per key with a 0 or 1 for each level."""
    return df.groupBy(key).agg(*[F.max((F.col(label) == v).cast("int")).alias(v) for v in levels])


def replicate(df: DataFrame, times: Column) -> DataFrame:
    """Each row so many times; not at all at 0."""
    return df.filter(times > 0).withColumn("__i", F.explode(F.sequence(F.lit(1), times.cast("int")))).drop("__i")


def split_columns(df: DataFrame, text: str, names: list[str], pattern: str) -> DataFrame:
    """Parts of a text as columns; missing parts are null and extra ones are dropped."""
    return df.withColumns({n: F.get(F.split(text, pattern), F.lit(i)) for i, n in enumerate(names)})


def clean_names(df: DataFrame) -> DataFrame:
    """Column names in lower snake case, made unique by numbers."""
    import re

    out: list[str] = []
    for c in df.columns:
        base = re.sub(r"_+", "_", re.sub(r"[^0-9a-z]+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", c.replace("%", "percent")).lower())).strip("_") or "x"
        name, k = (f"x{base}" if base[0].isdigit() else base), 2
        while name in out:
            name, k = f"{base}_{k}", k + 1
        out.append(name)
    return df.toDF(*out)
