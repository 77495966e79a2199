"""Expressions with the null semantics of statistical data frames, where a missing value spreads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

NUMBER = r"^-?(\d+\.?\d*|\.\d+)$"


def _over(c: Column, w: WindowSpec | None) -> Column:
    return c if w is None else c.over(w)


def strict_sum(x: Column, over: WindowSpec | None = None) -> Column:
    """A sum that is null when any term is."""
    whole = _over(F.count(x), over) == _over(F.count(F.lit(1)), over)
    return F.when(whole, _over(F.sum(x), over))


def holds_everywhere(test: Column, over: WindowSpec | None = None) -> Column:
    """True where the test is true for every cell of the group; null counts as not true."""
    return _over(F.count(F.when(test, F.lit(1))), over) == _over(F.count(F.lit(1)), over)


def if_else(test: Column, yes, no) -> Column:
    """Null where the test is null, unlike a CASE that would take the other branch."""
    return F.when(test.isNull(), F.lit(None)).when(test, yes).otherwise(no)


def row_max(*cols: Column) -> Column:
    """The greatest, or null if any is null."""
    some_null = reduce(lambda a, b: a | b, [c.isNull() for c in cols])
    return F.when(~some_null, F.greatest(*cols))


def row_min(*cols: Column) -> Column:
    some_null = reduce(lambda a, b: a | b, [c.isNull() for c in cols])
    return F.when(~some_null, F.least(*cols))


def as_number(text: Column) -> Column:
    """The number that a string spells, else null; 'inf', '12d' and the like spell none."""
    t = F.trim(text)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def share(x: Column, value) -> Column:
    """Proportion of values equal to one."""
    return F.avg((x == value).cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def first_mode(df: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """The most frequent value of each group; of several the one seen first by position."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first_at"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "first_at")
    return counts.withColumn("k", F.row_number().over(w)).filter("k = 1").select(*keys, F.col(value).alias("mode"), "n")


def carry_forward(x: Column, keys: list[str], order: list[str]) -> Column:
    """The last value that isn't null, at or before each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(x, ignorenulls=True).over(w)
