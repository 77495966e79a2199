"""All comparisons of two groups, with their t-statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsift.functions.stats import t_two_sided

CONTINUOUS, COUNTED = ("ci", "continuous"), ("percent", "numbers")


def pairs(table: DataFrame) -> DataFrame:
    """Each pair of groups of each row, in order: (pmcid, row, statistic, columns k, a, b) with a and b the cells.

    Pairs are numbered in dictionary order within the study's groups, and move
    the row's number on by that share, so that rows stay distinct; studies of
    two groups keep theirs and studies of one disappear. One exchange by study
    serves the group count and the pairing.
    """
    cell = F.struct("column", "stat1", "stat2", "sample_size")
    wide = table.repartition("pmcid").withColumn("k", F.max("column").over(Window.partitionBy("pmcid")))
    rows = wide.groupBy("pmcid", "row", "statistic", "k").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    combos = F.flatten(F.transform("cells", lambda x: F.transform(F.filter("cells", lambda y: y["column"] > x["column"]), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    out = rows.filter(F.col("k") > 1).select("pmcid", "row", "statistic", "k", F.explode(combos).alias("p")).select("pmcid", "row", "statistic", "k", "p.a", "p.b")
    i, j, k = F.col("a.column"), F.col("b.column"), F.col("k")
    nth = (i - 1) * k - i * (i - 1) / 2 + (j - i - 1)
    return out.withColumn("row", F.col("row") + nth / (k * (k - 1) / 2))


def pooled_t(m1: Column, s1: Column, n1: Column, m2: Column, s2: Column, n2: Column) -> tuple[Column, Column]:
    """(difference, standard error) of two means with a pooled variance."""
    pooled = F.try_divide((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2, n1 + n2 - 2)
    return m1 - m2, F.sqrt((F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)) * pooled)


def welch_t(m1: Column, s1: Column, n1: Column, m2: Column, s2: Column, n2: Column) -> tuple[Column, Column, Column]:
    """(difference, standard error, degrees of freedom) without pooling."""
    v1, v2 = F.try_divide(s1 * s1, n1), F.try_divide(s2 * s2, n2)
    df = F.try_divide((v1 + v2) * (v1 + v2), F.try_divide(v1 * v1, n1 - 1) + F.try_divide(v2 * v2, n2 - 1))
    return m1 - m2, F.sqrt(v1 + v2), df


def binomial_t(x1: Column, n1: Column, x2: Column, n2: Column) -> tuple[Column, Column]:
    """(difference, standard error) of two proportions, treated as means; 0 and 1 are moved by half an event."""

    def proportion(x: Column, n: Column) -> Column:
        p = F.try_divide(x, n)
        return F.when(p == 0, F.lit(0.5) / n).when(p == 1, (n - 0.5) / n).otherwise(p)

    p, q = proportion(x1, n1), proportion(x2, n2)
    pooled = F.try_divide((n1 - 1) * p * (1 - p) + (n2 - 1) * q * (1 - q), n1 + n2 - 2)
    return p - q, F.sqrt(pooled) * F.sqrt(F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2))


def compare(table: DataFrame, p_values: bool = True, equal_variance: bool = True) -> DataFrame:
    """(pmcid, row, statistic, size, mdiff, sem, t, [p,] sem2) of every pair whose difference and error exist."""
    a, b = (lambda f: F.col(f"a.{f}")), (lambda f: F.col(f"b.{f}"))
    n1, n2 = a("sample_size"), b("sample_size")
    means = (a("stat1"), a("stat2"), n1, b("stat1"), b("stat2"), n2)
    md, mse = pooled_t(*means)
    wd, wse, wdf = welch_t(*means)
    pd, pse = binomial_t(a("stat1"), n1, b("stat1"), n2)
    is_mean = F.col("statistic").isin(*CONTINUOUS)
    possible = (a("stat1") >= 0) & (b("stat1") >= 0) & (n1 >= a("stat1")) & (n2 >= b("stat1"))
    usable = pairs(table.filter(F.col("statistic").isin(*CONTINUOUS, *COUNTED))).filter(is_mean | possible)
    pooled_df = n1 + n2 - 2
    out = usable.select(
        "pmcid",
        "row",
        "statistic",
        (n1 + n2).alias("size"),
        F.when(is_mean, md if equal_variance else wd).otherwise(pd).alias("mdiff"),
        F.when(is_mean, mse if equal_variance else wse).otherwise(pse).alias("sem"),
        (pooled_df if equal_variance else F.when(is_mean, wdf).otherwise(pooled_df)).alias("df"),
    ).filter("mdiff IS NOT NULL AND sem IS NOT NULL AND NOT isnan(sem)")
    out = out.filter(is_mean | (F.col("sem") > 0)).withColumn("t", F.try_divide("mdiff", "sem"))
    if p_values:
        out = out.withColumn("p", t_two_sided(F.col("t"), F.col("df")))
    return out.withColumn("sem2", F.col("sem") * F.col("sem")).drop("df")


def numbered(comparisons: DataFrame) -> DataFrame:
    """With ``study``, the rank of pmcid: ranks of the distinct ids only are computed in one place, and joined."""
    ids = comparisons.select("pmcid").distinct().withColumn("study", F.dense_rank().over(Window.orderBy("pmcid")))
    return comparisons.join(ids, "pmcid")


def symmetrize(comparisons: DataFrame) -> DataFrame:
    """Differences alternate in sign by their rank, in the order of study and t, odd ranks being positive.

    Ranks are within a study, on from the rows of the studies before it; only
    the studies' counts, one row for each, are summed up in one place. Nulls of
    t come last, as in the SQL, and rows of no study are neither ranked nor kept.
    """
    before = F.sum("__n").over(Window.orderBy("pmcid").rowsBetween(Window.unboundedPreceding, -1))
    starts = comparisons.filter("pmcid IS NOT NULL").groupBy("pmcid").agg(F.count(F.lit(1)).alias("__n")).select("pmcid", F.coalesce(before, F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("pmcid").orderBy(F.asc_nulls_last("t"), "row"))
    odd = (F.col("__before") + nth) % 2 == 1
    flip = lambda c: F.when(F.col("odd"), F.abs(c)).otherwise(-F.abs(c))
    return comparisons.join(starts, "pmcid").withColumn("odd", odd).withColumns({"mdiff": flip("mdiff"), "t": flip("t")}).drop("odd", "__before")


def drop_mirrors(comparisons: DataFrame) -> DataFrame:
    """Without counted rows that mirror the one before: such as the women after the men.

    A row goes if its t and the last counted row's cancel within 0.001, t isn't
    0, and its number is whole, which it is only in studies of two groups and
    for the first pair of others.
    """
    counted = F.col("statistic").isin(*COUNTED)
    last = F.lag("t").over(Window.partitionBy("pmcid", counted).orderBy("row"))
    mirror = counted & (F.abs(F.col("last") + F.col("t")) < 0.001) & (F.col("t") != 0) & (F.col("row") == F.floor("row"))
    return comparisons.withColumn("last", last).filter(~F.coalesce(mirror, F.lit(False))).drop("last")


def check_pairs(table: DataFrame, comparisons: DataFrame) -> DataFrame:
    """(pmcid, expected, found, matches): comparisons that a study's rows call for, against those there are."""
    kept = table.filter(F.col("statistic").isin(*CONTINUOUS, *COUNTED))
    expected = kept.groupBy("pmcid", "row").agg(F.max("column").alias("k")).groupBy("pmcid").agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).cast("bigint").alias("expected"))
    found = comparisons.groupBy("pmcid").agg(F.count(F.lit(1)).alias("found"))
    return expected.join(found, "pmcid", "full").select("pmcid", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found")).withColumn("matches", F.col("expected") == F.col("found"))
