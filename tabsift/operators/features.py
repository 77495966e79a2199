"""Features of papers and of tables, digit scores, and models on them."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsift.functions.stats import Z975, chi_square_median


def first_digit(x: Column) -> Column:
    """The first digit from 1 to 9 of a number as printed without an exponent; null where there is none."""
    digits = F.regexp_replace(F.abs(x).cast("decimal(38,10)").cast("string"), "[^1-9]", "")
    return F.when(F.length(digits) > 0, F.substring(digits, 1, 1).cast("int"))


def benford(table: DataFrame, weighted: bool = True) -> DataFrame:
    """(pmcid, score): distance of first digits from Benford's law, per the median of its distribution.

    ``weighted`` counts a digit as often as it is large, as published code does
    where a tally takes the digit for a weight; without it digits count once.
    """
    digits = table.select("pmcid", first_digit(F.col("stat1")).alias("digit")).filter("digit IS NOT NULL")
    n = F.sum("digit") if weighted else F.count(F.lit(1))
    seen = digits.groupBy("pmcid", "digit").agg(n.cast("double").alias("n"))
    nine = table.sparkSession.range(1, 10).select(F.col("id").cast("int").alias("digit"), F.log10(1 + 1 / F.col("id")).alias("share"))
    all_digits = digits.select("pmcid").distinct().crossJoin(F.broadcast(nine)).join(seen, ["pmcid", "digit"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    total = F.sum("n").over(Window.partitionBy("pmcid"))
    part = F.pow(F.col("n") - F.col("share") * F.col("total"), 2) / (F.col("share") * F.col("total"))
    return all_digits.withColumn("total", total).groupBy("pmcid").agg((F.sum(part) / chi_square_median(8)).alias("score"))


def commonest_statistic(table: DataFrame) -> DataFrame:
    """(pmcid, statistic): the most frequent one, of several the first by name."""
    n = table.groupBy("pmcid", "statistic").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("k", F.row_number().over(Window.partitionBy("pmcid").orderBy(F.desc("n"), "statistic"))).filter("k = 1").select("pmcid", "statistic")


def paper_features(table: DataFrame, comparisons: DataFrame, least_rows: int = 3) -> DataFrame:
    """One vector per paper: spread of t and of sizes, rows, kinds of statistic, decimals, commonest statistic, digit score."""
    t = comparisons.groupBy("pmcid").agg(F.coalesce(F.stddev_samp("t"), F.lit(0.0)).alias("sd_t"), F.log(F.avg("size")).alias("log_size"))
    size = table.groupBy("pmcid").agg(
        F.coalesce(F.stddev_samp("sample_size"), F.lit(0.0)).alias("sd_size"),
        F.countDistinct("row").alias("n_rows"),
        F.countDistinct("statistic").alias("n_stats"),
        F.avg("dp1").alias("mean_dp"),
    )
    parts = [size, t, commonest_statistic(table), benford(table)]
    joined = reduce(lambda a, b: a.join(b, "pmcid", "left"), parts)
    return joined.filter(F.col("n_rows") >= least_rows).withColumns({"log_rows": F.log("n_rows"), "log_sd_size": F.log(F.col("sd_size") + 1)})


def table_features(table: DataFrame) -> DataFrame:
    """(pmcid, ncol, nrow, size_spread, log2_size, p_continuous, mean_dp, size_class)."""
    size = F.col("sample_size")
    out = table.groupBy("pmcid").agg(
        F.countDistinct("column").alias("ncol"),
        F.countDistinct("row").alias("nrow"),
        F.expr("(max(sample_size) - min(sample_size)) / percentile(sample_size, 0.5)").alias("size_spread"),
        F.log2(F.expr("percentile(sample_size, 0.5)")).alias("log2_size"),
        F.avg((F.col("statistic") == "continuous").cast("double")).alias("p_continuous"),
        F.avg("dp1").alias("mean_dp"),
        F.min(size).alias("lo"),
        F.max(size).alias("hi"),
    )
    size_class = F.when(F.col("lo") == F.col("hi"), "Equal").when(F.col("size_spread") < 0.1, "Small").otherwise("Large")
    return out.withColumn("size_class", size_class).drop("lo", "hi")


def collapse_rare(df: DataFrame, column: str, least: int, other: str = "Other") -> DataFrame:
    """Levels of a column with fewer than ``least`` rows become one. Counts are joined, so a frequent level isn't one task's work."""
    n = df.groupBy(column).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= least).select(F.col(column).alias("__v"))
    return df.join(n, F.col(column) == F.col("__v"), "left").withColumn(column, F.coalesce("__v", F.lit(other))).drop("__v")


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows of each group at random, the same ones whatever the order of rows: those with the least hashes of their key."""
    w = Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), key), key)
    return df.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= n).drop("__k")


def size_variance_by_flag(table: DataFrame, flags: DataFrame) -> DataFrame:
    """(any_difference, flagged, n): do groups' sizes differ, against being flagged; with totals, whose key is null."""
    v = table.groupBy("pmcid").agg((F.coalesce(F.var_samp("sample_size"), F.lit(0.0)) > 0).alias("any_difference"))
    return v.join(flags.select("pmcid", "flagged"), "pmcid", "left").rollup("any_difference", "flagged").agg(F.count(F.lit(1)).alias("n"))


def flag_tree(features: DataFrame, label: str, inputs: list[str], depth: int = 4, seed: int = 1):
    """A classification tree of depth 4 at most, fitted in Spark: (model, predictions)."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=inputs, outputCol="x").transform(features.na.drop(subset=inputs + [label]))
    model = DecisionTreeClassifier(labelCol=label, featuresCol="x", maxDepth=depth, minInstancesPerNode=7, seed=seed).fit(x)
    return model, model.transform(x)


def _moments(features: DataFrame, columns: list[str], fold: Column) -> dict[int, np.ndarray]:
    """By fold, the sums of products of all pairs of columns, a constant 1 first: one aggregation, whatever is fitted after."""
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    rows = features.groupBy(fold.alias("fold")).agg(*[F.sum(x[i] * x[j]).alias(f"m{i}_{j}") for i, j in pairs]).collect()
    out = {}
    for r in rows:
        m = np.zeros((len(x), len(x)))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"m{i}_{j}"]
        out[r["fold"]] = m
    return out


def _path(m: np.ndarray, lambdas: np.ndarray, mixing: float) -> np.ndarray:
    """Coefficients, the intercept first, by penalty; by coordinate descent on standardised inputs, each penalty from the one before."""
    n = m[0, 0]
    mean = m[0] / n
    cov = m / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[1:-1], 0))
    ok = sd > 0
    scale = np.where(ok, sd, 1.0)
    g, c = cov[1:-1, 1:-1] / np.outer(scale, scale), cov[1:-1, -1] / scale
    b, out = np.zeros(len(sd)), []
    for l in lambdas:
        for _ in range(1000):
            before = b.copy()
            for k in np.flatnonzero(ok):
                r = c[k] - g[k] @ b + g[k, k] * b[k]
                b[k] = np.sign(r) * max(abs(r) - l * mixing, 0) / (g[k, k] + l * (1 - mixing))
            if np.abs(b - before).max() < 1e-9 * max(np.abs(b).max(), 1):
                break
        slope = b / scale
        out.append(np.concatenate(([mean[-1] - slope @ mean[1:-1]], slope)))
    return np.array(out)


def _squares(m: np.ndarray, b: np.ndarray) -> float:
    """The residual sum of squares of coefficients on the rows that m sums up."""
    v = np.append(b, -1.0)
    return float(v @ m @ v)


def elastic_net(features: DataFrame, label: str, inputs: list[str], folds: int = 10, penalties: int = 100, mixing: float = 0.95, seed: int = 1) -> tuple[list[str], list[float], list[tuple[float, float]]]:
    """(kept inputs, coefficients, intervals): elastic net, then least squares on what it keeps.

    Of the path of penalties the largest is taken whose cross-validated error is
    within one standard error of the least. Rows are read once, for their sums of
    products by fold; paths, errors and intervals follow from these on the driver.
    """
    rows = features.na.drop(subset=inputs + [label])
    parts = _moments(rows, [*inputs, label], F.pmod(F.xxhash64(F.lit(seed), *inputs, label), F.lit(folds)))
    if not parts:
        return [], [], []
    total = sum(parts.values())
    n = total[0, 0]
    mean = total[0] / n
    cov = total / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[1:-1], 0))
    top = np.abs(cov[1:-1, -1] / np.where(sd > 0, sd, np.inf)).max() / mixing
    lambdas = np.geomspace(top, top * 1e-4, penalties) if top > 0 else np.array([1.0])
    errors = np.array([[_squares(m, b) / m[0, 0] for b in _path(total - m, lambdas, mixing)] for m in parts.values()])
    weight = np.array([m[0, 0] for m in parts.values()]) / n
    mse = weight @ errors
    se = np.sqrt(weight @ (errors - mse) ** 2 / max(len(parts) - 1, 1))
    chosen = int(np.flatnonzero(mse <= mse.min() + se[mse.argmin()])[0])
    kept = np.flatnonzero(np.abs(_path(total, lambdas[: chosen + 1], mixing)[-1][1:]) > 1e-9)
    if not len(kept):
        return [], [], []
    pick = np.concatenate(([0], kept + 1))
    inverse = np.linalg.inv(total[np.ix_(pick, pick)])
    b = inverse @ total[pick, -1]
    left = total[-1, -1] - b @ total[pick, -1]
    error = np.sqrt(np.maximum(left, 0) / max(n - len(pick), 1) * np.diag(inverse))
    return [inputs[k] for k in kept], [float(x) for x in b[1:]], [(float(x - Z975 * e), float(x + Z975 * e)) for x, e in zip(b[1:], error[1:])]
