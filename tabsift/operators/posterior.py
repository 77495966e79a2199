"""Screening of studies for under- or over-dispersion by a spike and a slab.

A study's differences have precision inv(sem2) * exp(beta * flag); flag is a
coin, beta is normal with mean 0 and precision 0.1. Given beta, rows are
independent, and the constants of the t-density cancel in the ratio of slab to
spike, so the posterior follows from one integral over beta, with no sampling:

    log ratio = sum over rows of beta / 2
                - (df + 1) / 2 * (ln(1 + exp(beta) t^2 / df) - ln(1 + t^2 / df))

A study is reduced to the arrays of its t and df, and integrated on a grid that
spans all of the posterior's mass: beta can't exceed what all t = 0 would give,
5 per row, by more than a few prior deviations. Steps shrink for large studies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VARIANCE, STEP, LOW, MARGIN = 10.0, 0.05, -25.0, 20.0


def _grid(n: int) -> np.ndarray:
    step = STEP if n <= 400 else 1 / np.sqrt(n)
    return LOW + step * np.arange(int(round((5.0 * n + MARGIN - LOW) / step)) + 1)


def integrate(t: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(beta, log density of the slab up to its constant, log of the ratio of marginal likelihoods)."""
    n = len(t)
    beta = _grid(n)
    on = t != 0
    logs = np.log(t[on] ** 2 / df[on])
    half, base = (df[on] + 1) / 2, np.logaddexp(0, np.log(t[on] ** 2 / df[on]))
    out = np.full(len(beta), 0.0)
    for a in range(0, len(beta), 4096):
        b = beta[a : a + 4096, None]
        out[a : a + 4096] = n * b[:, 0] / 2 - (half * (np.logaddexp(0, b + logs) - base)).sum(1)
    out -= beta**2 / (2 * VARIANCE) + 0.5 * np.log(2 * np.pi * VARIANCE)
    top = out.max()
    return beta, out, float(top + np.log(np.exp(out - top).sum() * (beta[1] - beta[0])))


def _quantile(beta: np.ndarray, mass: np.ndarray, q: float) -> float:
    return float(np.interp(q, np.cumsum(mass) - mass / 2, beta))


def _posterior(prior: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, df in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                beta, log_density, log_bf = integrate(np.array(t), np.array(df))
                odds = log_bf + np.log(prior / (1 - prior))
                p = 1 / (1 + np.exp(-odds)) if odds > -700 else 0.0
                slab = np.exp(log_density - log_density.max())
                slab /= slab.sum()
                spike = np.exp(-(beta**2) / (2 * VARIANCE))
                mass = p * slab + (1 - p) * spike / spike.sum()
                mean = float(slab @ beta)
                rows.append((log_bf, p, mean, p * mean, *(_quantile(beta, mass, q) for q in (0.5, 0.025, 0.975))))
            cols = list(zip(*rows)) if rows else [[] for _ in range(7)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(4), *(pa.array(c, pa.float64()) for c in cols)], ["pmcid", "n_rows", "size", "log_bf", "p_flag", "slab_mean", "mean", "median", "lower", "upper"])

    return run


def posterior(comparisons: DataFrame, prior: float = 0.5) -> DataFrame:
    """(pmcid, n_rows, size, log_bf, p_flag, slab_mean, mean, median, lower, upper) of each study.

    mean and quantiles are of beta over both states, as draws from the model
    would give them; slab_mean is given that the study is flagged. A study's
    rows are some hundreds at most, one array in a task. ``size`` is the median.
    """
    rows = comparisons.filter("t IS NOT NULL AND size > 1").select("pmcid", "t", (F.col("size") - 1).alias("df"), "size")
    studies = rows.groupBy("pmcid").agg(F.sort_array(F.collect_list(F.struct("t", "df"))).alias("x"), F.count(F.lit(1)).alias("n_rows"), F.expr("percentile(size, 0.5)").alias("size"))
    arrays = studies.select("pmcid", F.col("x.t").alias("t"), F.col("x.df").alias("df"), "n_rows", "size")
    return arrays.mapInArrow(_posterior(prior), "pmcid string, n_rows bigint, size double, log_bf double, p_flag double, slab_mean double, mean double, median double, lower double, upper double")


def posterior_sql(comparisons: str) -> str:
    """The same integral for DuckDB, for studies of at most 400 rows: (pmcid, n_rows, log_bf, p_flag, slab_mean)."""
    return f"""
    WITH c AS (SELECT pmcid, t, size - 1 AS df FROM ({comparisons}) WHERE t IS NOT NULL AND size > 1),
    n AS (SELECT pmcid, count(*) AS n FROM c GROUP BY pmcid),
    g AS (SELECT pmcid, n, {LOW} + {STEP} * unnest(range(0, CAST(round((5.0 * n + {MARGIN} - ({LOW})) / {STEP}) AS BIGINT) + 1)) AS beta FROM n),
    s AS (SELECT c.pmcid, g.n, g.beta, g.n * g.beta / 2 - sum(CASE WHEN t = 0 THEN 0 ELSE (df + 1) / 2.0 * (
            greatest(g.beta + ln(t * t / df), 0) + ln(1 + exp(-abs(g.beta + ln(t * t / df)))) - ln(1 + t * t / df)) END)
            - g.beta * g.beta / {2 * VARIANCE} - 0.5 * ln(2 * pi() * {VARIANCE}) AS l
          FROM c JOIN g ON c.pmcid = g.pmcid GROUP BY c.pmcid, g.n, g.beta),
    m AS (SELECT pmcid, max(l) AS top FROM s GROUP BY pmcid),
    r AS (SELECT s.pmcid, any_value(n) AS n_rows, any_value(top) + ln(sum(exp(l - top)) * {STEP}) AS log_bf, sum(beta * exp(l - top)) / sum(exp(l - top)) AS slab_mean
          FROM s JOIN m ON s.pmcid = m.pmcid GROUP BY s.pmcid)
    SELECT pmcid, n_rows, log_bf, 1 / (1 + exp(-log_bf)) AS p_flag, slab_mean FROM r"""


def shared_prior(studies: DataFrame, nodes: int = 199) -> DataFrame:
    """(p, weight): posterior of one prior probability of being flagged, uniform before, that all studies share.

    A study enters by its Bayes factor alone; sums over studies are one
    aggregation per node.
    """
    p = F.col("p")
    grid = studies.sparkSession.range(1, nodes + 1).select((F.col("id") / (nodes + 1)).alias("p"))
    m = F.greatest(F.col("log_bf"), F.lit(0.0))
    term = m + F.log((1 - p) * F.exp(-m) + p * F.exp(F.col("log_bf") - m))
    logs = studies.select("log_bf").crossJoin(F.broadcast(grid)).groupBy("p").agg(F.sum(term).alias("l"))
    w = F.exp(F.col("l") - F.max("l").over(Window.partitionBy()))
    return logs.withColumn("w", w).select("p", (F.col("w") / F.sum("w").over(Window.partitionBy())).alias("weight"))


def with_shared_prior(studies: DataFrame) -> DataFrame:
    """posterior() with p_flag averaged over the shared prior's posterior, as ``p_shared``."""
    prior = shared_prior(studies)
    odds = F.col("log_bf") + F.log(F.col("p") / (1 - F.col("p")))
    averaged = studies.select("pmcid", "log_bf").crossJoin(F.broadcast(prior)).groupBy("pmcid").agg(F.sum(F.col("weight") / (1 + F.exp(-odds))).alias("p_shared"))
    return studies.join(averaged, "pmcid")


def with_own_prior(studies: DataFrame) -> DataFrame:
    """Each study with a prior of its own, uniform: the flag is as with 0.5, and the prior's mean is (1 + p) / 3."""
    return studies.withColumn("theta_mean", (1 + F.col("p_flag")) / 3)


def classify(studies: DataFrame, threshold: float = 0.95) -> DataFrame:
    """With ``issue``: 'Over-dispersed', 'Under-dispersed' or 'No issue'. High precision is under-dispersion."""
    issue = F.when(F.col("p_flag") < threshold, "No issue").when(F.col("mean") <= 0, "Over-dispersed").otherwise("Under-dispersed")
    return studies.withColumn("issue", issue)


def summarise(studies: DataFrame) -> DataFrame:
    """One row per study and quantity: (pmcid, size, variable, nicevar, n, mean, median, lower, upper)."""
    precision = F.struct(F.lit("mu.var").alias("variable"), F.lit("Precision").alias("nicevar"), "mean", "median", "lower", "upper")
    p = F.col("p_flag")
    step = lambda q: F.when(p > 1 - q, 1.0).otherwise(0.0)
    flag = F.struct(F.lit("var.flag").alias("variable"), F.lit("Precision flag").alias("nicevar"), p.alias("mean"), step(0.5).alias("median"), step(0.025).alias("lower"), step(0.975).alias("upper"))
    return studies.select("pmcid", "size", "n_rows", F.explode(F.array(precision, flag)).alias("x")).select("pmcid", "size", F.col("n_rows").alias("n"), "x.*")


def flagged_precision(summaries: DataFrame, cut: float = 1e6) -> DataFrame:
    """Precisions of the studies that are out of the spike, by ``facet``; those of a multiplier beyond ``cut`` are marked ``truncated``.

    ``summaries`` is of summarise(); a study is out of the spike where its flag's median isn't 0.
    """
    out = summaries.filter((F.col("nicevar") == "Precision flag") & (F.col("median") != 0)).select("pmcid")
    precise = summaries.filter(F.col("nicevar") == "Precision").join(out, "pmcid", "left_semi")
    facet = F.when(F.col("mean") < 0, "Over-dispersed").otherwise("Under-dispersed")
    return precise.withColumns({"facet": facet, "truncated": F.col("mean") > F.log(F.lit(cut))})


def count_issues(classified: DataFrame, group: str) -> DataFrame:
    """(group, issue, n, percent of the group)."""
    n = classified.groupBy(group, "issue").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def repeat_offenders(classified: DataFrame, design: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Flagged studies with what is known of them."""
    return classified.filter(F.col("p_flag") > threshold).join(design, "pmcid", "left")


def extreme_and_random(classified: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` most extreme flagged studies of more than two rows, by |mean|, and as many others at random; tagged by ``group``."""
    flagged = classified.filter((F.col("issue") != "No issue") & (F.col("n_rows") > 2)).orderBy(F.desc(F.abs("mean")), "pmcid").limit(n)
    others = classified.filter(F.col("issue") == "No issue").orderBy(F.xxhash64(F.lit(seed), "pmcid"), "pmcid").limit(n)
    return flagged.withColumn("group", F.lit("flagged")).unionByName(others.withColumn("group", F.lit("random")))
