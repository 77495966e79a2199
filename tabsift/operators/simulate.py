"""Tables of trials with known truth. Draws depend on the seed and the paper's number alone, not on partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "pmcid string, row double, column int, statistic string, stat1 double, stat2 double, sample_size double, issue string"
Cells = list[tuple]


@dataclass(frozen=True)
class Shape:
    """How large tables and groups are: gamma shapes and rates of rows and of (the logarithm of) a group's size."""

    p_continuous: float = 0.33
    rows: tuple[float, float] = (2.2, 0.15)
    sizes: tuple[float, float] = (10.7, 2.84)
    log_sizes: bool = True
    least_size: int = 4
    digits: int = 1

    def draw(self, rng: np.random.Generator) -> tuple[int, int, int]:
        """(rows of counts, rows of means, size of each group): never fewer than three rows."""
        rows = self.table_rows(rng)
        means = int(rng.binomial(rows, self.p_continuous))
        return rows - means, means, self.group_size(rng)

    def table_rows(self, rng: np.random.Generator, over: int = 1) -> int:
        n = round(round(rng.gamma(self.rows[0], 1 / self.rows[1])) / over)
        return n if n > 2 else 3

    def group_size(self, rng: np.random.Generator) -> int:
        n = rng.gamma(self.sizes[0], 1 / self.sizes[1])
        return max(round(float(np.exp(n) if self.log_sizes else n)), self.least_size)


def _fixed(value: float) -> tuple[float, float]:
    """A gamma distribution with this mean and hardly any spread."""
    return value * 1e6, 1e6


def _papers(spark: SparkSession, n: int, issue: str, seed: int, one: Callable[[np.random.Generator], Cells], label: str | None = None, suffix: str = "") -> DataFrame:
    """Papers 1 to n; an id is the issue without blanks and the number."""
    name = issue.replace(" ", "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i in b["id"]:
                out += [(f"{name}{int(i) + 1}{suffix}", *cell, label or issue) for cell in one(np.random.default_rng([seed, int(i)]))]
            yield pd.DataFrame(out, columns=["pmcid", "row", "column", "statistic", "stat1", "stat2", "sample_size", "issue"]).astype({"column": "int32"})

    return spark.range(n).mapInPandas(run, SCHEMA)


def _counts(x: np.ndarray, size: int, row0: int = 0) -> Cells:
    """Counts by row and group as cells."""
    return [(float(row0 + i + 1), k + 1, "percent", float(v), None, float(size)) for i, line in enumerate(x) for k, v in enumerate(line)]


def _means(m: np.ndarray, s: np.ndarray, size: int, digits: int, row0: int = 0) -> Cells:
    m, s = np.round(m, digits), np.round(s, digits + 1)
    return [(float(row0 + i + 1), k + 1, "continuous", float(m[i, k]), float(s[i, k]), float(size)) for i in range(len(m)) for k in range(m.shape[1])]


def _binomial(rng: np.random.Generator, rows: int, size: int, groups: int = 2) -> np.ndarray:
    return rng.binomial(size, rng.random((rows, 1)), (rows, groups)).astype(float)


def _nearby(rng: np.random.Generator, x: np.ndarray, steps: list[float], size: int) -> None:
    """The second group's counts as the first's and a step, none of them impossible."""
    x[:, 1] = np.clip(x[:, 0] + rng.choice(steps, len(x)), 0, size)


def _samples(rng: np.random.Generator, mean: np.ndarray, sd: np.ndarray, size: int, groups: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(means, standard deviations) by row and group of participants who are drawn alike."""
    x = [rng.normal(m, s, (groups, size)) for m, s in zip(mean, sd)]
    return np.array([v.mean(1) for v in x]).reshape(-1, groups), np.array([v.std(1, ddof=1) for v in x]).reshape(-1, groups)


def table1(spark: SparkSession, n: int, issue: str, seed: int, shape: Shape = Shape(), rho: float = 0.0, skew: bool = False) -> DataFrame:
    """G1: participants of two groups are correlated by rho where issue is 'too precise', by -rho where it is 'too variable', and not where it is 'none'.

    Counts that are too precise are at most 2 apart; too variable ones aren't defined.
    """
    if rho < 0:
        raise ValueError("rho must not be negative")
    if issue == "too variable" and shape.p_continuous < 1:
        raise ValueError("counts can't be made more variable than chance; use moved()")
    r = {"none": 0.0, "too variable": -rho}.get(issue, rho)

    def one(rng: np.random.Generator) -> Cells:
        counts, means, size = shape.draw(rng)
        x = _binomial(rng, counts, size)
        if issue == "too precise":
            _nearby(rng, x, [-2, -1, 0, 1, 2], size)
        mean, sd = (np.zeros(means), np.ones(means)) if skew else (rng.normal(50, 100, means), rng.gamma(5, 1, means))
        m, s = np.zeros((means, 2)), np.zeros((means, 2))
        for k in range(means):
            v = rng.multivariate_normal([mean[k]] * 2, np.array([[1, r], [r, 1]]) * sd[k] ** 2, size)
            v = np.exp(v) if skew else v
            m[k], s[k] = v.mean(0), v.std(0, ddof=1)
        return _counts(x, size) + _means(m, s, size, shape.digits, counts)

    return _papers(spark, n, issue, seed, one)


def moved(spark: SparkSession, n: int, issue: str, seed: int, shape: Shape = Shape()) -> DataFrame:
    """The second group is the first and a step: large where issue is 'too variable', small where it is 'too precise'.

    Counts step by half the size or by up to 2. All means of a table step alike,
    by the last row's standard deviation or a tenth of it, as published.
    """

    def one(rng: np.random.Generator) -> Cells:
        counts, means, size = shape.draw(rng)
        x = _binomial(rng, counts, size)
        if issue != "none":
            _nearby(rng, x, [-size / 2, 0, size / 2] if issue == "too variable" else [-2, -1, 0, 1, 2], size)
        sd = rng.gamma(5, 1, means)
        m, s = _samples(rng, rng.normal(50, 60, means), sd, size)
        if issue != "none" and means:
            m[:, 1] = m[:, 0] + rng.choice([-1, 0, 1]) * sd[-1] / (1 if issue == "too variable" else 10)
        return _counts(x, size) + _means(m, s, size, shape.digits, counts)

    return _papers(spark, n, issue, seed, one)


def categorical(spark: SparkSession, n: int, seed: int, shape: Shape = Shape()) -> DataFrame:
    """Variables of three categories; the last has what is left of the size, so the rows depend on one another."""

    def one(rng: np.random.Generator) -> Cells:
        variables, size = shape.table_rows(rng, 3), shape.group_size(rng)
        out: Cells = []
        for v in range(variables):
            p = rng.poisson([3, 9, 27]) + 1.0
            x = rng.binomial(size, np.repeat(p[:2, None] / p.sum(), 2, 1)).astype(float)
            out += _counts(np.vstack([x, size - x.sum(0)]), size, 3 * v)
        return out

    return _papers(spark, n, "categorical", seed, one)


def copied(spark: SparkSession, n: int, issue: str, seed: int, shape: Shape = Shape(), share: float = 0.5, label: str | None = None, suffix: str = "") -> DataFrame:
    """Where issue is 'too precise', the first rows of counts and of means, a share of each, are copied to the second group.

    One mean is copied at least, as published; standard deviations never are.
    'too variable' is that of moved(); other issues are none.
    """

    def one(rng: np.random.Generator) -> Cells:
        counts, means, size = shape.draw(rng)
        x = _binomial(rng, counts, size)
        if issue == "too variable":
            _nearby(rng, x, [-size / 2, 0, size / 2], size)
        sd = rng.gamma(5, 1, means)
        m, s = _samples(rng, rng.normal(50, 60, means), sd, size)
        if issue == "too variable" and means:
            m[:, 1] = m[:, 0] + rng.choice([-1, 0, 1]) * sd[-1]
        if issue == "too precise":
            same = round(share * counts)
            x[:same, 1] = x[:same, 0]
            same = max(round(share * means), 1)
            m[:same, 1] = m[:same, 0]
        return _counts(x, size) + _means(m, s, size, shape.digits, counts)

    return _papers(spark, n, issue, seed, one, label, suffix)


def correlated(spark: SparkSession, n: int, issue: str, seed: int, rho: float, shape: Shape = Shape()) -> DataFrame:
    """The variables of a participant are exchangeably correlated."""

    def one(rng: np.random.Generator) -> Cells:
        rows, size = shape.table_rows(rng), shape.group_size(rng)
        v = np.sqrt(rho) * rng.standard_normal((2, size, 1)) + np.sqrt(1 - rho) * rng.standard_normal((2, size, rows))
        return _means(v.mean(1).T, v.std(1, ddof=1).T, size, shape.digits)

    return _papers(spark, n, issue, seed, one)


def three_arms(spark: SparkSession, n: int, seed: int, shape: Shape = Shape(p_continuous=0.5)) -> DataFrame:
    """Three groups drawn alike."""

    def one(rng: np.random.Generator) -> Cells:
        counts, means, size = shape.draw(rng)
        x = _binomial(rng, counts, size, 3)
        m, s = _samples(rng, rng.normal(50, 60, means), rng.gamma(5, 1, means), size, 3)
        return _counts(x, size) + _means(m, s, size, shape.digits, counts)

    return _papers(spark, n, "3arms", seed, one)


def blocking(spark: SparkSession, n: int, seed: int, per_group: int = 40, rho: float = 0.1, correlated: bool = True) -> DataFrame:
    """(id, simple, blocked): Welch's t for the ages of participants that follow an AR(1) in time, randomised simply or in blocks of 8 and 12."""

    def welch(x: np.ndarray, g: np.ndarray) -> float:
        a, b = x[~g], x[g]
        return float((a.mean() - b.mean()) / np.sqrt(a.var(ddof=1) / len(a) + b.var(ddof=1) / len(b)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i in b["id"]:
                rng = np.random.default_rng([seed, int(i)])
                people = 2 * per_group
                age = rng.normal(45, 10, people)
                if correlated:
                    x, e = np.zeros(people + 1), rng.normal(0, 5, people + 1)
                    for k in range(1, people + 1):
                        x[k] = rho * x[k - 1] + e[k]
                    age = 45 + x[1:]
                age = np.round(age)
                simple = rng.permutation(np.arange(people) < per_group)
                blocks: list[np.ndarray] = []
                while sum(map(len, blocks)) < people:
                    half = int(rng.choice([4, 6]))
                    blocks.append(rng.permutation(np.arange(2 * half) < half))
                out.append((int(i), welch(age, simple), welch(age, np.concatenate(blocks)[:people])))
            yield pd.DataFrame(out, columns=["id", "simple", "blocked"])

    return spark.range(n).mapInPandas(run, "id bigint, simple double, blocked double")


def mirrored_gender(spark: SparkSession, n: int, seed: int, shape: Shape = Shape(least_size=1)) -> DataFrame:
    """Counts of men and of women in two groups, which mirror each other."""

    def one(rng: np.random.Generator) -> Cells:
        size = shape.group_size(rng)
        x = _binomial(rng, 1, size)
        return _counts(np.vstack([x, size - x]), size)

    return _papers(spark, n, "sim", seed, one)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def first_scenarios(spark: SparkSession, seed: int, none: int = 200, variable: int = 50, precise: int = 50, rho: float = 0.9) -> DataFrame:
    """Means alone, of groups that are alike by chance, too different or too much alike."""
    shape = Shape(p_continuous=1.0)
    return _union([table1(spark, k, issue, seed + i, shape, rho) for i, (issue, k) in enumerate([("none", none), ("too variable", variable), ("too precise", precise)])])


def scenarios(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """Nine scenarios of n papers; what of them is rounded are the papers without an issue."""
    real = Shape(p_continuous=0.5, sizes=(11.2, 3.0))
    small, large = Shape(0.0, sizes=(1e4, 1e3), log_sizes=False, least_size=10), Shape(0.0, sizes=(1e6, 1e3), log_sizes=False, least_size=10)
    none = copied(spark, n, "none", seed + 3, real)
    rounded = none.withColumns({"issue": F.lit("rounded"), "pmcid": F.regexp_replace("pmcid", "none", "rounded"), "stat1": F.bround("stat1", 0), "stat2": F.bround("stat2", 1)})
    return _union(
        [
            table1(spark, n, "small binary", seed, small),
            table1(spark, n, "large binary", seed + 1, large),
            table1(spark, n, "skewed", seed + 2, replace(large, p_continuous=1.0), skew=True),
            none,
            rounded,
            copied(spark, n, "too precise", seed + 4, real),
            moved(spark, n, "too variable", seed + 5, real),
            categorical(spark, n, seed + 6, real),
            copied(spark, n, "none continuous", seed + 7, replace(real, p_continuous=1.0, digits=3)),
        ]
    )


def extra_scenarios(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """Correlated variables, weakly and strongly, and three groups."""
    fine = Shape(digits=2)
    return _union([correlated(spark, n, "Correlated 0.2", seed, 0.2, fine), correlated(spark, n, "Correlated 0.6", seed + 1, 0.6, fine), three_arms(spark, n, seed + 2, replace(fine, p_continuous=0.5))])


def by_rows(spark: SparkSession, n: int, seed: int, rows: tuple[int, ...] = (14, 28, 56), size: int = 60) -> DataFrame:
    """Copied results in tables of given numbers of rows (``size`` is their rank), with papers of no issue and too variable ones (99)."""
    shapes = [Shape(0.5, rows=_fixed(r), sizes=_fixed(size), log_sizes=False) for r in rows]
    parts = [copied(spark, n, "too precise", seed + k, s, label=f"too precise, size = {k + 1}", suffix=f".{k + 1}").withColumn("size", F.lit(float(k + 1))) for k, s in enumerate(shapes)]
    return _union(parts + [moved(spark, n, issue, seed + 90 + k, shapes[0]).withColumn("size", F.lit(99.0)) for k, issue in enumerate(("none", "too variable"))])


def by_size(spark: SparkSession, n: int, seed: int, sizes: tuple[int, ...] = (60, 120, 240)) -> DataFrame:
    """Copied results in groups of given sizes, with papers of no issue and too variable ones (99)."""
    shapes = {s: Shape(0.5, sizes=_fixed(s), log_sizes=False) for s in sizes}
    parts = [copied(spark, n, "too precise", seed + k, shapes[s], label=f"too precise, size = {s}", suffix=f".{s}").withColumn("size", F.lit(float(s))) for k, s in enumerate(sizes)]
    return _union(parts + [copied(spark, n, issue, seed + 90 + k, shapes[sizes[0]]).withColumn("size", F.lit(99.0)) for k, issue in enumerate(("none", "too variable"))])
