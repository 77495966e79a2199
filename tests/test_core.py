import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsift.functions import stats
from tabsift.functions.text import repair_numbers, sample_size_in
from tabsift.operators import comparisons, features, posterior, rules
from tabsift.operators.tables import interpret
from tabsift.plans import ORACLE, QUERIES
from tabsift.plans.golden import _wrap

TABLE = "pmcid string, row double, column int, statistic string, stat1 double, stat2 double, stat3 double, stat4 double, dp1 int, dp2 int, sample_size double"


def cell(row, column, kind, s1, s2=None, n=40.0, s3=None, s4=None, dp1=0, dp2=0, study="A"):
    return (study, float(row), column, kind, float(s1), *(None if x is None else float(x) for x in (s2, s3, s4)), dp1, dp2, float(n))


def table(spark, cells):
    return spark.createDataFrame(cells, TABLE)


GOLD = [
    # mean, sd and size, or events and size, of two groups; difference, error, t and p
    ("continuous", (41.75, 12.66, 79), (42.68, 12.52, 77), (-0.93, 2.016356, -0.461228, 0.645286)),
    ("continuous", (41.75, 12.66, 79), (40.25, 11.35, 77), (1.5, 1.926716, 0.778527, 0.437453)),
    ("percent", (54, None, 79), (52, None, 77), (0.00822, 0.074731, 0.10999, 0.912561)),
    ("percent", (0, None, 79), (1, None, 77), (-0.006658, 0.015618, -0.426298, 0.670486)),
    ("percent", (0, None, 79), (0, None, 77), (-0.000164, 0.01278, -0.012863, 0.989754)),
]


def test_golden_comparisons(spark):
    cells = [cell(1, k + 1, kind, g[0], g[1], g[2], study=f"s{i}") for i, (kind, a, b, _) in enumerate(GOLD) for k, g in enumerate((a, b))]
    got = {r.pmcid: r for r in comparisons.compare(table(spark, cells)).collect()}
    for i, (_, _, _, want) in enumerate(GOLD):
        r = got[f"s{i}"]
        assert (r.mdiff, r.sem, r.t, r.p) == pytest.approx(want, abs=2e-6)


def test_three_groups_become_three_pairs(spark):
    cells = [cell(2, k, "continuous", 10 + k, 2) for k in (1, 2, 3)] + [cell(1, 1, "continuous", 5, 1, study="B")]
    got = comparisons.pairs(table(spark, cells)).orderBy("row").collect()
    assert [(r.row, r.a.column, r.b.column) for r in got] == [(2.0, 1, 2), (pytest.approx(2 + 1 / 3), 1, 3), (pytest.approx(2 + 2 / 3), 2, 3)]


def test_symmetrized_zeros_and_nulls_are_those_of_sql(spark, tmp_path):
    lines = [
        # study, group, quantity, price, discount and tax
        *[(1, g, *v) for g, v in (("A", (1.0, 1.0, 4.0, 1.0)), ("A", (3.0, 2.0, 6.0, 3.0)), ("N", (2.0, 7.0, 1.0, 2.0)), ("N", (2.0, 9.0, 2.0, 2.0)))],  # t is 0 at the ranks 2 and 3
        *[(2, g, *v) for g, v in (("A", (5.0, 1.0, 4.0, 1.0)), ("A", (5.0, 2.0, 6.0, 3.0)), ("N", (7.0, 7.0, 1.0, 5.0)), ("N", (7.0, 9.0, 2.0, 2.0)))],  # no spread, so that t is null
        *[(None, g, *v, None) for g, v in (("A", (1.0, 1.0, 4.0)), ("A", (2.0, 3.0, 6.0)), ("N", (7.0, 1.0, 1.0)), ("N", (9.0, 2.0, 2.0)))],  # three rows of no study
    ]
    names = "l_suppkey bigint, l_returnflag string, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    spark.createDataFrame(lines, names).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(ORACLE["m5_symmetrize"]).fetchall()
    got = QUERIES["m5_symmetrize"](spark, str(tmp_path)).select("pmcid", "row", "t").collect()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    assert "('1', 1.0, -0.0)" in map(repr, want) and "('2', 1.0, None)" in map(repr, want)


@pytest.mark.parametrize(
    "cells, want",
    [
        ([cell(1, k, "continuous", 10, 40, s3=25) for k in (1, 2)], ("percent", 10, 25)),  # c
        ([cell(1, k, "continuous", 5, 3, s3=8) for k in (1, 2)], ("median", 5, 3)),  # d
        ([cell(1, k, "continuous", 5, 3, s3=8, s4=1, dp1=1) for k in (1, 2)], ("continuous", 5, 3)),  # d misses
        ([cell(1, k, "percent", 25, 10) for k in (1, 2)], ("percent", 10, 25)),  # h1a
        ([cell(1, k, "percent", 10, 30) for k in (1, 2)], None),  # k
        ([cell(1, k, "percent", 10) for k in (1, 2)], ("percent", 10, None)),  # k on a null
        ([cell(1, k, "ci", 5, 4, s3=6, n=100) for k in (1, 2)], ("ci", 5, 10 * 2 / (2 * stats.Z975))),  # q3
        ([cell(1, k, "continuous", 0, 0, dp1=1) for k in (1, 2)], ("continuous", 0, 1e-6)),  # p
        ([cell(1, 1, "continuous", 5, 1, dp1=1)], None),  # last
    ],
)
def test_rules(spark, cells, want):
    got = rules.clean(table(spark, cells)).collect()
    if want is None:
        assert got == []
    else:
        assert [(r.statistic, r.stat1, r.stat2) for r in got] == [(want[0], pytest.approx(want[1]), None if want[2] is None else pytest.approx(want[2]))] * 2


def test_rules_need_one_exchange(spark):
    plan = rules.mark(table(spark, [cell(1, 1, "percent", 1)]))._jdf.queryExecution().sparkPlan().toString()
    physical = rules.mark(table(spark, [cell(1, 1, "percent", 1)]))._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_posterior_of_equal_groups(spark):
    rows = [("A", float(i), "continuous", 100.0, 0.0, 1.0, 0.0, 1.0) for i in range(10)]
    got = posterior.posterior(spark.createDataFrame(rows, "pmcid string, row double, statistic string, size double, mdiff double, sem double, t double, sem2 double")).first()
    assert got.log_bf == pytest.approx(125.0, abs=1e-6) and got.slab_mean == pytest.approx(50.0, abs=1e-6) and got.p_flag == pytest.approx(1)


def test_statistics():
    assert stats.exact_binomial_interval([0, 5, 10], [10, 10, 10])[1][0] == pytest.approx(1 - 0.025 ** (1 / 10), abs=1e-9)
    assert stats.chi_square_median(2) == pytest.approx(2 * math.log(2), abs=1e-9)
    assert stats.fisher_p([3], [1], [1], [3])[0] == pytest.approx(34 / 70, abs=1e-9)


def test_text(spark):
    df = spark.createDataFrame([("(87,105)", "(87 105)"), ("12,345", "12345"), ("22- 33", "22 33"), ("1·5", "1.5"), ("N/A", " "), ("on 31/12/2019 and", "on 18261 and"), ("on 12/31/2019 and", "on 12/31/2019 and")], "x string, want string")
    assert [r.got for r in df.select(repair_numbers(F.col("x")).alias("got")).collect()] == [r.want for r in df.collect()]
    assert spark.createDataFrame([("group a (n = 79)",), ("n = 3 of n = 80",)], "x string").select(sample_size_in(F.col("x")).alias("n")).collect() == [(79.0,), (80.0,)]


def test_table_of_a_paper():
    got = interpret(_wrap("Baseline"), "", "baseline characteristics")
    assert got["reason"] is None and got["pvalues_in_table"] and [p["pvalue"] for p in got["pvalues"]] == ["0.62", "0.85", "0.77"]
    assert [(r["row"], r["column"], r["statistic"], r["stat1"], r["stat2"], r["stat3"], r["sample_size"]) for r in got["rows"]] == [
        (1, 1, "continuous", 41.5, 10.2, None, 40.0), (1, 2, "continuous", 42.7, 11.9, None, 42.0), (2, 1, "percent", 22.0, 55.0, None, 40.0),
        (2, 2, "percent", 24.0, 57.1, None, 42.0), (3, 1, "median", 71.0, 60.0, 82.0, 40.0), (3, 2, "median", 70.0, 61.0, 80.0, 42.0),
    ]
    assert interpret("<table-wrap><inline-graphic/></table-wrap>")["reason"] == "Table is graphic"


def test_posterior_against_draws_of_the_model(spark):
    """The integral over beta, by weighting draws from its prior with the whole likelihood."""
    rng = np.random.default_rng(1)
    studies = {"null": rng.standard_t(59, 12), "precise": rng.standard_t(59, 12) * 0.2, "variable": rng.standard_t(59, 12) * 3}
    df = spark.createDataFrame([(k, float(t), 60.0) for k, ts in studies.items() for t in ts], "pmcid string, t double, size double")
    got = {r.pmcid: r for r in posterior.posterior(df).collect()}
    beta = rng.normal(0, math.sqrt(10), 400_000)
    density = lambda x: math.lgamma(30) - math.lgamma(29.5) - 0.5 * math.log(59 * math.pi) - 30 * np.log1p(x * x / 59)
    for k, ts in studies.items():
        w = np.exp(sum(density(t * np.exp(beta / 2)) + beta / 2 - density(t) for t in ts))
        assert got[k].p_flag == pytest.approx(w.mean() / (1 + w.mean()), abs=0.01)
        assert got[k].slab_mean == pytest.approx((w * beta).mean() / w.mean(), abs=0.05)
    assert got["precise"].p_flag > 0.95 and got["variable"].p_flag > 0.95 and got["null"].p_flag < 0.5


def test_penalised_paths_meet_their_optimality_conditions():
    rng = np.random.default_rng(0)
    x = rng.normal(3, 2, (200, 5)) * [1, 5, 0.1, 1, 1]
    y = 2 * x[:, 0] - 0.5 * x[:, 1] + rng.normal(0, 1, 200)
    z = np.column_stack((np.ones(200), x, y))
    lambdas = np.geomspace(3, 0.01, 12)
    for l, b in zip(lambdas, features._path(z.T @ z, lambdas, 0.95)):
        left, s = y - b[0] - x @ b[1:], x.std(0)
        slope = ((x - x.mean(0)) / s).T @ left / 200
        beta = b[1:] * s
        on = np.abs(beta) > 1e-12
        assert left.mean() == pytest.approx(0, abs=1e-8)
        assert slope[on] == pytest.approx(l * (0.95 * np.sign(beta[on]) + 0.05 * beta[on]), abs=1e-6) and (np.abs(slope[~on]) <= 0.95 * l + 1e-6).all()
        assert features._squares(z.T @ z, b) == pytest.approx((left**2).sum())


def test_elastic_net_keeps_what_matters(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (800, 6))
    y = 1.5 * x[:, 0] - x[:, 3] + 4 + rng.normal(0, 1, 800)
    df = spark.createDataFrame([(float(b), *map(float, a), None if i % 50 == 0 else 1.0) for i, (a, b) in enumerate(zip(x, y))], "y double, " + ", ".join(f"x{k} double" for k in range(6)) + ", gap double")
    kept, coefficients, intervals = features.elastic_net(df, "y", [f"x{k}" for k in range(6)])
    want = np.linalg.lstsq(np.column_stack((np.ones(800), x[:, [0, 3]])), y, rcond=None)[0]
    assert kept == ["x0", "x3"] and coefficients == pytest.approx(want[1:], abs=1e-9)
    assert all(lo < b < hi for (lo, hi), b in zip(intervals, (1.5, -1.0)))
    assert features.elastic_net(df, "gap", ["x0"])[0] == [] and features.elastic_net(df.limit(0), "y", ["x0"]) == ([], [], [])
