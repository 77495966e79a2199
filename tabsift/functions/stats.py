"""Distribution functions as column expressions, and a few as vectorised functions.

Tail areas of Student's t come from the incomplete beta function, over Arrow
batches. The SQL that checks them has another form: with u = atan(|t| / sqrt(df))
the two-sided p is the share of cos(x)^(df - 1) that lies beyond u on [0, pi/2],
by Simpson's rule with 2000 intervals.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Z975 = 1.959963984540054
_PANELS = 2000


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) of Student's t, by the incomplete beta function, in Arrow batches."""

    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        known = (t.notna() & df.notna()).to_numpy()
        out = np.full(len(t), np.nan)
        x, n = t.to_numpy(float)[known], df.to_numpy(float)[known]
        out[known] = beta_cdf(n / (n + x * x), n / 2, np.full(len(n), 0.5))
        return pd.Series(out)

    return p(t.cast("double"), df.cast("double"))


def t_two_sided_sql(t: str, df: str) -> str:
    """The same for DuckDB."""

    def simpson(low: str, high: str) -> str:
        h = f"(({high} - {low}) / {float(_PANELS)})"
        return f"(list_sum(list_transform(range(0, {_PANELS + 1}), lambda i: (CASE WHEN i = 0 OR i = {_PANELS} THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END) * pow(greatest(cos({low} + {h} * i), 0.0), ({df}) - 1))) * {h} / 3)"

    start = f"atan(abs({t}) / sqrt({df}))"
    end = f"least(pi() / 2, 9.0 / sqrt({df}))"
    return f"least((CASE WHEN {start} >= {end} THEN 0.0 ELSE {simpson(start, end)} END) / {simpson('0.0', end)}, 1.0)"


def kolmogorov_p(d: Column, n: Column) -> Column:
    """P-value of Kolmogorov's distance d of n values, by the asymptotic series with Stephens' correction."""
    root = F.sqrt(n.cast("double"))
    x = (root + 0.12 + F.lit(0.11) / root) * d
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * k * k * x * x))
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def kolmogorov_p_sql(d: str, n: str) -> str:
    x = f"((sqrt({n}::DOUBLE) + 0.12 + 0.11 / sqrt({n}::DOUBLE)) * {d})"
    return f"CASE WHEN {x} < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, list_sum(list_transform(range(1, 61), lambda k: (CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2 * k * k * {x} * {x}))))) END"


def chi_square_yates(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Chi-square of a two-by-two table with the continuity correction, which never exceeds the deviation."""
    n = (a + b + c + d).cast("double")
    cross = F.abs(a * d - b * c)
    dev = F.greatest(cross - F.least(n / 2, cross), F.lit(0.0))
    return F.try_divide(n * dev * dev, ((a + b) * (c + d) * (a + c) * (b + d)).cast("double"))


def chi_square_yates_sql(a: str, b: str, c: str, d: str) -> str:
    n, cross = f"({a} + {b} + {c} + {d})::DOUBLE", f"abs({a} * {d} - {b} * {c})"
    dev = f"greatest({cross} - least({n} / 2, {cross}), 0.0)"
    return f"({n} * {dev} * {dev}) / nullif((({a} + {b}) * ({c} + {d}) * ({a} + {c}) * ({b} + {d}))::DOUBLE, 0)"


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers: Stirling's series from 10 on, which smaller ones are raised to."""
    x = np.asarray(x, float)
    up, less = x.copy(), np.zeros_like(x)
    for _ in range(10):
        low = up < 10
        less = np.where(low, less + np.log(np.where(low, up, 1.0)), less)
        up = np.where(low, up + 1, up)
    z = 1 / (up * up)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / up
    return (up - 0.5) * np.log(up) - up + 0.5 * math.log(2 * math.pi) + series - less


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        before = h
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.allclose(h, before, rtol=1e-14, atol=0, equal_nan=True):
            break
    with np.errstate(divide="ignore"):
        front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    out = np.clip(front * h, 0, 1)
    out = np.where(swap, 1 - out, out)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def _bisect(f, low: np.ndarray, high: np.ndarray, steps: int = 80) -> np.ndarray:
    for _ in range(steps):
        mid = (low + high) / 2
        below = f(mid) < 0
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def exact_binomial_interval(x: np.ndarray, n: np.ndarray, level: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """Clopper and Pearson's interval."""
    x, n = np.asarray(x, float), np.asarray(n, float)
    a = (1 - level) / 2
    zero, one = np.zeros_like(x), np.ones_like(x)
    low = _bisect(lambda p: beta_cdf(p, np.maximum(x, 1e-9), n - x + 1) - a, zero, one)
    high = _bisect(lambda p: beta_cdf(p, x + 1, np.maximum(n - x, 1e-9)) - (1 - a), zero, one)
    return np.where(x == 0, 0.0, low), np.where(x == n, 1.0, high)


def gamma_cdf(x: np.ndarray, shape: float) -> np.ndarray:
    """Regularised lower incomplete gamma function, by its series."""
    x = np.asarray(x, float)
    term = np.full_like(x, 1 / shape)
    total = term.copy()
    for k in range(1, 500):
        term = term * x / (shape + k)
        total = total + term
    with np.errstate(divide="ignore"):
        return np.where(x > 0, total * np.exp(-x + shape * np.log(x) - math.lgamma(shape)), 0.0)


def chi_square_median(df: int) -> float:
    return float(2 * _bisect(lambda v: gamma_cdf(v, df / 2) - 0.5, np.zeros(1), np.full(1, df + 10.0))[0])


def gamma_fit(mean: float, mean_log: float) -> tuple[float, float]:
    """(shape, rate) of the gamma distribution of greatest likelihood, from the means of x and ln x."""
    s = math.log(mean) - mean_log
    k = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(50):
        h = 1e-5 * k
        digamma = lambda v: (math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h)
        tri = (math.lgamma(k + h) - 2 * math.lgamma(k) + math.lgamma(k - h)) / h**2
        step = (math.log(k) - digamma(k) - s) / (1 / k - tri)
        k -= step
        if abs(step) < 1e-10 * k:
            break
    return k, k / mean


def fisher_p(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Fisher's exact test: the probability of all tables with these margins that are no likelier than this one."""
    a, b, c, d = (np.asarray(x, np.int64) for x in (a, b, c, d))
    r, col, n = a + b, a + c, a + b + c + d
    low, high = np.maximum(0, col - (n - r)), np.minimum(r, col)
    row = np.repeat(np.arange(len(a)), high - low + 1)
    k = np.arange(len(row)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[row]
    lf = lambda x: log_gamma(x + 1.0)
    fixed = lf(r) + lf(n - r) + lf(col) + lf(n - col) - lf(n)
    logs = lambda k, i: fixed[i] - lf(k) - lf(r[i] - k) - lf(col[i] - k) - lf(n[i] - r[i] - col[i] + k)
    here, own = logs(k, row), logs(a, np.arange(len(a)))
    return np.minimum(np.bincount(row, np.where(here <= own[row] + 1e-7, np.exp(here), 0.0), len(a)), 1.0)


def fisher(a: str, b: str, c: str, d: str) -> Column:
    """fisher_p() of columns."""

    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(fisher_p(a, b, c, d))

    return p(a, b, c, d)
