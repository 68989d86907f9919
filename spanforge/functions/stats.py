"""Special functions and tests, as vectorised functions of columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def gamma_p(s: float, x: float) -> float:
    """The lower regularised incomplete gamma function: series below s + 1, else continued fraction."""
    if x <= 0:
        return 0.0
    if x > s + 1:
        return 1.0 - gamma_q(s, x)
    term = total = 1.0 / s
    k = s
    while abs(term) > abs(total) * 1e-16:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(-x + s * math.log(x) - math.lgamma(s))


def gamma_q(s: float, x: float) -> float:
    """The upper regularised incomplete gamma function."""
    if x <= s + 1:
        return 1.0 - gamma_p(s, x)
    tiny = 1e-300
    b = x + 1 - s
    c, d = 1 / tiny, 1 / b
    h = d
    for k in range(1, 10_000):
        a = -k * (k - s)
        b += 2
        d = 1 / ((a * d + b) or tiny)
        c = (b + a / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + s * math.log(x) - math.lgamma(s))


def beta_i(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_i(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    h = d
    for m in range(1, 10_000):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + t * d) or tiny)
            c = (1 + t / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(a * math.log(x) + b * math.log(1 - x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a


def _applied(function, *cols: Column) -> Column:
    """A function of numbers over columns; null if any argument is."""

    @F.pandas_udf("double")
    def run(args: pd.DataFrame) -> pd.Series:
        # equal arguments are computed once: real columns of counts repeat few values
        cols = [args[c].to_numpy(float) for c in args.columns]
        rows = np.stack(cols, axis=1)
        some = np.flatnonzero(~np.isnan(rows).any(axis=1))
        out = np.full(len(rows), np.nan)
        if len(some):
            distinct, which = np.unique(rows[some], axis=0, return_inverse=True)
            out[some] = np.array([function(*vs) for vs in distinct.tolist()])[which.reshape(-1)]
        return pd.Series([None if x else v for v, x in zip(out.tolist(), np.isnan(rows).any(axis=1).tolist(), strict=True)], dtype="object")

    return run(F.struct(*[c.cast("double").alias(f"c{k}") for k, c in enumerate(cols)]))


def lgamma(x: Column) -> Column:
    """Logarithm of the gamma function."""
    return _applied(math.lgamma, x)


def erfc(x: Column) -> Column:
    """Complementary error function."""
    return _applied(math.erfc, x)


def gammap(s: Column, x: Column) -> Column:
    """Lower regularised incomplete gamma function."""
    return _applied(gamma_p, s, x)


def gammaq(s: Column, x: Column) -> Column:
    """Upper regularised incomplete gamma function."""
    return _applied(gamma_q, s, x)


def betai(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function."""
    return _applied(beta_i, a, b, x)


_FACTORIALS = np.zeros(1)


def _log_factorials(most: int) -> np.ndarray:
    """Logarithms of 0! to at least ``most``!, kept and extended by doubling."""
    global _FACTORIALS
    if len(_FACTORIALS) <= most:
        size = max(most + 1, 2 * len(_FACTORIALS), 1024)
        _FACTORIALS = np.array([math.lgamma(i + 1) for i in range(size)]) if size <= 1 << 22 else np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, size)))])
    return _FACTORIALS


def fisher(n11: int, n12: int, n21: int, n22: int) -> tuple[float, float, float]:
    """(left, right, two-tailed) probabilities of Fisher's exact test on a 2x2 table."""
    row, col, total = n11 + n12, n11 + n21, n11 + n12 + n21 + n22
    low, high = max(0, row + col - total), min(row, col)
    k = np.arange(low, high + 1)
    table = _log_factorials(total)
    log = table[row] + table[total - row] + table[col] + table[total - col] - table[total] - table[k] - table[row - k] - table[col - k] - table[total - row - col + k]
    p = np.exp(log)
    at = p[n11 - low]
    return float(min(p[k <= n11].sum(), 1)), float(min(p[k >= n11].sum(), 1)), float(min(p[p <= at * (1 + 1e-8)].sum(), 1))


def fisher_exact(n11: Column, n12: Column, n21: Column, n22: Column) -> Column:
    """struct<left,right,two> of Fisher's exact test."""

    @F.pandas_udf("left double, right double, two double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fisher(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(a, b, c, d, strict=True)], columns=["left", "right", "two"])

    return run(n11, n12, n21, n22)
