"""Tail probabilities and a hypergeometric series, as Arrow UDFs.

Spark has no erfc, incomplete gamma or incomplete beta. The p-value UDFs run
over aggregated rows only (one per test).
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if not (a > 0 and x >= 0):
        return math.nan
    if x == 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > 1e-17 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1.0 - front * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        step = c * d
        h *= step
        if abs(step - 1) < 1e-15:
            return front * h
    raise ArithmeticError(f"Q({a}, {x}) did not converge")


def beta_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b) by Lentz's continued fraction."""
    if not 0 <= x <= 1:
        return math.nan
    if x in (0.0, 1.0):
        return x
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_reg(b, a, 1 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    h = d
    for m in range(1, 10_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            return front * h / a
    raise ArithmeticError(f"I_{x}({a}, {b}) did not converge")


def digamma_trigamma(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of ln Γ for positive arguments.

    Small arguments are moved up by the recurrences, large ones use the
    asymptotic series.
    """
    x = np.array(x, float)
    first, second = np.zeros_like(x), np.zeros_like(x)
    while (small := x < 12).any():
        first -= np.where(small, 1 / x, 0.0)
        second += np.where(small, 1 / x**2, 0.0)
        x += small
    y = 1 / x**2
    first += np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))
    second += 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y * (1 / 30 - y * 5 / 66))))
    return first, second


def _map(fn, *series: pd.Series) -> pd.Series:
    return pd.Series(
        [None if any(pd.isna(v) for v in row) else fn(*map(float, row)) for row in zip(*series)],
        dtype="float64",
    )


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """P(|N(0,1)| ≥ |z|)."""
    return _map(lambda v: math.erfc(abs(v) / math.sqrt(2)), z)


@F.pandas_udf(T.DoubleType())
def chi2_sf(x: pd.Series, dof: pd.Series) -> pd.Series:
    """P(χ²(dof) ≥ x)."""
    return _map(lambda v, k: 1.0 if k == 0 else gamma_upper(k / 2, v / 2), x, dof)


@F.pandas_udf(T.DoubleType())
def student_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    """P(|T(dof)| ≥ |t|); for very many degrees of freedom the normal tail of the matching quantile."""

    def tail(v: float, k: float) -> float:
        if math.isinf(v):
            return 0.0
        if k < 1e6:
            return beta_reg(k / 2, 0.5, k / (k + v * v))
        return math.erfc(abs(v) * (1 - (v * v + 1) / (4 * k)) / math.sqrt(2))

    return _map(tail, t, dof)


def hyp2f1(a: np.ndarray, b: np.ndarray, c: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Gauss hypergeometric series for 0 ≤ z < 1, whole arrays at a time."""
    term = np.ones_like(z)
    total = np.ones_like(z)
    for k in range(100_000):
        term = term * (a + k) * (b + k) / ((c + k) * (k + 1)) * z
        total = total + term
        if np.all(np.abs(term) <= 1e-15 * np.abs(total)):
            return total
    raise ArithmeticError("the hypergeometric series did not converge")
