"""BG/NBD purchase counts and Gamma-Gamma spend: fitted and scored on Spark.

Both likelihoods are sums over customers with derivatives in closed form, so a
Newton step is one Spark pass that returns the sum, its gradient and its second
derivatives: a dozen numbers, however many customers there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.special import digamma_trigamma, hyp2f1
from ..session import materialize

#: Of a batch and parameters: log likelihood, gradient and second derivatives, a row for each customer.
Terms = Callable[[pd.DataFrame, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _sums(rows: DataFrame, terms: Terms, params: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Weight, weighted log likelihood, gradient and second derivatives over all customers, in one pass."""
    k = len(params)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(2 + k + k * k)
        for batch in batches:
            w = batch["w"].to_numpy(dtype=float)
            value, gradient, second = terms(batch, params)
            total += np.concatenate([[w.sum(), w @ value], w @ gradient, (w @ second.reshape(len(w), -1))])
        yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    found = rows.mapInPandas(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    v = np.zeros(2 + k + k * k)
    for row in found:
        v[row["i"]] = row["v"]
    return float(v[0]), float(v[1]), v[2 : 2 + k], v[2 + k :].reshape(k, k)


def _maximize(
    rows: DataFrame, terms: Terms, start: np.ndarray, penalizer: float, max_iter: int = 100, tol: float = 1e-9
) -> tuple[np.ndarray, float]:
    """Maximise mean log likelihood − penalizer·Σθ² over log parameters by damped Newton steps."""

    def at_point(point: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        theta = np.exp(point)
        weight, value, gradient, second = _sums(rows, terms, theta)
        slope = theta * gradient / weight
        bend = np.diag(slope) + np.outer(theta, theta) * second / weight
        return value / weight - penalizer * (theta**2).sum(), slope - 2 * penalizer * theta**2, bend - 4 * penalizer * np.diag(theta**2)

    at = np.array(start, dtype=float)
    value, gradient, bend = at_point(at)
    for _ in range(max_iter):
        if np.abs(gradient).max() < tol:
            break
        # Directions of positive curvature are flipped, and no step is longer than two.
        lam, vec = np.linalg.eigh(-bend)
        step = vec @ ((vec.T @ gradient) / np.maximum(np.abs(lam), 1e-3))
        step = step * min(1.0, 2.0 / np.abs(step).max())
        trial = at_point(at + step)
        while not (np.isfinite(trial[0]) and trial[0] > value) and np.abs(step).max() > 1e-10:
            step = step / 4
            trial = at_point(at + step)
        if not trial[0] > value:
            # No step of any length is better: the top, as far as the likelihood's digits reach.
            if np.abs(gradient).max() < math.sqrt(tol):
                break
            raise RuntimeError("no step improves the likelihood")
        at, (value, gradient, bend) = at + step, trial
    else:
        raise RuntimeError(f"no convergence after {max_iter} steps")
    return np.exp(at), value


def _rising(top: int, base: float) -> np.ndarray:
    """ln Γ(base + x) − ln Γ(base) and its first two derivatives, for x = 0..top."""
    at = base + np.arange(top)
    steps = np.stack([np.log(at), 1 / at, -1 / at**2])
    return np.concatenate([np.zeros((3, 1)), np.cumsum(steps, axis=1)], axis=1)


def _bgnbd_terms(batch: pd.DataFrame, params: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The likelihood is a sum of two ways: still active, or gone after the last purchase."""
    r, alpha, a, b = params
    x = batch["x"].to_numpy(dtype="int64")
    tx, t = batch["tx"].to_numpy(dtype=float), batch["t"].to_numpy(dtype=float)
    top, n = int(x.max(initial=0)), len(x)
    by_r, by_b, by_ab = (_rising(top, base)[:, x] for base in (r, b, a + b))
    bought = x > 0
    last = b + np.maximum(x, 1) - 1
    alive = -(r + x) * np.log(alpha + t)
    gone = np.log(a) - np.log(last) - (r + x) * np.log(alpha + tx)
    both = np.where(bought, np.logaddexp(alive, gone), alive)
    p = np.where(bought, np.exp(gone - both), 0.0)

    # Slopes of the two ways, and of what they share.
    active, left, shared = np.zeros((3, n, 4))
    active[:, 0], active[:, 1] = -np.log(alpha + t), -(r + x) / (alpha + t)
    left[:, 0], left[:, 1], left[:, 2], left[:, 3] = -np.log(alpha + tx), -(r + x) / (alpha + tx), 1 / a, -1 / last
    shared[:, 0], shared[:, 1], shared[:, 2], shared[:, 3] = by_r[1] + np.log(alpha), r / alpha, -by_ab[1], by_b[1] - by_ab[1]
    gap = left - active
    second = (p * (1 - p))[:, None, None] * gap[:, :, None] * gap[:, None, :]
    for weight, time in ((1 - p, t), (p, tx)):
        second[:, 0, 1] -= weight / (alpha + time)
        second[:, 1, 1] += weight * (r + x) / (alpha + time) ** 2
    second[:, 2, 2] += -p / a**2 - by_ab[2]
    second[:, 3, 3] += p / last**2 + by_b[2] - by_ab[2]
    second[:, 2, 3] -= by_ab[2]
    second[:, 0, 0] += by_r[2]
    second[:, 0, 1] += 1 / alpha
    second[:, 1, 1] -= r / alpha**2
    second[:, 1, 0], second[:, 3, 2] = second[:, 0, 1], second[:, 2, 3]
    value = by_r[0] + r * math.log(alpha) + by_b[0] - by_ab[0] + both
    return value, shared + active + p[:, None] * gap, second


def _lgamma(v: np.ndarray) -> np.ndarray:
    values, where = np.unique(v, return_inverse=True)
    return np.array([math.lgamma(u) for u in values])[where]


def _gamma_gamma_terms(batch: pd.DataFrame, params: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p, q, v = params
    x, m = batch["x"].to_numpy(dtype=float), batch["m"].to_numpy(dtype=float)
    spent, px = x * m + v, p * x
    value = _lgamma(px + q) - _lgamma(px) - math.lgamma(q) + q * math.log(v) + (px - 1) * np.log(m) + px * np.log(x) - (px + q) * np.log(spent)
    (sum1, sum2), (own1, own2), (q1, q2) = digamma_trigamma(px + q), digamma_trigamma(px), digamma_trigamma(np.array([q]))
    gradient = np.stack([x * (sum1 - own1 + np.log(m * x) - np.log(spent)), sum1 - q1 + math.log(v) - np.log(spent), q / v - (px + q) / spent], axis=1)
    second = np.zeros((len(x), 3, 3))
    second[:, 0, 0], second[:, 1, 1], second[:, 2, 2] = x * x * (sum2 - own2), sum2 - q2, (px + q) / spent**2 - q / v**2
    second[:, 0, 1] = second[:, 1, 0] = x * sum2
    second[:, 0, 2] = second[:, 2, 0] = -x / spent
    second[:, 1, 2] = second[:, 2, 1] = 1 / v - 1 / spent
    return value, gradient, second


@dataclass(frozen=True)
class BetaGeo:
    """BG/NBD parameters."""

    r: float
    alpha: float
    a: float
    b: float
    log_likelihood: float

    def expected(self, t: float, x: str = "frequency", tx: str = "recency", age: str = "T") -> Column:
        """Expected purchases in the next ``t`` days."""
        r, alpha, a, b = self.r, self.alpha, self.a, self.b

        @F.pandas_udf(T.DoubleType())
        def expect(x: pd.Series, tx: pd.Series, age: pd.Series) -> pd.Series:
            xv, rec, end = (s.to_numpy(dtype=float) for s in (x, tx, age))
            z = t / (alpha + end + t)
            # Euler's transformation keeps the series short when z is near one.
            ones = np.ones_like(z)
            tail = (1 - z) ** (a - 1) * hyp2f1((a + b - 1 - r) * ones, (a - 1) * ones, a + b + xv - 1, z)
            upper = (a + b + xv - 1) / (a - 1) * (1 - tail)
            odds = np.where(xv > 0, a / (b + np.maximum(xv, 1) - 1) * ((alpha + end) / (alpha + rec)) ** (r + xv), 0.0)
            return pd.Series(upper / (1 + odds))

        return expect(x, tx, age)

    def p_alive(self, x: str = "frequency", tx: str = "recency", age: str = "T") -> Column:
        """Probability that the customer is still active."""
        xc = F.col(x).cast("double")
        grown = F.pow((F.lit(self.alpha) + F.col(age)) / (F.lit(self.alpha) + F.col(tx)), F.lit(self.r) + xc)
        odds = F.when(xc > 0, F.lit(self.a) / (F.lit(self.b) + xc - 1) * grown).otherwise(0.0)
        return 1 / (1 + odds)


@dataclass(frozen=True)
class GammaGamma:
    """Gamma-Gamma spend parameters."""

    p: float
    q: float
    v: float
    log_likelihood: float

    def expected_value(self, x: str = "frequency", m: str = "monetary") -> Column:
        """Expected spend per purchase day: population mean and own mean, weighted."""
        px = F.lit(self.p) * F.col(x)
        weight = px / (px + F.lit(self.q - 1))
        return (1 - weight) * F.lit(self.v * self.p / (self.q - 1)) + weight * F.col(m)


def _triples(summary: DataFrame) -> DataFrame:
    same = summary.groupBy(F.col("frequency").alias("x"), F.col("recency").alias("tx"), F.col("T").alias("t"))
    return materialize(same.agg(F.count("*").alias("w")))


def _spends(summary: DataFrame) -> DataFrame:
    return materialize(summary.groupBy(F.col("frequency").alias("x"), F.col("monetary").alias("m")).agg(F.count("*").alias("w")))


def bgnbd_terms(summary: DataFrame, r: float, alpha: float, a: float, b: float) -> tuple[float, np.ndarray]:
    """Log likelihood of all customers and its gradient by (r, alpha, a, b), at these parameters."""
    _, value, gradient, _ = _sums(_triples(summary), _bgnbd_terms, np.array([r, alpha, a, b]))
    return value, gradient


def gamma_gamma_terms(summary: DataFrame, p: float, q: float, v: float) -> tuple[float, np.ndarray]:
    """Log likelihood of all customers' spend and its gradient by (p, q, v), at these parameters."""
    _, value, gradient, _ = _sums(_spends(summary), _gamma_gamma_terms, np.array([p, q, v]))
    return value, gradient


def fit_bgnbd(summary: DataFrame, penalizer: float = 0.001) -> BetaGeo:
    """Fit purchase and dropout rates to (frequency, recency, T).

    Customers with the same triple are collapsed into one weighted row first.
    Time is rescaled so the longest T is 10 while fitting.
    """
    rows = _triples(summary)
    longest = rows.agg(F.max("t")).first()[0]
    if not longest:
        raise ValueError("no observation time to fit on")
    scale = 10.0 / longest
    scaled = rows.select("x", (F.col("tx") * scale).alias("tx"), (F.col("t") * scale).alias("t"), "w").cache()
    try:
        (r, alpha, a, b), ll = _maximize(scaled, _bgnbd_terms, np.log([1.0, 1.0, 1.0, 1.0]), penalizer)
    finally:
        scaled.unpersist()
    return BetaGeo(float(r), float(alpha / scale), float(a), float(b), ll)


def fit_gamma_gamma(summary: DataFrame, penalizer: float = 0.001) -> GammaGamma:
    """Fit the spend model to customers with repeat purchases."""
    if not summary.where((F.col("monetary") <= 0) | (F.col("frequency") <= 0)).isEmpty():
        raise ValueError("frequency and monetary must be positive")
    rows = _spends(summary).cache()
    try:
        (p, q, v), ll = _maximize(rows, _gamma_gamma_terms, np.log([1.0, 1.0, 1.0]), penalizer)
    finally:
        rows.unpersist()
    return GammaGamma(float(p), float(q), float(v), ll)


def with_expected_purchases(summary: DataFrame, model: BetaGeo, horizons: Sequence[int] = (30, 90)) -> DataFrame:
    return summary.withColumns({f"pred_purchases_{t}d": model.expected(float(t)) for t in horizons})


def with_clv(
    summary: DataFrame,
    purchases: BetaGeo,
    spend: GammaGamma,
    months: int = 3,
    rate: float = 0.01,
    out: str = "predicted_clv",
) -> DataFrame:
    """Discounted value of the purchases expected in each coming 30-day month."""
    steps = {f"_e{m}": purchases.expected(30.0 * m) for m in range(1, months + 1)}
    scored = summary.withColumns(steps)
    total = F.lit(0.0)
    for m in range(1, months + 1):
        gained = F.col(f"_e{m}") - (F.col(f"_e{m - 1}") if m > 1 else F.lit(0.0))
        total = total + gained / F.lit((1 + rate) ** m)
    return scored.withColumn(out, spend.expected_value() * total).drop(*steps)
