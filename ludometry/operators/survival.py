"""Kaplan-Meier curves, Cox regression, concordance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.special import normal_two_sided
from ..session import materialize
from .features import drop_missing
from .ordering import rows_at, running_totals
from .places import WINDOW, carried, in_ranges


def kaplan_meier(
    df: DataFrame, duration: str, event: str, by: str, floor: float = 1
) -> DataFrame:
    """Survival curve per group, starting at t = 0 with S = 1.

    Rows are first counted per (group, duration). The counts are cut into
    ranges of (group, duration), so a group with very many different durations
    lies in many ranges: windows run inside a range, and a small table of
    ranges carries on what lies outside it, units at risk from the ranges behind
    and survival from the ones before. Durations are used as they are,
    fractions included.
    """
    kind = "double" if isinstance(df.schema[duration].dataType, T.FractionalType) else "long"
    t = F.greatest(F.col(duration), F.lit(floor)).cast(kind).alias("t")
    days = df.select(by, t, F.col(event).cast("int").alias("e")).groupBy(by, "t").agg(
        F.count("*").alias("n"), F.sum("e").alias("d")
    )
    zero = days.groupBy(by).agg(F.lit(0).cast(kind).alias("t"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("d"))
    rows = in_ranges(materialize(days.unionByName(zero)), [by, "t"])
    inside = Window.partitionBy(by, "_range").orderBy("t")
    before = inside.rowsBetween(Window.unboundedPreceding, 0)
    # Counted from the end, so that every frame grows: one that shrinks is summed anew for each row.
    after = Window.partitionBy(by, "_range").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)

    counted = carried(rows, by, {"_behind": F.sum("n")}, behind=True)
    counted = carried(counted, by, {"_earlier": F.count("*")})
    risk = counted.withColumn("n_at_risk", F.col("_behind") + F.sum("n").over(after))
    risk = risk.withColumn("point", (F.col("_earlier") + F.row_number().over(inside)).cast("int"))
    risk = materialize(risk.select(by, "_range", "point", "t", "n_at_risk", "d", (1 - F.col("d") / F.col("n_at_risk")).alias("_step")))
    curve = carried(risk, by, {"_so_far": F.product("_step")}, start=1.0)
    curve = curve.withColumn("survival", F.col("_so_far") * F.product("_step").over(before))
    return curve.select(by, "point", "t", "n_at_risk", "d", "survival")


def median_survival(curve: DataFrame, by: str, never: float = 365.0) -> DataFrame:
    """First day with survival at or below one half; ``never`` when it stays above."""
    hit = F.min(F.when(F.col("survival") <= 0.5, F.col("t")))
    return curve.groupBy(by).agg(F.coalesce(hit.cast("double"), F.lit(float(never))).alias("median"))


# ── Cox proportional hazards ────────────────────────────────────────────────


@dataclass(frozen=True)
class CoxModel:
    """Coefficients on the original scale and the fitted log likelihood."""

    covariates: list[str]
    coef: np.ndarray
    se: np.ndarray
    log_likelihood: float
    iterations: int
    gradient: np.ndarray

    def summary(self, spark) -> DataFrame:
        """coef, exp(coef), SE, z and p per covariate, smallest p first."""
        rows = [(c, float(b), float(s)) for c, b, s in zip(self.covariates, self.coef, self.se)]
        out = spark.createDataFrame(rows, "covariate string, coef double, se double")
        out = out.withColumns({"exp_coef": F.exp("coef"), "z": F.try_divide("coef", "se")})
        return out.withColumn("p", normal_two_sided("z")).orderBy("p", "covariate")

    def risk(self) -> Column:
        """Linear predictor as a Column."""
        total = F.lit(0.0)
        for name, b in zip(self.covariates, self.coef):
            total = total + F.col(name).cast("double") * F.lit(float(b))
        return total


_WRITTEN_OUT = 20_000
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(32)


def _tie_sums(d: int, s0: float, t0: float) -> tuple[float, float, float, float, float, float]:
    """Sums over the ``d`` tied failures with denominators ``s0 − (l/d)·t0``.

    The last ``_WRITTEN_OUT`` terms, where denominators are smallest, are added
    one by one. The smooth rest is the midpoint rule read backwards: an integral
    by Gauss-Legendre over panels that double in length, and the first
    correction at its ends. No term cancels another, so precision holds for any
    number of ties, and a day on which a third of all units fail costs the same
    as any other.
    """

    def terms(at: np.ndarray) -> np.ndarray:
        w = at / d
        den = s0 - w * t0
        return np.stack([np.log(den), 1 / den, 1 / den**2, w / den, w / den**2, w**2 / den**2])

    cut = max(0, d - _WRITTEN_OUT)
    total = terms(np.arange(cut, d)).sum(axis=1)
    if cut:
        right, length = cut - 0.5, float(_WRITTEN_OUT)
        while right > -0.5:
            left = max(-0.5, right - length)
            half = (right - left) / 2
            total += terms(left + half * (1 + _NODES)) @ _WEIGHTS * half
            right, length = left, 2 * length
        slopes = terms(np.array([cut, cut - 1, 0, -1.0]))
        total -= (slopes[:, 0] - slopes[:, 1] - slopes[:, 2] + slopes[:, 3]) / 24
    return tuple(map(float, total))


#: Different durations that one range holds, and how many ranges there are at most.
_RANGE, _MOST_RANGES = 10_000, 4096
#: Different durations that a task gathers before it passes their sums on.
_GATHERED = 20_000


class _CoxRows:
    """Units as ``t, e, x`` arrays, and the cut points of ranges of durations.

    A Newton step sends the driver one vector of sums for each range (not for
    each duration) and one vector of likelihood, gradient and information.
    """

    def __init__(self, rows: DataFrame, size: int | None = None):
        self.rows = rows
        times = materialize(rows.select("t").distinct())
        n = times.count()
        size = size or max(_RANGE, -(-n // _MOST_RANGES))
        at = rows_at(times, ["t"], range(size, n, size), rows=n)
        self.edges = np.array(sorted(v[0] for v in at.values()), float)

    def _sums(self, beta: np.ndarray) -> DataFrame:
        """``range, t, v``: risk-weighted sums over all units and over the failing ones, reduced inside each task."""
        p, edges = len(beta), self.edges
        upper = np.triu_indices(p)

        def merged(t: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            times, where = np.unique(t, return_inverse=True)
            sums = np.zeros((len(times), parts.shape[1]))
            np.add.at(sums, where, parts)
            return times, sums

        def rows(times: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(times) + 1, dtype=np.int32) * sums.shape[1]), pa.array(sums.ravel()))
            ranges = np.searchsorted(edges, times, side="right").astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(ranges), pa.array(times), lists], names=["range", "t", "v"])

        def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                t, e = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(t), p)
                r = np.exp(x @ beta)
                full = np.column_stack([r, r[:, None] * x, r[:, None] * (x[:, upper[0]] * x[:, upper[1]])])
                found = merged(t, np.column_stack([full, e[:, None] * full, e, e[:, None] * x]))
                held = found if held is None else merged(np.concatenate([held[0], found[0]]), np.concatenate([held[1], found[1]]))
                if len(held[0]) >= _GATHERED:
                    yield rows(*held)
                    held = None
            if held is not None:
                yield rows(*held)

        return self.rows.select("t", "e", "x").mapInArrow(reduce, "range int, t double, v array<double>")

    def terms(self, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Efron log likelihood, gradient and information at ``beta``."""
        p = len(beta)
        width = 1 + p + p * (p + 1) // 2
        sums = self._sums(beta)
        later = np.zeros((len(self.edges) + 1, width))
        if len(self.edges):
            sums = materialize(sums)
            parts = sums.select("range", array_to_vector(F.slice("v", 1, width)).alias("v"))
            for r in parts.groupBy("range").agg(Summarizer.sum(F.col("v")).alias("v")).collect():
                later[r["range"]] = r["v"].toArray()
            later = np.cumsum(later[::-1], axis=0)[::-1] - later
        shared = self.rows.sparkSession.sparkContext.broadcast(later)

        def of_range(table: pa.Table) -> pa.Table:
            times, where = np.unique(table["t"].to_numpy(), return_inverse=True)
            lists = np.asarray(table["v"].combine_chunks().flatten()).reshape(len(where), -1)
            own = np.zeros((len(times), lists.shape[1]))
            np.add.at(own, where, lists)
            ll, gradient, info = _newton_terms(own, beta, shared.value[table["range"][0].as_py()])
            return pa.table({"v": pa.array([[ll, *gradient, *info[np.triu_indices(p)]]], pa.list_(pa.float64()))})

        found = sums.groupBy("range").applyInArrow(of_range, "v array<double>")
        total = found.agg(Summarizer.sum(array_to_vector("v")).alias("v")).first()["v"]
        if total is None or not len(total):
            raise ValueError("no units")
        v = total.toArray()
        return float(v[0]), v[1 : 1 + p], _square(v[1 + p :], p)


def _square(upper: np.ndarray, p: int) -> np.ndarray:
    """The symmetric matrix with this upper triangle."""
    m = np.zeros((p, p))
    m[np.triu_indices(p)] = upper
    return m + m.T - np.diag(np.diag(m))


def _newton_terms(table: np.ndarray, beta: np.ndarray, later: np.ndarray):
    """Efron log likelihood, gradient and information of durations in ascending order, with the sums over all ``later`` ones."""
    p = len(beta)
    width = len(later)
    at_risk = np.cumsum(table[::-1, :width], axis=0)[::-1] + later
    ll, grad, info = 0.0, np.zeros(p), np.zeros((p, p))
    for risk, row in zip(at_risk, table):
        d = int(round(row[2 * width]))
        if d == 0:
            continue
        fail, events = row[width : 2 * width], row[2 * width + 1 :]
        s0, s1, s2 = risk[0], risk[1 : 1 + p], _square(risk[1 + p :], p)
        t0, t1, t2 = fail[0], fail[1 : 1 + p], _square(fail[1 + p :], p)
        logs, a1, a2, b1, b2, c2 = _tie_sums(d, s0, t0)
        ll += events @ beta - logs
        grad += events - (s1 * a1 - t1 * b1)
        info += s2 * a1 - t2 * b1
        info -= np.outer(s1, s1) * a2 - (np.outer(s1, t1) + np.outer(t1, s1)) * b2 + np.outer(t1, t1) * c2
    return ll, grad, info


def cox_ph(
    df: DataFrame,
    duration: str,
    event: str,
    covariates: Sequence[str],
    penalizer: float = 0.01,
    max_iter: int = 30,
    tol: float = 1e-7,
) -> CoxModel:
    """Ridge-penalised Cox regression with Efron ties, by Newton steps.

    Covariates are standardised; the objective is the mean log likelihood minus
    ``penalizer/2 · Σβ²``. Durations may be fractions, with any number of
    different values: they are cut into ranges, and sums over all later units
    are carried from range to range.
    """
    covariates = list(covariates)
    clean = drop_missing(df.select(duration, event, *covariates), [duration, event, *covariates], {duration: 1})
    clean = materialize(clean.select(*[F.col(c).cast("double").alias(c) for c in clean.columns]))
    stats = clean.agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(covariates)],
        *[F.stddev_samp(c).alias(f"s_{i}") for i, c in enumerate(covariates)],
    ).first()
    n, p = stats["n"], len(covariates)
    if not n:
        raise ValueError("no units")
    mean = np.array([stats[f"m_{i}"] for i in range(p)])
    sd = np.array([stats[f"s_{i}"] or 1.0 for i in range(p)])
    x = F.array(*[(F.col(c) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(covariates, mean, sd)])
    rows = clean.select(F.col(duration).alias("t"), F.col(event).alias("e"), x.alias("x")).cache()
    try:
        units = _CoxRows(rows)
        beta = np.zeros(p)

        def at(b: np.ndarray):
            ll, grad, info = units.terms(b)
            return ll / n - penalizer / 2 * b @ b, grad / n - penalizer * b, info / n + penalizer * np.eye(p), ll

        value, grad, info, ll = at(beta)
        steps = 0
        for steps in range(1, max_iter + 1):
            move = np.linalg.solve(info, grad)
            trial = at(beta + move)
            while not (np.isfinite(trial[0]) and trial[0] >= value - 1e-12):
                move = move / 2
                if np.abs(move).max() < tol * 1e-3:
                    raise RuntimeError("no step improves the likelihood")
                trial = at(beta + move)
            beta = beta + move
            value, grad, info, ll = trial
            if np.abs(move).max() < tol:
                break
        else:
            raise RuntimeError(f"no convergence after {max_iter} steps")
    finally:
        rows.unpersist()
    se = np.sqrt(np.diag(np.linalg.inv(info * n)))
    return CoxModel(covariates, beta / sd, se / sd, float(ll), steps, grad)


def cox_terms(
    df: DataFrame, duration: str, event: str, covariates: Sequence[str], beta: Sequence[float]
) -> tuple[float, np.ndarray]:
    """Efron log likelihood and gradient at ``beta``, covariates as they are; rows and durations as in ``cox_ph``."""
    covariates = list(covariates)
    clean = drop_missing(df.select(duration, event, *covariates), [duration, event, *covariates], {duration: 1})
    x = F.array(*[F.col(c).cast("double") for c in covariates])
    rows = clean.select(F.col(duration).cast("double").alias("t"), F.col(event).cast("double").alias("e"), x.alias("x"))
    ll, gradient, _ = _CoxRows(materialize(rows)).terms(np.asarray(beta, dtype=float))
    return ll, gradient


# ── concordance ─────────────────────────────────────────────────────────────


def concordance(
    df: DataFrame,
    duration: str,
    event: str,
    risk: str,
    most: int = WINDOW,
) -> DataFrame:
    """Concordance index: do units with higher risk fail earlier?

    A pair counts when the earlier of the two failed (a failure also precedes a
    censoring at the same time); equal risks count one half. Pairs are never
    formed. Times are coded by their dense rank and split along its binary digits:
    any two different codes part at exactly one digit, where one lies in the
    left half and one in the right half of a range. Within each range the
    right-hand units with lower risk are a running sum over the risk order, so
    the work is rows × digits.
    """
    counted = materialize(
        df.where(F.col(duration).isNotNull() & F.col(event).isNotNull() & F.col(risk).isNotNull())
        .groupBy(F.col(duration).alias("t"), F.col(event).cast("long").alias("e"), F.col(risk).cast("double").alias("risk"))
        .agg(F.count("*").alias("n"))
    )
    ranks = running_totals(counted.select("t").distinct(), ["t"], {"rank": F.lit(1)}, most)
    code = (F.col("rank").cast("long") * 2 + (1 - F.col("e"))).alias("code")
    hist = materialize(counted.join(ranks, "t").select(code, "risk", "n"))
    top = hist.agg(F.max("code")).first()[0] or 0
    digits = max(1, int(top).bit_length())
    level = F.explode(F.array(*[F.lit(i) for i in range(digits)])).alias("level")
    parts = hist.select("code", "risk", "n", level).select(
        "level",
        F.expr("shiftright(code, level + 1)").alias("range"),
        "risk",
        F.when((F.expr("shiftright(code, level)") % 2 == 0) & (F.col("code") % 2 == 0), F.col("n"))
        .otherwise(0)
        .alias("failed_left"),
        F.when(F.expr("shiftright(code, level)") % 2 == 1, F.col("n")).otherwise(0).alias("right"),
    )
    cells = (
        parts.where((F.col("failed_left") > 0) | (F.col("right") > 0))
        .groupBy("level", "range", "risk")
        .agg(F.sum("failed_left").alias("failed_left"), F.sum("right").alias("right"))
    )
    run = materialize(running_totals(cells, ["level", "range", "risk"], {"before": "right"}, most))
    spans = run.groupBy("level", "range").agg(F.min("before").alias("start"), F.sum("right").alias("all_right"))
    lower = (F.col("before") - F.col("start")).cast("double")
    left = F.col("failed_left").cast("double")
    pairs = run.where(F.col("failed_left") > 0).join(spans, ["level", "range"]).agg(
        F.coalesce(F.sum(left * lower), F.lit(0.0)).alias("concordant"),
        F.coalesce(F.sum(left * F.col("right")), F.lit(0.0)).alias("tied"),
        F.coalesce(F.sum(left * F.col("all_right")), F.lit(0.0)).alias("comparable"),
    )
    index = F.try_divide(F.col("concordant") + 0.5 * F.col("tied"), F.col("comparable"))
    return pairs.withColumn("concordance", index)
