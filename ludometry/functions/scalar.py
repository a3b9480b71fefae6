"""Column builders: day arithmetic, guarded ratios, flags, bins, scores.

All are plain Column expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_date(value) -> Column:
    """A DATE column from a date literal, ISO string or Column."""
    return value if isinstance(value, Column) else F.to_date(F.lit(str(value)))


def days_since(col: str | Column, obs, elapsed: bool = False) -> Column:
    """Whole days from ``col`` to ``obs``.

    Calendar days by default; ``elapsed=True`` counts completed 24-hour spans,
    which differs only when the inputs carry a time of day.
    """
    if not elapsed:
        return F.datediff(as_date(obs), F.to_date(_c(col)))
    end = (obs if isinstance(obs, Column) else F.lit(str(obs))).cast("timestamp")
    seconds = F.unix_micros(end) - F.unix_micros(_c(col).cast("timestamp"))
    return F.floor(seconds / F.lit(86_400_000_000)).cast("int")


def safe_ratio(num: str | Column, den: str | Column, floor: float = 1) -> Column:
    """``num / max(den, floor)``; NULL when either side is NULL."""
    den = _c(den)
    return _c(num) / F.when(den.isNotNull(), F.greatest(den, F.lit(floor)))


def flag_eq(col: str | Column, value) -> Column:
    """1 when equal, 0 otherwise; a NULL input counts as not equal."""
    return F.coalesce((_c(col) == F.lit(value)).cast("int"), F.lit(0))


def flag_in(col: str | Column, values: Sequence) -> Column:
    """1 when the value is in the list, 0 otherwise (also for NULL)."""
    return F.coalesce(_c(col).isin(list(values)).cast("int"), F.lit(0))


def cut(col: str | Column, bins: Sequence[float], labels: Sequence[str], include_lowest: bool = False) -> Column:
    """Label of the right-closed bin ``(lo, hi]``; NULL outside all bins."""
    if len(labels) != len(bins) - 1:
        raise ValueError("need one label per bin")
    col = _c(col)
    expr = None
    for i, label in enumerate(labels):
        low = col >= F.lit(bins[i]) if i == 0 and include_lowest else col > F.lit(bins[i])
        hit = low & (col <= F.lit(bins[i + 1]))
        expr = F.when(hit, F.lit(label)) if expr is None else expr.when(hit, F.lit(label))
    return expr


def cut_order(label_col: str | Column, labels: Sequence[str]) -> Column:
    """1-based position of a bin label, for sorting an ordered category."""
    return F.array_position(F.array(*[F.lit(x) for x in labels]), _c(label_col)).cast("int")


def weighted_score(weights: Mapping[str, float]) -> Column:
    """Sum of column × weight."""
    total = None
    for name, weight in weights.items():
        term = F.col(name) * F.lit(weight)
        total = term if total is None else total + term
    return total


def affine(col: str | Column, scale: float = 1, shift: float = 0) -> Column:
    """``shift + scale · col``."""
    return F.lit(shift) + F.lit(scale) * _c(col)


def first_match(rules: Sequence[tuple[Column, object]], otherwise) -> Column:
    """Value of the first rule whose predicate holds."""
    expr = None
    for predicate, value in rules:
        expr = F.when(predicate, F.lit(value)) if expr is None else expr.when(predicate, F.lit(value))
    return expr.otherwise(F.lit(otherwise))
