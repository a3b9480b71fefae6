"""Global order without a global sort in one task.

Ranks, running sums and exact quantiles over a whole table are usually written
with an unpartitioned window, which moves every row into one task, or with
``percentile``, which keeps every distinct value in one buffer. Here rows get
their place from a sort by ranges, and windows run over blocks of bounded size
whose offsets are added up level by level; the number of blocks grows with the
table. Single positions are found by narrowing: only the ranges that hold one
are cut further, until they are small enough to be sorted.

The order columns must identify a row. Collapse ties first (``groupBy(value)``
with a weight), so a value that holds a third of all rows is one row here.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .places import WINDOW, placed

#: Ranges that one step of narrowing cuts a range into.
BUCKETS = 1024
_SAMPLE_PER_BUCKET = 50


def _key(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])


def _edges(df: DataFrame, order: Sequence[str], rows: int, bits: int) -> Column:
    """``2**bits − 1`` sampled bucket edges in order, from a scalar subquery."""
    buckets = 2**bits
    every = max(1, rows // (buckets * _SAMPLE_PER_BUCKET))
    sample = df.where(F.pmod(F.xxhash64(*order), F.lit(every)) == 0).agg(
        F.sort_array(F.collect_list(_key(order))).alias("s")
    )
    spots = F.sequence(F.lit(1), F.lit(buckets - 1))
    picked = F.transform(spots, lambda i: F.get("s", F.floor(i * F.size("s") / F.lit(buckets)).cast("int")))
    return sample.select(picked.alias("edges")).scalar()


def _with_bucket(df: DataFrame, order: Sequence[str], rows: int, buckets: int) -> DataFrame:
    """Add the number of edges below each row, found by binary search."""
    bits = max(1, (buckets - 1).bit_length())
    halves = F.array(*[F.lit(2**b) for b in reversed(range(bits))])
    df = df.withColumn("_edges", _edges(df, order, rows, bits)).withColumn("_key", _key(order))
    bucket = F.aggregate(
        halves,
        F.lit(0),
        lambda at, half: at + F.when(F.get("_edges", at + half - 1) < F.col("_key"), half).otherwise(0),
    )
    return df.withColumn("_b", bucket).drop("_edges", "_key")


def _before(window) -> "Window":
    return window.rowsBetween(Window.unboundedPreceding, -1)


def _offsets(totals: DataFrame, names: Sequence[str], most: int) -> DataFrame:
    """``_b`` and, for each name, the sum over all lower ``_b``; no window sees more than ``most`` rows."""
    if totals.select("_b").limit(most + 1).count() <= most:
        run = _before(Window.orderBy("_b"))
        return totals.select("_b", *[F.coalesce(F.sum(n).over(run), F.lit(0)).alias(n) for n in names])
    totals = materialize(totals.withColumn("_up", F.floor(F.col("_b") / most)))
    above = totals.groupBy(F.col("_up").alias("_b")).agg(*[F.sum(n).alias(n) for n in names])
    above = _offsets(above, names, most).withColumnsRenamed({"_b": "_up", **{n: f"_above_{n}" for n in names}})
    run = _before(Window.partitionBy("_up").orderBy("_b"))
    inner = totals.select("_b", "_up", *[F.coalesce(F.sum(n).over(run), F.lit(0)).alias(n) for n in names]).join(above, "_up")
    return inner.select("_b", *[(F.col(n) + F.col(f"_above_{n}")).alias(n) for n in names])


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    sums: Mapping[str, str | Column],
    most: int = WINDOW,
) -> DataFrame:
    """Add, per row, the sum of each expression over all rows ordered before it.

    Windows run over blocks of exactly ``most`` rows in the order of the table;
    a table of no more rows is one block.
    """
    sums = {n: (F.col(e) if isinstance(e, str) else e) for n, e in sums.items()}
    written = materialize(df.withColumn("_all", F.lit(0)))
    if written.count() <= most:
        run = _before(Window.orderBy(*order))
        return written.select(*df.columns, *[F.coalesce(F.sum(e).over(run), F.lit(0)).alias(n) for n, e in sums.items()])
    rows = placed(written, "_all", order)
    rows = rows.withColumn("_b", F.floor(F.col("place") / most))
    totals = materialize(rows.groupBy("_b").agg(*[F.sum(e).alias(f"_o_{n}") for n, e in sums.items()]))
    offsets = _offsets(totals, [f"_o_{n}" for n in sums], most)
    run = _before(Window.partitionBy("_b").orderBy("place"))
    local = rows.withColumns({f"_l_{n}": F.coalesce(F.sum(e).over(run), F.lit(0)) for n, e in sums.items()})
    joined = local.join(offsets, "_b")
    return joined.select(*df.columns, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def rows_at(
    df: DataFrame,
    order: Sequence[str],
    positions: Sequence[int],
    weight: str | None = None,
    rows: int | None = None,
    most: int = WINDOW,
) -> dict[int, tuple]:
    """Order-column values at 0-based ``positions`` of the sorted table.

    With ``weight`` a row stands for that many equal copies. ``df`` should be
    materialized. Ranges that hold no wanted position are dropped, the others
    cut further until none has more than ``most`` rows, and only those rows are
    sorted. Returns one tuple per position (a handful).
    """
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    largest = rows = df.count() if rows is None else rows
    wanted = F.array(*[F.lit(int(p)).cast("long") for p in sorted(set(positions))]).cast("array<bigint>")

    def inside(start: Column, length: Column) -> Column:
        return F.filter(wanted, lambda p: (p >= start) & (p < start + length))

    current = df.select(*order, w.alias("_w"), F.lit(0).cast("long").alias("_base"))
    while largest > most:
        cut = _with_bucket(current, order, rows, BUCKETS)
        parts = cut.groupBy("_base", "_b").agg(F.sum("_w").alias("_w"), F.count("*").alias("_n"))
        below = _before(Window.partitionBy("_base").orderBy("_b"))
        start = F.col("_base") + F.coalesce(F.sum("_w").over(below), F.lit(0))
        hit = parts.withColumn("_start", start).where(F.size(inside(F.col("_start"), F.col("_w"))) > 0)
        hit = materialize(hit.select("_base", "_b", "_start", "_n"))
        kept = cut.join(F.broadcast(hit.drop("_n")), ["_base", "_b"])
        current = materialize(kept.select(*order, "_w", F.col("_start").alias("_base")))
        rows, largest = hit.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    run = _before(Window.partitionBy("_base").orderBy(*order))
    found = current.withColumn("_start", F.col("_base") + F.coalesce(F.sum("_w").over(run), F.lit(0)))
    picked = found.select(F.explode(inside(F.col("_start"), F.col("_w"))).alias("_pos"), *order).collect()
    return {r["_pos"]: tuple(r[c] for c in order) for r in picked}


def exact_quantiles(
    df: DataFrame,
    col: str,
    probs: Sequence[float],
    most: int = WINDOW,
) -> list[float | None]:
    """Exact quantiles with linear interpolation, NULLs ignored.

    Eager like ``DataFrame.approxQuantile``: the few results become literals
    of the next plan, so no join is needed to apply them.
    """
    hist = materialize(df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("_n")))
    rows, total = hist.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    if not total:
        return [None] * len(probs)
    spots = [(total - 1) * p for p in probs]
    lows = [min(int(s + 1e-9), total - 1) for s in spots]
    need = {k for lo in lows for k in (lo, min(lo + 1, total - 1))}
    at = rows_at(hist, [col], sorted(need), weight="_n", rows=rows, most=most)
    out = []
    for spot, lo in zip(spots, lows):
        a, b = float(at[lo][0]), float(at[min(lo + 1, total - 1)][0])
        out.append(a + (b - a) * max(spot - lo, 0.0))
    return out


def rank_cuts(
    df: DataFrame, value: str, key: str, q: int = 5, most: int = WINDOW
) -> list[tuple]:
    """The last ``(value, key)`` of each of the first ``q − 1`` rank quantiles.

    Ranks run over (value, key), so equal values are split in key order. Row
    ``i`` of ``n`` (0-based) is in quantile ``1 + #{j : q·i > (n − 1)·j}``.
    ``df`` should be materialized.
    """
    pairs = df.where(F.col(value).isNotNull()).select(value, key)
    rows = pairs.count()
    if not rows:
        return []
    spots = [((rows - 1) * j) // q for j in range(1, q)]
    at = rows_at(pairs, [value, key], spots, rows=rows, most=most)
    return [at[s] for s in spots]


def rank_score(value: str, key: str, cuts: Sequence[tuple]) -> Column:
    """Quantile number (1 = lowest) of a row, from ``rank_cuts``."""
    score = F.lit(1)
    for v, k in cuts:
        past = (F.col(value) > F.lit(v)) | ((F.col(value) == F.lit(v)) & (F.col(key) > F.lit(k)))
        score = score + past.cast("int")
    return score


def value_score(value: str, edges: Sequence[float]) -> Column:
    """Quantile number of a value from right-closed quantile edges.

    Equal edges collapse: fewer distinct scores come out instead of an error.
    """
    score = F.lit(1)
    for edge in edges:
        score = score + (F.col(value) > F.lit(edge)).cast("int")
    return score


def share_of_total(df: DataFrame, col: str, out: str = "share", scale: float = 100.0) -> DataFrame:
    """Each row's share of the column total.

    The total is a scalar subquery, so rows are not moved to one task.
    """
    total = df.agg(F.sum(F.col(col).cast("double")).alias("t")).scalar()
    return df.withColumn(out, F.try_divide(F.lit(scale) * F.col(col).cast("double"), total))


def top_k(df: DataFrame, by: str, k: int, tiebreak: Sequence[str] = (), ascending: bool = False) -> DataFrame:
    """First ``k`` rows by a column; plans as TakeOrderedAndProject."""
    lead = F.col(by).asc() if ascending else F.col(by).desc()
    return df.orderBy(lead, *[F.col(c).asc() for c in tiebreak]).limit(k)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Frequency table, most frequent first."""
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(col))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same ones for any partitioning."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(n)
