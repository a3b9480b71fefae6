"""Places in an order and joins with groups of any size, without one task for all of a group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Rows up to which a counted table is broadcast.
FEW = 10_000
#: Groups that hold more than one part in so many of all rows: there are at most so many of them.
HOT = 1000
#: Rows that a window runs over.
WINDOW = 100_000


def hinted(rows: DataFrame) -> DataFrame:
    """Broadcast a table of few, counted rows; a longer one is joined by Spark's own choice."""
    return F.broadcast(rows) if rows.select(F.lit(1)).limit(FEW + 1).count() <= FEW else rows


def in_ranges(rows: DataFrame, order: Sequence[str], most: int = WINDOW) -> DataFrame:
    """Rows, written, with the number of the range of the whole order they lie in; nulls come first.

    A range holds about ``most`` rows, and rows equal in ``order`` lie in one.
    ``rows`` should be materialized.
    """
    by = [F.col(c).asc_nulls_first() for c in order]
    parts = max(1, -(-rows.count() // most))
    return materialize(rows.repartitionByRange(parts, *by).withColumn("_range", F.spark_partition_id()))


def carried(rows: DataFrame, group: str, totals: Mapping[str, Column], start: float = 0, behind: bool = False) -> DataFrame:
    """Add what the other ranges of a row's group amount to: the ones before its own, or with ``behind`` after it.

    ``rows`` come from ``in_ranges`` with ``group`` leading the order. A total is
    a sum, a count or a product (with ``start`` 1), worked out per group and
    range first; there are as many of those as ranges and groups.
    """
    order = F.col("_in").desc() if behind else F.col("_in")
    others = Window.partitionBy("_of").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    over = F.product if start == 1 else F.sum
    spans = rows.groupBy(F.col(group).alias("_of"), F.col("_range").alias("_in")).agg(*[c.alias(n) for n, c in totals.items()])
    spans = spans.select("_of", "_in", *[F.coalesce(over(n).over(others), F.lit(start)).alias(n) for n in totals])
    return rows.join(hinted(spans), F.col(group).eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_in"))).drop("_of", "_in")


def placed(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Rows with ``place`` (from 0) in the order of their ``group`` and the group's ``total``.

    Rows are cut into ranges of the whole order, so a group that holds most
    rows lies in many ranges; a range and a group together are one row of the
    table of offsets. Nulls come first. ``rows`` are read twice.
    """
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = materialize(ranged.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    spans = ranged.groupBy(F.col(group).alias("_of"), F.col("_range").alias("_in")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_of").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_of")
    spans = spans.select("_of", "_in", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("total"))
    same = F.col(group).eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_in"))
    found = ranged.join(hinted(spans), same).withColumn("place", F.col("_before") + F.col("_at") - F.col("_first"))
    return found.drop("_range", "_at", "_of", "_in", "_first", "_before")


def join_sized(rows: DataFrame, groups: DataFrame, on: Sequence[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one or few rows per group, hot groups broadcast.

    ``size`` says how many of the ``total`` rows a group has. The groups with
    more than a thousandth of them are at most a thousand; they are broadcast,
    so their rows stay where they are. All others are joined by key. Where no
    group can be that large, this is a plain join.
    """
    limit = max(FEW, total // HOT)
    if total <= limit:
        return rows.join(groups, list(on))
    groups = materialize(groups)
    hot = groups.where(F.col(size) > limit)
    names = hot.select(*on).distinct().withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(names), list(on), "left")
    large = marked.where("_hot").drop("_hot").join(F.broadcast(hot), list(on))
    small = marked.where("_hot IS NULL").drop("_hot").join(groups.where(F.col(size) <= limit), list(on))
    return large.unionByName(small)
