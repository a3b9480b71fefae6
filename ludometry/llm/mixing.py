"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of rows. With share ``w`` of the slots, block
``i`` (from 0) of a source is released at slot ``floor(i / w)`` and due by slot
``ceil((i + 1) / w)``. Each slot goes to the released block of the earliest
deadline, so after any number ``t`` of slots a source that still has blocks has
got more than ``w t - 1`` and fewer than ``w t + 1`` of them. Weights are whole
numbers, so the schedule repeats after their sum: one period is worked out, and
every block finds its slot from its number.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Longest period; weights of a larger sum are an error.
MOST_SLOTS = 1_000_000
#: Tables of at most so many rows are broadcast, larger ones joined by a shuffle.
_BROADCAST_ROWS = 10_000


@dataclass(frozen=True)
class Turn:
    source: str
    turn: int  #: of the source within the period
    release: int
    deadline: int
    slot: int


def period(weights: Mapping[str, int]) -> list[Turn]:
    """One period of the schedule: as many slots as the weights' sum. Equal deadlines go to the smaller source."""
    total = sum(weights.values())
    if any(w < 1 for w in weights.values()) or total > MOST_SLOTS:
        raise ValueError(f"weights are whole numbers from 1, of a sum of at most {MOST_SLOTS}")
    ahead = [(i * total // w, s, i) for s, w in weights.items() for i in range(w)]
    ahead.sort()
    ready: list[tuple[int, str, int, int]] = []
    out, at = [], 0
    for slot in range(total):
        while at < len(ahead) and ahead[at][0] <= slot:
            release, source, turn = ahead[at]
            heapq.heappush(ready, (-(-(turn + 1) * total // weights[source]), source, turn, release))
            at += 1
        deadline, source, turn, release = heapq.heappop(ready)
        out.append(Turn(source, turn, release, deadline, slot))
    return out


def mix_sources(docs: DataFrame, weights: Mapping[str, int], default: int = 1, source: str = "source", key: str = "doc_id", block_rows: int = 32) -> DataFrame:
    """``docs`` with ``block``, ``release``, ``deadline``, ``slot`` and ``position``, one row per row.

    ``weights`` are target weights of sources, ``default`` that of sources not
    named; a null source is the source ``""``. Within a source rows are
    shuffled by ``md5(key)``, ties by key, and cut into blocks of
    ``block_rows``. No row is dropped or repeated: after a source's last block
    its slots stay empty, and the others keep their proportions. Sorting by
    ``position`` gives the mixed corpus; positions have gaps at empty slots.
    Equal rows of one key get places side by side. Result columns replace
    columns of their names.

    Ranks within a source come from counts of hash ranges, about as many as its
    share of four times the shuffle partitions, so a source of any share of the
    rows is ranked by many tasks. The driver sees the distinct sources, at most
    one per slot.
    """
    spark = docs.sparkSession
    keyed = docs.withColumns({"__source": F.coalesce(F.col(source).cast("string"), F.lit("")), "__h": F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))})
    sizes = {r["__source"]: r["count"] for r in keyed.groupBy("__source").count().limit(MOST_SLOTS + 1).collect()}
    turns = period({s: int(weights.get(s, default)) for s in sizes}) if sizes else []
    schedule = spark.createDataFrame([(t.source, t.turn, t.release, t.deadline, t.slot) for t in turns], "__source string, __turn long, __r long, __d long, __s long")
    cells = 4 * int(spark.conf.get("spark.sql.shuffle.partitions")) / max(1, sum(sizes.values()))
    known = [(s, int(weights.get(s, default)), _digits(cells * n)) for s, n in sizes.items()]
    weight = spark.createDataFrame(known, "__source string, __w long, __digits int")
    keyed = keyed.join(_small(weight, len(known)), "__source").withColumn("__cell", F.substring(F.col("__h"), F.lit(1), F.col("__digits")))
    cells = keyed.groupBy("__source", "__cell").count()
    before = Window.partitionBy("__source").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("__source", "__cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__source", "__cell").orderBy("__h", key)
    ranked = keyed.withColumn("__in", F.row_number().over(inside)).join(offsets, ["__source", "__cell"])
    rank = F.col("__offset") + F.col("__in") - 1
    placed = ranked.withColumns({"__block": F.floor(rank / block_rows), "__at": rank % block_rows})
    placed = placed.withColumns({"__turn": F.col("__block") % F.col("__w"), "__lap": F.floor(F.col("__block") / F.col("__w")) * len(turns)})
    out = placed.join(_small(schedule, len(turns)), ["__source", "__turn"])
    results = {n: F.col("__lap") + F.col(c) for n, c in (("release", "__r"), ("deadline", "__d"), ("slot", "__s"))}
    results = {"block": F.col("__block"), **results, "position": results["slot"] * block_rows + F.col("__at")}
    own = [c for c in docs.columns if c not in results]
    return out.select(*own, *[v.alias(n) for n, v in results.items()])


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= _BROADCAST_ROWS else df


def _digits(cells: float) -> int:
    """Hexadecimal digits that tell at least ``cells`` ranges apart."""
    return max(0, math.ceil(math.log(max(cells, 1), 16)))


def in_mixed_order(mixed: DataFrame) -> DataFrame:
    """The rows in order of ``position``: range-partitioned, sorted within partitions, so written files follow the mix."""
    return mixed.repartitionByRange(F.col("position")).sortWithinPartitions("position")
