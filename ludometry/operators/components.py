"""Connected components of an edge list in O(log n) rounds, whatever the diameter."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ludometry.session import materialize

#: Edges that one task joins up.
LAST = 500_000


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "id", a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)``: the smallest node reachable over ``edges``, itself included.

    ``nodes`` lists every node once or more; nulls are dropped from both inputs.
    Each round gives every root the best root within two hops, under an order
    that a hash of node and round shuffles. Roots that keep themselves are at
    least three hops apart, so each round halves the roots of a component at
    least, and chains of parents stay short for any numbering. Edges are then
    moved to the roots. Only minima are gathered per node, which combine on the
    map side, so a hub costs no more than its edges.
    """
    members = nodes.select(F.col(node).alias("id")).where(F.col("id").isNotNull()).distinct()
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    live = materialize(pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    moves: list[DataFrame] = []
    while (left := live.count()) > 2 * LAST:
        parents = _compressed(materialize(_two_hop(live, len(moves))))
        moves.append(parents)
        at_u = parents.select(F.col("u"), F.col("p").alias("pu"))
        at_v = parents.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        moved = live.join(at_u, "u").join(at_v, "v").where("pu <> pv")
        live = materialize(moved.select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct())
    if left:
        kind = live.schema["u"].dataType
        schema = T.StructType([T.StructField("u", kind), T.StructField("p", kind)])
        moves.append(materialize(live.where("u < v").coalesce(1).mapInArrow(lambda batches: _joined(batches, schema), schema)))
    labels = members.withColumn("root", F.col("id"))
    for parents in moves:
        step = parents.select(F.col("u").alias("root"), "p")
        labels = labels.join(step, "root", "left").select("id", F.coalesce("p", "root").alias("root"))
    labels = materialize(labels) if moves else labels
    least = labels.groupBy("root").agg(F.min("id").alias("component"))
    return labels.join(least, "root").select(F.col("id").alias(node), "component")


def _joined(batches: Iterator[pa.RecordBatch], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Each node and one node of its component, for edges ``(u, v)`` that fit in a task."""
    parent: dict = {}

    def find(n):
        while parent.setdefault(n, n) != n:
            parent[n] = n = parent[parent[n]]
        return n

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent[find(u)] = find(v)
    if parent:
        yield pa.RecordBatch.from_arrays([pa.array(list(parent), kind), pa.array([find(n) for n in list(parent)], kind)], names=schema.names)


def _two_hop(live: DataFrame, turn: int) -> DataFrame:
    """``(u, p)``: the best node within two hops of ``u``, ordered by a hash of node and round."""

    def order(name: str):
        return F.struct(F.xxhash64(F.col(name), F.lit(turn)).alias("h"), F.col(name).alias("n"))

    one = live.groupBy("u").agg(F.least(F.min(order("v")), F.first(order("u"))).alias("m"))
    across = live.join(one.select(F.col("u").alias("v"), "m"), "v")
    return across.groupBy("u").agg(F.min("m").alias("m")).select("u", F.col("m.n").alias("p"))


def _compressed(parents: DataFrame) -> DataFrame:
    """Parents replaced by the ends of their chains, which halve in each step."""
    while True:
        up = parents.select(F.col("u").alias("p"), F.col("p").alias("g"))
        nxt = parents.join(up, "p").select("u", F.col("g").alias("p"), (F.col("g") != F.col("p")).alias("moved"))
        nxt = materialize(nxt)
        parents = nxt.select("u", "p")
        if nxt.where("moved").isEmpty():
            return parents
