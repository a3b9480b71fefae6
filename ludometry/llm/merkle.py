"""Merkle manifest of a dataset by time-forward processing.

Nodes are labelled ``(level, place)``. Leaves and inner nodes send their
digests to their parents through a priority queue ordered by label, so every
parent finds all it needs when its turn comes. A second sweep runs through the
labels backwards and sends each node the steps of its proof that lie above it.

The queue is external: a task runs the sweep over one aligned block of
``BLOCK`` neighbouring nodes with a heap, and what leaves a block (its top on
the way up, the steps above it on the way down) are rows that Spark shuffles to
the block of the next round. A tree of n leaves takes log(n) / log(BLOCK)
rounds, each over 1 / BLOCK of the rows of the one before.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ludometry.operators.places import hinted, placed
from ludometry.session import materialize

#: Nodes of one block; a power of two, so blocks and runs of two never cross.
BLOCK = 4096
_NODE = "tree long, place long, total long, digest string"
_ABOVE = [T.StructField("proof", T.ArrayType(T.StringType())), T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType())]


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Hex sha256 of the fields, each ``-`` if null, else its number of UTF-8 bytes, ``:`` and its text."""
    texts = [f.cast("string") for f in fields]
    parts = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def fold_proof(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and the steps of its proof lead to."""

    def step(digest: Column, sibling: Column) -> Column:
        other = F.substring(sibling, 2, 64)
        run = F.when(sibling.startswith("L"), F.concat(other, digest)).otherwise(F.concat(digest, other))
        return F.sha2(run.cast("binary"), 256)

    return F.aggregate(proof, leaf, step)


def merkle_manifest(docs: DataFrame, key: str, group: str, fields: Sequence[str], carry: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: key, ``carry``, ``leaf``, ``subroot``, ``root``, ``proof``.

    Leaves of one ``group`` ascend by key (null first; rows of one key by
    digest, so repeated rows are interchangeable). While a level has several
    nodes, every two consecutive ones become the digest of both, a last odd one
    the digest of itself. What remains is the group's ``subroot``; subroots in
    order of their group (null first, UTF-8 bytewise) form the tree that ends
    in ``root``. A step of ``proof`` is ``L`` or ``R`` and the sibling on that
    side, or ``-`` where a node had none; ``fold_proof`` follows the steps.

    Null fields, null keys, null groups and empty texts have a defined digest.
    An empty table gives no rows. Other columns of ``docs`` are left out, so
    their names cannot clash; a ``carry`` column must not be named like a result.
    Texts are read once and only their digests travel. ``block``, a power of
    two, is the number of neighbouring nodes that one task sweeps.
    """
    leaves = docs.select(
        F.col(group).cast("string").alias("_group"),
        F.col(key).alias("_key"),
        leaf_digest([F.col(c) for c in fields]).alias("digest"),
        *[F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)],
    )
    ranked = placed(materialize(leaves), "_group", ["_key", "digest"])
    trees = placed(ranked.groupBy("_group").agg(F.count("*").alias("n")).withColumn("all", F.lit(0)), "all", ["_group"])
    trees = trees.select(F.col("_group").alias("_g"), F.col("place").alias("tree"), F.col("total").alias("n_trees"))
    nodes = ranked.join(hinted(trees), F.col("_group").eqNullSafe(F.col("_g"))).drop("_g", "_group")
    lower = _rise(materialize(nodes), block)
    joined = lower[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("n_trees").alias("total"), "digest")
    upper = _rise(materialize(joined.withColumn("n_trees", F.col("total"))), block)
    start = upper[-1].select("tree", "place", F.array().cast("array<string>").alias("proof"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    tops = _deliver(upper, start, block).select(F.col("place").alias("tree"), F.lit(0).cast("long").alias("place"), "proof", F.col("digest").alias("subroot"), "root")
    found = _deliver(lower, tops, block)
    carried = [F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)]
    return found.select(F.col("_key").alias(key), *carried, F.col("digest").alias("leaf"), "subroot", "root", "proof")


def _levels(total: int, block: int) -> int:
    """Levels that one round climbs: a whole block, or to the root of a tree within one block."""
    return block.bit_length() - 1 if total > block else (total - 1).bit_length()


def _rise(nodes: DataFrame, block: int) -> list[DataFrame]:
    """The nodes of each round; the last has one row for each tree. The first round always runs."""
    rounds = [nodes]
    most = nodes.agg(F.max("total")).first()[0] or 0
    schema = f"{_NODE}, n_trees long"
    while True:
        blocks = rounds[-1].select("tree", F.floor(F.col("place") / block).alias("block"), "place", "total", "digest", "n_trees")
        rounds.append(materialize(blocks.groupBy("tree", "block").applyInArrow(lambda t: _top_of_block(t, block), schema)))
        most = -(-most // block)
        if most <= 1:
            return rounds


def _deliver(rounds: list[DataFrame], above: DataFrame, block: int) -> DataFrame:
    """The nodes of the first round with the steps above them, from those of each tree's top."""
    for nodes in reversed(rounds[:-1]):
        schema = T.StructType([*nodes.schema.fields, *_ABOVE])
        blocks = nodes.withColumn("block", F.floor(F.col("place") / block))
        tops = above.select("tree", F.col("place").alias("block"), "proof", "subroot", "root")
        above = blocks.groupBy("tree", "block").cogroup(tops.groupBy("tree", "block")).applyInArrow(lambda t, a: _steps_of_block(t, a, block), schema)
        if nodes is not rounds[0]:
            above = materialize(above)
    return above


def _hash(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def _sweep_up(leaves: Sequence[str], levels: int) -> dict[tuple[int, int], str]:
    """Digest of each label, labels in ascending order."""
    queue = [(0, i, d) for i, d in enumerate(leaves)]
    seen: dict[tuple[int, int], str] = {}
    while queue:
        level, i, digest = heapq.heappop(queue)
        seen[level, i] = digest
        if level == levels:
            continue
        run = [digest]
        if queue and queue[0][:2] == (level, i + 1):
            seen[level, i + 1] = heapq.heappop(queue)[2]
            run.append(seen[level, i + 1])
        heapq.heappush(queue, (level + 1, i // 2, _hash(*run)))
    return seen


def _sweep_down(seen: dict[tuple[int, int], str], levels: int, above: list[str]) -> list[list[str]]:
    """Steps from each leaf on, in order of the leaves."""
    queue = [(-levels, 0, above)]
    found: dict[int, list[str]] = {}
    while queue:
        level, i, steps = heapq.heappop(queue)
        level, i = -level, -i
        if not level:
            found[i] = steps
            continue
        left, right = seen[level - 1, 2 * i], seen.get((level - 1, 2 * i + 1))
        heapq.heappush(queue, (1 - level, -2 * i, ["-" if right is None else f"R{right}", *steps]))
        if right is not None:
            heapq.heappush(queue, (1 - level, -2 * i - 1, [f"L{left}", *steps]))
    return [found[i] for i in range(len(found))]


def _top_of_block(nodes: pa.Table, block: int) -> pa.Table:
    nodes = nodes.sort_by("place")
    total = nodes["total"][0].as_py()
    levels = _levels(total, block)
    top = _sweep_up(nodes["digest"].to_pylist(), levels)[levels, 0]
    one = {"tree": nodes["tree"][0].as_py(), "place": nodes["block"][0].as_py(), "total": -(-total // block), "digest": top, "n_trees": nodes["n_trees"][0].as_py()}
    kinds = pa.schema([(n, pa.string() if n == "digest" else pa.int64()) for n in one])
    return pa.Table.from_pylist([one], schema=kinds)


def _steps_of_block(nodes: pa.Table, above: pa.Table, block: int) -> pa.Table:
    nodes = nodes.drop_columns(["block"]).sort_by("place")
    levels = _levels(nodes["total"][0].as_py(), block)
    steps = _sweep_down(_sweep_up(nodes["digest"].to_pylist(), levels), levels, above["proof"][0].as_py())
    out = nodes.append_column("proof", pa.array(steps, pa.list_(pa.string())))
    for name in ("subroot", "root"):
        out = out.append_column(name, pa.array([above[name][0].as_py()] * len(nodes), pa.string()))
    return out
