"""Near duplicates among vectors by sorted projection passes.

A pass draws random rotations and orders vectors lexicographically by the
nearest axis under each (a cross-polytope hash), so that close vectors tend to
be neighbours. Neighbours in that order are compared, and all vectors of one
bucket (equal leading codes), however many blocks it fills; what one pass puts
in two buckets, another puts in one. The number of passes follows from the
number of vectors and the wanted share of pairs at the threshold itself.

Crowds have more links than anyone can list. Therefore vectors are gathered first, by passes of the same kind, in balls whose
radius is half the threshold's angle: members of a ball are all linked, and the
angle between two centres and the radii often tell that all or no members of two
balls are linked. Links are counted by ball where that is so; only what remains
open is compared vector by vector, in bounded pieces. A large ball sends one
delegate into each bucket that any of its members falls into, and a pair of balls is
looked at if the delegates' angle and the radii leave a link possible, so no
pair of vectors that meets in a bucket is lost by it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ludometry.operators.components import connected_components
from ludometry.operators.places import join_sized, placed
from ludometry.session import materialize

from .arrow_batches import ragged

#: Neighbours compared at once, and how many of the next ones each of them sees besides those of its bucket.
BLOCK, WINDOW = 2048, 256
#: Members up to which all of a ball go into the passes; of a larger one, one for each bucket.
DELEGATES = 64
#: Axes of a rotation, so codes have seven bits.
_AXES = 64
#: Radians by which bounds are widened, well above rounding.
_SLACK = 1e-6
#: Vectors of a ball that one task compares at once.
_PIECE = 1024


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, recall: float = 0.99, seed: int = 11) -> DataFrame:
    """``id_col, n_links, component_id, kept`` for every row of ``vectors``.

    Two vectors link if their cosine, in double precision, is ``threshold`` or
    more; ``n_links`` counts the other rows linked directly, equal rows
    included. ``component_id`` is the smallest id reachable, ``kept`` tells
    whether it is the row's own. No pair below the threshold links. A pair at
    the threshold is missed with a probability of at most 1 - ``recall``, closer
    pairs more rarely, and none up to ``BLOCK`` vectors.

    Rows whose vector is null, empty, zero or has null or non-finite components
    link with nothing; nor do rows without an id, whose ``component_id`` is
    null and which are kept. Shorter vectors count as filled up with zeros.
    Other columns are left out.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce(F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = materialize(rows.withColumns({"usable": usable, "rid": F.monotonically_increasing_id()}))
    live = rows.where("usable").select("rid", "id", "v")
    n, width = live.agg(F.count("*"), F.max(F.size("v"))).first()
    alone = rows.where("NOT usable").select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if not n:
        return alone
    theta = math.acos(threshold)
    plan = _Passes(n, width, threshold, recall, seed)
    balls = _gather(live, plan, theta / 2 - _SLACK)
    linked = _links(live, balls, plan, threshold)
    found = linked.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    return found.unionByName(alone)


class _Passes:
    """How many passes a table needs, and the order of each."""

    def __init__(self, n: int, width: int, threshold: float, recall: float, seed: int):
        self.n, self.width, self.seed = n, width, seed
        self.axes = min(_AXES, width)
        base = 2 * self.axes
        self.codes = max(1, min(9, math.ceil(math.log(n) / math.log(base)) + 1))
        together, blocks, leading = 1.0, n / BLOCK, 0
        agree = self._agreement(threshold)
        while blocks > 1 and leading < self.codes:
            together, blocks, leading = together * agree, blocks / base, leading + 1
        #: Keys of one bucket differ in less than this.
        self.bucket = base ** (self.codes - leading)
        self.passes = 1 if together >= recall else math.ceil(math.log(1 - recall) / math.log(1 - together))

    def _agreement(self, cosine: float, draws: int = 20_000) -> float:
        """The chance that two vectors at ``cosine`` share a code, by simulation with a fixed seed."""
        a, b = np.random.default_rng(self.seed).standard_normal((2, draws, self.axes))
        b = cosine * a + math.sqrt(1 - cosine * cosine) * b
        return min(0.999, max(0.01, float(np.mean(_nearest_axis(a) == _nearest_axis(b)))))

    def keys(self, rows: DataFrame, first: int, count: int) -> DataFrame:
        """``pass, key, rid`` of ``rows`` (rid, v) in passes ``first`` to ``first + count - 1``."""
        width, axes, codes, seed = self.width, self.axes, self.codes, self.seed

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            turns = [np.random.default_rng([seed, p]).standard_normal((codes, width, axes)).astype(np.float32) for p in range(first, first + count)]
            for batch in batches:
                unit = _units(batch.column(1), width).astype(np.float32)
                for p, turn in enumerate(turns, first):
                    key = np.zeros(len(unit), np.int64)
                    for rotation in turn:
                        key = key * (2 * axes) + _nearest_axis(unit @ rotation)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), p, np.int32)), pa.array(key), batch.column(0)], names=["pass", "key", "rid"])

        return rows.select("rid", "v").mapInArrow(hashed, "pass int, key long, rid long")


def _nearest_axis(x: np.ndarray) -> np.ndarray:
    """Number of the axis, with its sign, that each row is closest to."""
    at = np.abs(x).argmax(axis=1)
    return at.astype(np.int64) * 2 + (x[np.arange(len(x)), at] < 0)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks() if lists.num_chunks else pa.array([], lists.type)
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    return lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def _units(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors of length 1 in double precision, filled up with zeros."""
    sizes, values = _flat(lists)
    out = np.zeros((len(sizes), width))
    if len(values):
        out[np.repeat(np.arange(len(sizes)), sizes), ragged(np.zeros(len(sizes), np.int64), sizes)] = values
    # Scaled first, so that squares of very large or small components neither overflow nor vanish.
    out /= np.maximum(np.abs(out).max(axis=1, keepdims=True, initial=0.0), np.finfo(float).tiny)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), np.finfo(float).tiny)


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


# ── balls ───────────────────────────────────────────────────────────────────


def _gather(live: DataFrame, plan: _Passes, radius: float) -> DataFrame:
    """``rid, ball, angle``: a ball for each vector, named by the vector at its centre, no member farther than ``radius``.

    After the first pass only balls with several members go on: whole balls
    move to a better centre, and each member only if it is within reach of that.
    Passes go on while they take away a tenth of those balls.
    """
    vectors = live.select("rid", "v")
    blocks = _in_blocks(plan.keys(vectors, 0, 1)).join(vectors, "rid")
    width = plan.width
    balls = materialize(blocks.groupBy("pass", "block").applyInArrow(lambda t: _cover(t, width, radius), "rid long, ball long, angle double"))
    turn = 1
    while True:
        sizes = balls.groupBy("ball").agg(F.count("*").alias("size"))
        centres = materialize(sizes.where("size > 1").select(F.col("ball").alias("rid"), "size"))
        several = centres.count()
        if several < 2:
            return balls
        at = materialize(vectors.join(centres, "rid"))
        # Larger balls come first in a block, so smaller ones move to them.
        blocks = _in_blocks(plan.keys(at, 1000 + turn, 1)).join(at, "rid")
        moves = blocks.groupBy("pass", "block").applyInArrow(lambda t: _cover(t, width, radius), "rid long, ball long, angle double")
        moves = materialize(moves.where("rid <> ball").select(F.col("rid").alias("ball"), F.col("ball").alias("to")))
        moved = moves.count()
        if moved:
            goals = moves.join(at.select(F.col("rid").alias("to"), F.col("v").alias("centre")), "to").join(centres.withColumnRenamed("rid", "ball"), "ball")
            asked = _of_ball(balls.drop("angle"), goals, plan.n).join(vectors, "rid").select("rid", "ball", "to", "v", "centre")
            better = asked.mapInArrow(lambda b: _within(b, width, radius), "rid long, to long, to_angle double")
            balls = materialize(
                balls.join(better, "rid", "left").select("rid", F.coalesce("to", "ball").alias("ball"), F.coalesce("to_angle", "angle").alias("angle"))
            )
        if moved * 10 < several:
            return balls
        turn += 1


def _in_blocks(keyed: DataFrame) -> DataFrame:
    """``pass, block, rid``: the order of each pass cut into blocks."""
    return placed(keyed, "pass", ["key", "rid"]).select("pass", F.floor(F.col("place") / BLOCK).alias("block"), "rid")


def _of_ball(rows: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """Join ``rows`` and ``groups`` (with ``size``) by ball."""
    return join_sized(rows, groups, ["ball"], "size", n)


def _cover(block: pa.Table, width: int, radius: float) -> pa.Table:
    """Centres chosen greedily, larger balls first; each takes what is within reach and not taken."""
    block = block.sort_by([("size", "descending"), ("rid", "ascending")] if "size" in block.column_names else "rid")
    rid = block["rid"].to_numpy()
    unit = _units(block["v"], width)
    cosines = unit @ unit.T
    close = cosines >= math.cos(radius)
    centre = np.arange(len(rid))
    free = np.ones(len(rid), bool)
    for i in np.flatnonzero(close.sum(axis=1) > 1):
        if free[i]:
            mine = close[i] & free
            mine[i] = True
            centre[mine] = i
            free[mine] = False
    angle = np.where(centre == np.arange(len(rid)), 0.0, _angles(cosines[np.arange(len(rid)), centre]))
    return pa.table({"rid": rid, "ball": rid[centre], "angle": angle})


def _within(batches: Iterator[pa.RecordBatch], width: int, radius: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        angle = _angles(np.einsum("ij,ij->i", _units(batch.column(3), width), _units(batch.column(4), width)))
        near = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(angle)], names=["rid", "to", "to_angle"])
        yield near.filter(pa.array(angle <= radius))


# ── links ───────────────────────────────────────────────────────────────────


def _links(live: DataFrame, balls: DataFrame, plan: _Passes, threshold: float) -> DataFrame:
    """``id, n_links, component_id`` of every row of ``live``."""
    width = plan.width
    vectors = live.select("rid", "v")
    stats = balls.groupBy("ball").agg(F.count("*").alias("size"), F.max("angle").alias("radius"))
    centres = materialize(stats.join(live.select(F.col("rid").alias("ball"), F.col("v").alias("centre")), "ball"))
    sizes = centres.select("ball", "size", "radius")
    ends = centres.select(F.col("ball").alias("other"), *[F.col(c).alias(f"other_{c}") for c in ("size", "radius", "centre")])

    pairs = _candidates(live, balls, sizes, plan, math.acos(threshold))
    both = pairs.join(centres, "ball").join(ends, "other").select("ball", "other", "size", "radius", "centre", "other_size", "other_radius", "other_centre")
    judged = materialize(both.mapInArrow(lambda b: _judge_balls(b, width, threshold), "ball long, other long, sure boolean"))
    whole = judged.where("sure").select("ball", "other")
    linked = _both_ways(whole).join(sizes.select(F.col("ball").alias("other"), "size"), "other")
    by_ball = linked.groupBy("ball").agg(F.sum("size").alias("ball_links"))

    # What the bounds of two balls leave open is asked member by member, from both sides.
    goals = _both_ways(judged.where("NOT sure").select("ball", "other")).join(sizes.select("ball", "size"), "ball").join(ends, "other")
    asked = _of_ball(balls.select("rid", "ball"), goals, plan.n).join(vectors, "rid")
    asked = asked.select("rid", "ball", "other", "v", "other_size", "other_radius", "other_centre")
    counted = materialize(asked.mapInArrow(lambda b: _judge_members(b, width, threshold), "rid long, ball long, other long, v array<double>, n long"))
    exact = _compared(counted.where("n IS NULL").select("rid", "ball", "other", "v"), balls, sizes, vectors, width, threshold)
    single = materialize(counted.where("n > 0").select("rid", "ball", "other", "n").unionByName(exact))
    by_row = single.groupBy("rid").agg(F.sum("n").alias("row_links"))

    edges = whole.unionByName(single.select("ball", "other").distinct())
    component = materialize(connected_components(sizes.select("ball"), edges, "ball", "ball", "other").withColumnRenamed("component", "root"))
    named = balls.join(live.select("rid", "id"), "rid")
    lowest = named.groupBy("ball").agg(F.min("id").alias("least")).join(component, "ball")
    roots = lowest.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = sizes.select("ball", "size").join(component, "ball").join(roots, "root").join(by_ball, "ball", "left")
    labels = materialize(labels.select("ball", "size", "component_id", "ball_links"))
    out = _of_ball(named.select("rid", "ball", "id"), labels, plan.n).join(by_row, "rid", "left")
    total = F.col("size") - 1 + F.coalesce("ball_links", F.lit(0)) + F.coalesce("row_links", F.lit(0))
    return out.select("id", total.cast("long").alias("n_links"), "component_id")


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("other").alias("ball"), F.col("ball").alias("other")))


def _candidates(live: DataFrame, balls: DataFrame, sizes: DataFrame, plan: _Passes, theta: float) -> DataFrame:
    """``ball, other`` (ball < other): pairs of balls that neighbours in some pass leave possible.

    Passes carry sketches of one byte per component with their error, so the
    comparison errs on the safe side.
    """
    width = plan.width
    alone = F.when(F.col("size") <= DELEGATES, F.col("rid")).alias("alone")
    member = _of_ball(balls, sizes, plan.n).select("rid", "ball", "angle", "radius", alone)
    keyed = plan.keys(live, 1, plan.passes).withColumn("bucket", F.floor(F.col("key") / F.lit(plan.bucket))).join(member, "rid")
    nearest = F.min(F.struct("angle", "rid", "key")).alias("n")
    going = keyed.groupBy("pass", "bucket", "ball", "alone").agg(nearest, F.count("*").alias("size"), F.first("radius").alias("radius"))
    # Members of the bucket that stay away lie within the ball, so no farther from the delegate than this.
    reach = F.when(F.col("size") > 1, F.col("n.angle") + F.col("radius")).otherwise(F.lit(0.0))
    going = materialize(going.select("pass", "bucket", "n.key", "n.rid", reach.alias("reach")))
    sketched = going.select("rid").distinct().join(live.select("rid", "v"), "rid").join(balls.select("rid", "ball"), "rid").select("rid", "v", "ball")
    sketches = materialize(sketched.mapInArrow(lambda b: _sketch(b, width), "rid long, ball long, sketch binary, scale double, error double"))
    order = placed(going, "pass", ["key", "rid"]).withColumn("block", F.floor(F.col("place") / BLOCK))
    spans = order.groupBy("pass", "bucket").agg(F.min("block").alias("from"), F.max("block").alias("to")).where("from < to")
    order = order.join(spans, ["pass", "bucket"], "left").select("rid", "pass", "place", "block", "reach", "from", "to")
    # A block meets itself and the window after it; where a bucket goes on in others, its rows meet those of every other of its blocks.
    also = (F.col("place") % BLOCK < WINDOW) & (F.col("block") > 0)
    seen = F.explode(F.when(also, F.array(F.col("block"), F.col("block") - 1)).otherwise(F.array("block")))
    own = order.select("rid", "reach", "pass", F.col("block").alias("_home"), seen.alias("block"))
    own = own.select("rid", "reach", "pass", "block", F.col("block").alias("with"), (F.col("_home") == F.col("block")).alias("own"))
    ahead = F.explode(F.sequence(F.col("from"), F.col("to")))
    across = order.where("from IS NOT NULL").select("rid", "reach", "pass", "block", ahead.alias("_other")).where("block <> _other")
    across = across.select("rid", "reach", "pass", F.least("block", "_other").alias("block"), F.greatest("block", "_other").alias("with"), (F.col("block") < F.col("_other")).alias("own"))
    rows = own.unionByName(across).join(sketches, "rid")
    found = rows.groupBy("pass", "block", "with").applyInArrow(lambda t: _neighbours(t, width, theta), "ball long, other long")
    return materialize(found.distinct())


def _sketch(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        unit = _units(batch.column(1), width)
        scale = np.abs(unit).max(axis=1, initial=0.0) / 127
        whole = np.rint(unit / scale[:, None])
        error = np.linalg.norm(whole * scale[:, None] - unit, axis=1)
        packed = pa.array([r.tobytes() for r in whole.astype(np.int8)], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), packed, pa.array(scale), pa.array(error)], names=["rid", "ball", "sketch", "scale", "error"]
        )


def _neighbours(block: pa.Table, width: int, theta: float) -> pa.Table:
    """Different balls whose delegates are near enough; own rows are compared with all of a block, or with the rest of a pair of blocks."""
    own = np.flatnonzero(block["own"].to_numpy())
    rest = np.flatnonzero(~block["own"].to_numpy())
    order = np.concatenate([own, rest])
    ball, reach, error = (block[c].to_numpy()[order] for c in ("ball", "reach", "error"))
    sketch = np.frombuffer(b"".join(block["sketch"].to_pylist()), np.int8).reshape(-1, width)[order]
    unit = (sketch * block["scale"].to_numpy()[order, None]).astype(np.float32)
    far = slice(0 if block["block"][0] == block["with"][0] else len(own), None)
    cosines = unit[: len(own)] @ unit[far].T
    least = np.cos(theta) if not reach.any() else np.cos(np.minimum(np.pi, theta + reach[: len(own), None] + reach[far]))
    # Norms are at most 1 + error; the last term covers single precision.
    cosines += error[: len(own), None] + error[far] + 1.1 * error[: len(own), None] * error[far] + 1e-5
    i, j = np.nonzero(cosines >= least)
    a, b = ball[i], ball[far][j]
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b], axis=0)
    return pa.table({"ball": pairs[:, 0], "other": pairs[:, 1]})


def _judge_balls(batches: Iterator[pa.RecordBatch], width: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Are all members of two balls linked? Pairs of balls that have no link at all are left out."""
    theta = math.acos(threshold)
    for batch in batches:
        at = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
        cosines = np.einsum("ij,ij->i", _units(at["centre"], width), _units(at["other_centre"], width))
        angle, radius = _angles(cosines), at["radius"].to_numpy() + at["other_radius"].to_numpy()
        points = (at["size"].to_numpy() == 1) & (at["other_size"].to_numpy() == 1) & (radius == 0)
        sure = np.where(points, cosines >= threshold, angle + radius <= theta - _SLACK)
        left = sure | ~points & (angle - radius <= theta + _SLACK)
        yield pa.RecordBatch.from_arrays([at["ball"], at["other"], pa.array(sure)], names=["ball", "other", "sure"]).filter(pa.array(left))


def _judge_members(batches: Iterator[pa.RecordBatch], width: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """The number of members of the other ball that a vector is linked with; null, with the vector, where its radius leaves that open."""
    theta = math.acos(threshold)
    for batch in batches:
        at = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
        unit = _units(at["v"], width)
        cosines = np.einsum("ij,ij->i", unit, _units(at["other_centre"], width))
        angle, size, radius = _angles(cosines), at["other_size"].to_numpy(), at["other_radius"].to_numpy()
        point = (size == 1) & (radius == 0)
        every = np.where(point, cosines >= threshold, angle + radius <= theta - _SLACK)
        none = ~every & (point | (angle - radius > theta + _SLACK))
        n = pa.array(np.where(every, size, 0), mask=~every & ~none)
        flat = pa.array(unit.ravel())
        v = pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1) * width, pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([at["rid"], at["ball"], at["other"], v, n], names=["rid", "ball", "other", "v", "n"]).filter(pa.array(~none))


def _compared(asking: DataFrame, balls: DataFrame, sizes: DataFrame, vectors: DataFrame, width: int, threshold: float) -> DataFrame:
    """``rid, ball, other, n``: links of each asking vector with members of the other ball, compared piece by lot.

    Members are cut into pieces and askers into lots, both of bounded size, and
    every lot meets every piece once; only counts leave a task.
    """
    lots = asking.groupBy("other").agg(F.ceil(F.count("*") / _PIECE).cast("int").alias("lots"))
    shape = materialize(lots.join(sizes.select(F.col("ball").alias("other"), F.ceil(F.col("size") / _PIECE).cast("int").alias("pieces")), "other"))

    def cut(into: str):
        return F.pmod(F.xxhash64("rid"), F.col(into)).cast("int")

    def all_of(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    askers = asking.join(shape, "other").withColumn("lot", cut("lots")).withColumn("piece", all_of("pieces")).select("other", "lot", "piece", "rid", "ball", "v")
    members = balls.select("rid", F.col("ball").alias("other")).join(shape, "other").join(vectors, "rid")
    members = members.withColumn("piece", cut("pieces")).withColumn("lot", all_of("lots")).select("other", "lot", "piece", "rid", "v")
    by = ("other", "lot", "piece")
    return askers.groupBy(*by).cogroup(members.groupBy(*by)).applyInArrow(lambda a, m: _count(a, m, width, threshold), "rid long, ball long, other long, n long").where("n > 0")


def _count(asking: pa.Table, members: pa.Table, width: int, threshold: float) -> pa.Table:
    if not asking.num_rows or not members.num_rows:
        n = np.zeros(asking.num_rows, np.int64)
    else:
        ours, theirs = _units(asking["v"], width), _units(members["v"], width).T
        step = max(1, (4 << 20) // members.num_rows)
        n = np.concatenate([(ours[i : i + step] @ theirs >= threshold).sum(axis=1) for i in range(0, len(ours), step)])
    return pa.table({"rid": asking["rid"], "ball": asking["ball"], "other": asking["other"], "n": pa.array(n.astype(np.int64))})
