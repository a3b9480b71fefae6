"""Exact density-based clustering over packed boxes.

Points are never compared all against all. Equal points are merged into one
weighted point. The space is cut into cells whose diagonal is below ``eps``:
points of one cell are neighbours, so a cell that holds ``min_samples`` rows is
all core and acts as one node, however many rows it has.

Cells lie along a Z-order curve and are packed, ``CELL_FAN`` at a time, into boxes,
boxes into larger ones, up to one. Neighbouring cells come from descending that
tree with itself, so only occupied space is visited, in any number of
dimensions. The points of a cell are packed the same way. A question between a
point and a cell, or between two cells, starts with their outermost boxes: a box
within ``eps`` settles it, a box out of reach is dropped, and only boxes that
straddle the distance are opened, level by level. Questions that have found a
witness leave before the next level. Cells are only asked about while they are
not connected by others: neighbours side by side come first, and after each
level pairs that have become connected leave.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .components import connected_components
from .ordering import running_totals
from .places import join_sized, placed

NOISE = -1
#: Boxes or points in one box.
FAN = 64
#: Cells, or boxes of cells, in one box.
CELL_FAN = 256
#: Pairs of members that are compared at once.
_PAIRS = 1 << 18


def dbscan(df: DataFrame, key: str, cols: Sequence[str], eps: float = 1.5, min_samples: int = 5) -> DataFrame:
    """``(key, cluster, is_core)`` for every row.

    A row counts itself, and a distance equal to ``eps`` is inside. Clusters
    are numbered from 0 by their smallest core key. A border row joins the
    lowest-numbered cluster with a core row in reach, so the result does not
    depend on row order. Noise is −1, and so is a row with a NULL, NaN or
    infinite coordinate, which is near nothing.
    """
    axes = [f"v{i}" for i in range(len(cols))]
    rows = materialize(df.select(key, *[F.col(c).cast("double").alias(a) for c, a in zip(cols, axes)]))
    finite = " AND ".join(f"abs({a}) < double('infinity')" for a in axes)
    merged = rows.where(finite).groupBy(*axes)
    merged = merged.agg(F.count("*").alias("w"), F.min(key).alias("first_key"))
    points = materialize(merged.select(F.monotonically_increasing_id().alias("pid"), F.array(*axes).alias("x"), "w", "first_key"))
    grid = _Grid(points, len(axes), eps, min_samples)
    labelled = grid.labels().select(*[F.col("x")[i].alias(a) for i, a in enumerate(axes)], "w", "cluster", "is_core")
    found = join_sized(rows, labelled, axes, "w", grid.weight).select(key, "cluster", "is_core")
    rest = rows.where(f"NOT coalesce({finite}, false)")
    return found.unionByName(rest.select(key, F.lit(NOISE).alias("cluster"), F.lit(False).alias("is_core")))


def dbscan_summary(labels: DataFrame) -> DataFrame:
    """Number of clusters and of noise rows."""
    return labels.agg(
        F.countDistinct(F.when(F.col("cluster") != NOISE, F.col("cluster"))).alias("n_clusters"),
        F.count(F.when(F.col("cluster") == NOISE, 1)).alias("n_noise"),
    )


# ── boxes ───────────────────────────────────────────────────────────────────


def _box(d: int, low: str = "lo", high: str = "hi") -> list[Column]:
    """The tight box of a group, from its members' corners."""
    return [
        F.array(*[F.min(F.get(low, F.lit(i))) for i in range(d)]).alias("lo"),
        F.array(*[F.max(F.get(high, F.lit(i))) for i in range(d)]).alias("hi"),
    ]


def _packed(members: DataFrame, by: Sequence[str], kid: str, d: int, *more: Column) -> DataFrame:
    """One box per group: its corners, and its members' numbers, corners and weights one after another."""
    one = F.struct(F.col(kid).cast("long").alias("kid"), F.concat("lo", "hi").alias("box"), F.col("weight").alias("weight"))
    grouped = members.groupBy(*by).agg(*_box(d), F.sum("weight").alias("weight"), F.collect_list(one).alias("_all"), *more)
    return grouped.select(
        *by,
        "lo",
        "hi",
        "weight",
        F.transform("_all", lambda s: s["kid"]).alias("kids"),
        F.flatten(F.transform("_all", lambda s: s["box"])).alias("boxes"),
        F.transform("_all", lambda s: s["weight"]).alias("weights"),
        *[c for c in grouped.columns if c not in (*by, "lo", "hi", "weight", "_all")],
    )


def _z_order(parts: np.ndarray, bits: int) -> np.ndarray:
    """Interleaved bits of whole numbers below ``2**bits``, row by row."""
    z = np.zeros(len(parts), np.int64)
    for bit in reversed(range(bits)):
        for column in parts.T:
            z = (z << 1) | ((column >> bit) & 1)
    return z


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a list column."""
    return column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


def _gap2(low_a, high_a, low_b, high_b) -> np.ndarray:
    """Squared smallest distance between boxes."""
    return (np.maximum(np.maximum(low_a - high_b, low_b - high_a), 0.0) ** 2).sum(axis=-1)


def _reach2(low_a, high_a, low_b, high_b) -> np.ndarray:
    """Squared largest distance between points of two boxes."""
    return (np.maximum(high_a - low_b, high_b - low_a) ** 2).sum(axis=-1)


def _near_kids(batches: Iterator[pa.RecordBatch], d: int, eps2: float, itself: bool) -> Iterator[pa.RecordBatch]:
    """Members ``a <= b`` of two boxes (``a, b, kids_a, boxes_a, kids_b, boxes_b``) within reach of each other, and the square of their largest distance."""
    for batch in batches:
        for a, b, kids_a, boxes_a, kids_b, boxes_b in zip(*batch.columns):
            left, right = (np.asarray(x.values).reshape(-1, 2, d) for x in (boxes_a, boxes_b))
            i, j = np.nonzero(_gap2(left[:, None, 0], left[:, None, 1], right[None, :, 0], right[None, :, 1]) <= eps2)
            u, v = np.asarray(kids_a.values)[i], np.asarray(kids_b.values)[j]
            keep = (u <= v if itself else u < v) if a.as_py() == b.as_py() else slice(None)
            u, v, i, j = u[keep], v[keep], i[keep], j[keep]
            reach2 = _reach2(left[i, 0], left[i, 1], right[j, 0], right[j, 1])
            yield pa.RecordBatch.from_arrays([*map(pa.array, (np.minimum(u, v), np.maximum(u, v), reach2))], names=["a", "b", "reach2"])


def _weigh(batches: Iterator[pa.RecordBatch], d: int, eps2: float) -> Iterator[pa.RecordBatch]:
    """How much weight of a box (``pid, x, o, kids, boxes, weights``) is surely within reach of a point, how much may be, and which members to open."""
    for batch in batches:
        at = dict(zip(batch.schema.names, batch.columns))
        x = _lists(at["x"])[1].reshape(-1, d)
        sizes, boxes = _lists(at["boxes"])
        boxes = boxes.reshape(-1, 2, d)
        row = np.repeat(np.arange(len(x)), sizes // (2 * d))
        kids, weights = _lists(at["kids"])[1], _lists(at["weights"])[1]
        point = x[row]
        sure = _reach2(point, point, boxes[:, 0], boxes[:, 1]) <= eps2
        maybe = ~sure & (_gap2(point, point, boxes[:, 0], boxes[:, 1]) <= eps2)
        sums = [np.bincount(row[m], weights=weights[m], minlength=len(x)).astype(np.int64) for m in (sure, maybe)]
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[maybe], minlength=len(x)))])
        opened = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(kids[maybe], pa.int64()))
        some = pa.array((sums[0] > 0) | (sums[1] > 0))
        yield pa.RecordBatch.from_arrays([at["pid"], at["o"], *map(pa.array, sums), opened], names=["pid", "o", "sure", "maybe", "open"]).filter(some)


def _meet(batches: Iterator[pa.RecordBatch], d: int, eps2: float) -> Iterator[pa.RecordBatch]:
    """Are two members of boxes ``a`` and ``b`` surely within reach? Else all pairs of members that may be."""
    for batch in batches:
        at = dict(zip(batch.schema.names, batch.columns))
        ids = [at[s].to_numpy() for s in "ab"]
        sizes, kids = zip(*(_lists(at[f"kids_{s}"]) for s in "ab"))
        boxes = [_lists(at[f"boxes_{s}"])[1].reshape(-1, 2, d) for s in "ab"]
        first = [np.cumsum(n) - n for n in sizes]
        counts = sizes[0] * sizes[1]
        turns = np.cumsum(counts) // _PAIRS
        for rows in np.split(np.arange(len(counts)), np.flatnonzero(np.diff(turns)) + 1):
            if not len(rows):
                continue
            row = np.repeat(rows, counts[rows])
            number = np.arange(len(row)) - np.repeat(np.cumsum(counts[rows]) - counts[rows], counts[rows])
            i, j = first[0][row] + number // sizes[1][row], first[1][row] + number % sizes[1][row]
            corners = boxes[0][i, 0], boxes[0][i, 1], boxes[1][j, 0], boxes[1][j, 1]
            sure = _reach2(*corners) <= eps2
            met = np.zeros(len(counts), bool)
            met[row[sure]] = True
            maybe = np.flatnonzero((_gap2(*corners) <= eps2) & ~met[row])
            hits = np.flatnonzero(met)
            picked = np.concatenate([hits, row[maybe]])
            none = np.zeros(len(hits), np.int64)
            out = [ids[0][picked], ids[1][picked], met[picked], np.concatenate([none, kids[0][i[maybe]]]), np.concatenate([none, kids[1][j[maybe]]])]
            yield pa.RecordBatch.from_arrays([*map(pa.array, out)], names=["a", "b", "met", "kid_a", "kid_b"])


class _Grid:
    """Weighted points, their cells, and the boxes over both."""

    def __init__(self, points: DataFrame, d: int, eps: float, min_samples: int):
        self.d, self.eps2, self.min_samples = d, eps * eps, min_samples
        # A hair finer than needed, so that rounding never puts points of one cell out of reach.
        self.scale = d**0.5 / eps * (1 + 1e-9)
        low, high = ([f(F.col("x")[i]) for i in range(d)] for f in (F.min, F.max))
        self.count, self.weight, low, high = points.agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0)), F.array(*low), F.array(*high)).first()
        self.low, self.high = ([0.0] * d, [0.0] * d) if not self.count else (low, high)
        self.points = self._ordered(points)
        self.cells, self.n_cells, self.most = self._cells()
        self.nodes = self._nodes()
        self.near = self._near()

    def _ordered(self, points: DataFrame) -> DataFrame:
        """Points with their cell and their place in it, cells along the curve."""
        d, scale = self.d, self.scale
        first = np.floor(np.array(self.low) * scale)
        span = np.floor(np.array(self.high) * scale) - first + 1
        bits = max(1, 62 // d)
        schema = T.StructType([*points.schema.fields, T.StructField("cell", T.BinaryType()), T.StructField("z", T.LongType())])

        def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _lists(batch.column(1))[1].reshape(-1, d) * scale
                corner = np.floor(x)
                steps = 2.0 ** min(bits, 52)
                coarse, fine = ((y * steps).astype(np.int64).clip(0, 2 ** min(bits, 52) - 1)[:, :62] for y in ((corner - first) / span, x - corner))
                order = _z_order(coarse, min(bits, 52)).astype(">i8").tobytes()
                exact = (corner + 0.0).tobytes()
                cells = [order[8 * i : 8 * i + 8] + exact[8 * d * i : 8 * d * (i + 1)] for i in range(len(x))]
                more = [pa.array(cells, pa.binary()), pa.array(_z_order(fine, min(bits, 52)))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=schema.names)

        return placed(points.mapInArrow(located, schema), "cell", ["z", "pid"]).drop("z")

    def _cells(self) -> tuple[DataFrame, int, int]:
        """``cell, c, lo, hi, weight, lead, size``, numbered along the curve, their number and the most points of one."""
        cells = self.points.groupBy("cell").agg(
            *_box(self.d, "x", "x"), F.sum("w").alias("weight"), F.min("first_key").alias("lead"), F.count("*").alias("size")
        )
        cells = placed(materialize(cells.withColumn("_one", F.lit(0))), "_one", ["cell"]).drop("_one", "total").withColumnRenamed("place", "c")
        return cells, *cells.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0))).first()

    def _nodes(self) -> list[DataFrame]:
        """Boxes of each level, ``c, chunk`` and their members; the last level has one box for each cell."""
        sized = self.cells.select("cell", "c", "size", (F.col("weight") >= self.min_samples).alias("heavy"))
        known = join_sized(self.points, sized, ["cell"], "size", self.count)
        members = known.select("c", "heavy", F.floor(F.col("place") / FAN).alias("chunk"), F.col("pid").alias("kid"), F.col("x").alias("lo"), F.col("x").alias("hi"), F.col("w").alias("weight"))
        levels = [materialize(_packed(members, ["c", "chunk"], "kid", self.d, F.first("heavy").alias("heavy")))]
        most = -(-self.most // FAN)
        while most > 1:
            above = levels[-1].select("c", "heavy", F.floor(F.col("chunk") / FAN).alias("up"), F.col("chunk").alias("kid"), "lo", "hi", "weight")
            above = _packed(above, ["c", "up"], "kid", self.d, F.first("heavy").alias("heavy")).withColumnRenamed("up", "chunk")
            levels.append(materialize(above))
            most = -(-most // FAN)
        return levels

    def _near(self) -> DataFrame:
        """Pairs ``a < b`` of cells whose boxes are within ``eps``, with their ``reach2``, from the tree over cells."""
        level = self.cells.select(F.col("c").alias("kid"), "lo", "hi", "weight")
        tree, most = [], max(1, self.n_cells)
        while not tree or most > 1:
            level = materialize(_packed(level.withColumn("n", F.floor(F.col("kid") / CELL_FAN)), ["n"], "kid", self.d))
            tree.append(level.select("n", "kids", "boxes"))
            level = level.select(F.col("n").alias("kid"), "lo", "hi", "weight")
            most = -(-most // CELL_FAN)
        pairs = tree[-1].select(F.col("n").alias("a"), F.col("n").alias("b"))
        d, eps2 = self.d, self.eps2
        for depth in reversed(range(len(tree))):
            itself = depth > 0
            both = _sides(_spread(pairs.select("a", "b")), ["a", "b"], tree[depth].withColumnRenamed("n", "c"), tree[depth].withColumnRenamed("n", "c"), [])
            pairs = both.mapInArrow(lambda rows, itself=itself: _near_kids(rows, d, eps2, itself), "a long, b long, reach2 double")
        return materialize(pairs)

    def _both_ways(self, whole: bool) -> DataFrame:
        """``c, o``: neighbouring cells whose boxes lie within ``eps`` as a ``whole``, or only in part."""
        near = self.near.where((F.col("reach2") <= self.eps2) == F.lit(whole))
        return near.select(F.col("a").alias("c"), F.col("b").alias("o")).unionByName(near.select(F.col("b").alias("c"), F.col("a").alias("o")))

    def _core(self, light: DataFrame) -> DataFrame:
        """``pid, is_core`` of points in cells that are too light to be all core."""
        least, d, eps2 = self.min_samples, self.d, self.eps2
        around = self._both_ways(True).join(self.cells.select(F.col("c").alias("o"), "weight"), "o").groupBy("c").agg(F.sum("weight").alias("around"))
        known = F.col("cell_weight") + F.coalesce("around", F.lit(0))
        light = materialize(light.select("pid", "x", "c", "cell_weight").join(around, "c", "left").select("pid", "x", "c", known.alias("known")))
        decided = [light.where(F.col("known") >= least).select("pid", F.lit(True).alias("is_core"))]
        light = light.where(F.col("known") < least)
        asked = light.select("pid", "x", "c").join(self._both_ways(False), "c").select("pid", "x", "o", F.lit(0).cast("long").alias("chunk"))
        pending = light.select("pid", "known")
        for depth in reversed(range(len(self.nodes))):
            boxes = self.nodes[depth].select(F.col("c").alias("o"), "chunk", "kids", "boxes", "weights")
            rows = asked.join(boxes, ["o", "chunk"]).select("pid", "x", "o", "kids", "boxes", "weights")
            found = rows.mapInArrow(lambda b: _weigh(b, d, eps2), "pid long, o long, sure long, maybe long, open array<long>")
            found = materialize(found) if depth else found
            counts = found.groupBy("pid").agg(F.sum("sure").alias("sure"), F.sum("maybe").alias("maybe"))
            known = F.col("known") + F.coalesce("sure", F.lit(0))
            state = materialize(pending.join(counts, "pid", "left").select("pid", known.alias("known"), F.coalesce("maybe", F.lit(0)).alias("maybe")))
            open_yet = (F.col("known") < least) & (F.col("known") + F.col("maybe") >= least) if depth else F.lit(False)
            decided.append(state.where(~open_yet).select("pid", (F.col("known") >= least).alias("is_core")))
            if not depth:
                break
            pending = state.where(open_yet).select("pid", "known")
            kids = found.select("pid", "o", F.explode("open").alias("chunk"))
            asked = kids.join(pending.select("pid"), "pid", "left_semi").join(light.select("pid", "x"), "pid").select("pid", "x", "o", "chunk")
        out = decided[0]
        for part in decided[1:]:
            out = out.unionByName(part)
        return materialize(out)

    def _witnessed(self, pairs: DataFrame, left: list[DataFrame], right: list[DataFrame]) -> DataFrame:
        """The pairs ``a, b`` that have two members within ``eps``; one list of boxes for each side, by level."""
        current, met = _asked(pairs), None
        for depth in reversed(range(len(left))):
            step = self._met(current, left[depth], right[depth])
            hits = step.where("met").select("a", "b").distinct()
            met = hits if met is None else met.unionByName(hits)
            if not depth:
                break
            current = step.where("NOT met").join(hits, ["a", "b"], "left_anti").drop("met")
        return met

    def _met(self, current: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
        """``a, b, met, kid_a, kid_b``: what one level of boxes answers."""
        d, eps2 = self.d, self.eps2
        rows = _sides(_spread(current), ["a", "b"], left, right, ["chunk"])
        return materialize(rows.mapInArrow(lambda b: _meet(b, d, eps2), "a long, b long, met boolean, kid_a long, kid_b long"))

    def _connected(self, ends: DataFrame, pairs: DataFrame, boxes: list[DataFrame]) -> DataFrame:
        """``c, component`` of the cells ``ends`` (c), linked where ``pairs`` (a, b, reach2) have members within ``eps`` in ``boxes``.

        Cells whose boxes lie within ``eps`` as a whole need no look at members.
        Others are asked about level by level while they are in different
        components, cells side by side before those farther apart.
        """
        comps = connected_components(ends, pairs.where(F.col("reach2") <= self.eps2), "c", "a", "b")
        # Two full cells that share a face: in one dimension two sides, in the others one.
        beside = F.col("reach2") <= (1 + 3 / self.d) * self.eps2
        for near in (beside, ~beside):
            current = _asked(pairs.where((F.col("reach2") > self.eps2) & near))
            for depth in reversed(range(len(boxes))):
                comps = materialize(comps)
                a, b = (comps.select(F.col("c").alias(side), F.col("component").alias(f"of_{side}")) for side in "ab")
                current = materialize(current.join(a, "a").join(b, "b").where("of_a <> of_b").drop("of_a", "of_b"))
                if current.isEmpty():
                    break
                step = self._met(current, boxes[depth], boxes[depth])
                hits = step.where("met").select("a", "b").distinct()
                known = comps.select(F.col("c").alias("a"), F.col("component").alias("b"))
                comps = connected_components(ends, known.unionByName(hits), "c", "a", "b")
                current = step.where("NOT met").drop("met")
        return comps

    def labels(self) -> DataFrame:
        """``x, w, cluster, is_core`` of every point."""
        sized = self.cells.select("cell", "c", "size", "lead", F.col("weight").alias("cell_weight"))
        small = F.col("cell_weight") < self.min_samples
        light = materialize(self.points.select("cell", "pid", "x", "w", "first_key").join(sized.where(small).select("cell", "c", "cell_weight"), "cell").drop("cell"))
        decided = self._core(light)
        core = light.join(decided.where("is_core"), "pid")

        # Boxes over core points only: heavy cells as they are, of light cells the core points.
        d = self.d
        first = core.select("c", F.lit(0).cast("long").alias("chunk"), "first_key", F.col("pid").alias("kid"), F.col("x").alias("lo"), F.col("x").alias("hi"), F.col("w").alias("weight"))
        level = materialize(_packed(first, ["c", "chunk"], "kid", d, F.min("first_key").alias("lead")))
        light_leads = level.select("c", "lead")
        boxes = []
        for nodes in self.nodes:
            columns = ("c", "chunk", "kids", "boxes", "weights")
            boxes.append(nodes.where("heavy").select(*columns).unionByName(level.select(*columns)))
            up = level.select("c", F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("kid"), "lo", "hi", "weight")
            level = _packed(up, ["c", "chunk"], "kid", d)
        leads = materialize(sized.where(~small).select("c", "lead").unionByName(light_leads))

        ends = leads.select("c")
        near_core = self.near.join(ends.withColumnRenamed("c", "a"), "a", "left_semi").join(ends.withColumnRenamed("c", "b"), "b", "left_semi")
        comps = self._connected(ends, near_core, boxes)
        led = materialize(leads.join(comps, "c"))
        order = running_totals(led.groupBy("component").agg(F.min("lead").alias("lead")), ["lead"], {"cluster": F.lit(1)})
        numbered = order.select("component", F.col("cluster").cast("int").alias("cluster"))
        of_cell = materialize(led.join(numbered, "component").select("c", "cluster"))

        # Border points: the lowest-numbered cluster within reach.
        lone = light.join(decided.where("NOT is_core"), "pid").select("pid", "x", "c", "w")
        zero = F.lit(0).cast("long")
        single = lone.select(F.col("pid").alias("c"), zero.alias("chunk"), F.array(zero).alias("kids"), F.concat("x", "x").alias("boxes"))
        whole, asked = (
            lone.select(F.col("pid").alias("a"), "c").join(self._both_ways(w).withColumnRenamed("o", "b"), "c").select("a", "b").join(ends.withColumnRenamed("c", "b"), "b", "left_semi")
            for w in (True, False)
        )
        reached = whole.unionByName(self._witnessed(asked, [single] * len(boxes), boxes)).select(F.col("a").alias("pid"), F.col("b").alias("c"))
        reached = reached.unionByName(lone.select("pid", "c")).join(of_cell, "c").groupBy("pid").agg(F.min("cluster").alias("cluster"))

        no = F.lit(NOISE)
        border = lone.join(reached, "pid", "left").select("x", "w", F.coalesce("cluster", no).alias("cluster"), F.lit(False).alias("is_core"))
        inner = core.join(of_cell, "c").select("x", "w", "cluster", F.lit(True).alias("is_core"))
        heavy = sized.where(~small).join(of_cell, "c").select("cell", "size", "cluster")
        dense = join_sized(self.points.select("cell", "x", "w"), heavy, ["cell"], "size", self.count).select("x", "w", "cluster", F.lit(True).alias("is_core"))
        return dense.unionByName(inner).unionByName(border)


def _asked(pairs: DataFrame) -> DataFrame:
    """Questions ``a, b`` to the outermost boxes of both sides."""
    outer = F.lit(0).cast("long")
    return pairs.select("a", "b", outer.alias("kid_a"), outer.alias("kid_b"))


def _spread(questions: DataFrame) -> DataFrame:
    """Over all tasks: a question is a short row and much work."""
    return questions.repartition(4 * questions.sparkSession.sparkContext.defaultParallelism, *questions.columns)


def _sides(pairs: DataFrame, names: Sequence[str], left: DataFrame, right: DataFrame, chunk: Sequence[str]) -> DataFrame:
    """Pairs with the boxes of both sides; ``chunk`` tells that sides are known by cell and chunk."""
    a, b = names
    for side, boxes in ((a, left), (b, right)):
        renamed = boxes.select(F.col("c").alias(side), *[F.col(c).alias(f"kid_{side}") for c in chunk], F.col("kids").alias(f"kids_{side}"), F.col("boxes").alias(f"boxes_{side}"))
        pairs = pairs.join(renamed, [side, *(f"kid_{side}" for _ in chunk)])
    return pairs.select(a, b, f"kids_{a}", f"boxes_{a}", f"kids_{b}", f"boxes_{b}")
