"""Standardised features, K-Means selection, PCA projection."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.schemas import require_columns

# Features of the player clustering and of the outlier search.
SEGMENT_FEATURES = [
    "total_sessions",
    "avg_session_minutes",
    "total_play_hours",
    "days_active",
    "max_stage_reached",
    "session_frequency",
    "play_intensity",
    "engagement_ratio",
    "max_play_streak",
    "total_spend_usd",
    "num_purchases",
    "is_payer",
    "d1_retained",
    "d7_retained",
    "d30_retained",
    "fb_connected",
    "is_ios",
    "age",
]
OUTLIER_FEATURES = ["total_spend_usd", "num_purchases", "total_sessions", "total_play_hours", "max_stage_reached"]


def standardize(df: DataFrame, cols: Sequence[str], ddof: int = 0, suffix: str = "_z") -> DataFrame:
    """Add mean-0, deviation-1 columns (NULL counts as 0; constant columns become 0).

    The statistics are one row behind a scalar subquery, so no join is planned.
    """
    require_columns(df, cols)
    spread = F.stddev_samp if ddof else F.stddev_pop

    def value(c: str):
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0))

    stats = df.agg(
        F.struct(
            *[F.avg(value(c)).alias(f"m{i}") for i, c in enumerate(cols)],
            *[spread(value(c)).alias(f"s{i}") for i, c in enumerate(cols)],
        ).alias("s")
    ).scalar()
    out = df.withColumn("_s", stats)
    return out.withColumns(
        {
            f"{c}{suffix}": (value(c) - F.col(f"_s.m{i}"))
            / F.when(F.col(f"_s.s{i}") > 0, F.col(f"_s.s{i}")).otherwise(1.0)
            for i, c in enumerate(cols)
        }
    ).drop("_s")


def standard_vectors(df: DataFrame, cols: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Kept columns and one vector of the standardised features."""
    z = standardize(df, cols)
    assembled = VectorAssembler(inputCols=[f"{c}_z" for c in cols], outputCol="features").transform(z)
    return assembled.select(*keep, "features")


@dataclass(frozen=True)
class KMeansFit:
    """Centres (cluster × feature), the sum of squared distances to them, passes until they settled."""

    centres: np.ndarray
    cost: float
    iterations: int


@dataclass(frozen=True)
class Sweep:
    """Scores per k and the best model of each k."""

    scores: list[tuple[int, float, float]]
    models: dict[int, KMeansFit]

    @property
    def best_k(self) -> int:
        return max(self.scores, key=lambda s: s[2])[0]

    def table(self, spark) -> DataFrame:
        out = spark.createDataFrame(self.scores, "k int, inertia double, silhouette double")
        return out.withColumn("is_best", F.col("k") == self.best_k)


def kmeans_sweep(
    data: DataFrame,
    ks: Sequence[int] = range(2, 8),
    restarts: int = 10,
    max_iter: int = 300,
    seed: int = 42,
    key: str | None = None,
) -> Sweep:
    """K-Means for each k, lowest cost of several restarts, scored by silhouette.

    ``data`` has a ``features`` vector and all of its rows are used. All k and
    restarts are fitted together: every iteration is one pass over the data.
    The silhouette is the Euclidean one over all rows, see ``silhouettes``.
    """
    rows = hashed_rows(data, key).persist()
    try:
        starts = _seeds(rows, ks, restarts, seed)
        fits = _lloyd(rows, [centres for k in ks for centres in starts[k]], max_iter)
        best = {int(k): min(fits[i * restarts : (i + 1) * restarts], key=lambda f: f.cost) for i, k in enumerate(ks)}
        scores = silhouettes(rows, list(best.values()))
    finally:
        rows.unpersist()
    return Sweep([(k, fit.cost, s) for (k, fit), s in zip(best.items(), scores)], best)


def lloyd(data: DataFrame, starts: Sequence[np.ndarray], max_iter: int = 300, tol: float = 1e-4) -> list[KMeansFit]:
    """K-Means from each of the given sets of centres, all in the same passes over ``features``.

    A model is done when no centre moves farther than ``tol``, and leaves the
    passes. A cluster that loses all rows keeps its centre. The cost is that of
    the final centres.
    """
    return _lloyd(hashed_rows(data), starts, max_iter, tol)


def kmeans_assign(data: DataFrame, model: KMeansFit, out: str = "kmeans_cluster") -> DataFrame:
    """Number of the nearest centre for every row, the first one of several."""
    x = vector_to_array("features")
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.centres])
    gaps = F.transform(centres, lambda c: F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    return data.withColumn("_gaps", gaps).withColumn(out, (F.array_position("_gaps", F.array_min("_gaps")) - 1).cast("int")).drop("_gaps")


def silhouettes(rows: DataFrame, models: Sequence[KMeansFit]) -> list[float]:
    """Mean Euclidean silhouette of each model over all rows.

    ``rows`` has ``x``. A row's value is (b - a) / max(a, b), with its mean
    distances to the rest of its own cluster (a) and to the nearest other one
    (b); 0 in a cluster of one, and with a single cluster.

    Every row is compared with every other one, once for all models, so the work
    grows with the square of the rows. Rows are dealt over blocks; a task
    compares two blocks, or one with itself, and holds these rows and their sums
    of distances to each cluster. The sums of a row's tasks are added up after.
    """
    n = rows.count()
    if not n:
        return [0.0] * len(models)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast([m.centres for m in models])
    ends = np.cumsum([0, *(len(m.centres) for m in models)])
    most = max(_PIECE_ROWS, _SIDE_BYTES // (8 * (int(ends[-1]) + models[0].centres.shape[1])))
    blocks = max(1, min(-(-n // _PIECE_ROWS), max(math.ceil((8 * spark.sparkContext.defaultParallelism) ** 0.5), -(-n // most))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            for at in range(0, batch.num_rows, _PIECE_ROWS):
                lists = batch.column(0).slice(at, _PIECE_ROWS)
                part = batch.column(1)[0].as_py()
                sizes = np.concatenate([np.bincount(_nearest(_matrix(lists), c)[0], minlength=len(c)) for c in shared.value])
                row = {"block": part % blocks, "piece": (part << 32) + turn, "x": lists.flatten().to_numpy(zero_copy_only=False), "sizes": sizes}
                turn += 1
                yield pa.RecordBatch.from_pydict({c: [v] for c, v in row.items()}, schema=_PIECE)

    dealt = rows.select("x").repartition(blocks).select("x", F.spark_partition_id().cast("long").alias("part"))
    pieces = materialize(dealt.mapInArrow(pack, "block long, piece long, x array<double>, sizes array<long>"))
    counted = dict(pieces.select(F.posexplode("sizes").alias("at", "n")).groupBy("at").agg(F.sum("n")).collect())
    sizes = np.array([counted[i] for i in range(ends[-1])], float)

    # Blocks low <= high meet in the task number high * (high + 1) / 2 + low.
    met = pieces.select("block", "piece", "x", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    task = F.expr("int(shiftright(greatest(block, other) * (greatest(block, other) + 1), 1) + least(block, other))")
    met = met.select(task.alias("task"), (F.col("block") <= F.col("other")).alias("low"), "piece", "x")
    spread = met.repartitionById(blocks * (blocks + 1) // 2, "task")
    sums = spread.groupBy("task").applyInArrow(lambda t: _compare(t, shared.value), "piece long, sums array<double>, label array<int>")

    def score(t: pa.Table) -> pa.Table:
        whole = np.sum([s.values.to_numpy(zero_copy_only=False) for s in t["sums"]], axis=0).reshape(-1, ends[-1])
        (label,) = (s.values.to_numpy(zero_copy_only=False).reshape(len(whole), -1) for s in t["label"] if s.is_valid)
        found = [_silhouette(whole[:, a:b], sizes[a:b], label[:, m]).sum() for m, (a, b) in enumerate(zip(ends, ends[1:]))]
        return pa.table({"model": pa.array(np.arange(len(found), dtype=np.int32)), "s": pa.array(found, pa.float64())})

    totals = sums.groupBy("piece").applyInArrow(score, "model int, s double").groupBy("model").agg(F.sum("s").alias("s")).collect()
    found = {r["model"]: r["s"] / n for r in totals}
    return [float(found[m]) for m in range(len(models))]


#: Rows that travel together, and the most that are compared with as many at once.
_PIECE_ROWS = 1024
#: About the bytes of a block's rows and sums: a task holds two blocks and a few copies.
_SIDE_BYTES = 32 << 20
#: Squared distances below this share of the squared lengths are mostly rounding in a matrix product.
_ROUNDING = 1e-8
_PIECE = pa.schema([("block", pa.int64()), ("piece", pa.int64()), ("x", pa.list_(pa.float64())), ("sizes", pa.list_(pa.int64()))])


class _Side:
    """Rows of a block's pieces in the order of their clusters, and their sums of distances to each cluster."""

    def __init__(self, pieces: pa.Table, models: Sequence[np.ndarray]):
        d, starts = models[0].shape[1], np.cumsum([0, *map(len, models)])
        lists = pieces["x"].combine_chunks()
        self.pieces, self.lengths = pieces["piece"], lists.value_lengths().to_numpy(zero_copy_only=False) // d
        x = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        self.label = np.stack([_nearest(x, c)[0] for c in models], axis=1).astype(np.int32)
        self.order = np.lexsort(self.label.T)
        self.x = x[self.order]
        self.sums = np.zeros((len(x), starts[-1]))
        norms = (self.x**2).sum(axis=1, keepdims=True)
        self.as_left = np.hstack([-2 * self.x, norms, np.ones_like(norms)])
        self.as_right = np.hstack([self.x, np.ones_like(norms), norms])
        clusters = self.label[self.order] + starts[:-1]
        changes = np.concatenate([[True], (np.diff(clusters, axis=0) != 0).any(axis=1)])
        # Slices of the rows, the first rows of the runs of equal clusters in each, and which clusters those are.
        self.slices = []
        for at in range(0, len(x), _PIECE_ROWS):
            rows = slice(at, min(at + _PIECE_ROWS, len(x)))
            runs = np.union1d([0], np.flatnonzero(changes[rows]))
            member = np.zeros((len(runs), starts[-1]))
            member[np.arange(len(runs))[:, None], clusters[rows][runs]] = 1
            self.slices.append((rows, runs, member))

    def table(self, labelled: bool) -> pa.Table:
        """``piece, sums, label`` of each piece, in the order the rows came in."""
        ends = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int32)
        sums = np.empty_like(self.sums)
        sums[self.order] = self.sums
        lists = [pa.ListArray.from_arrays(pa.array(ends * v.shape[1]), pa.array(v.ravel())) for v in (sums, self.label)]
        if not labelled:
            lists[1] = pa.nulls(len(self.lengths), lists[1].type)
        return pa.table([self.pieces, *lists], names=["piece", "sums", "label"])


def _compare(t: pa.Table, models: Sequence[np.ndarray]) -> pa.Table:
    """Sums of distances between the rows of two blocks, or of one, told apart by ``low``."""
    left = _Side(t.filter(t["low"]), models)
    alone = left.pieces.length() == t.num_rows
    room = np.empty(_PIECE_ROWS * _PIECE_ROWS)
    right = left if alone else _Side(t.filter(pc.invert(t["low"])), models)
    for i, (a, runs_a, member_a) in enumerate(left.slices):
        for j, (b, runs_b, member_b) in enumerate(right.slices):
            if alone and j < i:
                continue
            far = _distances(left, a, right, b, room)
            left.sums[a] += np.add.reduceat(far, runs_b, axis=1) @ member_b
            if not alone or j > i:
                # reduceat is slow along this axis.
                runs = [far[first:end].sum(axis=0) for first, end in zip(runs_a, [*runs_a[1:], len(far)])]
                right.sums[b] += np.stack(runs, axis=1) @ member_a
    return left.table(True) if alone else pa.concat_tables([left.table(False), right.table(False)])


def _distances(left: _Side, a: slice, right: _Side, b: slice, room: np.ndarray) -> np.ndarray:
    """Distances of rows to rows by a matrix product, in ``room``; those of close ones by differences, as rounding would show there."""
    x, y = left.x[a], right.x[b]
    # New memory for each product costs more than the product.
    far = np.matmul(left.as_left[a], right.as_right[b].T, out=room[: len(x) * len(y)].reshape(len(x), len(y)))
    close = np.flatnonzero(far < _ROUNDING * (left.as_left[a, -2].max() + right.as_right[b, -1].max()))
    if len(close) > far.size // 16:
        far[:] = 0
        for c in range(x.shape[1]):
            far += (x[:, c, None] - y[:, c]) ** 2
    elif len(close):
        i, j = np.divmod(close, len(y))
        far.flat[close] = ((x[i] - y[j]) ** 2).sum(axis=1)
    return np.sqrt(far, out=far)


#: Rows that a step compares with all centres at once.
_STEP_ROWS = 4096
#: Rounds of seeding, and candidates drawn in each as a multiple of the largest k.
_ROUNDS, _OVERSAMPLED = 2, 2


def hashed_rows(data: DataFrame, key: str | None = None) -> DataFrame:
    """``x`` arrays and ``h``, a hash of the key; without a key rows count as their own."""
    x = vector_to_array("features").alias("x")
    name = F.col(key).cast("string") if key else F.to_json(F.array(F.col("x")))
    return data.select(x, *([key] if key else [])).select("x", F.md5(name.cast("binary")).alias("h"))


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's nearest centre, and the squared distance."""
    label = ((centres**2).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)
    return label, ((x - centres[label]) ** 2).sum(axis=1)


def _silhouette(sums: np.ndarray, sizes: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Silhouettes from each row's sums of distances to the members of each cluster."""
    at = np.arange(len(label))
    own = sums[at, label] / np.maximum(sizes[label] - 1, 1)
    means = np.where(sizes > 0, sums / np.maximum(sizes, 1), np.inf)
    means[at, label] = np.inf
    other = means.min(axis=1)
    largest = np.maximum(own, other)
    good = (sizes[label] > 1) & np.isfinite(other) & (largest > 0)
    return np.where(good, (np.where(good, other, 0.0) - own) / np.where(good, largest, 1.0), 0.0)


def _members(x: np.ndarray, models: Sequence[np.ndarray], starts: np.ndarray) -> np.ndarray:
    """Cluster of all models × row: 1 for the nearest cluster of each model, the first one of several.

    Models with the same number of clusters are compared together, row by row of
    centres, so the work is a few long vector operations.
    """
    mine = np.zeros((starts[-1], len(x)))
    for k in {len(c) for c in models}:
        at = [m for m, c in enumerate(models) if len(c) == k]
        centres = np.stack([models[m] for m in at], axis=1)
        far = (centres**2).sum(axis=2)[:, :, None] - 2 * (centres.reshape(k * len(at), -1) @ x.T).reshape(k, len(at), -1)
        label, best = np.zeros(far.shape[1:], np.int32), far[0]
        for j in range(1, k):
            closer = far[j] < best
            np.copyto(label, j, where=closer)
            best = np.minimum(best, far[j])
        for j in range(k):
            mine[starts[at] + j] = label == j
    return mine


def _pass(rows: DataFrame, models: Sequence[np.ndarray], costs: bool = True) -> list[list[tuple[int, float, np.ndarray]]]:
    """Rows, squared distances and sums of the rows of each cluster of each model, from one pass.

    Tasks reduce their rows to one vector per cluster, so what is shuffled and
    returned grows with the models only. Without ``costs`` the distances are 0:
    a step needs none, and they are most of the work.
    """
    shared = rows.sparkSession.sparkContext.broadcast(list(models))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        starts = np.cumsum([0, *map(len, centres)])
        total = np.zeros((starts[-1], 2 + centres[0].shape[1]))
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = _matrix(batch.column(0))
            for x in np.array_split(whole, -(-len(whole) // _STEP_ROWS)):
                mine = _members(x, centres, starts)
                total[:, 0] += mine.sum(axis=1)
                total[:, 2:] += mine @ x
            for start, c in zip(starts, centres) if costs else ():
                label, gap = _nearest(whole, c)
                total[start : start + len(c), 1] += np.bincount(label, weights=gap, minlength=len(c))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1, dtype=np.int32) * total.shape[1]), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), lists], names=["at", "v"])

    parts = rows.select("x").mapInArrow(reduce, "at int, v array<double>")
    found = parts.groupBy("at").agg(Summarizer.sum(array_to_vector("v")).alias("v")).collect()
    by_cluster = {r["at"]: r["v"].toArray() for r in found}
    out, at = [], 0
    for c in models:
        sums = [by_cluster.get(at + i, np.zeros(2 + c.shape[1])) for i in range(len(c))]
        out.append([(int(round(v[0])), float(v[1]), v[2:]) for v in sums])
        at += len(c)
    return out


def _lloyd(rows: DataFrame, starts: Sequence[np.ndarray], max_iter: int, tol: float = 1e-4) -> list[KMeansFit]:
    centres = [np.asarray(c, float) for c in starts]
    steps = [0] * len(centres)
    live = list(range(len(centres)))
    for _ in range(max_iter):
        if not live:
            break
        left = []
        for m, clusters in zip(live, _pass(rows, [centres[m] for m in live], costs=False)):
            moved = np.array([s / n if n else c for c, (n, _, s) in zip(centres[m], clusters)])
            if ((moved - centres[m]) ** 2).sum(axis=1).max() > tol * tol:
                left.append(m)
            centres[m], steps[m] = moved, steps[m] + 1
        live = left
    costs = [sum(cost for _, cost, _ in clusters) for clusters in _pass(rows, centres)] if centres else []
    return [KMeansFit(c, cost, n) for c, cost, n in zip(centres, costs, steps)]


def _seeds(rows: DataFrame, ks: Sequence[int], restarts: int, seed: int) -> dict[int, list[np.ndarray]]:
    """Starting centres for each k and restart: oversampled candidates, shared by all k of a restart.

    A restart begins with one row and draws rows with a chance in proportion to
    their squared distance from its candidates, twice. Draws are hashes of the
    row, so copies are drawn together and once. The few candidates, weighted by
    the rows nearest to them, are reduced to k on the driver.
    """
    first = rows.agg(*[F.min(F.struct(F.xxhash64("h", F.lit(seed), F.lit(r)).alias("o"), "x")).alias(f"r{r}") for r in range(restarts)]).first()
    if first["r0"] is None:
        raise ValueError("no rows to cluster")
    candidates = [np.array([first[f"r{r}"]["x"]], float) for r in range(restarts)]
    wanted = _OVERSAMPLED * max(ks)
    for turn in range(_ROUNDS):
        costs = [sum(cost for _, cost, _ in clusters) for clusters in _pass(rows, candidates)]
        drawn = _draw(rows, candidates, [wanted / c if c > 0 else 0.0 for c in costs], seed + 1000 * (turn + 1))
        candidates = [np.concatenate([c, more]) if len(more) else c for c, more in zip(candidates, drawn)]
    weights = [np.array([n for n, _, _ in clusters], float) for clusters in _pass(rows, candidates)]
    return {k: [_plus_plus(c, w, k, np.random.default_rng([seed, k, r])) for r, (c, w) in enumerate(zip(candidates, weights))] for k in ks}


def _draw(rows: DataFrame, candidates: Sequence[np.ndarray], rates: Sequence[float], seed: int) -> list[np.ndarray]:
    """Different rows drawn for each restart; their number follows from the rates, not from the data."""
    shared = rows.sparkSession.sparkContext.broadcast((list(candidates), list(rates)))
    draws = F.array(*[F.pmod(F.xxhash64("x", F.lit(seed), F.lit(r)), F.lit(1 << 52)) / float(1 << 52) for r in range(len(candidates))])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, rate = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, u = _matrix(batch.column(0)), _matrix(batch.column(1))
            for r, c in enumerate(centres):
                chosen = pa.array(np.flatnonzero(u[:, r] < rate[r] * _nearest(x, c)[1]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(chosen), r, np.int32)), batch.column(0).take(chosen)], names=["r", "x"])

    found = rows.select("x", draws.alias("u")).mapInArrow(pick, "r int, x array<double>").distinct().collect()
    picked = [sorted(tuple(row["x"]) for row in found if row["r"] == r) for r in range(len(candidates))]
    return [np.array(p, float).reshape(-1, candidates[0].shape[1]) for p in picked]


def _plus_plus(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` of the weighted candidates, far from each other, moved to the means of what is nearest to them."""
    chosen = [points[rng.choice(len(points), p=weights / weights.sum())]]
    while len(chosen) < k:
        chance = weights * _nearest(points, np.array(chosen))[1]
        if chance.sum() <= 0:
            # Fewer different rows than clusters: repeated centres stay empty.
            chosen.append(points[rng.integers(len(points))])
        else:
            chosen.append(points[rng.choice(len(points), p=chance / chance.sum())])
    centres = np.array(chosen)
    for _ in range(30):
        mine = np.eye(k)[_nearest(points, centres)[0]] * weights[:, None]
        sizes = mine.sum(axis=0)[:, None]
        moved = np.where(sizes > 0, mine.T @ points / np.maximum(sizes, 1e-300), centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def pca_project(data: DataFrame, k: int = 2) -> tuple[DataFrame, list[float]]:
    """Add ``pca_1 … pca_k`` and return the explained variance shares.

    ``data`` has standardised ``features``. Each component's sign is fixed so
    that its largest loading is positive.
    """
    model = PCA(k=k, inputCol="features", outputCol="_pca").fit(data)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    out = model.transform(data).withColumn("_pca", vector_to_array("_pca"))
    out = out.withColumns({f"pca_{j + 1}": F.col("_pca")[j] * F.lit(signs[j]) for j in range(k)})
    return out.drop("_pca"), [float(v) for v in model.explainedVariance.toArray()]
