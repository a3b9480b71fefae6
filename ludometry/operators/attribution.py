"""Additive feature attributions of boosted trees.

The margin of a row is split into per-feature Shapley values, where a feature
that is left out follows the training cover at its splits. Each leaf is a small
game over the features on its path: a feature in the coalition lets the row
through or not, a missing one passes the share of training rows on that side.

The weights of coalition sizes are integrals of t^k (1 - t)^(n - k), so a
feature's value is the integral over t of the product of the others' factors
``share * (1 - t) + pass * t``. Gauss-Legendre nodes give it exactly.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir

#: Conditions that one lookup holds; one bit more than this is its number of bits.
_PIECE = 7
#: Rows and games that are looked up together, so that tables stay in the cache.
_ROWS, _GAMES = 256, 256


@dataclass(frozen=True)
class LeafTable:
    """All leaves of an ensemble as arrays (leaf × path position).

    A padded position has an unbounded interval and share 1: it is a feature
    that changes nothing, so it gets no value and moves no other value.
    ``twin`` marks leaves whose sibling is the leaf after them: the two differ
    in one position.
    """

    value: np.ndarray
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    twin: np.ndarray

    @property
    def base(self) -> float:
        return float((self.value * self.share.prod(axis=1)).sum())


def leaf_table(spark: SparkSession, model) -> LeafTable:
    """Read a fitted ensemble's saved node table; its size is trees × leaves."""
    path = os.path.join(checkpoint_dir(spark), f"model-{uuid.uuid4().hex}")
    model.write().save(path)
    n = F.col("nodeData")
    nodes = (
        spark.read.parquet(f"{path}/data")
        .select(
            "treeID",
            n["id"].alias("id"),
            n["prediction"].alias("value"),
            F.get(n["impurityStats"], F.lit(0)).alias("cover"),
            n["leftChild"].alias("left"),
            n["rightChild"].alias("right"),
            n["split"]["featureIndex"].alias("feature"),
            F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
            n["split"]["numCategories"].alias("categories"),
        )
        .collect()
    )
    if any(r["categories"] >= 0 for r in nodes):
        raise ValueError("attributions need numeric splits")
    tree_of: dict[int, dict[int, object]] = {}
    for r in nodes:
        tree_of.setdefault(r["treeID"], {})[r["id"]] = r
    leaves: list[tuple[float, dict[int, tuple[float, float, float]]]] = []
    twins: list[bool] = []
    for tree, weight in enumerate(model.treeWeights):
        table = tree_of[tree]
        stack = [(0, {})]
        while stack:
            at, path_so_far = stack.pop()
            node = table[at]
            if node["left"] < 0:
                leaves.append((weight * node["value"], path_so_far))
                twins.append(False)
                continue
            f, cut = node["feature"], node["threshold"]
            low, high, share = path_so_far.get(f, (-math.inf, math.inf, 1.0))
            children = []
            for child, bounds in ((node["left"], (low, min(high, cut))), (node["right"], (max(low, cut), high))):
                part = table[child]["cover"] / node["cover"]
                children.append((child, {**path_so_far, f: (*bounds, share * part)}))
            if all(table[child]["left"] < 0 for child, _ in children):
                leaves += [(weight * table[child]["value"], steps) for child, steps in children]
                twins += [True, False]
            else:
                stack += children
    width = max((len(p) for _, p in leaves), default=0) or 1
    shape = (len(leaves), width)
    feature, share = np.zeros(shape, dtype=int), np.ones(shape)
    low, high = np.full(shape, -np.inf), np.full(shape, np.inf)
    for i, (_, steps) in enumerate(leaves):
        for j, (f, (lo, hi, s)) in enumerate(steps.items()):
            feature[i, j], low[i, j], high[i, j], share[i, j] = f, lo, hi, s
    return LeafTable(np.array([v for v, _ in leaves]), feature, low, high, share, np.array(twins, bool))


class _Games:
    """The games of a leaf table, worked out for every pattern of met conditions.

    Two sibling leaves are one game: they share all conditions but one, which
    is put first and has a bit for either leaf. Conditions are cut into pieces
    of ``_PIECE``. A piece's table has, per pattern of its conditions, the value
    of each of its features without the factors of other pieces, and the
    product of its own factors, which the other pieces are multiplied by. Most
    ensembles have paths of one piece, and then values are summed over the nodes.

    A feature's cut points, sorted, turn its value into an interval number, and
    the bits of all conditions on it are one row per interval. So a row's
    patterns are a sum of one such row per feature.
    """

    def __init__(self, table: LeafTable, n_features: int):
        self.n_features = n_features
        first = np.flatnonzero(~np.concatenate([[False], table.twin])[: len(table.value)])
        second = np.where(table.twin[first], first + 1, first)
        parts = [a[i] for i in (first, second) for a in (table.low, table.high, table.share)]
        differ = (parts[0] != parts[3]) | (parts[1] != parts[4]) | (parts[2] != parts[5])
        lead = differ.argmax(axis=1)
        order = np.argsort(np.arange(differ.shape[1]) != lead[:, None], axis=1, kind="stable")
        feature, low, high, share, low2, high2, share2 = (np.take_along_axis(a, order, axis=1) for a in (table.feature[first], *parts))
        value = np.stack([table.value[first], np.where(table.twin[first], table.value[second], 0.0)], axis=1)
        self.count, width = feature.shape
        self.pieces = [range(a, min(a + _PIECE, width)) for a in range(0, width, _PIECE)]
        nodes, weights = np.polynomial.legendre.leggauss((width + 1) // 2)
        self._fill(share, np.stack([share[:, 0], share2[:, 0]], axis=1), value, (nodes + 1) / 2, weights / 2)
        self._index(feature, low, high, low2[:, 0], high2[:, 0])
        self.spread = np.zeros((self.count, width, n_features))
        self.spread[np.arange(self.count)[:, None], np.arange(width), feature] = 1.0

    def _fill(self, share: np.ndarray, ends: np.ndarray, value: np.ndarray, t: np.ndarray, weight: np.ndarray) -> None:
        """Tables of values (game × pattern, position × node) and products (game × pattern, node)."""
        self.values, self.products = [], []
        for k, piece in enumerate(self.pieces):
            bits = len(piece) + (k == 0)
            met = ((np.arange(2**bits)[:, None] >> np.arange(bits)) & 1).astype(float)
            factors = [share[:, p, None, None] * (1 - t) + met[None, :, i, None] * t for i, p in enumerate(piece)]
            gains = [met[None, :, i, None] - share[:, p, None, None] for i, p in enumerate(piece)]
            if k == 0:
                # The leaves' own condition: the last bit is the second leaf's.
                passed = np.stack([met[:, 0], met[:, -1]])
                both = [ends[:, s, None, None] * (1 - t) + passed[s][None, :, None] * t for s in (0, 1)]
                factors[0] = sum(value[:, s, None, None] * both[s] for s in (0, 1)) * weight
                gains[0] = sum(value[:, s, None, None] * (passed[s][None, :, None] - ends[:, s, None, None]) for s in (0, 1)) * weight
            found = []
            for i, gain in enumerate(gains):
                for j, factor in enumerate(factors):
                    gain = gain * factor if j != i else gain
                gain = np.broadcast_to(gain, (len(share), len(met), len(t)))
                found.append(gain.sum(axis=2, keepdims=True) if len(self.pieces) == 1 else gain)
            table = np.stack(found, axis=2)
            self.values.append(np.ascontiguousarray(table.reshape(len(share), len(met), -1)))
            product = np.ones((len(share), len(met), len(t)))
            for factor in factors:
                product = product * factor
            self.products.append(product)

    def _index(self, feature: np.ndarray, low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray) -> None:
        """Cut points of each feature, and per piece the bits of each interval (interval × game)."""
        width = feature.shape[1]
        conditions = [(feature[:, p], low[:, p], high[:, p], p // _PIECE, p % _PIECE) for p in range(width)]
        conditions.append((feature[:, 0], low2, high2, 0, len(self.pieces[0])))
        bounded = [np.isfinite(lo) | np.isfinite(hi) for _, lo, hi, _, _ in conditions]
        self.always = [np.zeros(self.count, np.uint8) for _ in self.pieces]
        for (_, _, _, k, bit), some in zip(conditions, bounded):
            self.always[k] += np.where(some, 0, 1 << bit).astype(np.uint8)
        self.cuts, self.bits = [], []
        for f in range(self.n_features):
            own = [np.flatnonzero(some & (c[0] == f)) for c, some in zip(conditions, bounded)]
            ends = [x[games] for c, games in zip(conditions, own) for x in (c[1], c[2])]
            cuts = np.unique(np.concatenate(ends))
            cuts = cuts[np.isfinite(cuts)]
            numbers = np.arange(len(cuts) + 1)[:, None]
            tables = [np.zeros((len(cuts) + 1, self.count), np.uint8) for _ in self.pieces]
            for (_, lo, hi, k, bit), games in zip(conditions, own):
                above = numbers > np.where(np.isfinite(lo[games]), np.searchsorted(cuts, lo[games]), -1)
                below = numbers <= np.where(np.isfinite(hi[games]), np.searchsorted(cuts, hi[games]), len(cuts))
                tables[k][:, games] += (above & below).astype(np.uint8) << np.uint8(bit)
            self.cuts.append(cuts)
            self.bits.append(tables)

    def _patterns(self, rows: np.ndarray) -> list[np.ndarray]:
        interval = [np.searchsorted(cuts, rows[:, f]) for f, cuts in enumerate(self.cuts)]
        out = []
        for k, always in enumerate(self.always):
            pattern = np.repeat(always[None], len(rows), axis=0)
            for f, numbers in enumerate(interval):
                if len(self.cuts[f]):
                    pattern += self.bits[f][k][numbers]
            out.append(pattern)
        return out

    def shapley(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.n_features))
        for at in range(0, len(x), _ROWS):
            rows = x[at : at + _ROWS]
            patterns = self._patterns(rows)
            for start in range(0, self.count, _GAMES):
                games = slice(start, min(start + _GAMES, self.count))
                number = np.arange(games.stop - start)
                places = [p[:, games].astype(np.intp) + number * t.shape[1] for p, t in zip(patterns, self.values)]
                found = [np.take(t[games].reshape(-1, t.shape[2]), i, axis=0) for t, i in zip(self.values, places)]
                if len(self.pieces) > 1:
                    products = [np.take(p[games].reshape(-1, p.shape[2]), i, axis=0) for p, i in zip(self.products, places)]
                    for k, phi in enumerate(found):
                        others = math.prod(p for j, p in enumerate(products) if j != k)
                        found[k] = (phi.reshape(*phi.shape[:2], -1, others.shape[2]) * others[:, :, None]).sum(axis=3)
                    found = [np.concatenate(found, axis=2)]
                out[at : at + _ROWS] += found[0].reshape(len(rows), -1) @ self.spread[games].reshape(-1, self.n_features)
        return out


def shapley(x: np.ndarray, table: LeafTable) -> np.ndarray:
    """Shapley values, rows × features."""
    return _Games(table, x.shape[1]).shapley(x)


def attributions(data: DataFrame, model, out: str = "attribution", scale: float = 1.0) -> DataFrame:
    """Add each row's per-feature values and the ensemble's ``base``.

    ``base + Σ attribution`` is ``scale`` × the model's margin. Boosted
    classifiers turn a margin m into 1 / (1 + exp(−2m)), so ``scale=2`` gives
    log-odds. The leaf table is broadcast (its size is that of the model) and
    its games are worked out once per task.
    """
    table = leaf_table(data.sparkSession, model)
    shared = data.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def values(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        games = None
        for batch in batches:
            if len(batch):
                x = np.stack(batch.to_numpy())
                games = games or _Games(shared.value, x.shape[1])
                yield pd.Series(list(scale * games.shapley(x)))
            else:
                yield pd.Series([], dtype=object)

    return data.withColumns({out: values(vector_to_array("features")), "base": F.lit(scale * table.base)})


def global_importance(attributed: DataFrame, features: Sequence[str], k: int = 15, col: str = "attribution") -> DataFrame:
    """Features by mean absolute attribution, top ``k``."""
    names = F.array(*[F.lit(f) for f in features])
    return (
        attributed.select(F.posexplode(col).alias("i", "phi"))
        .groupBy("i")
        .agg(F.avg(F.abs("phi")).alias("mean_abs"))
        .select(F.get(names, F.col("i")).alias("feature"), "mean_abs")
        .orderBy(F.desc("mean_abs"), "feature")
        .limit(k)
    )


def explain_top(
    scored: DataFrame,
    model,
    features: Sequence[str],
    key: str = "player_id",
    prob: str = "churn_probability",
    k: int = 3,
    reasons: int = 3,
) -> DataFrame:
    """The ``k`` rows with the highest probability and their strongest signed reasons."""
    top = scored.orderBy(F.desc(prob), key).limit(k)
    names = F.array(*[F.lit(f) for f in features])
    x = vector_to_array("features")
    parts = attributions(top, model, scale=2.0).withColumn("_x", x)
    entries = F.transform(
        "attribution",
        lambda phi, i: F.struct(
            (-F.abs(phi)).alias("o"),
            F.get(names, i).alias("feature"),
            phi.alias("attribution"),
            F.get("_x", i).alias("value"),
        ),
    )
    best = F.slice(F.sort_array(entries), 1, reasons)
    flat = parts.select(key, prob, F.posexplode(best).alias("_r", "e"))
    return flat.select(
        key, prob, (F.col("_r") + 1).alias("reason_no"), "e.feature", "e.attribution", "e.value"
    )
