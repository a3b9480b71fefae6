"""Quality classifier: gated attention over passages, learned from document labels.

Each text is cut into passages of ``PASSAGE`` bytes, all of it. A passage is
encoded by shares of byte classes and of their successions, by repeated words
and by word lengths; a learned layer maps that to a short vector. Gated
attention weighs the passages of a document, and a logistic unit scores the
weighted sum. Only labels of documents teach the weights of passages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_batches import mix, slices, text_bytes, with_column

PASSAGE = 256
_BATCH = 1 << 20
#: Bytes of the sample that the driver encodes at once; each takes a few dozen bytes meanwhile.
_SAMPLE_BATCH = 1 << 17
#: Bytes that are classes of their own.
_MARKS = b".,!?|*&%$#'\"-:;/"
_LAGS = 3


def _class_table() -> np.ndarray:
    """Byte → class: lower, upper, digit, space, line end, control, lead and later UTF-8 bytes, other, marks."""
    table = np.full(256, 8, np.uint8)
    table[:32], table[127], table[128:192], table[192:] = 5, 5, 7, 6
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1] = 0, 1, 2
    table[ord(" ")], table[ord("\n")] = 3, 4
    for k, b in enumerate(_MARKS):
        table[b] = 9 + k
    return table


_CLASS = _class_table()
_N = int(_CLASS.max()) + 1
#: The classes again, marks together, for successions.
_COARSE = np.minimum(_CLASS, 9)
_M = int(_COARSE.max()) + 1
WIDTH = _N + _M * _M + _LAGS + 2


def held_out(doc_id: Column) -> Column:
    """Whether ``crc32`` of the id as text leaves 2 when divided by 4; labels of such rows are never learned."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def encode_passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``WIDTH`` numbers, one for each passage, and how many passages each text has (one at least)."""
    data, offsets = text_bytes(texts)
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    first = np.cumsum(counts) - counts
    total = int(counts.sum())
    at = np.arange(len(data)) - np.repeat(offsets[:-1], sizes)
    passage = np.repeat(first, sizes) + at // PASSAGE
    share = 1.0 / np.maximum(1, np.bincount(passage, minlength=total))[:, None]
    out = np.zeros((total, WIDTH), np.float32)
    out[:, :_N] = np.bincount(passage * _N + _CLASS[data], minlength=total * _N).reshape(total, _N) * share
    coarse = _COARSE[data].astype(np.int64)
    together = passage[1:] == passage[:-1]
    pairs = (passage[1:] * _M + coarse[:-1]) * _M + coarse[1:]
    out[:, _N : _N + _M * _M] = np.bincount(pairs[together], minlength=total * _M * _M).reshape(total, -1) * share
    out[:, _N + _M * _M :] = _word_shares(data, at, passage, total)
    return out, counts


def _word_shares(data: np.ndarray, at: np.ndarray, passage: np.ndarray, total: int) -> np.ndarray:
    """Shares of words equal to the one 1, 2, … before in the same passage, words per byte, and share of long words."""
    out = np.zeros((total, _LAGS + 2), np.float32)
    inside = (data > 32) | ((data < 9) | (data > 13)) & (data != 32)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (passage[1:] != passage[:-1])
    starts = np.flatnonzero(begins)
    if not len(starts):
        return out
    of = passage[starts]
    word = np.cumsum(begins)[inside] - 1
    places = np.flatnonzero(inside)
    with np.errstate(over="ignore"):
        terms = mix(data[places].astype(np.uint64) + np.uint64(257) * (places - starts[word]).astype(np.uint64))
    ends = np.concatenate([np.flatnonzero(np.diff(word)) + 1, [len(word)]])
    lengths = np.diff(np.concatenate([[0], ends]))
    hashes = np.add.reduceat(terms, ends - lengths)
    n = np.maximum(1, np.bincount(of, minlength=total))
    for lag in range(1, _LAGS + 1):
        same = (hashes[lag:] == hashes[:-lag]) & (of[lag:] == of[:-lag])
        out[:, lag - 1] = np.bincount(of[lag:][same], minlength=total) / n
    out[:, _LAGS] = n / PASSAGE
    out[:, _LAGS + 1] = np.bincount(of[lengths > 12], minlength=total) / n
    return out


@dataclass
class AttentionModel:
    """Weights of a fixed size; ``prior`` is the score when nothing could be learned."""

    mean: np.ndarray
    scale: np.ndarray
    encode: np.ndarray
    value: np.ndarray
    gate: np.ndarray
    attend: np.ndarray
    weigh: np.ndarray
    prior: float | None = None

    def standard(self, x: np.ndarray) -> np.ndarray:
        return _with_one((x - self.mean) / self.scale)

    def forward(self, inputs: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        h = np.tanh(inputs @ self.encode)
        v, g = np.tanh(h @ self.value), 1 / (1 + np.exp(-(h @ self.gate)))
        raw = (v * g) @ self.attend
        raw = np.exp(raw - np.repeat(np.maximum.reduceat(raw, starts), counts))
        a = raw / np.repeat(np.add.reduceat(raw, starts), counts)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"h": h, "v": v, "g": g, "a": a, "z": z, "score": 1 / (1 + np.exp(-(_with_one(z) @ self.weigh)))}

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(counts), self.prior)
        return self.forward(self.standard(x), np.cumsum(counts) - counts, counts)["score"].astype(np.float64)


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1), x.dtype)])


def fit_attention(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, weights: np.ndarray, hidden: int = 24, gates: int = 12, rounds: int = 250, rate: float = 0.02, decay: float = 1e-4, seed: int = 11) -> AttentionModel:
    """Weighted logistic loss over documents, minimized by Adam on the whole sample."""
    rng = np.random.default_rng(seed)
    scale = x.std(axis=0) + 1e-3

    def start(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    model = AttentionModel(x.mean(axis=0), scale.astype(np.float32), start(x.shape[1] + 1, hidden), start(hidden, gates), start(hidden, gates), start(gates), start(hidden + 1))
    starts = np.cumsum(counts) - counts
    weights = (weights / weights.sum()).astype(np.float32)
    names = ("encode", "value", "gate", "attend", "weigh")
    first, second = ({n: np.zeros_like(getattr(model, n)) for n in names} for _ in range(2))
    inputs = model.standard(x)
    for turn in range(1, rounds + 1):
        f = model.forward(inputs, starts, counts)
        h, v, g, a = f["h"], f["v"], f["g"], f["a"]
        dlogit = (f["score"] - labels).astype(np.float32) * weights
        dz = np.repeat(dlogit[:, None] * model.weigh[:-1], counts, axis=0)
        pull = (dz * h).sum(axis=1)
        draw = a * (pull - np.repeat(np.add.reduceat(a * pull, starts), counts))
        dvg = draw[:, None] * model.attend
        dv, dg = dvg * g * (1 - v * v), dvg * v * g * (1 - g)
        dh = (a[:, None] * dz + dv @ model.value.T + dg @ model.gate.T) * (1 - h * h)
        steps = {"encode": inputs.T @ dh, "value": h.T @ dv, "gate": h.T @ dg, "attend": (v * g).T @ draw, "weigh": _with_one(f["z"]).T @ dlogit}
        for n in names:
            grad = steps[n] + decay * getattr(model, n)
            first[n] = 0.9 * first[n] + 0.1 * grad
            second[n] = 0.999 * second[n] + 0.001 * grad * grad
            move = first[n] / (1 - 0.9**turn) / (np.sqrt(second[n] / (1 - 0.999**turn)) + 1e-8)
            setattr(model, n, (getattr(model, n) - rate * move).astype(np.float32))
    return model


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", per_class: int = 1500, max_bytes: int = 100_000) -> AttentionModel:
    """Fit on a bounded sample: of each class the ``per_class`` documents of smallest ``md5(key)``, of texts up to ``max_bytes``.

    Held-out rows, null labels and documents with both labels are left out. The
    loss weighs the classes by their shares among all usable labels. The bounds
    hold for learning alone; every text is scored whole.
    """
    own = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col(key))).groupBy(F.col(key).alias("__id")).agg(F.min(label).alias("y"), F.max(label).alias("__z")).where("y = __z")
    known = docs.select(F.col(key).alias("__id"), F.col(text).alias("__text"))
    counts = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    if len(counts) < 2:
        return _constant(float(max(counts, default=1)))
    parts = [own.where(F.col("y") == y).orderBy(F.md5(F.col("__id").cast("string")), "__id").limit(per_class) for y in (0, 1)]
    sample = parts[0].union(parts[1]).select("__id", "y")
    sampled = known.where(F.octet_length("__text") <= max_bytes).join(F.broadcast(sample), "__id").dropDuplicates(["__id"])
    rows = sampled.select("__id", "y", "__text").toArrow().sort_by("__id")
    y = rows["y"].to_numpy().astype(np.float32)
    if len(set(y.tolist())) < 2:
        return _constant(float(y[0]) if len(y) else 1.0)
    parts = [encode_passages(b.column(0)) for b in slices(iter(rows.select(["__text"]).to_batches()), "__text", _SAMPLE_BATCH)]
    x, passages = (np.concatenate(p) for p in zip(*parts))
    del rows, parts
    share = {c: counts[c] / max(1.0, float((y == c).sum())) for c in (0, 1)}
    return fit_attention(x, passages, y, np.where(y == 1, share[1], share[0]))


def _constant(prior: float) -> AttentionModel:
    empty = np.zeros(0, np.float32)
    return AttentionModel(empty, empty, empty, empty, empty, empty, empty, prior)


def score_quality(docs: DataFrame, model: AttentionModel, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``, from 0 to 1: higher means label 1 is likelier. Null counts as empty; one row per row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(f for f in docs.schema if f.name != out), T.StructField(out, T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, _BATCH):
            x, counts = encode_passages(batch.column(batch.schema.get_field_index(text)))
            yield with_column(batch, out, pa.array(np.round(sent.value.score(x, counts), 6)))

    return docs.mapInArrow(score, schema)


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with their columns."""
    scored = score_quality(docs, train_quality(docs, labels, key=key, text=text), text, "__score")
    return scored.where(F.col("__score") >= threshold).select(*docs.columns)
