"""Suffix-array dedup of bytes with a run-length index.

Sampling brings repeated stretches together: of each window of ``least`` bytes
the smallest hash of a run of ``ANCHOR`` bytes, the rightmost on ties, is its
anchor, so equal windows have equal anchors at equal distance. A segment is the
bytes of the windows that share one anchor. Segments whose anchor occurs twice
in the corpus go to the anchor's bucket, equal ones of a block once: of them all
but the first are known to go, and travel as merged runs under their block. In the bucket the
different segments are indexed by :mod:`run_index`; matching statistics streamed
from the index's sampled run ends find every window that starts earlier too.
Different anchors share no window, so an index holds few of them. An anchor
that very many blocks hold would still gather too many segments in one task:
its windows travel one by one under their own hashes, where only copies meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .arrow_batches import mix, ragged, text_bytes
from .run_index import build_index, earliest
from .words import BYTE_VALUES, run_hashes, span_hashes

ANCHOR = 28
_SEGMENTS = "bucket int, block long, anchor binary, key binary, place binary, start binary, windows binary, whole binary, size binary, data binary, done_place binary, done_start binary, done_end binary"
_GONE = "block long, place binary, start binary, end binary"
_PLACE_BITS = 23


@dataclass
class Segments:
    """Stretches of windows with one anchor, in order of text and place."""

    data: np.ndarray
    offsets: np.ndarray  #: of the texts in ``data``
    doc: np.ndarray
    start: np.ndarray  #: first window, as a place of ``data``
    windows: np.ndarray  #: how many
    anchor: np.ndarray  #: hash
    n_split: int = 0  #: so many at the end are single windows under their own hashes

    def take(self, at: np.ndarray) -> Segments:
        return Segments(self.data, self.offsets, self.doc[at], self.start[at], self.windows[at], self.anchor[at])


def segments_of(texts: pa.Array, least: int) -> Segments:
    """The segments of all texts; a text shorter than ``least`` bytes has none."""
    data, offsets = text_bytes(texts)
    n = len(data) - least + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return Segments(data, offsets, none, none, none, np.zeros(0, np.uint64))
    hashes = run_hashes(BYTE_VALUES[data], ANCHOR)
    starts, windows, anchors = [], [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= least:
            picked = _minima(hashes[a : b - ANCHOR + 1], least - ANCHOR + 1)
            new = np.flatnonzero(np.concatenate([[True], picked[1:] != picked[:-1]]))
            starts.append(a + new)
            windows.append(np.diff(np.concatenate([new, [len(picked)]])))
            # Minima crowd at the low end; mixed once more, equal ranges hold equal shares.
            anchors.append(mix(hashes[a + picked[new]]))
    if not starts:
        none = np.zeros(0, np.int64)
        return Segments(data, offsets, none, none, none, np.zeros(0, np.uint64))
    start = np.concatenate(starts)
    return Segments(data, offsets, np.searchsorted(offsets, start, side="right") - 1, start, np.concatenate(windows), np.concatenate(anchors))


def _minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest value of each run of ``width``, the rightmost on ties."""
    n = len(hashes)
    if n >= 1 << _PLACE_BITS:
        step = (1 << _PLACE_BITS) - width
        return np.concatenate([_minima(hashes[i : i + step + width - 1], width) + i for i in range(0, n - width + 1, step)])
    low = np.uint64((1 << _PLACE_BITS) - 1)
    least = (hashes & ~low) | (low - np.arange(n, dtype=np.uint64))
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    return (low - (least & low)).astype(np.int64)


def dedup_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 100, as_text: bool = False, hot_blocks: int = 1024) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (binary), one row per row.

    A text is its UTF-8 bytes. A byte goes if a string of ``least`` bytes that
    covers it also starts earlier: in a row of smaller key, or before it in its
    own text; strings are judged on the input and never cross rows. ``n_spans``
    counts the maximal removed runs. Cuts may fall inside a character, so
    ``kept`` is binary. Rows of one key are ordered by where the input holds
    them; null keys come first. A null text has no bytes. With ``as_text`` the
    kept bytes are text, without the characters that a cut leaves incomplete.
    Anchors of at least ``hot_blocks`` blocks are split into windows; the result
    is the same for any value.
    Columns of ``docs`` named as the results are replaced.
    """
    packed = B.pack(docs, text)

    def anchor_hashes(rows: pa.StructArray, _: dict) -> np.ndarray:
        return segments_of(B.texts_of(rows, text), least).anchor

    some = B.repeated(B.messages(packed.table, packed.n_buckets, anchor_hashes), hot_blocks)
    n_buckets = packed.n_buckets

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows, others in B.each_block(batches):
            found = B.joined_hashes(others["hashes"])
            if len(found):
                whole = segments_of(B.texts_of(rows, text), least)
                twice = whole.take(np.flatnonzero(B.contains(found, whole.anchor)))
                yield _sent(block, _split(twice, B.joined_hashes(others["often"]), least), _ordered_keys(B.texts_of(rows, key)), least, n_buckets)

    sent = packed.join(some).mapInArrow(send, _SEGMENTS)
    gone = sent.groupBy("bucket").applyInArrow(lambda group: _judge(group, least), _GONE)
    answers = gone.groupBy("block").agg(F.collect_list(F.struct("place", "start", "end")).alias("gone"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, others in B.each_block(batches):
            data, offsets = text_bytes(B.texts_of(rows, text))
            change = np.zeros(len(data) + 1, np.int64)
            for x in others["gone"] or ():
                doc, start, end = (B.unpack(x[n], np.int64) for n in ("place", "start", "end"))
                np.add.at(change, offsets[doc] + start, 1)
                np.add.at(change, offsets[doc] + end + least - 1, -1)
            removed = np.cumsum(change)[:-1] > 0
            counts = np.concatenate([[0], np.cumsum(removed)])[offsets]
            n_removed = np.diff(counts)
            begins = removed.copy()
            begins[1:] &= ~removed[:-1]
            edge = offsets[:-1][np.diff(offsets) > 0]
            begins[edge] = removed[edge]
            spans = np.diff(np.concatenate([[0], np.cumsum(begins)])[offsets])
            kept_offsets = np.concatenate([[0], np.cumsum(np.diff(offsets) - n_removed)]).astype(np.int32)
            kept = pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(kept_offsets), pa.py_buffer(np.ascontiguousarray(data[~removed]))])
            if as_text:
                kept = pa.array([x.decode("utf-8", "ignore") for x in kept.to_pylist()], pa.string())
            results = {"n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": kept}
            yield B.with_results(rows, results)

    return packed.join(answers).mapInArrow(apply, B.result_schema(docs.schema, f"n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}"))


def _ordered_keys(keys: pa.Array) -> np.ndarray:
    """Integer keys as they are, null as the least."""
    return keys.cast(pa.int64()).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)


def _split(segments: Segments, often: np.ndarray, least: int) -> Segments:
    """Segments of the anchors ``often`` as single windows, each under its own hash."""
    hot = B.contains(often, segments.anchor)
    if not hot.any():
        return segments
    cold, some = segments.take(np.flatnonzero(~hot)), segments.take(np.flatnonzero(hot))
    start = ragged(some.start, some.windows)
    own = span_hashes(some.data, start, np.full(len(start), least))
    parts = [(cold.doc, np.repeat(some.doc, some.windows)), (cold.start, start), (cold.windows, np.ones(len(start), np.int64)), (cold.anchor, own)]
    return Segments(some.data, some.offsets, *(np.concatenate(p) for p in parts), len(start))


def _sent(block: int, segments: Segments, keys: np.ndarray, least: int, n_buckets: int) -> pa.RecordBatch:
    """Segments by bucket, equal ones once: the earliest. The others start earlier too; one more row has their runs of starts."""
    sizes = segments.windows + least - 1
    content = span_hashes(segments.data, segments.start, sizes)
    bucket = B.bucket_of(segments.anchor, n_buckets)
    # Buckets ascend with anchors, so each bucket is a stretch of this order.
    order = np.lexsort((segments.start, segments.doc, keys[segments.doc], content, segments.anchor))
    a, c = segments.anchor[order], content[order]
    first = np.ones(len(order), bool)
    first[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    copies, order = order[~first], order[first]
    a, c, doc, start = segments.anchor[order], content[order], segments.doc[order], segments.start[order]
    carried = np.where(order < len(segments.start) - segments.n_split, sizes[order], 0)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]]) if len(order) else np.zeros(1, np.int64)
    done = _merged(segments, copies)
    many = len(edges) - 1
    values = {"anchor": a, "key": keys[doc], "place": doc.astype(np.int64), "start": start - segments.offsets[doc], "windows": segments.windows[order].astype(np.int64), "whole": c, "size": carried.astype(np.int64)}
    parts = {n: [v[x:y].tobytes() for x, y in zip(edges, edges[1:])] for n, v in values.items()}
    parts["data"] = [segments.data[ragged(start[x:y], carried[x:y])].tobytes() for x, y in zip(edges, edges[1:])]
    ends = {n: [b""] * many for n in ("done_place", "done_start", "done_end")}
    buckets = bucket[order][edges[:-1]].tolist()
    if len(copies):
        buckets.append(block % n_buckets)
        for x in parts.values():
            x.append(b"")
        for x, v in zip(ends.values(), done):
            x.append(v.tobytes())
    heads = {"bucket": pa.array(buckets, pa.int32()), "block": pa.array([block] * len(buckets), pa.int64())}
    columns = {n: pa.array(x, pa.binary()) for n, x in (parts | ends).items()}
    return pa.RecordBatch.from_arrays([*heads.values(), *columns.values()], names=[*heads, *columns])


def _merged(segments: Segments, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, start, end)`` of the starts that ``rows`` cover, touching ones as one run."""
    rows = rows[np.argsort(segments.start[rows], kind="stable")]
    doc, start = segments.doc[rows], segments.start[rows]
    end = start + segments.windows[rows]
    # A text's starts end before the next text's begin, so only starts of one text touch.
    new = np.ones(len(rows), bool)
    new[1:] = (start[1:] > end[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    stop = end[np.concatenate([at[1:], [len(rows)]]) - 1] if len(rows) else end
    base = segments.offsets[doc[at]]
    return doc[at].astype(np.int64), (start[at] - base).astype(np.int64), (stop - base).astype(np.int64)


def _judge(group: pa.Table, least: int) -> pa.Table:
    """The windows of a bucket's segments that start earlier too, as runs of starts."""
    kinds = {"anchor": np.uint64, "key": np.int64, "place": np.int64, "start": np.int64, "windows": np.int64, "whole": np.uint64, "size": np.int64, "data": np.uint8, "done_place": np.int64, "done_start": np.int64, "done_end": np.int64}
    lists = {n: [B.unpack(x, k) for x in group[n].to_pylist()] for n, k in kinds.items()}
    counts = [len(x) for x in lists["anchor"]]
    block = np.repeat(group["block"].to_numpy(), counts)
    s = {n: np.concatenate(x) for n, x in lists.items()}
    at = np.cumsum(s["size"]) - s["size"]
    order = np.lexsort((s["start"], s["place"], block, s["key"], s["whole"], s["anchor"]))
    anchor, whole = s["anchor"][order], s["whole"][order]
    first = np.ones(len(order), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])
    copies, kept = order[~first], order[first]
    # Anchors with several different segments; windows split off carry no bytes and need no index.
    _, of, n = np.unique(s["anchor"][kept], return_inverse=True, return_counts=True)
    several = kept[(n[of] > 1) & (s["size"][kept] > 0)]
    out = [(block[copies], s["place"][copies], s["start"][copies], s["start"][copies] + s["windows"][copies])]
    out.append((np.repeat(group["block"].to_numpy(), [len(x) for x in lists["done_place"]]), s["done_place"], s["done_start"], s["done_end"]))
    for part in _by_anchor(several, s["anchor"], s["size"]):
        part = part[np.lexsort((s["start"][part], s["place"][part], block[part], s["key"][part]))]
        sizes = s["size"][part]
        ends = np.cumsum(sizes)
        best = earliest(build_index(s["data"][ragged(at[part], sizes)], ends), least)
        base = ends - sizes + np.arange(len(part))
        windows = s["windows"][part]
        place = ragged(base, windows)
        gone = best[place] < place
        of = np.repeat(np.arange(len(part)), windows)
        edge = np.concatenate([[True], (gone[1:] != gone[:-1]) | (of[1:] != of[:-1])])
        runs = np.flatnonzero(edge)
        stops = np.concatenate([runs[1:], [len(gone)]])
        runs, stops = runs[gone[runs]], stops[gone[runs]]
        row = part[of[runs]]
        start = s["start"][row] + place[runs] - base[of[runs]]
        out.append((block[row], s["place"][row], start, start + stops - runs))
    block, place, start, end = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(block, kind="stable")
    parts = [p for p in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(p)]
    return pa.table(
        {
            "block": pa.array([block[p[0]] for p in parts], pa.int64()),
            **{n: pa.array([x[p].astype(np.int64).tobytes() for p in parts], pa.binary()) for n, x in (("place", place), ("start", start), ("end", end))},
        }
    )


def _by_anchor(rows: np.ndarray, anchor: np.ndarray, size: np.ndarray, most: int = 1 << 19) -> Iterator[np.ndarray]:
    """Rows (in order of anchor) in parts of about ``most`` bytes, all rows of an anchor in one."""
    if not len(rows):
        return
    new = np.concatenate([[True], anchor[rows][1:] != anchor[rows][:-1]])
    turn = (np.cumsum(size[rows]) // most)[new]
    part = np.repeat(turn, np.diff(np.concatenate([np.flatnonzero(new), [len(rows)]])))
    yield from np.split(rows, np.flatnonzero(np.diff(part)) + 1)
