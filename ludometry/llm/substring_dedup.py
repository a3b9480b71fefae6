"""Substring dedup over words: difference-cover anchors, then extension to whole windows.

``COVER`` is a difference cover modulo ``PERIOD``: for any two places some shift
below the period moves both onto the cover. So two equal windows of
``window`` words share an anchor of ``window - PERIOD + 1`` words that starts at
a covered place in both, and only anchors at covered places are hashed. Anchors
that occur twice in the corpus are then extended: the windows around them are
compared whole, and those that occur twice mark their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B
from .words import Words, run_hashes, words_of

#: A perfect difference set modulo 21.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)


def anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (among all words) and hashes of the anchors at covered places of texts that hold a window."""
    length = window - PERIOD + 1
    hashes = run_hashes(words.hashes, length)
    covered = np.isin(np.arange(PERIOD), COVER)
    left = words.counts[words.doc] - words.place
    at = np.flatnonzero(covered[words.place % PERIOD] & (left >= length) & (words.counts[words.doc] >= window))
    return at, hashes[at]


def candidates(words: Words, window: int, found: np.ndarray) -> np.ndarray:
    """First words of the windows that hold a repeated anchor."""
    at, hashes = anchors(words, window)
    at = at[B.contains(found, hashes)]
    change = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(change, np.maximum(at - PERIOD + 1, words.first[words.doc[at]]), 1)
    np.add.at(change, at + 1, -1)
    fits = words.counts[words.doc] - words.place >= window
    return np.flatnonzero((np.cumsum(change)[:-1] > 0) & fits)


def dedup_windows(docs: DataFrame, text: str = "text", window: int = 35) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept``, one row per row.

    Words are runs of characters other than ASCII white space. A word goes if a
    window that covers it occurs anywhere else, in its own document too;
    windows are judged on the input. ``kept`` joins the other words by one
    space. A null or empty text has no words and an empty ``kept``; a text of
    fewer than ``window`` words loses none. Repeated rows repeat each other, so
    both lose their windows. Columns of ``docs`` named as the results are
    replaced.
    """
    if window < PERIOD:
        raise ValueError(f"a window needs {PERIOD} words at least")
    packed = B.pack(docs, text)

    def anchor_hashes(rows: pa.StructArray, _: dict) -> np.ndarray:
        return anchors(words_of(B.texts_of(rows, text)), window)[1]

    def window_hashes(rows: pa.StructArray, others: dict) -> np.ndarray:
        found = B.joined_hashes(others["hashes"])
        if not len(found):
            return found
        words = words_of(B.texts_of(rows, text))
        return run_hashes(words.hashes, window)[candidates(words, window, found)]

    some = B.repeated(B.messages(packed.table, packed.n_buckets, anchor_hashes))
    whole = B.repeated(B.messages(packed.join(some), packed.n_buckets, window_hashes))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, others in B.each_block(batches):
            words = words_of(B.texts_of(rows, text))
            gone = _covered(words, window, B.joined_hashes(others["hashes"]))
            kept = _spelled(words, ~gone)
            removed = np.bincount(words.doc[gone], minlength=len(rows))
            yield B.with_results(rows, {"n_words": pa.array(words.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": kept})

    return packed.join(whole).mapInArrow(apply, B.result_schema(docs.schema, "n_words long, n_removed long, kept string"))


def _covered(words: Words, window: int, found: np.ndarray) -> np.ndarray:
    """Words under a window whose hash is among ``found``."""
    change = np.zeros(len(words.hashes) + 1, np.int64)
    if len(found):
        hashes = run_hashes(words.hashes, window)
        fits = np.flatnonzero(words.counts[words.doc] - words.place >= window)
        at = fits[B.contains(found, hashes[fits])]
        change[at] += 1
        change[at + window] -= 1
    return np.cumsum(change)[:-1] > 0


def _spelled(words: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    at = np.flatnonzero(kept)
    doc = words.doc[at]
    later = np.concatenate([[False], doc[1:] == doc[:-1]]) if len(at) else np.zeros(0, bool)
    sizes = words.ends[at] - words.starts[at] + later
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    # A word's byte before its first is white space or another text's: the space goes over it.
    source = np.arange(total) + np.repeat(words.starts[at] - later - (ends - sizes), sizes)
    out = words.data[source] if total else np.zeros(0, np.uint8)
    out = out.copy()
    out[(ends - sizes)[later]] = 32
    per_doc = np.zeros(len(words.counts), np.int64)
    np.add.at(per_doc, doc, sizes)
    offsets = np.concatenate([[0], np.cumsum(per_doc)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(per_doc), pa.py_buffer(offsets), pa.py_buffer(out))
