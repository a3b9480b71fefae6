"""A run-length index of a repetitive text: run-compressed Burrows-Wheeler transform with sampled run ends.

The text is a sequence of segments with an end mark each; no match crosses one.
Inside a run of the transform, the suffix one place earlier has the match of
its neighbour plus one. So the longest match of every position with its
predecessor in suffix order follows from the samples at run starts alone:
walking the text from a sample to the next, the match shrinks by one and the
matching place moves by one. That walk streams the matching statistics of the
text against itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_FIRST = 7
_BITS = np.uint64(9)


@dataclass
class RunIndex:
    heads: np.ndarray  #: the byte (plus one; 0: an end mark) of each run of the transform
    lengths: np.ndarray  #: of the runs
    at: np.ndarray  #: text places of the suffixes at run starts, ascending
    match: np.ndarray  #: their longest match with the suffix before them in suffix order
    other: np.ndarray  #: where that match starts; -1 for the first suffix
    size: int

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the text the length and the start of its match with the suffix before it."""
        place = np.arange(self.size)
        sample = np.searchsorted(self.at, place, side="right") - 1
        ahead = place - self.at[sample]
        return np.maximum(self.match[sample] - ahead, 0), np.where(self.other[sample] >= 0, self.other[sample] + ahead, -1)


def build_index(data: np.ndarray, ends: np.ndarray) -> RunIndex:
    """Index of the segments that end before ``ends`` (ascending places of ``data``)."""
    n, k = len(data), len(ends)
    starts = np.concatenate([[0], ends[:-1]])
    segment = np.repeat(np.arange(k), ends - starts)
    # Text with an end mark after each segment.
    size = n + k
    text = np.zeros(size, np.uint16)
    text[np.arange(n) + segment] = data.astype(np.uint16) + 1
    marks = ends + np.arange(k)
    left = np.repeat(marks, ends - starts + 1) - np.arange(size)
    order, levels = _suffix_order(text, left)
    before = text[order - 1]
    before[order == 0] = 0
    new = np.ones(size, bool)
    new[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
    runs = np.flatnonzero(new)
    lengths = np.diff(np.concatenate([runs, [size]]))
    here = order[runs]
    prior = np.where(runs > 0, order[runs - 1], -1)
    match = np.zeros(len(runs), np.int64)
    inner = runs > 0
    match[inner] = _common(text, left, levels, here[inner], prior[inner])
    by_place = np.argsort(here)
    return RunIndex(before[runs], lengths, here[by_place], match[by_place], prior[by_place], size)


def _suffix_order(text: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The suffix array, ends of segments by place, and ranks by the first 7, 14, 28, … symbols."""
    size = len(text)
    padded = np.concatenate([text, np.zeros(_FIRST, np.uint16)]).astype(np.uint64)
    key = np.zeros(size, np.uint64)
    for q in range(_FIRST):
        key = (key << _BITS) | np.where(left >= q, padded[q : q + size], np.uint64(0))
    levels = []
    span = _FIRST
    place = np.arange(size, dtype=np.uint64)
    longest = int(left.max(initial=0)) + 1
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(size, np.uint32)
        rank[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
        levels.append((span, rank))
        if span >= longest or int(rank.max(initial=0)) == size:
            break
        there = np.minimum(np.arange(size) + span, size - 1)
        key = rank.astype(np.uint64) << np.uint64(32) | np.where(left >= span, rank[there], 0).astype(np.uint64)
        span *= 2
    return np.argsort(rank.astype(np.uint64) << np.uint64(32) | place).astype(np.int64), levels


def _common(text: np.ndarray, left: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of suffixes, up to the end marks."""
    size = len(text)
    length = np.zeros(len(a), np.int64)
    for span, rank in reversed(levels):
        for _ in range(2):
            x, y = a + length, b + length
            go = (x < size) & (y < size)
            x, y = np.minimum(x, size - 1), np.minimum(y, size - 1)
            go &= (rank[x] == rank[y]) & (left[x] >= span) & (left[y] >= span)
            length += span * go
    for _ in range(_FIRST):
        x, y = np.minimum(a + length, size - 1), np.minimum(b + length, size - 1)
        length += (text[x] == text[y]) & (text[x] > 0)
    return length


def earliest(index: RunIndex, least: int) -> np.ndarray:
    """For each place of the text the first place with the same ``least`` symbols, which may be itself.

    Places whose match reaches ``least`` hang on the place of that match; chains
    of them are shortened by doubling.
    """
    match, other = index.matching_statistics()
    best = np.arange(index.size)
    up = np.where(match >= least, other, best)
    while True:
        best = np.minimum(best, best[up])
        nxt = up[up]
        if (nxt == up).all():
            break
        up = nxt
    # The end of a chain sees only itself: hand the chain's least place down again.
    least_of = np.full(index.size, index.size)
    np.minimum.at(least_of, up, best)
    return least_of[up]
