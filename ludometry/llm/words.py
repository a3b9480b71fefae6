"""Words and runs of words as hashes, for many texts at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .arrow_batches import mix, text_bytes

_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A random value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2^64 for ``i < n``."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
        _POWERS[base] = have
    return have[:n]


def run_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` values; runs may cross texts, callers mask those."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(_BASE, len(values)))])
        return mix((sums[length:] - sums[:-length]) * powers(_INVERSE, n) + np.uint64(length))


@dataclass
class Words:
    data: np.ndarray  #: bytes of all texts
    starts: np.ndarray  #: first byte of each word
    ends: np.ndarray
    hashes: np.ndarray
    doc: np.ndarray  #: text of each word
    place: np.ndarray  #: place of each word in its text
    counts: np.ndarray  #: words of each text
    first: np.ndarray  #: first word of each text


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """Runs of bytes other than ASCII white space; ``lower`` maps A-Z to a-z. Null counts as empty."""
    data, offsets = text_bytes(texts)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = ~((data == 32) | (data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    doc = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return Words(data, starts, ends, _word_hashes(data, starts, ends), doc, np.arange(len(starts)) - first[doc], counts, first)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(data, starts, ends - starts)


def span_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of the ``sizes`` bytes from each of ``starts``."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * powers(_BASE, len(data)), out=sums[1:])
        return mix((sums[starts + sizes] - sums[starts]) * powers(_INVERSE, len(data) + 1)[starts] + sizes.astype(np.uint64))
