"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

Each text is ``" " + text``; a space is the piece character U+2581. Merges
come from an agenda ordered by piece score, then from left to right. With
dropout, a candidate merge is skipped for good when a hash keyed by seed,
variant, span and split falls below the rate; a variant is drawn for every
stretch of a document from seed, document and place. So segmentations vary from
place to place, and any run, on any executor, repeats them. Characters outside
the vocabulary, U+2581 itself included, become byte pieces, so decoding gives
back every text.

Texts are cut where no piece spans two neighbouring characters. Merges never
cross such a cut, so each distinct (stretch, variant) of a batch is segmented
once, all of them side by side.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_batches import mix, ragged, slices, text_bytes, with_column

_SPACE = "▁"
_NONE = np.int32(2**31 - 1)
#: Longest stretch that is segmented side by side with others; longer ones use a heap each.
_WIDE = 32
_BATCH = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class PieceModel:
    """Tables of a BPE vocabulary with byte pieces; their size is that of the vocabulary."""

    size: int
    keys: np.ndarray  #: left symbol << 32 | right symbol, ascending
    ranks: np.ndarray  #: rank of the merge at the same place: smaller first, equal scores alike
    merged: np.ndarray  #: merged symbol at the same place
    symbols: np.ndarray  #: code point → symbol, -1 if no piece holds it
    alone: np.ndarray  #: symbol → whether it is in the vocabulary itself
    chars: np.ndarray  #: symbol → place among single characters, -1 if longer
    joins: np.ndarray  #: bits: whether some piece holds two characters side by side
    n_chars: int
    byte_ids: np.ndarray  #: byte → id
    data: np.ndarray  #: bytes of all pieces
    starts: np.ndarray  #: id → first byte in ``data``
    sizes: np.ndarray
    code_points: np.ndarray  #: symbol → code point, for single characters
    _lookup: dict[int, tuple[int, int]] | None = None

    @classmethod
    def load(cls, path: str) -> PieceModel:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        if not all(sp.is_byte(int(i)) for i in byte_ids):
            raise ValueError("the vocabulary needs a piece for each byte")
        ids = {names[i]: i for i in plain}
        chars = sorted({c for p in ids for c in p})
        for c in chars:
            ids.setdefault(c, len(ids) + n)
        extra = sorted(v for v in ids.values() if v >= n)
        renumbered = {v: n + k for k, v in enumerate(extra)}
        ids = {p: renumbered.get(v, v) for p, v in ids.items()}
        total = n + len(extra)
        score = {i: sp.get_score(i) for i in plain}
        long = [i for i in plain if len(names[i]) > 1]
        order = {s: k for k, s in enumerate(sorted({score[i] for i in long}, reverse=True))}
        pairs = {}
        for i in long:
            p = names[i]
            for cut in range(1, len(p)):
                if p[:cut] in ids and p[cut:] in ids:
                    pairs[ids[p[:cut]] << 32 | ids[p[cut:]]] = (order[score[i]], i)
        keys = np.array(sorted(pairs), np.int64)
        symbols = np.full(0x110000, -1, np.int32)
        place = np.full(total, -1, np.int32)
        code_points = np.zeros(total, np.uint32)
        for k, c in enumerate(chars):
            symbols[ord(c)], place[ids[c]], code_points[ids[c]] = ids[c], k, ord(c)
        symbols[0x20], symbols[ord(_SPACE)] = ids.get(_SPACE, -1), -1
        m = len(chars)
        at = {c: k for k, c in enumerate(chars)}
        joins = np.zeros((m * m + 7) // 8, np.uint8)
        inner = np.array(sorted({at[a] * m + at[b] for p in ids for a, b in zip(p, p[1:])}), np.int64)
        np.bitwise_or.at(joins, inner >> 3, np.uint8(1) << (inner & 7).astype(np.uint8))
        alone = np.zeros(total, bool)
        alone[plain] = True
        spelled = [b""] * n
        for i in plain:
            spelled[i] = names[i].replace(_SPACE, " ").encode()
        for b in range(256):
            spelled[byte_ids[b]] = bytes([b])
        sizes = np.array([len(s) for s in spelled], np.int64)
        return cls(n, keys, np.array([pairs[k][0] for k in keys.tolist()], np.int32), np.array([pairs[k][1] for k in keys.tolist()], np.int32), symbols, alone, place, joins, m, byte_ids, np.frombuffer(b"".join(spelled), np.uint8), np.cumsum(sizes) - sizes, sizes, code_points)

    def lookup(self) -> dict[int, tuple[int, int]]:
        """Pair → rank and merged symbol, made once per process."""
        if self._lookup is None:
            self._lookup = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist())))
        return self._lookup

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of two symbols, ``_NONE`` where there is none."""
        if not len(self.keys):
            return np.full(left.shape, _NONE)
        want = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], _NONE)

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged symbols of pairs that have a rank."""
        return self.merged[np.searchsorted(self.keys, left.astype(np.int64) << 32 | right.astype(np.int64))]

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether some piece holds the two characters side by side."""
        bit = self.chars[left].astype(np.int64) * self.n_chars + self.chars[right]
        return (self.joins[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0


def skipped(key: np.ndarray, start: np.ndarray, mid: np.ndarray, end: np.ndarray, rate: float) -> np.ndarray:
    """Whether the merge of ``[start, mid)`` and ``[mid, end)`` is dropped in a stretch of that key."""
    span = start.astype(np.uint64) << np.uint64(42) ^ mid.astype(np.uint64) << np.uint64(21) ^ end.astype(np.uint64)
    return (mix(key ^ mix(span + _BASE)) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < rate


def encode_pieces(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", rate: float = 0.1, seed: int = 7, variants: int = 16, out: str = "pieces") -> DataFrame:
    """``docs`` with ``out``: the piece ids of each text as ``array<int>``, row by row.

    ``rate`` is the share of candidate merges dropped; 0 gives the plain
    segmentation. The variant of a stretch depends on ``seed``, on ``key`` as
    text, and on the stretch's place, so repeated rows get equal pieces. A null
    text has null pieces, an empty one none. An existing column ``out`` is
    replaced. Rows are encoded where they lie; the model's tables, bounded by
    the vocabulary, are sent to the executors once.
    """
    model = docs.sparkSession.sparkContext.broadcast(PieceModel.load(model_path))
    keyed = docs.drop(out).withColumn("__salt", F.xxhash64(F.col(key).cast("string"), F.lit(seed)))
    schema = T.StructType([*(f for f in docs.schema if f.name != out), T.StructField(out, T.ArrayType(T.IntegerType(), False))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, _BATCH):
            texts = batch.column(batch.schema.get_field_index(text))
            salts = batch.column(batch.schema.get_field_index("__salt")).to_numpy().view(np.uint64)
            ids, counts = encode_texts(model.value, texts.to_pylist(), salts, rate, variants)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()), mask=texts.is_null() if texts.null_count else None)
            names = [n for n in batch.schema.names if n != "__salt"]
            yield with_column(batch.select(names), out, lists)

    return keyed.mapInArrow(encode, schema)


def decode_pieces(encoded: DataFrame, model_path: str, pieces: str = "pieces", out: str = "decoded") -> DataFrame:
    """``encoded`` with ``out``: the text of each list of piece ids; null for null. An existing ``out`` is replaced."""
    model = encoded.sparkSession.sparkContext.broadcast(PieceModel.load(model_path))
    schema = T.StructType([*(f for f in encoded.schema if f.name != out), T.StructField(out, T.StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(part.schema.get_field_index(pieces))
                sizes = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
                yield with_column(part, out, decode_ids(model.value, lists.flatten().to_numpy(), sizes, lists.is_null()))

    return encoded.mapInArrow(decode, schema)


def decode_ids(model: PieceModel, ids: np.ndarray, sizes: np.ndarray, nulls: pa.Array) -> pa.Array:
    own = model.sizes[ids]
    data = model.data[ragged(model.starts[ids], own)]
    ends = np.concatenate([[0], np.cumsum(own)])
    bounds = ends[np.concatenate([[0], np.cumsum(sizes)])]
    # The first byte of each text is the space that encoding put there.
    starts = np.minimum(bounds[:-1] + 1, bounds[1:])
    lengths = bounds[1:] - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    kept = data[ragged(starts, lengths)]
    texts = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept)))
    return pa.compute.if_else(nulls, pa.scalar(None, pa.string()), texts)


def encode_texts(model: PieceModel, texts: list[str | None], salts: np.ndarray, rate: float, variants: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts one after another, and how many each text has."""
    sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    points = np.frombuffer("".join(f" {t}" for t in texts if t).encode("utf-32-le"), np.uint32)
    if not len(points):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    symbols = model.symbols[points]
    cut = np.ones(len(points) + 1, bool)
    left, right = symbols[:-1], symbols[1:]
    known = np.flatnonzero((left >= 0) & (right >= 0))
    cut[1:-1][known] = ~model.joined(left[known], right[known])
    cut[np.cumsum(sizes)] = True
    starts = np.flatnonzero(cut[:-1])
    lengths = np.diff(np.concatenate([starts, [len(points)]]))
    docs = np.searchsorted(np.cumsum(sizes), starts, side="right")
    first = np.searchsorted(starts, np.cumsum(sizes) - sizes)
    place = np.arange(len(starts)) - first[docs]
    variant = mix(salts[docs] + _BASE * place.astype(np.uint64)) % np.uint64(max(variants, 1)) if rate > 0 else np.zeros(len(starts), np.uint64)
    keys = _content(points, starts, lengths) + mix(variant + np.uint64(1))
    unique, at, of = np.unique(keys, return_index=True, return_inverse=True)
    flat, counts = _segment(model, points, symbols, starts[at], lengths[at], unique, rate)
    flat_at = np.cumsum(counts) - counts
    ids = flat[ragged(flat_at[of], counts[of])]
    per_doc = np.bincount(docs, weights=counts[of], minlength=len(texts)).astype(np.int64)
    return ids, per_doc


def _content(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch's characters."""
    with np.errstate(over="ignore"):
        places = np.arange(len(points), dtype=np.uint64) - np.repeat(starts, lengths).astype(np.uint64)
        terms = mix(points.astype(np.uint64) + _BASE * (places + np.uint64(1)))
        return mix(np.add.reduceat(terms, starts) + lengths.astype(np.uint64))


def _segment(model: PieceModel, points: np.ndarray, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of distinct stretches, one after another, and how many each has."""
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    low = 0
    for wide in (1, 4, 8, 16, _WIDE):
        rows = np.flatnonzero((lengths > low) & (lengths <= wide))
        low = wide
        for part in np.array_split(rows, max(1, len(rows) * wide // (1 << 20))):
            if len(part):
                done.append((part, *_side_by_side(model, symbols, starts[part], lengths[part], keys[part], wide, rate)))
    for row in np.flatnonzero(lengths > _WIDE):
        ids = _agenda(model, symbols[starts[row] : starts[row] + lengths[row]], keys[row], rate)
        done.append((np.array([row]), ids, np.array([len(ids)])))
    counts = np.zeros(len(starts), np.int64)
    for rows, _, n in done:
        counts[rows] = n
    out = np.empty(int(counts.sum()), np.int32)
    at = np.cumsum(counts) - counts
    for rows, ids, n in done:
        out[ragged(at[rows], n)] = ids
    return _with_bytes(model, points, out, counts, starts)


def _with_bytes(model: PieceModel, points: np.ndarray, ids: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that are no ids of the vocabulary replaced by the ids of their bytes."""
    odd = np.flatnonzero((ids < 0) | (ids >= model.size))
    if not len(odd):
        return ids, counts
    row = np.searchsorted(np.cumsum(counts), odd, side="right")
    code = np.where(ids[odd] < 0, points[starts[row]], model.code_points[np.maximum(ids[odd], 0)])
    raw = [chr(int(c)).encode() for c in code]
    sizes = np.ones(len(ids), np.int64)
    sizes[odd] = [len(r) for r in raw]
    out = np.repeat(ids, sizes)
    out[ragged((np.cumsum(sizes) - sizes)[odd], sizes[odd])] = model.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    counts = counts.copy()
    np.add.at(counts, row, sizes[odd] - 1)
    return out, counts


def _side_by_side(model: PieceModel, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray, wide: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Segment stretches of at most ``wide`` characters, a row of a table each; every turn does one merge per row."""
    n = len(starts)
    inside = np.arange(wide) < lengths[:, None]
    table = np.full((n, wide), -1, np.int32)
    table[inside] = symbols[ragged(starts, lengths)]
    ends = np.broadcast_to(np.arange(1, wide + 1, dtype=np.int16), (n, wide)).copy()
    sizes = lengths.copy()
    if wide > 1:
        rank = np.full((n, wide), _NONE, np.int32)
        pairs = np.nonzero(inside[:, 1:])
        rank[pairs] = _candidate(model, table, ends, keys, rate, *pairs)
        live = np.arange(n)
        while True:
            best = rank[live].argmin(axis=1)
            found = rank[live, best]
            go = found < _NONE
            live, best = live[go], best[go]
            if not len(live):
                break
            table[live, best] = model.merge(table[live, best], table[live, best + 1])
            ends[live, best] = ends[live, best + 1]
            after = np.arange(wide - 1)
            moved = after >= best[:, None] + 1
            for grid, gap in ((table, -1), (ends, 0), (rank, _NONE)):
                part = grid[live]
                part[:, :-1] = np.where(moved, part[:, 1:], part[:, :-1])
                part[:, -1] = gap
                grid[live] = part
            sizes[live] -= 1
            for shift in (-1, 0):
                col = best + shift
                has = (col >= 0) & (col + 1 < sizes[live])
                inner = (col >= 0) & ~has
                rank[live[inner], col[inner]] = _NONE
                rank[live[has], col[has]] = _candidate(model, table, ends, keys, rate, live[has], col[has])
    return table[np.arange(wide) < sizes[:, None]], sizes


def _candidate(model: PieceModel, table: np.ndarray, ends: np.ndarray, keys: np.ndarray, rate: float, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    rank = model.rank(table[row, col], table[row, col + 1])
    if rate > 0:
        some = np.flatnonzero(rank < _NONE)
        r, c = row[some], col[some]
        start = np.where(c > 0, ends[r, np.maximum(c - 1, 0)], 0)
        rank[some[skipped(keys[r], start, ends[r, c], ends[r, c + 1], rate)]] = _NONE
    return rank


def _agenda(model: PieceModel, symbols: np.ndarray, key: np.uint64, rate: float) -> np.ndarray:
    """Segment one long stretch with a heap of candidate merges."""
    ids = symbols.tolist()
    ends = list(range(1, len(ids) + 1))
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    heap: list[tuple[int, int, int, int, int]] = []
    merges = model.lookup()

    def offer(i: int, j: int) -> None:
        found = merges.get(ids[i] << 32 | ids[j])
        if found is not None and not (rate > 0 and skipped(np.array([key]), np.array([i]), np.array([ends[i]]), np.array([ends[j]]), rate)[0]):
            heapq.heappush(heap, (found[0], i, ends[i], ends[j], found[1]))

    for i in range(len(ids) - 1):
        offer(i, i + 1)
    gone = [False] * len(ids)
    while heap:
        _, i, mid, end, merged = heapq.heappop(heap)
        j = after[i]
        if gone[i] or ends[i] != mid or j >= len(ids) or ends[j] != end:
            continue
        ids[i], ends[i], gone[j], after[i] = merged, end, True, after[j]
        if after[i] < len(ids):
            before[after[i]] = i
            offer(i, after[i])
        if before[i] >= 0:
            offer(before[i], i)
    return np.array([x for x, out in zip(ids, gone) if not out], np.int32)
