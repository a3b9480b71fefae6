"""N-gram Jaccard join by adaptive multi-match prefixes.

A document is the set of its distinct shingles. Shingles have one global order,
rare ones first by a count sketch of the corpus. Two sets of Jaccard similarity
``t`` share at least ``l`` of the first ``n - ceil(t n) + l`` shingles of each,
for every ``l``. Each document picks the ``l`` that costs least: more prefix
means more postings to read, but more shared shingles asked of a candidate mean
fewer to verify. A pair is a candidate when it shares the smaller ``l`` of the
two. Candidates are verified on whole sets.

Equal sets are one node from the start. Hot groups of near copies never become
pairs: rounds first link the members of each posting list to one of them, and
only postings that still hold several components give pairs, which all get
verified. So no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ludometry.operators.components import connected_components
from ludometry.session import materialize

from . import blocks as B
from .words import run_hashes, words_of

#: Cells of the count sketch, and the parts it travels in.
_CELL_BITS, _PARTS = 22, 64
_PER_PART = (1 << _CELL_BITS) // _PARTS
#: Shared shingles a document may ask for (at least, and as a part of its set), the cost of a verified shingle
#: against a posting, and the partners expected of a shingle that the sketch calls rare.
_MOST_MATCHES, _MATCH_PART, _VERIFY, _RARE = 6, 10, 0.05, 0.05
#: A set asks for its size divided by this at least, so sets with few repeated prefix shingles have no partner.
_ASK_PART = 16
#: Pairs left for a posting from which on leaders are asked first.
_PAIRS_PER_POSTING = 2
#: Leaders of a posting list in a turn, and the members that meet pair by pair.
_LEADERS, _SHORT = 8, 32
#: Leaders are looked for in one of so many parts of the posting lists.
_PARTS_OF_LISTS = 4
_PART = f"pmod(token, {_PARTS_OF_LISTS}) = 0"
#: Shingles that one side of a comparison within a crowd holds in memory; a larger set is a part of its own.
_PART_SHINGLES = 1 << 20
_PROFILE = "rid long, n long, s1 long, s2 long, part int, cells binary"


@dataclass(frozen=True)
class Measure:
    text: str = "text"
    shingle: int = 5
    percent: int = 75

    def least_asked(self, n: int) -> int:
        """The matches that a set of ``n`` asks for at least, whatever its cost."""
        return min(max(1, n // _ASK_PART), self.least_shared(n))

    def least_shared(self, n: int) -> int:
        """``ceil(t n)``: what a set of ``n`` shares with a similar one."""
        return -(-self.percent * n // 100)

    def band(self, shared: int, n: int, m: int) -> int:
        """The Jaccard distance in whole multiples of the largest distance of a link."""
        union = n + m - shared
        return (union - shared) * 100 // (union * (100 - self.percent)) if self.percent < 100 else 0

    def similar(self, shared: int, n: int, m: int) -> bool:
        return 100 * shared >= self.percent * (n + m - shared)


def shingle_sets(texts: pa.Array, shingle: int = 5) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, ascending; a text of fewer words has its whole sequence, one without words none."""
    words = words_of(texts, lower=True)
    runs = run_hashes(words.hashes, shingle)
    short = {size: run_hashes(words.hashes, size) for size in range(1, shingle)}
    out = []
    for first, count in zip(words.first.tolist(), words.counts.tolist()):
        if count >= shingle:
            own = np.sort(runs[first : first + count - shingle + 1])
            new = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=new[1:])
            out.append(own if new.all() else own[new])
        else:
            out.append(short[count][first : first + 1] if count else np.zeros(0, np.uint64))
    return out


def choose_prefix(tokens: np.ndarray, excess: np.ndarray, measure: Measure) -> tuple[np.ndarray, int]:
    """The prefix of a set and how many of its shingles a candidate must share.

    ``excess`` is the number of other documents expected in a shingle's posting
    list. Its coarse logarithm orders the shingles, then their hashes.
    Candidates that share ``l`` shingles number at most the sum over the prefix
    divided by ``l``.
    """
    n = len(tokens)
    base, most = n - measure.least_shared(n), min(max(_MOST_MATCHES, n // _MATCH_PART), measure.least_shared(n))
    hot = np.flatnonzero(excess)
    if n - len(hot) >= base + most:
        cold = tokens if not len(hot) else np.delete(tokens, hot)
        best = _matches(base, measure.least_asked(n), most, n)
        return cold[: base + best], best
    order = np.argsort(np.log2(1 + excess).astype(np.int8), kind="stable")
    best = _cheapest(np.cumsum(excess[order[: base + most]] + _RARE), base, measure.least_asked(n), most, n)
    return tokens[order[: base + best]], best


def _cheapest(reached: np.ndarray, base: int, least: int, most: int, n: int) -> int:
    matches = np.arange(least, max(least, most) + 1)
    cost = base + matches + reached[base + matches - 1] * (1 + (1 + _VERIFY * n) / matches)
    return int(matches[np.argmin(cost)])


@lru_cache(maxsize=1 << 16)
def _matches(base: int, least: int, most: int, n: int) -> int:
    """The choice where the whole prefix is rare."""
    return _cheapest(_RARE * np.arange(1, base + max(least, most) + 1), base, least, most, n)


def ngram_join(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with ``n_shingles`` and ``component_id``, one row per row.

    Words are runs of characters other than ASCII white space, A-Z lower-cased.
    Rows link when ``100 * shared >= percent * union`` of their shingle sets;
    ``component_id`` is the smallest key reachable over links, itself included.
    Null, empty and blank texts have no shingles and no links. Rows of one key
    are one document; a null key counts for links but is no ``component_id``
    unless the component has no other. Result columns replace columns of their names.
    """
    return _labelled(docs, key, text, shingle, percent).drop("__first")


def _labelled(docs: DataFrame, key: str, text: str, shingle: int, percent: int) -> DataFrame:
    """``ngram_join`` with ``__first``: is a row the one of smallest key in its component, and of such the first?"""
    measure = Measure(text, shingle, percent)
    packed = B.pack(docs, text)
    profile = materialize(_profile(packed, measure))
    sketch = _sketch(profile)
    sets = profile.where("part IS NULL").select("rid", "n", "s1", "s2")
    nodes = sets.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("rid").alias("node"))
    sent = packed.table.sparkSession.sparkContext.broadcast(sketch)
    chosen = nodes.select(_block("node"), _place("node").alias("at")).groupBy("block").agg(F.sort_array(F.collect_list("at")).alias("places"))
    chosen = materialize(chosen)

    def prefix_hashes(rows: pa.StructArray, others: dict) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *(p for _, _, p, _ in _prefixes(rows, others["places"], sent.value, measure))])

    shared = B.repeated(B.messages(packed.join(chosen), packed.n_buckets, prefix_hashes))
    postings = materialize(_postings(packed.join(chosen.join(shared, "block")), sent, measure))
    links = _link(packed, postings, measure)
    rid_schema = packed.table.select("block", F.posexplode("rows").alias("at", "row"))
    keyed = rid_schema.select(F.shiftleft("block", B.PLACE_BITS).bitwiseOR(F.col("at").cast("long")).alias("rid"), F.col(f"row.{key}").alias("__key"))
    same = keyed.where("__key IS NOT NULL").groupBy("__key").agg(F.min("rid").alias("a"), F.count("*").alias("c")).where("c > 1")
    twins = keyed.join(same, "__key").where("rid <> a").select(F.col("rid").alias("b"), "a")
    member = sets.join(nodes, ["s1", "s2", "n"], "left").select("rid", "n", F.coalesce("node", "rid").alias("node"))
    member = materialize(member.join(keyed, "rid"))
    twin_nodes = twins.join(member.select(F.col("rid").alias("a"), F.col("node").alias("na")), "a").join(member.select(F.col("rid").alias("b"), F.col("node").alias("nb")), "b")
    edges = links.union(twin_nodes.where("na <> nb").select("na", "nb"))
    rooted = _components(edges)
    labelled = member.join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = labelled.groupBy("root").agg(F.min(F.struct(F.col("__key").isNull().alias("none"), F.col("__key").alias("k"), F.col("rid").alias("r"))).alias("least"))
    answer = F.struct(_place("rid").alias("at"), F.col("n").alias("n"), F.col("least.k").alias("c"), (F.col("least.r") == F.col("rid")).alias("f"))
    answers = labelled.join(least, "root").groupBy(_block("rid")).agg(F.sort_array(F.collect_list(answer)).alias("found"))
    own = docs.schema[key].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, others in B.each_block(batches):
            found = others["found"]
            component = pa.array([x["c"] for x in found], rows.type.field(rows.type.get_field_index(key)).type)
            yield B.with_results(rows, {"n_shingles": pa.array([x["n"] for x in found], pa.int64()), "component_id": component, "__first": pa.array([x["f"] for x in found], pa.bool_())})

    return packed.join(answers).mapInArrow(apply, B.result_schema(docs.schema, f"n_shingles long, component_id {own}, __first boolean"))


def _block(rid: str):
    return F.shiftright(rid, B.PLACE_BITS).alias("block")


def _place(rid: str):
    return F.col(rid).bitwiseAND(F.lit((1 << B.PLACE_BITS) - 1)).cast("int")


def _profile(packed: B.Blocks, measure: Measure) -> DataFrame:
    """Size and signature of every row's set, and the counts of each task's shingles by cell."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << _CELL_BITS, np.uint32)
        for block, rows, _ in B.each_block(batches):
            sets = shingle_sets(B.texts_of(rows, measure.text), measure.shingle)
            n = np.array([len(s) for s in sets], np.int64)
            with np.errstate(over="ignore"):
                s1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                s2 = np.array([((s >> np.uint64(7)) * (s | np.uint64(1))).sum(dtype=np.uint64) for s in sets], np.uint64)
            for s in sets:
                cells[s >> np.uint64(64 - _CELL_BITS)] += 1
            rid = (block << B.PLACE_BITS) + np.arange(len(sets))
            none = pa.nulls(len(sets))
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), none.cast(pa.int32()), none.cast(pa.binary())], names=["rid", "n", "s1", "s2", "part", "cells"])
        for part in range(_PARTS):
            own = cells[part * _PER_PART : (part + 1) * _PER_PART]
            at = np.flatnonzero(own).astype(np.uint32)
            if len(at):
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([part], pa.int32()), pa.array([np.stack([at, own[at]]).tobytes()], pa.binary())], names=["rid", "n", "s1", "s2", "part", "cells"])

    return packed.table.mapInArrow(profile, _PROFILE)


@dataclass(frozen=True)
class Sketch:
    """Counts of the cells that stand out from the mean over all cells; only these move a shingle in the order."""

    mean: float
    at: np.ndarray
    counts: np.ndarray

    @cached_property
    def cells(self) -> np.ndarray:
        """All cells, 0 where nothing stands out; tasks build them, the driver never does."""
        out = np.zeros(1 << _CELL_BITS, np.uint32)
        out[self.at] = self.counts
        return out


def _sketch(profile: DataFrame) -> Sketch:
    """Counts by cell over the corpus; of its 16 MB only the cells above the noise come to the driver."""

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(_PER_PART, np.int64)
        for cells in group["cells"]:
            at, counts = np.frombuffer(cells.as_buffer(), np.uint32).reshape(2, -1)
            total[at] += counts
        total = np.minimum(total, 2**32 - 1)
        return pa.table({"part": group["part"].slice(0, 1).cast(pa.int32()), "cells": pa.array([total.astype(np.uint32).tobytes()], pa.binary()), "total": pa.array([total.sum()], pa.int64())})

    parts = profile.where("part IS NOT NULL").select("part", "cells").groupBy("part").applyInArrow(add, "part int, cells binary, total long")
    parts = materialize(parts)
    mean = (parts.agg(F.sum("total")).first()[0] or 0) / (1 << _CELL_BITS)
    noise = mean + 4 * np.sqrt(mean) + 1

    def loud(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = np.frombuffer(cells.as_buffer(), np.uint32)
                at = np.flatnonzero(counts > noise)
                yield pa.RecordBatch.from_arrays([pa.array([part * _PER_PART + at], pa.list_(pa.int32())), pa.array([counts[at]], pa.list_(pa.int64()))], names=["at", "counts"])

    found = parts.select("part", "cells").mapInArrow(loud, "at array<int>, counts array<long>").toArrow()
    at, counts = (np.concatenate([np.zeros(0, np.int64), *(c.flatten().to_numpy() for c in found[n].chunks)]) for n in ("at", "counts"))
    return Sketch(mean, at.astype(np.int32), counts.astype(np.uint32))


def _prefixes(rows: pa.StructArray, places: list[int] | None, sketch: Sketch, measure: Measure) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """``(place, set size, prefix, matches asked)`` of the rows at ``places``."""
    if not places:
        return
    cells, mean = sketch.cells, sketch.mean
    sets = shingle_sets(B.texts_of(rows, measure.text).take(pa.array(places)), measure.shingle)
    for place, tokens in zip(places, sets):
        counts = cells[tokens >> np.uint64(64 - _CELL_BITS)]
        prefix, matches = choose_prefix(tokens, np.where(counts > 0, counts - mean, 0), measure)
        yield place, len(tokens), prefix, matches


def _postings(blocks: DataFrame, sent, measure: Measure) -> DataFrame:
    """``token, rid, n, asks``: the prefix shingles that stand in several prefixes.

    A partner has at least ``percent`` of a set's size and asks for at least
    ``least_asked`` of that, so a set with fewer such shingles has no partner
    and no posting.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows, others in B.each_block(batches):
            found = B.joined_hashes(others["hashes"])
            if not len(found):
                continue
            parts = []
            for place, n, prefix, asks in _prefixes(rows, others["places"], sent.value, measure):
                prefix = prefix[B.contains(found, prefix)]
                if len(prefix) < max(1, measure.least_shared(n) // _ASK_PART):
                    continue
                parts.append((prefix.view(np.int64), np.full(len(prefix), (block << B.PLACE_BITS) + place), np.full(len(prefix), n), np.full(len(prefix), asks, np.int32)))
            if parts:
                token, rid, n, asks = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(rid, pa.int64()), pa.array(n, pa.int64()), pa.array(asks, pa.int32())], names=["token", "rid", "n", "asks"])

    return blocks.mapInArrow(post, "token long, rid long, n long, asks int")


def _link(packed: B.Blocks, postings: DataFrame, measure: Measure) -> DataFrame:
    """Verified links ``(a, b)`` between nodes that join all similar ones into the components they belong to."""
    fits = f"100 * least(n, m) >= {measure.percent} * greatest(n, m)"
    live = postings.withColumn("root", F.col("rid"))
    links: DataFrame | None = None
    turn, left = 0, _pairs_left(live)
    while left > _PAIRS_PER_POSTING * live.count():
        best = materialize(_led(live, fits, _LEADERS, turn))
        found = materialize(_verified(packed, best, measure))
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            live = materialize(_rooted(live.drop("root"), links))
        before, left = left, _pairs_left(live)
        turn += 1
        # Another turn pays while turns settle most pairs; what is left is compared by crowds and pairs.
        if left > before / 4:
            break
    lists = live.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("c"), F.min(F.struct(F.xxhash64("rid").alias("h"), "rid")).alias("hub"))
    lists = materialize(lists.where("x <> y").select("token", "c", F.col("hub.rid").alias("hub")))
    crowded = _hub_links(packed, live.join(lists.where(F.col("c") > _SHORT).select("token", "hub"), "token"), measure)
    pairs = _short_pairs(live.join(lists.where(F.col("c") <= _SHORT).select("token"), "token"), fits)
    pairs = materialize(pairs.groupBy("a", "b", "asks_a", "asks_b").count().where("count >= least(asks_a, asks_b)").select("a", "b"))
    last = _verified(packed, materialize(_possible(packed, pairs, measure)), measure).union(crowded)
    return materialize(last if links is None else links.union(last))


def _short_pairs(rest: DataFrame, fits: str) -> DataFrame:
    """A row ``(a, b, asks_a, asks_b)`` for each prefix shingle that members of different components share."""
    left = rest.select("token", F.col("rid").alias("a"), "n", F.col("asks").alias("asks_a"), F.col("root").alias("root_a"))
    right = rest.select("token", F.col("rid").alias("b"), F.col("n").alias("m"), F.col("asks").alias("asks_b"), F.col("root").alias("root_b"))
    return left.join(right, "token").where("root_a < root_b").where(fits).select("a", "b", "asks_a", "asks_b")


def _hub_links(packed: B.Blocks, crowded: DataFrame, measure: Measure) -> DataFrame:
    """Links ``(a, b)`` between different components within posting lists of more than ``_SHORT`` members.

    Lists with the same first member (by a hash), their hub, are one crowd.
    Each member knows its distance to the hub: Jaccard distance is a metric,
    so sets whose distances differ by more than a link allows are left out.
    Members of one distance and size class are a cell. All of a crowd but its
    largest component ask the cells around them, and the sets of both sides
    travel to the cell, so askers are held against all members of a cell at
    once, in however many blocks those are; one link to each component is
    enough. Cells and their askers are cut into parts of about
    ``_PART_SHINGLES``, and every part meets every other: only a cell of
    several parts sends a set more than once.
    """
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / measure.percent))).cast("int") if measure.percent < 100 else F.col("n")
    crowd = materialize(crowded.select("hub", "rid", "root", size.alias("size")).distinct())
    to_hub = materialize(crowd.where("rid <> hub").select(F.col("rid").alias("a"), F.col("hub").alias("b")))
    bands = _compared(packed, to_hub, measure, _narrowed, lambda mine, theirs: measure.band(*_shared(mine, theirs)))
    bands = bands.select(F.col("a").alias("rid"), F.col("b").alias("hub"), F.col("value").alias("band"))
    crowd = materialize(crowd.join(bands, ["rid", "hub"], "left").withColumn("band", F.coalesce("band", F.lit(0))))
    largest = crowd.groupBy("hub", "root").count().groupBy("hub").agg(F.max(F.struct("count", "root")).alias("l")).select("hub", F.col("l.root").alias("largest"))
    asking = materialize(crowd.join(largest, "hub").where("root <> largest").select("hub", F.col("rid").alias("b"), "root", "band", "size"))
    # Sizes a link apart are at most one class apart; one more for rounding.
    around = asking.withColumn("near", F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1))))).withColumn("like", F.explode(F.array(*(F.col("size") + k for k in (-2, -1, 0, 1, 2)))))
    held = crowd.select("hub", F.col("band").alias("near"), F.col("size").alias("like"), "rid", "root")
    cell = ["hub", "near", "like"]
    cells = held.groupBy(*cell).agg(F.count("*").alias("n_held"), F.min("root").alias("x"), F.max("root").alias("y"))
    asked = materialize(around.join(cells, cell).where("x <> root OR y <> root").select(*cell, "n_held", "b", "root", "band"))
    most = F.pow(F.lit(100 / measure.percent), F.col("like") + 1) if measure.percent < 100 else F.col("like")
    parts = [F.least(c, F.ceil(F.col(c) * most / _PART_SHINGLES)).alias(p) for c, p in (("n_held", "held_parts"), ("n_asked", "asked_parts"))]
    cut = asked.groupBy(*cell).agg(F.count("*").alias("n_asked"), F.first("n_held").alias("n_held")).select(*cell, *parts)
    asks = _dealt(asked.join(cut, cell), "b", "asked_parts", "held_parts").select(F.xxhash64(*cell, "own", "other").alias("to"), F.col("b").alias("rid"), "root", "band", F.lit(True).alias("asks"))
    holds = _dealt(held.join(cut, cell), "rid", "held_parts", "asked_parts").select(F.xxhash64(*cell, "other", "own").alias("to"), "rid", "root", F.col("near").alias("band"), F.lit(False).alias("asks"))
    met = materialize(asks.union(holds))
    requests = met.select("rid", "to").distinct().groupBy(_block("rid")).agg(F.collect_list(F.struct(_place("rid").alias("at"), "to")).alias("asked"))

    def compare(sets: pa.Table, rows: pa.Table) -> pa.Table:
        own = {b: _widened(digest) for b, digest in zip(sets["b"].to_pylist(), sets["digest"].to_pylist())}
        askers, members = ([x for x in rows.to_pylist() if x["asks"] == side] for side in (True, False))
        links: dict[tuple[int, int], int] = {}
        if askers and members:
            local = _Crowd(members, own)
            for x in askers:
                for k in local.linked(own[x["rid"]], x["root"], x["band"], measure):
                    links.setdefault((x["rid"], members[k]["root"]), members[k]["rid"])
        return pa.table({"a": pa.array(links.values(), pa.int64()), "b": pa.array([b for b, _ in links], pa.int64())})

    sets = _sent_sets(packed, requests, measure, _narrowed)
    return materialize(sets.groupBy("block").cogroup(met.groupBy("to")).applyInArrow(compare, "a long, b long"))


def _dealt(rows: DataFrame, key: str, own: str, other: str) -> DataFrame:
    """``rows`` with a part of their ``own`` number, by a hash, once for each part of the ``other`` side."""
    return rows.withColumn("own", F.pmod(F.xxhash64(key), own)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))


class _Crowd:
    """Members of a cell, their shingles in one array."""

    def __init__(self, members: list[dict], sets: dict[int, np.ndarray]):
        own = [sets[x["rid"]] for x in members]
        self.sizes = np.array([len(s) for s in own], np.int64)
        self.tokens = np.concatenate(own)
        self.owner = np.repeat(np.arange(len(own)), self.sizes)
        self.root = np.array([x["root"] for x in members], np.int64)
        self.band = np.array([x["band"] for x in members], np.int64)

    def linked(self, theirs: np.ndarray, root: int, band: int, measure: Measure) -> np.ndarray:
        """Which members of other components are similar to a set."""
        n = len(theirs)
        may = (self.root != root) & (np.abs(self.band - band) <= 1)
        may &= 100 * np.minimum(self.sizes, n) >= measure.percent * np.maximum(self.sizes, n)
        if not may.any():
            return np.zeros(0, np.int64)
        tokens, owner = (self.tokens, self.owner) if may.all() else (self.tokens[may[self.owner]], self.owner[may[self.owner]])
        shared = np.bincount(owner[B.contains(theirs, tokens)], minlength=len(may))
        return np.flatnonzero(may & (100 * shared >= measure.percent * (self.sizes + n - shared)))


def _led(live: DataFrame, fits: str, leaders: int, turn: int) -> DataFrame:
    """Pairs ``(a, b)`` to try: for each component up to ``leaders`` members with the leaders they share most with.

    A posting list's leaders are the first members of ``leaders`` slots, in an
    order of members that changes with every turn, so a group whose members
    are similar to some of it only meets other members each time. A part of the
    lists is enough here: it only saves work later, no link depends on it.
    """
    live = live.where(_PART)
    slot = F.pmod(F.xxhash64("rid", F.lit(turn)), F.lit(leaders))
    order = F.struct(F.xxhash64(F.lit(turn), "rid").alias("h"), "root", "rid", "n", "asks")
    lead = live.groupBy("token", slot.alias("slot")).agg(F.min(order).alias("l"))
    lead = lead.select("token", F.col("l.root").alias("lead_root"), F.col("l.rid").alias("lead"), F.col("l.n").alias("m"), F.col("l.asks").alias("lead_asks"))
    seen = live.join(lead, "token").where("root <> lead_root").where(fits).groupBy("root", "rid", "lead", "asks", "lead_asks").count().where(f"{_PARTS_OF_LISTS} * count >= least(asks, lead_asks)")
    best = seen.groupBy("root", F.pmod(F.xxhash64("lead"), F.lit(leaders))).agg(F.max(F.struct("count", F.col("rid").alias("a"), F.col("lead").alias("b"))).alias("p"))
    return best.select("p.a", "p.b")


def _pairs_left(live: DataFrame) -> int:
    """Pairs of members of different components over all posting lists, estimated from a part of the lists."""
    each = live.where(_PART).groupBy("token", "root").count().groupBy("token").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("q"))
    return _PARTS_OF_LISTS * int(each.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("q")) / 2), F.lit(0))).first()[0])


def _rooted(postings: DataFrame, links: DataFrame) -> DataFrame:
    roots = _components(links).withColumnRenamed("node", "rid")
    return postings.join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid"))


def _components(links: DataFrame) -> DataFrame:
    a, b = links.columns
    nodes = links.select(F.col(a).alias("node")).union(links.select(F.col(b).alias("node")))
    return connected_components(nodes, links, "node", a, b).withColumnRenamed("component", "root")


def _verified(packed: B.Blocks, pairs: DataFrame, measure: Measure) -> DataFrame:
    """The pairs whose whole sets are similar."""

    def similar(mine: np.ndarray, theirs: bytes) -> int | None:
        return 1 if measure.similar(*_shared(mine, theirs)) else None

    return _compared(packed, pairs, measure, _narrowed, similar).select("a", "b")


def _shared(mine: np.ndarray, theirs: bytes) -> tuple[int, int, int]:
    """Shingles that a set shares with a narrowed one, and the sizes of both."""
    other = _widened(theirs)
    return int(B.contains(other, mine >> _DROPPED).sum()), len(mine), len(other)


def _possible(packed: B.Blocks, pairs: DataFrame, measure: Measure) -> DataFrame:
    """The pairs that may be similar: a hash table of counts, one byte for about each shingle, bounds what two sets share."""

    def count(tokens: np.ndarray) -> bytes:
        cells = np.bincount((tokens & np.uint64((1 << _cell_bits(len(tokens))) - 1)).astype(np.int64), minlength=1 << _cell_bits(len(tokens)))
        return np.int64(len(tokens)).tobytes() + np.minimum(cells, 255).astype(np.uint8).tobytes()

    def may(mine: np.ndarray, theirs: bytes) -> int | None:
        n, cells = int(np.frombuffer(theirs[:8], np.int64)[0]), np.frombuffer(theirs[8:], np.uint8)
        own = np.bincount((mine & np.uint64(len(cells) - 1)).astype(np.int64), minlength=len(cells))
        # A full cell stands for any count.
        return 1 if measure.similar(int(np.where(cells == 255, own, np.minimum(own, cells)).sum()), len(mine), n) else None

    return _compared(packed, pairs, measure, count, may).select("a", "b")


def _cell_bits(n: int) -> int:
    return max(3, int(n).bit_length())


#: Sets travel as the upper 48 bits of their hashes.
_DROPPED = np.uint64(16)


def _narrowed(tokens: np.ndarray) -> bytes:
    return (tokens >> _DROPPED).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _widened(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _compared(packed: B.Blocks, pairs: DataFrame, measure: Measure, digest: Callable[[np.ndarray], bytes], judge: Callable[[np.ndarray, bytes], int | None]) -> DataFrame:
    """``(a, b, value)`` of the pairs for which ``judge`` gives a value.

    The digest of ``b``'s set travels to the block of ``a``, once per block
    that needs it, and is held against the sets of that block's documents.
    """
    asked = pairs.select(_block("b"), _place("b").alias("at"), F.shiftright("a", B.PLACE_BITS).alias("to")).distinct()
    asked = asked.groupBy("block").agg(F.collect_list(F.struct("at", "to")).alias("asked"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows, others in B.each_block(batches):
            theirs = {x["b"]: x["digest"] for x in others["sets"]}
            wanted = [(x["a"] & ((1 << B.PLACE_BITS) - 1), x["b"]) for x in others["pairs"]]
            own = _sets_at(rows, sorted({p for p, _ in wanted}), measure)
            judged = [((block << B.PLACE_BITS) + p, b, v) for p, b in wanted if (v := judge(own[p], theirs[b])) is not None]
            columns = [pa.array([x[k] for x in judged], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "value"])

    sets = _sent_sets(packed, asked, measure, digest)
    here = sets.groupBy("block").agg(F.collect_list(F.struct("b", "digest")).alias("sets"))
    wanted = pairs.groupBy(_block("a")).agg(F.collect_list(F.struct("a", "b")).alias("pairs"))
    return packed.table.join(wanted.join(here, "block").hint("shuffle_hash"), "block").mapInArrow(compare, "a long, b long, value int")


def _sets_at(rows: pa.StructArray, places: list[int], measure: Measure) -> dict[int, np.ndarray]:
    return dict(zip(places, shingle_sets(B.texts_of(rows, measure.text).take(pa.array(places, pa.int32())), measure.shingle)))


def _sent_sets(packed: B.Blocks, asked: DataFrame, measure: Measure, digest: Callable[[np.ndarray], bytes]) -> DataFrame:
    """``(block, b, digest)``: the sets that ``asked`` (``block, asked array<struct<at, to>>``) wants at other blocks."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows, others in B.each_block(batches):
            digests = {p: digest(s) for p, s in _sets_at(rows, sorted({x["at"] for x in others["asked"]}), measure).items()}
            to, at = [x["to"] for x in others["asked"]], [x["at"] for x in others["asked"]]
            for i in range(0, len(at), 64):
                part = at[i : i + 64]
                yield pa.RecordBatch.from_arrays([pa.array(to[i : i + 64], pa.int64()), pa.array([(block << B.PLACE_BITS) + p for p in part], pa.int64()), pa.array([digests[p] for p in part], pa.binary())], names=["block", "b", "digest"])

    return packed.table.join(asked.hint("shuffle_hash"), "block").mapInArrow(send, "block long, b long, digest binary")


def dedup_near(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 75) -> DataFrame:
    """One row of each component, the first one of its smallest key; rows without shingles all stay. The columns are those of ``docs``.

    Repeated rows are copies like any other, and so are copies without a key.
    A column of ``docs`` named as a result of ``ngram_join`` keeps its values.
    """
    results = {"n_shingles": "__n_shingles", "component_id": "__component_id", "__first": "__was_first"}
    aside = {c: results[c] for c in docs.columns if c in results}
    joined = _labelled(docs.withColumnsRenamed(aside), key, text, shingle, percent)
    kept = joined.where((F.col("n_shingles") == 0) | F.col("__first"))
    return kept.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])
