"""Substring dedup, suffix dedup and the Jaccard join against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ludometry.llm import blocks
from ludometry.llm import ngram_join as ngram_join_module
from ludometry.llm.ngram_join import Measure, choose_prefix, dedup_near, ngram_join
from ludometry.llm.queries import QUERIES
from ludometry.llm.run_index import build_index, earliest
from ludometry.llm.substring_dedup import COVER, PERIOD, dedup_windows
from ludometry.llm.suffix_dedup import dedup_bytes

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^ \t-\r]+", text or "")


def brute_windows(texts, window):
    places = {}
    split = [words(t) for t in texts]
    for d, w in enumerate(split):
        for i in range(len(w) - window + 1):
            places.setdefault(tuple(w[i : i + window]), []).append((d, i))
    gone = [set() for _ in split]
    for found in places.values():
        if len(found) > 1:
            for d, i in found:
                gone[d].update(range(i, i + window))
    return [(len(w), len(g), " ".join(x for i, x in enumerate(w) if i not in g)) for w, g in zip(split, gone)]


def brute_bytes(texts, least):
    """Of ``(key, text)`` in order: bytes, removed bytes, spans, what is kept."""
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if b[i : i + least] in seen:
                gone[i : i + least] = b"\1" * least
            else:
                seen.add(b[i : i + least])
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return out


def brute_join(rows, percent=75):
    sets = []
    for _, t in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            same = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if same or (shared and 100 * shared >= percent * (len(a) + len(sets[j]) - shared)):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [(k, len(s), least.get(find(i))) for i, ((k, _), s) in enumerate(zip(rows, sets))]


def test_cover_meets_every_shift():
    for d in range(PERIOD):
        assert any((a - b) % PERIOD == d for a in COVER for b in COVER)


def test_windows_of_edge_texts(edge, nothing):
    rows = edge.select("doc_id", "text").collect()
    want = sorted(brute_windows([r.text for r in rows], 35), key=str)
    out = dedup_windows(edge)
    assert sorted(((r.n_words, r.n_removed, r.kept) for r in out.collect()), key=str) == want
    assert "host" in out.columns and dedup_windows(nothing).count() == 0


def test_bytes_of_documents(spark, texts):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op8_suffix_array_dedup"](spark, SF).collect()}
    want = brute_bytes([t for _, t in texts], 100)
    assert got == {k: (n, g, s, hashlib.sha256(kept).hexdigest()) for (k, _), (n, g, s, kept) in zip(texts, want)}


def test_bytes_of_edge_texts(edge, nothing):
    rows = edge.select("doc_id", "text").collect()
    want = sorted(brute_bytes([r.text for r in rows], 100))
    got = dedup_bytes(edge).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want
    assert dedup_bytes(nothing).count() == 0
    cut = dedup_bytes(edge, as_text=True).where("doc_id = 7").first()
    assert cut.kept == cut.text


@pytest.mark.parametrize("hot_blocks", [2, 1024])
def test_bytes_with_hot_anchors(spark, hot_blocks):
    """A passage in every document, its windows split off or indexed: the same bytes go."""
    rng = random.Random(1)
    passage = " ".join(rng.choices(["ab", "cde", "fghi", "jklmn"], k=60))
    rows = [(i, "".join(rng.choices("abcdefgh ", k=90)) + passage[rng.randrange(9) :] + "".join(rng.choices("abcdefgh ", k=50))) for i in range(60)]
    got = dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), hot_blocks=hot_blocks).collect()
    want = brute_bytes([t for _, t in rows], 100)
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sorted(got)] == want


def test_run_index_finds_first_places():
    rng = np.random.default_rng(5)
    for _ in range(40):
        base = rng.integers(97, 100, 60).astype(np.uint8)
        parts = [base[a : b + 1].copy() for a, b in (sorted(rng.integers(0, 60, 2)) for _ in range(rng.integers(1, 9)))]
        parts = [np.concatenate([p, p]) if rng.random() < 0.5 else p for p in parts]
        index = build_index(np.concatenate(parts), np.cumsum([len(p) for p in parts]))
        got = earliest(index, 5)
        place, seen = 0, {}
        for p in parts:
            for i in range(len(p) + 1):
                assert got[place] == (seen.setdefault(p[i : i + 5].tobytes(), place) if i + 5 <= len(p) else place)
                place += 1
        assert index.lengths.sum() == index.size


@pytest.mark.parametrize("copies", [12, 60])
def test_near_copies(spark, copies):
    """Chains and hubs of near copies around the threshold, with a passage that all documents share."""
    rng = random.Random(copies)
    vocabulary = [f"w{i}" for i in range(5000)]
    passage = rng.choices(vocabulary, k=30)
    rows = []
    for base in range(4):
        body = rng.choices(vocabulary, k=80)
        for _ in range(copies):
            text = list(body)
            for at in rng.sample(range(80), rng.choice([0, 1, 1, 2, 3])):
                text[at] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(text + (passage if base % 2 else []))))
            if rng.random() < 0.3:
                body = text
    rng.shuffle(rows)
    got = ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_join(rows))


@pytest.mark.parametrize("most", [1 << 20, 500])
def test_crowd_over_many_blocks(spark, monkeypatch, most):
    """All links of a crowd, in cells of one part and of several; sets travel once per cell, not once per block."""
    rng = random.Random(3)
    body, rows = [f"w{i}" for i in range(60)], []
    for i in range(48):
        text = list(body)
        for at in rng.sample(range(60), i % 4):
            text[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    packed = blocks.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(24))
    found = packed.table.select("block", F.posexplode("rows").alias("at", "row")).select(((F.col("block") * (1 << blocks.PLACE_BITS)) + F.col("at")).alias("rid"), "row.text").collect()
    sets = {r.rid: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for r in found for w in [words(r.text)]}
    crowd = [(min(sets), rid, rid, len(s)) for rid, s in sets.items()]
    sent, send = [], ngram_join_module._sent_sets

    def counted(packed, asked, *rest):
        sent.append(asked.select(F.sum(F.size("asked"))).first()[0])
        return send(packed, asked, *rest)

    monkeypatch.setattr(ngram_join_module, "_sent_sets", counted)
    monkeypatch.setattr(ngram_join_module, "_PART_SHINGLES", most, raising=False)
    links = ngram_join_module._hub_links(packed, spark.createDataFrame(crowd, "hub long, rid long, root long, n long"), Measure()).collect()
    similar = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert len(similar) > 100 and {tuple(sorted(x)) for x in links} == similar
    assert packed.table.count() > 20 and (most < 1000 or sent[-1] <= 8 * len(sets))


def test_join_of_edge_texts(edge, nothing):
    rows = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    got = ngram_join(edge).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_join(rows), key=str)
    assert ngram_join(nothing).count() == 0
    assert dedup_near(edge.where("doc_id = 7")).count() == 1


def test_prefix_grows_with_candidate_cost():
    tokens = np.arange(100, dtype=np.uint64)
    quiet = choose_prefix(tokens, np.zeros(100), Measure())
    busy = choose_prefix(tokens, np.full(100, 500.0), Measure())
    assert len(quiet[0]) == 25 + quiet[1] and len(busy[0]) == 25 + busy[1]
    assert busy[1] > quiet[1]


def test_driver_gets_only_cells_above_the_noise(spark):
    """Of four million cells those of a repeated passage; the others count as before, as nothing."""
    own = " ".join(f"w{k}" for k in range(30))
    docs = spark.range(60).selectExpr("id AS doc_id", f"concat('{own} ', array_join(transform(sequence(1, 40), k -> concat('v', id, '_', k)), ' ')) AS text")
    measure = Measure()
    sketch = ngram_join_module._sketch(ngram_join_module._profile(blocks.pack(docs), measure))
    sets = [ngram_join_module.shingle_sets(pa.array([r.text]), measure.shingle)[0] for r in docs.collect()]
    whole = np.bincount(np.concatenate(sets) >> np.uint64(42), minlength=1 << 22)
    mean = whole.sum() / (1 << 22)
    loud = whole > mean + 4 * np.sqrt(mean) + 1
    assert sketch.mean == mean and 26 <= len(sketch.at) == loud.sum() < 40
    assert (sketch.cells == np.where(loud, whole, 0)).all()
    nothing = ngram_join_module._sketch(ngram_join_module._profile(blocks.pack(docs.limit(0)), measure))
    assert nothing.mean == 0 and not nothing.cells.any()


def test_copies_of_a_block_are_sent_once():
    """The first copy in key order travels; the others are merged runs, also when windows are split off."""
    import pyarrow as pa

    from ludometry.llm import suffix_dedup as S

    text = "".join(random.Random(5).choices("abcdefghijklmnopqrstuvwxyz", k=400))
    found = S.segments_of(pa.array([text] * 50), 100)
    keys = np.arange(50)[::-1].copy()
    for some in (found, S._split(found, np.unique(found.anchor), 100)):
        sent = S._sent(3, some, keys, 100, 8).to_pydict()
        places = np.concatenate([np.frombuffer(x, np.int64) for x in sent["place"]])
        assert set(places) == {49} and len(places) == (some.doc == 49).sum()
        done = [np.concatenate([np.frombuffer(x, np.int64) for x in sent[n]]) for n in ("done_place", "done_start", "done_end")]
        assert list(zip(*map(list, done))) == [(d, 0, 301) for d in range(49)]


def test_anchors_fill_buckets_evenly():
    """An anchor is a minimum of hashes, yet no bucket holds much more than its share."""
    import pyarrow as pa

    from ludometry.llm import blocks as B
    from ludometry.llm.suffix_dedup import segments_of

    text = "".join(random.Random(6).choices("abcdefghijklmnopqrstuvwxyz", k=100_000))
    held = np.bincount(B.bucket_of(segments_of(pa.array([text]), 100).anchor, 100), minlength=100)
    assert held.max() < 3 * held.mean()


def test_one_row_of_each_group_stays(spark):
    """Repeated rows, copies without a key, texts without words, and columns named as results."""
    text, other = ("one two three four five six seven eight nine " * 3, "another text of quite different words here and there")
    rows = [(2, text), (1, text), (1, text), (None, other), (None, other), (None, None), (None, None), (5, ""), (6, text + "ten")]
    docs = spark.createDataFrame([(k, t, "clash", "clash") for k, t in rows], "doc_id long, text string, n_shingles string, component_id string")
    got = dedup_near(docs)
    assert got.columns == docs.columns
    found = sorted(map(str, ((r.doc_id, r.text, r.n_shingles, r.component_id) for r in got.collect())))
    want = [(1, text), (None, other), (None, None), (None, None), (5, "")]
    assert found == sorted(str((k, t, "clash", "clash")) for k, t in want)
    assert dedup_near(docs.limit(0)).count() == 0
