"""Fingerprints, search, mixing, pieces and quality against brute force, the public library or held-out labels."""

import hashlib
import os
import re
import struct
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from ludometry.llm import quality as quality_module
from ludometry.llm.fingerprints import K, MAX_TOKEN, W, fingerprint_edits
from ludometry.llm.mixing import in_mixed_order, mix_sources, period
from ludometry.llm.piece_queries import MODEL
from ludometry.llm.pieces import PieceModel, decode_pieces, encode_pieces, encode_texts, skipped
from ludometry.llm.quality import keep_quality, score_quality, train_quality
from ludometry.llm.queries import QUERIES
from ludometry.llm.topk_search import top_k

SF = "/root/testdata/sf0.001"


def signed(h):
    return struct.unpack("<q", struct.pack("<Q", h))[0]


def chained(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64(struct.pack("<q", v), seed=seed).intdigest()
    return signed(seed)


def brute_winnow(text):
    tokens = [signed(xxhash.xxh64(t.encode(), seed=42).intdigest()) for t in re.findall(rf"[^ \t-\r]{{1,{MAX_TOKEN}}}", text)]
    if not tokens:
        return []
    if len(tokens) < K:
        h = 0
        for t in tokens:
            h = chained([h, t])
        grams = [h]
    else:
        grams = [chained(tokens[i : i + K]) for i in range(len(tokens) - K + 1)]
    grams = [g & (2**31 - 1) for g in grams]
    picked = []
    for i in range(max(1, len(grams) - W + 1)):
        window = grams[i : i + W]
        at = max(j for j, g in enumerate(window) if g == min(window)) + i
        if not picked or picked[-1][1] != at:
            picked.append((grams[at], at))
    return picked


def brute_edits(rows):
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0], r[1]))
    out = []
    for i, (k, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        n = len(t) // 4
        edited = t[: len(t) - n] + nxt[:n]
        a, b, c = ({h for h, _ in brute_winnow(x)} for x in (t, edited, nxt))
        near = [len(a & x) / len(a | x) if a | x else 1.0 for x in (b, c)]
        spelled = [" ".join(f"{h:X}@{p}" for h, p in brute_winnow(x)) for x in (t, edited)]
        out.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), *spelled, *near))
    return out


def test_fingerprints_of_documents(spark, texts):
    got = sorted(map(tuple, QUERIES["op5_document_fingerprints"](spark, SF).collect()))
    assert got == sorted(brute_edits(texts))


def test_fingerprints_of_edge_texts(edge, nothing):
    rows = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    got = fingerprint_edits(edge).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_edits(rows), key=str)
    assert fingerprint_edits(nothing).count() == 0
    one = fingerprint_edits(edge.where("doc_id = 8")).first()
    assert one.near_next == 1.0


def test_top_k_ties_and_odd_vectors(spark):
    rows = [(0, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 0.0]), (6, [float("inf"), 0.0]), (7, []), (8, [-0.0001, 3.0]), (None, [1.0, 1.0]), (10, [1e6, -1e6])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for sizes in ({}, {"group_rows": 2, "block_queries": 1}):
        got = top_k(vectors, F.col("vec_id") % 2 == 0, k=3, **sizes).collect()
        by_query = {}
        for r in sorted(got, key=lambda r: r["rank"]):
            by_query.setdefault(r.query_id, []).append((r.vec_id, r.score))
        exact = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
        for q in (0, 2, 8, 10):
            scores = sorted((-sum(a * b for a, b in zip(exact[q], exact[c])), c) for c in exact if c != q)
            assert by_query[q] == [(c, -s) for s, c in scores[:3]]
        assert set(by_query) == {0, 2, 8, 10}
    assert top_k(vectors.limit(0), F.lit(True)).count() == 0


def test_schedule_stays_within_one_block():
    for weights in ({"a": 1}, {"a": 3, "b": 2, "c": 2}, {"a": 50, **{f"s{i}": 1 for i in range(50)}}, {"x": 7, "y": 11, "z": 1}):
        turns = period(weights)
        total, counts = sum(weights.values()), Counter()
        assert [t.slot for t in turns] == list(range(total))
        for t in turns:
            assert t.release <= t.slot < t.deadline
            counts[t.source] += 1
            assert all(abs(counts[s] * total - w * (t.slot + 1)) < total for s, w in weights.items())
    with pytest.raises(ValueError):
        period({"a": 0})


def test_mix_keeps_rows_and_shares(spark):
    rows = [(i, f"s{i % 3}" if i % 7 else None, *["clash"] * 6) for i in range(3000)] + [(5, "s2", *["clash"] * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, slot string, turn string, r string, d string, s string, count string")
    got = in_mixed_order(mix_sources(docs, {"s0": 2}, block_rows=10)).collect()
    assert len(got) == len(rows) and len({r.position for r in got}) == len(rows)
    assert {(r.turn, r.r, r.d, r.s, r["count"]) for r in got} == {("clash",) * 5}
    assert [r.position for r in got] == sorted(r.position for r in got)
    seen = Counter(r.source for r in got[:1000])
    assert abs(seen["s0"] - 400) <= 20 and all(abs(seen[s] - 200) <= 20 for s in ("s1", "s2", None))
    assert mix_sources(docs.limit(0), {}).count() == 0


def agenda(sp, text, keep):
    """Merge-dropout by rescanning all neighbours of one whole text."""
    pieces = list(" " + text if text else "")
    pieces = ["▁" if c == " " else c for c in pieces]
    known = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    while True:
        options = [(-known[a + b], i) for i, (a, b) in enumerate(zip(pieces, pieces[1:])) if a + b in known and keep(pieces, i)]
        if not options:
            return pieces
        at = min(options)[1]
        pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces_without_dropout_are_the_librarys(library, texts):
    model = PieceModel.load(MODEL)
    cases = [t for _, t in texts[:80]] + ["", "a", "  two  spaces ", "\t\n", "=" * 90, "日本語\n漢字 \U0001f600", "<s> <0x41>"]
    ids, counts = encode_texts(model, cases, np.zeros(len(cases), np.uint64), 0.0, 1)
    for text, own in zip(cases, np.split(ids, np.cumsum(counts)[:-1])):
        assert own.tolist() == library.encode(text), text[:40]


@pytest.mark.parametrize("text", ["internationalization", "the tokenization", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"])
def test_dropout_matches_a_rescan(library, text):
    """Each stretch against a whole rescan that asks the same keyed hash."""
    from ludometry.llm import pieces as P

    model = PieceModel.load(MODEL)
    ids, _ = encode_texts(model, [text], np.array([99], np.uint64), 0.3, 4)
    points = np.frombuffer(f" {text}".encode("utf-32-le"), np.uint32)
    symbols = model.symbols[points]
    cuts = [0, *(i + 1 for i in range(len(points) - 1) if not model.joined(symbols[i : i + 1], symbols[i + 1 : i + 2])[0]), len(points)]
    want = []
    for place, (a, b) in enumerate(zip(cuts, cuts[1:])):
        variant = P.mix(np.array([99], np.uint64) + P._BASE * np.uint64(place)) % np.uint64(4)
        key = (P._content(points[a:b], np.array([0]), np.array([b - a])) + P.mix(variant + np.uint64(1)))[0]

        def keep(pieces, i):
            start = sum(map(len, pieces[:i]))
            mid = start + len(pieces[i])
            return not skipped(np.array([key]), np.array([start]), np.array([mid]), np.array([mid + len(pieces[i + 1])]), 0.3)[0]

        stretch = "".join(map(chr, points[a:b])).replace(" ", "▁")
        known = {library.id_to_piece(i): library.get_score(i) for i in range(259, library.get_piece_size())}
        pieces = list(stretch)
        while True:
            options = [(-known[x + y], i) for i, (x, y) in enumerate(zip(pieces, pieces[1:])) if x + y in known and keep(pieces, i)]
            if not options:
                break
            at = min(options)[1]
            pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        want += [library.piece_to_id(p) for p in pieces]
    assert ids.tolist() == want


def test_pieces_round_trip_and_vary(spark, edge, nothing):
    once = encode_pieces(edge, MODEL, rate=0.2)
    back = decode_pieces(once, MODEL).collect()
    assert len(back) == 10 and all(r.decoded == r.text for r in back)
    assert [r.pieces for r in back if r.text is None] == [None]
    again = {r.text: r.pieces for r in encode_pieces(edge.repartition(3), MODEL, rate=0.2).collect()}
    assert again == {r.text: r.pieces for r in back}
    many = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("tokenization").alias("text"))
    assert len({tuple(r.pieces) for r in encode_pieces(many, MODEL, rate=0.2).collect()}) > 3
    assert encode_pieces(nothing, MODEL).count() == 0


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = pq.read_table(f"{sf}/labels.parquet")
    quality = dict(zip(labels["doc_id"].to_pylist(), labels["quality"].to_pylist()))
    rows = [r for r in QUERIES["op10_quality_classifier"](spark, sf).collect() if r.held_out and r.doc_id in quality]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert np.mean([r.predicted == quality[r.doc_id] for r in rows]) > 0.95
    good, bad = ([r.score for r in rows if quality[r.doc_id] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_quality_of_edge_texts(spark, edge, nothing):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = train_quality(docs, labels)
    scored = score_quality(edge, model).collect()
    assert len(scored) == 10 and all(0 <= r.score <= 1 for r in scored)
    assert score_quality(nothing, model).count() == 0
    odd = labels.withColumn("quality", F.lit(None).cast("int")).union(labels.limit(0))
    assert {r.score for r in score_quality(edge, train_quality(docs, odd)).collect()} == {1.0}
    assert keep_quality(edge, labels.limit(0)).count() == 10
    os.environ.setdefault("OMP_NUM_THREADS", "1")


def test_quality_encodes_the_sample_in_small_parts(spark, monkeypatch):
    """What the driver works on at once does not grow with the sample."""
    encode, seen = quality_module.encode_passages, []
    monkeypatch.setattr(quality_module, "encode_passages", lambda texts: seen.append(sum(map(len, texts.to_pylist()))) or encode(texts))
    docs = spark.range(80).selectExpr("id AS doc_id", "if(id % 2 = 0, repeat('plain words of a text. ', 500), repeat('%$ 77 #* ', 1000)) AS text")
    train_quality(docs, docs.selectExpr("doc_id", "int(doc_id % 2 = 0) AS quality"))
    assert sum(seen) > 500_000 and max(seen) < 150_000
