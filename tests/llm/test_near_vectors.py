"""Near duplicates among vectors against brute force."""

import numpy as np
import pytest

from ludometry.llm import near_vectors as nv
from ludometry.llm.near_vectors import near_vectors
from ludometry.operators import places

SCHEMA = "vec_id long, embedding array<double>, n_links string, component_id string, ball string"


def brute(rows, threshold=0.9):
    """``vec_id, n_links, component_id`` of each row; rows that cannot be compared link with nothing."""
    width = max((len(v) for _, v in rows if v), default=0)
    live = [i for i, (k, v) in enumerate(rows) if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.zeros((len(live), width))
    for at, i in enumerate(live):
        x[at, : len(rows[i][1])] = np.array(rows[i][1]) / np.abs(rows[i][1]).max()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= threshold
    np.fill_diagonal(linked, False)
    root = np.array([rows[i][0] for i in live], dtype=object)
    while True:
        nxt = np.array([min([root[a], *root[linked[a]]]) for a in range(len(live))], dtype=object)
        if (nxt == root).all():
            break
        root = nxt
    out = [(k, 0, k) for k, _ in rows]
    for at, i in enumerate(live):
        out[i] = (rows[i][0], int(linked[at].sum()), int(root[at]))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(k, v, "clash", "clash", "clash") for k, v in rows], SCHEMA)
    got = near_vectors(df, **kw).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str)


def around(rng, centre, n, noise):
    return centre + noise * rng.standard_normal((n, len(centre))) / np.sqrt(len(centre))


def clusters(rng, d=24):
    """Copies, a tight crowd, loose crowds with pairs on both sides of the threshold, a chain, and single vectors."""
    parts = [np.repeat(rng.standard_normal((1, d)), 40, axis=0), rng.standard_normal((60, d))]
    for n, noise in ((150, 0.05), (80, 0.3), (40, 0.35), (12, 0.2)):
        centre = rng.standard_normal(d)
        parts.append(around(rng, centre / np.linalg.norm(centre), n, noise))
    a, b = np.linalg.qr(rng.standard_normal((d, 2)))[0].T
    turn = np.arange(0, 2.5, 0.2)[:, None]
    parts.append(np.cos(turn) * a + np.sin(turn) * b)
    x = np.concatenate(parts) * rng.uniform(0.1, 10, (sum(map(len, parts)), 1))
    return x[rng.permutation(len(x))]


def test_against_brute_force(spark):
    """One block holds all, so nothing may be missed: counts by ball, by member and by comparison must all agree."""
    x = clusters(np.random.default_rng(5))
    rows = [(int(k), v.tolist()) for k, v in zip(np.random.default_rng(6).permutation(10 * len(x))[: len(x)], x)]
    want = brute(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, threshold=0.97) == brute(rows, 0.97)


def test_small_blocks_and_hot_balls(spark, monkeypatch):
    """Many passes over small blocks, balls that send delegates only, pieces and broadcast balls."""
    monkeypatch.setattr(nv, "BLOCK", 64)
    monkeypatch.setattr(nv, "WINDOW", 16)
    monkeypatch.setattr(nv, "DELEGATES", 8)
    monkeypatch.setattr(nv, "_PIECE", 16)
    monkeypatch.setattr(places, "FEW", 10)
    monkeypatch.setattr(places, "HOT", 10)
    x = clusters(np.random.default_rng(7))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got, want = run(spark, rows, recall=0.9999), brute(rows)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want)
    assert np.mean([g[2] == w[2] for g, w in zip(got, want)]) >= 0.98


def test_recall_at_the_threshold(spark, monkeypatch):
    """Pairs just above the threshold among many other vectors, in blocks far smaller than the table."""
    monkeypatch.setattr(nv, "BLOCK", 128)
    monkeypatch.setattr(nv, "WINDOW", 16)
    rng = np.random.default_rng(8)
    a = rng.standard_normal((1500, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal(a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.901 * a + np.sqrt(1 - 0.901**2) * side
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([a, b]))]
    got, want = run(spark, rows), brute(rows)
    links = sum(g[1] for g in got) / sum(w[1] for w in want)
    assert links >= 0.97 and all(g[1] <= w[1] for g, w in zip(got, want))


EDGE = [
    (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
    (None, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [2e-300, 0.0]), (9, [3e300, 1e299, 0.0]), (10, [-1.0, 0.0]), (11, [1.0]), (-12, [0.0, 5.0]),
]


@pytest.mark.parametrize("rows", [EDGE, EDGE[:6], EDGE[7:8], []], ids=["all", "unusable", "one", "none"])
def test_edge_rows(spark, rows):
    """Unusable rows, no id, one id twice, tiny and huge components, short vectors."""
    assert run(spark, rows) == brute(rows)


def test_wide_vectors(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((30, 700))
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([x, x + 0.1 * rng.standard_normal(x.shape)]))]
    assert run(spark, rows) == brute(rows)


def test_a_diffuse_crowd_of_many_blocks_is_compared_whole(spark, monkeypatch):
    """Vectors of one bucket are compared with each other, however many blocks they fill and windows they exceed."""
    monkeypatch.setattr(nv, "BLOCK", 64)
    monkeypatch.setattr(nv, "WINDOW", 4)
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(16)
    x = np.concatenate([around(rng, centre / np.linalg.norm(centre), 700, 0.3), rng.standard_normal((40, 16))])
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)]
    got, want = run(spark, rows), brute(rows)
    missed = sum(w[1] for w in want) - sum(g[1] for g in got)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert 0 <= missed <= 0.01 * sum(w[1] for w in want)
