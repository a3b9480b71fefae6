"""Merkle manifest and spelling variants against brute force."""

import hashlib
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from ludometry.llm.merkle import fold_proof, leaf_digest, merkle_manifest
from ludometry.llm.spelling import _keys, _long_keys, spelling_variants, spelling_words
from ludometry.operators import places

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row):
    return sha(*("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS))


def brute_tree(leaves):
    """Root and the steps of each leaf."""
    nodes, steps = [(d, [i]) for i, d in enumerate(leaves)], [[] for _ in leaves]
    while len(nodes) > 1:
        nxt = []
        for k in range(0, len(nodes), 2):
            run = nodes[k : k + 2]
            if len(run) == 1:
                for i in run[0][1]:
                    steps[i].append("-")
                nxt.append((sha(run[0][0]), run[0][1]))
            else:
                (a, left), (b, right) = run
                for i in left:
                    steps[i].append("R" + b)
                for i in right:
                    steps[i].append("L" + a)
                nxt.append((sha(a, b), left + right))
        nodes = nxt
    return nodes[0][0], steps


def brute_manifest(rows):
    """Sorted ``(key, leaf, subroot, root, proof)``."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    found, tops = [], []
    for g in order:
        own = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, brute_leaf(r)))
        top, steps = brute_tree([brute_leaf(r) for r in own])
        tops.append(top)
        found.append([(r["doc_id"], brute_leaf(r), top, s) for r, s in zip(own, steps)])
    root, above = brute_tree(tops)
    return [(k, leaf, top, root, s + up) for one, up in zip(found, above) for k, leaf, top, s in one]


def rows_of(n, langs=("de", "en", "", None, "ä", "z")):
    """Null, empty and repeated fields; one language holds most rows."""
    out = []
    for i in range(n):
        lang = "en" if i % 2 else langs[i % len(langs)]
        out.append({"doc_id": None if i == 3 else i - i % 7 if i % 5 == 0 else i, "source": None if i % 11 == 0 else "src", "lang": lang, "n_chars": None if i % 13 == 0 else i, "text": None if i % 17 == 0 else "" if i % 19 == 0 else f"text ä {i}"})
    return out + out[:2]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def manifest(spark, rows, **kw):
    df = spark.createDataFrame([tuple(r[f] for f in FIELDS) for r in rows], SCHEMA)
    for clash in ("leaf", "proof", "root", "subroot", "place", "total", "digest", "tree", "block", "_key"):
        df = df.withColumn(clash, F.lit("clash"))
    return merkle_manifest(df, "doc_id", "lang", FIELDS, **kw)


def as_rows(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in df.collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 60])
@pytest.mark.parametrize("block", [2, 8, 4096])
def test_manifest_against_brute_force(spark, n, block):
    """Small blocks, so trees take several rounds and end in blocks of any size."""
    if block < 4096 and n < 60:
        pytest.skip("one block in any case")
    rows = rows_of(n)
    got = as_rows(manifest(spark, rows, block=block))
    assert got == sorted(brute_manifest(rows), key=str)


def test_manifest_of_one_group_and_of_nothing(spark):
    rows = [{**r, "lang": "en"} for r in rows_of(9)]
    df = manifest(spark, rows)
    assert as_rows(df) == sorted(brute_manifest(rows), key=str)
    assert manifest(spark, rows).schema == df.schema
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle_manifest(empty, "doc_id", "lang", FIELDS).count() == 0


def test_proofs_hold_for_their_leaf_only(spark):
    rows = rows_of(40)
    df = spark.createDataFrame([tuple(r[f] for f in FIELDS) for r in rows], SCHEMA)
    changed = leaf_digest([F.concat(F.coalesce("text", F.lit("")), F.lit("x")) if f == "text" else F.col(f) for f in FIELDS])
    out = merkle_manifest(df.withColumn("changed", changed), "doc_id", "lang", FIELDS, ["changed"])
    checks = out.select(fold_proof(F.col("leaf"), F.col("proof")).alias("a"), fold_proof(F.col("changed"), F.col("proof")).alias("b"), "root").collect()
    assert all(r.a == r.root != r.b for r in checks)


def test_many_groups_are_joined_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(places, "FEW", 0)
    rows = rows_of(30)
    assert as_rows(manifest(spark, rows)) == sorted(brute_manifest(rows), key=str)


# ── spelling ────────────────────────────────────────────────────────────────


def brute_words(docs, every=97):
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if key is None else key}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute_variants(words, ratio=2):
    out, forms = {}, {}
    for w, n in words.items():
        close = [v for v in words if near(w, v)]
        best = min(close, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= ratio * n else None
        out[w] = [n, len(close), forms[w], words[best] if forms[w] is not None else None]
    for w in words:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w].append(root)
    return {w: tuple(v) for w, v in out.items()}


def variants(spark, words):
    df = spark.createDataFrame([(w, n, "clash", "clash") for w, n in words.items()], "word string, n long, id string, root string")
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling_variants(df).collect()}


def test_variants_against_brute_force(spark):
    """Runs of equal letters, ties of counts, chains of forms, words of one letter and an empty one."""
    words = {"": 1, "a": 4, "b": 4, "ab": 9, "aab": 2, "aaab": 5, "aaaab": 40, "abab": 3, "baba": 3, "aba": 3, "color": 9, "colour": 30, "colours": 100, "culour": 1, "colur": 4, "kolur": 1, "ÿes": 3, "yes": 7, "yess": 7, "yesss": 14}
    got = variants(spark, words)
    assert got == brute_variants(words)
    assert got["kolur"][-1] == "colours"


def test_variants_of_long_words(spark):
    """Keys of long words are digests; both kinds meet where lengths differ by one."""
    base = "xyzw" * 16
    words = {}
    for i, size in enumerate((62, 63, 64)):
        words |= {base[:size]: 50 + i, base[: size - 1] + "é": 10 + i, "q" + base[1:size]: 3, base[:30] + base[31:size]: 5}
    words |= {base * 20: 7, (base * 20)[:-1]: 30, "e" * 3000: 3, "e" * 3001: 8}
    assert variants(spark, words) == brute_variants(words)


def test_keys_group_alike():
    """Digest keys are equal exactly where rotations are."""
    words = ["a" * 65, "a" * 64 + "b", "a" * 66, "ab" * 33, "ba" * 33]
    plain, digests = ([k for w in words for k, _ in make(w)] for make in (_keys, _long_keys))
    assert len(set(plain)) == len(set(digests)) == len(set(zip(plain, digests)))
    assert [r for w in words for _, r in _keys(w)] == [r for w in words for _, r in _long_keys(w)]


def test_words_of_texts(spark, edge, nothing, texts):
    def got(df, **kw):
        return {r.word: r.n for r in spelling_words(df, **kw).collect()}

    docs = [(r.doc_id, r.text) for r in edge.collect()]
    assert got(edge) == brute_words(docs) and got(nothing) == {}
    assert got(edge, edit_every=3) == brute_words(docs, 3)
    sample = texts[:80] + [(10**6, "Größe " * 400_000), (None, "Größe größe GRÖßE \udcff".encode("utf-8", "replace").decode())]
    df = spark.createDataFrame(sample, "doc_id long, text string")
    assert got(df) == brute_words(sample)
    words = brute_words(sample)
    assert variants(spark, words) == brute_variants(words)
    assert spelling_variants(spelling_words(nothing)).count() == 0
