"""Registered queries of the subpackage against their SQL, and the pipeline's contract."""

import os

import duckdb
import pytest

import corpus_pipeline
from ludometry.llm.mixing import mix_sources
from ludometry.llm.mixing_queries import WEIGHTS
from ludometry.llm.piece_queries import MODEL
from ludometry.llm.pieces import decode_pieces
from ludometry.llm.queries import ORACLES, QUERIES
from test_dedup import brute_bytes, brute_join

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    got = sorted(map(str, (tuple(r[c] for c in sorted(columns)) for r in df.collect())))
    want = sorted(map(str, (tuple(r[columns.index(c)] for c in sorted(columns)) for r in result.fetchall())))
    assert got == want


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_against_brute_force(spark):
    """Every stage from what the one before kept: which rows stay, and which texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "repeats", "mix", "pieces"]

    def step(name, before):
        after = corpus_pipeline.materialize(stages[name](spark, before, SF))
        assert name == "pieces" or after.columns == columns
        return after, {r.doc_id: r for r in after.collect()}

    rows = {r.doc_id: r for r in docs.collect()}
    docs, good = step("quality", docs)
    scores = {r.doc_id: r.score for r in QUERIES["op10_quality_classifier"](spark, SF).collect()}
    assert good == {k: r for k, r in rows.items() if scores[k] >= 0.7} and 0 < len(good) < len(rows)

    docs, single = step("near_duplicates", docs)
    joined = brute_join([(k, r.text) for k, r in good.items()])
    assert set(single) == {k for k, n, c in joined if not n or k == c} and len(single) < len(good)
    assert all(single[k] == good[k] for k in single)

    docs, cut = step("repeats", docs)
    kept = brute_bytes([single[k].text for k in sorted(single)], 100)
    want = {k: b.decode("utf-8", "ignore") for k, (_, _, _, b) in zip(sorted(single), kept)}
    assert {k: r.text for k, r in cut.items()} == want and all(r.n_chars == len(r.text) for r in cut.values())
    assert {k: (r.lang, r.source) for k, r in cut.items()} == {k: (r.lang, r.source) for k, r in single.items()}

    packed = list(corpus_pipeline._spent)
    assert packed and all(spark.catalog.tableExists(t) for t in packed)
    docs, mixed = step("mix", docs)
    assert not corpus_pipeline._spent and not any(spark.catalog.tableExists(t) for t in packed)
    assert mixed == cut
    position = {r.doc_id: r.position for r in mix_sources(spark.createDataFrame(list(cut.values())), WEIGHTS).collect()}
    written = [r.doc_id for r in docs.coalesce(1).collect()]
    assert written == sorted(written, key=position.get)

    docs, encoded = step("pieces", docs)
    assert set(encoded) == set(mixed) and [r.doc_id for r in docs.coalesce(1).collect()] == written
    decoded = {r.doc_id: r.decoded for r in decode_pieces(docs, MODEL).collect()}
    assert decoded == want and all(r.n_pieces == len(r.pieces) for r in encoded.values())


def test_pieces_state_the_mix_of_several_files(spark, tmp_path):
    """Part files of unequal size come back in another order; the places in the mix do not depend on it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()
    for k, (a, b) in enumerate([(0, 3), (3, 10), (10, 30), (30, 60)]):
        spark.createDataFrame(docs[a:b]).coalesce(1).write.mode("append").parquet(str(tmp_path / f"docs/part={k}"))
    read = spark.read.parquet(str(tmp_path / "docs")).drop("part")
    want = {r.doc_id: (r.slot, r.position) for r in mix_sources(spark.createDataFrame(docs), WEIGHTS).collect()}
    got = dict(corpus_pipeline.STAGES)["pieces"](spark, read, SF).collect()
    assert len(got) == 60 and {r.doc_id: (r.slot, r.position) for r in got} == want
