"""Ranges must give what a plain global order gives."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ludometry.operators import ordering
from ludometry.session import materialize


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value."""
    rng = random.Random(3)
    rows = [(i, 7.0 if i % 3 == 0 else round(rng.paretovariate(1.2), 2)) for i in range(5000)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k long, v double").repartition(7)


def test_running_totals(skewed):
    rows, df = skewed
    out = ordering.running_totals(df, ["v", "k"], {"rn": F.lit(1), "s": "k"}, most=64)
    got = sorted((r["v"], r["k"], r["rn"], r["s"]) for r in out.collect())
    total = 0
    for i, ((v, k, rn, s), (wk, wv)) in enumerate(zip(got, sorted(rows, key=lambda r: (r[1], r[0])))):
        assert (v, k, rn, s) == (wv, wk, i, total)
        total += wk


def test_no_window_sees_more_rows_than_it_may(skewed, monkeypatch):
    """Blocks are of bounded size, and so are the tables of their offsets, however many there are."""
    _, df = skewed
    sizes = []
    before = ordering._offsets

    def watched(totals, names, most):
        sizes.append(totals.count())
        return before(totals, names, most)

    monkeypatch.setattr(ordering, "_offsets", watched)
    out = ordering.running_totals(df, ["v", "k"], {"rn": F.lit(1)}, most=5)
    assert sizes == [1000, 200, 40, 8, 2]
    ranks = [r["rn"] for r in out.orderBy("v", "k").collect()]
    assert ranks == list(range(5000))


def test_narrowing_ends_in_small_ranges(spark):
    """Positions among many rows, with a bound that takes several rounds, and weights."""
    df = materialize(spark.range(20_000).select(F.col("id").alias("v"), (F.col("id") % 3).alias("w")))
    at = ordering.rows_at(df, ["v"], [0, 1, 7777, 19_999], most=3)
    assert at == {0: (0,), 1: (1,), 7777: (7777,), 19_999: (19_999,)}
    copies = [i for i in range(20_000) for _ in range(i % 3)]
    spots = [0, 5, 9000, len(copies) - 1]
    assert ordering.rows_at(df.where("w > 0"), ["v"], spots, weight="w", most=3) == {p: (copies[p],) for p in spots}


@pytest.mark.parametrize("probs", [[0.5], [0.0, 0.2, 0.8, 0.97, 1.0]])
def test_exact_quantiles(skewed, probs):
    rows, df = skewed
    got = ordering.exact_quantiles(df, "v", probs, most=50)
    assert np.allclose(got, np.percentile([v for _, v in rows], [100 * p for p in probs]), rtol=1e-12)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([(None,)], "v double")
    assert ordering.exact_quantiles(empty, "v", [0.5]) == [None]


def test_rank_scores_split_ties_by_key(skewed):
    rows, df = skewed
    cuts = ordering.rank_cuts(materialize(df), "v", "k", 5, most=50)
    got = {r["k"]: r["s"] for r in df.select("k", ordering.rank_score("v", "k", cuts).alias("s")).collect()}
    n = len(rows)
    for i, (k, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0]))):
        assert got[k] == 1 + sum(5 * i > (n - 1) * j for j in range(1, 5))


def test_rank_quantiles_are_not_ntile(spark):
    """Twelve rows split 3,2,2,2,3."""
    df = spark.createDataFrame([(i, float(i)) for i in range(12)], "k long, v double")
    cuts = ordering.rank_cuts(materialize(df), "v", "k")
    sizes = df.groupBy(ordering.rank_score("v", "k", cuts).alias("s")).count().orderBy("s").collect()
    assert [r["count"] for r in sizes] == [3, 2, 2, 2, 3]


def test_string_keys(spark):
    df = spark.createDataFrame([(f"P{i:04d}", float(i % 3)) for i in range(500)], "k string, v double")
    a = ordering.rank_cuts(materialize(df), "v", "k", most=50)
    assert a == ordering.rank_cuts(materialize(df), "v", "k")


def test_share_of_total_and_top_k(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3)], "k string, v int")
    assert {r["k"]: r["share"] for r in ordering.share_of_total(df, "v").collect()} == {"a": 25.0, "b": 75.0}
    assert [r["k"] for r in ordering.top_k(df, "v", 1, ["k"]).collect()] == ["b"]


def test_sample_is_stable_across_partitionings(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    one = {r["k"] for r in ordering.sample_n(df.coalesce(1), 50, "k").collect()}
    many = {r["k"] for r in ordering.sample_n(df.repartition(8), 50, "k").collect()}
    assert one == many and len(one) == 50
