"""Semantics that are easy to get wrong."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ludometry.functions.scalar import cut, days_since, flag_eq, flag_in, safe_ratio
from ludometry.operators import experiments, features, funnel, liveops, ltv, segments
from ludometry.sources import schemas, views

OBS = "2025-01-15"


def _txns(spark, rows):
    rows = [(f"T{i}", p, dt.date.fromisoformat(d), "item", "cat", float(v)) for i, (p, d, v) in enumerate(rows)]
    return spark.createDataFrame(
        rows,
        "transaction_id string, player_id string, transaction_date date, item_name string, item_category string, price_usd double",
    )


def test_value_quantiles_equal_pandas(spark):
    """T1: interpolated, right-closed, lowest included."""
    rng = np.random.default_rng(0)
    days = rng.permutation(1000)[:237].tolist()
    table = spark.createDataFrame([(i, int(d), 1, 1.0) for i, d in enumerate(days)], "player_id long, recency int, frequency long, monetary double")
    got = {r["player_id"]: r["recency_score"] for r in features.rfm_scores(table).collect()}
    want = pd.qcut(pd.Series(days), 5, labels=[5, 4, 3, 2, 1]).astype(int)
    assert [got[i] for i in range(len(days))] == want.tolist()


def test_rank_quantiles_equal_pandas(spark):
    """T2: first-occurrence ranks, ties split in key order."""
    rng = np.random.default_rng(1)
    freq = rng.integers(1, 5, 123).tolist()
    table = spark.createDataFrame([(i, 0, f, float(f)) for i, f in enumerate(freq)], "player_id long, recency int, frequency long, monetary double")
    got = {r["player_id"]: r["frequency_score"] for r in features.rfm_scores(table).collect()}
    want = pd.qcut(pd.Series(freq).rank(method="first"), 5, labels=[1, 2, 3, 4, 5]).astype(int)
    assert [got[i] for i in range(len(freq))] == want.tolist()


def test_tied_recency_edges_collapse(spark):
    """T1: equal edges give fewer scores, not an error."""
    table = spark.createDataFrame([(i, 3, i, float(i)) for i in range(10)], "player_id long, recency int, frequency long, monetary double")
    assert {r["recency_score"] for r in features.rfm_scores(table).collect()} == {5}


def test_zero_fill_is_numeric_only(spark):
    """T3: dates and unmatched names stay NULL."""
    df = spark.createDataFrame(
        [("a", None, None, None, None)],
        "player_id string, recency int, spend_x double, last_purchase_date date, unique_categories int",
    )
    row = features.fill_by_pattern(df).first()
    assert (row["recency"], row["spend_x"]) == (0, 0.0)
    assert row["last_purchase_date"] is None and row["unique_categories"] is None


def test_day_zero_buyers(spark):
    """T4: the lowest edge is open unless asked otherwise."""
    df = spark.createDataFrame([(0,), (1,), (365,), (366,), (None,)], "d int")
    total = lambda closed: sum(
        r["n"]
        for r in funnel.bucket_distribution(df, "d", funnel.CONVERT_BINS, funnel.CONVERT_LABELS, closed).collect()
        if r["bucket"] != "unbinned"
    )
    assert total(False) == 3 and total(True) == 4


def test_empty_bands_are_listed(spark):
    from ludometry.operators.churn import risk_bands, with_risk

    df = spark.createDataFrame([(0.0,), (0.1,), (0.3,), (0.9,)], "churn_probability double")
    got = [(r["bucket"], r["n"]) for r in risk_bands(df).orderBy("bucket_no").collect()]
    assert got == [("Low", 2), ("Medium", 0), ("High", 0), ("Critical", 1), ("unbinned", 1)]
    assert [r["churn_risk"] for r in with_risk(df).collect()] == [None, "Low", "Low", "Critical"]


def test_funnel_is_not_nested(spark):
    """T5: a later stage may be larger than the one before."""
    df = spark.createDataFrame([(1, 0), (0, 1), (0, 1)], "a int, b int")
    rows = funnel.funnel(df, {"all": F.lit(True), "a": F.col("a") == 1, "b": F.col("b") == 1}).orderBy("stage_no").collect()
    assert rows[2]["pct_of_previous"] == 200.0 and rows[2]["dropoff_rate"] == -100.0


def test_empty_stage_restarts_percentages(spark):
    df = spark.createDataFrame([(1,)], "a int")
    rows = funnel.funnel(df, {"all": F.lit(True), "none": F.col("a") == 2, "again": F.col("a") == 1}).orderBy("stage_no").collect()
    assert rows[2]["pct_of_previous"] == 100.0 and rows[2]["dropoff_rate"] == 0.0


def test_horizon_has_no_lower_bound(spark):
    """T6: purchases dated before the install count; day N is inside."""
    players = spark.createDataFrame([("a", dt.date(2024, 1, 10), 1), ("b", dt.date(2024, 1, 10), 1)], "player_id string, install_date date, is_payer int")
    txns = _txns(spark, [("a", "2024-01-05", 1), ("a", "2024-01-17", 2), ("a", "2024-01-18", 4)])
    got = {r["player_id"]: (r["ltv_7d"], r["ltv_30d"]) for r in ltv.horizon_ltv(txns, players).collect()}
    assert got == {"a": (3.0, 7.0), "b": (0.0, 0.0)}


def test_purchases_after_the_observation_date(spark):
    """T7: negative recency in RFM, cut off in the CLV summary."""
    txns = _txns(spark, [("a", "2025-01-01", 5), ("a", "2025-01-10", 7), ("a", "2025-02-01", 9)])
    assert features.rfm(txns, OBS).first()["recency"] == -17
    row = ltv.clv_summary(txns, OBS).first()
    assert (row["frequency"], row["recency"], row["T"], row["monetary"]) == (1, 9, 14, 7.0)


def test_t_test_flavours(spark):
    """T8: pooled by default; the reported SE is unpooled either way."""
    rng = np.random.default_rng(5)
    a, b = rng.normal(0, 1, 40), rng.normal(0.4, 3, 90)
    df = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b], "arm string, y double")
    pooled, welch = (experiments.t_test(df, "arm", "a", "b", "y", equal_var=e).first() for e in (True, False))
    se = np.sqrt(a.var(ddof=1) / 40 + b.var(ddof=1) / 90)
    sp = np.sqrt((39 * a.var(ddof=1) + 89 * b.var(ddof=1)) / 128)
    assert pooled["se"] == welch["se"] == pytest.approx(se)
    assert pooled["t_stat"] == pytest.approx((a.mean() - b.mean()) / (sp * np.sqrt(1 / 40 + 1 / 90)))
    assert welch["t_stat"] == pytest.approx((a.mean() - b.mean()) / se)
    assert pooled["dof"] == 128 and welch["dof"] < 128


def test_no_variance_means_no_statistic(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 1.0)], "arm string, y double")
    row = experiments.t_test(df, "arm", "a", "b", "y").first()
    assert row["t_stat"] is None and row["p_value"] is None


def test_cuped_matches_row_level_computation(spark):
    """T9: theta = sample covariance ÷ population variance; correlated data reduce variance."""
    rng = np.random.default_rng(42)
    n = 4000
    pre = rng.poisson(5, n).astype(float)
    arm = rng.integers(0, 2, n)
    y = 0.5 + 0.3 * pre + rng.exponential(0.5, n) + 0.08 * arm
    df = spark.createDataFrame(pd.DataFrame({"treatment": arm, "pre": pre, "y": y}))
    rows = {r["method"]: r for r in experiments.cuped(df, "treatment", 1, 0, "y", "pre").collect()}
    theta = np.cov(y, pre)[0, 1] / np.var(pre)
    adj = y - theta * (pre - pre.mean())
    assert rows["raw"]["theta"] == pytest.approx(theta)
    assert rows["cuped"]["variance_reduction"] == pytest.approx(1 - adj.var(ddof=1) / y.var(ddof=1))
    se = np.sqrt(sum(adj[arm == g].var(ddof=1) / (arm == g).sum() for g in (0, 1)))
    assert rows["cuped"]["se"] == pytest.approx(se)
    assert rows["cuped"]["diff"] == pytest.approx(adj[arm == 1].mean() - adj[arm == 0].mean())
    assert rows["cuped"]["se_reduction"] == pytest.approx(1 - rows["cuped"]["se"] / rows["raw"]["se"])
    assert rows["cuped"]["variance_reduction"] > 0.3


def test_leaky_features_can_be_left_out(spark):
    """T11."""
    from ludometry.operators import churn

    df = spark.createDataFrame([("a", 1, 2.0, 9)], "player_id string, churned_d7 int, x double, days_since_last_active int")
    names = ["x", "days_since_last_active"]
    assert churn.churn_frame(df, names)[1] == names
    assert churn.churn_frame(df, names, exclude_leaky=True)[1] == ["x"]


def test_recommendation_bounds_follow_the_rules(spark):
    """T13: idle 3 up to but not including 6; more than one session."""
    df = spark.createDataFrame(
        [(i, s) for i, s in [(2, 1), (3, 1), (5, 2), (6, 2)]], "days_since_last_active int, total_sessions int"
    ).withColumns({"player_tier": F.lit("whale"), "churn_probability": F.lit(0.6), "tutorial_completed": F.lit(0), "is_payer": F.lit(1)})
    got = [r["count"] for r in liveops.recommendations(df).orderBy("rule_no").collect()]
    assert got == [0, 2, 2, 0, 0]


def test_cohort_without_payers_has_no_arppu(spark):
    """T15."""
    df = spark.createDataFrame(
        [("a", dt.date(2024, 1, 3), 1, 0, 0, 0, 0.0)],
        "player_id string, install_date date, d1_retained int, d7_retained int, d30_retained int, is_payer int, total_spend_usd double",
    )
    row = views.cohort_retention(df).first()
    assert row["arppu"] is None and row["arpu"] == 0.0 and row["cohort_week"] == dt.date(2024, 1, 1)


def test_elapsed_and_calendar_days(spark):
    """T16: 01-01 23:00 to 01-03 01:00 is two calendar days and one elapsed."""
    df = spark.createDataFrame([("2024-01-01 23:00:00",)], "t string").select(F.to_timestamp("t").alias("t"))
    row = df.select(
        days_since("t", "2024-01-03 01:00:00").alias("c"), days_since("t", "2024-01-03 01:00:00", elapsed=True).alias("e")
    ).first()
    assert (row["c"], row["e"]) == (2, 1)


def test_single_purchase_has_no_deviation(spark):
    row = features.purchase_summary(_txns(spark, [("a", "2024-01-01", 5)])).first()
    assert row["std_txn_value"] is None and row["total_revenue"] == 5.0


def test_guarded_ratio_flags_and_bins(spark):
    df = spark.createDataFrame([(6.0, 0.0, "iOS", 17), (6.0, 3.0, None, 18), (6.0, None, "x", 0)], "a double, b double, p string, age int")
    rows = df.select(
        safe_ratio("a", "b").alias("r"),
        flag_eq("p", "iOS").alias("e"),
        flag_in("p", ["iOS", "y"]).alias("i"),
        cut("age", features.AGE_BINS, features.AGE_LABELS).alias("g"),
    ).collect()
    assert [tuple(r) for r in rows] == [(6.0, 1, 1, "teen"), (2.0, 0, 0, "young_adult"), (None, 0, 0, None)]


def test_missing_columns_raise(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="missing columns: b"):
        schemas.require_columns(df, ["a", "b"])
    with pytest.raises(ValueError, match="missing"):
        features.select_features(df, ["zz"])


def test_segment_rules_are_ordered(spark):
    rows = [(5, 5, 5), (3, 4, 5), (5, 1, 5), (1, 4, 1), (1, 1, 4), (3, 3, 2), (1, 2, 2), (3, 3, 3)]
    df = spark.createDataFrame(rows, "recency_score int, frequency_score int, monetary_score int")
    got = [r["rfm_segment"] for r in segments.rfm_segments(df).collect()]
    assert got == [
        "Champions",
        "Loyal Whales",
        "New Payers",
        "At Risk High Value",
        "Lapsed Whales",
        "Low Spend Active",
        "Churning",
        "Potential Loyalists",
    ]


def test_players_without_purchases_get_the_default_segment(spark):
    players = spark.createDataFrame([("a",), ("b",)], "player_id string")
    scored = spark.createDataFrame([("a", 5, 5, 5)], "player_id string, recency_score int, frequency_score int, monetary_score int")
    got = {r["player_id"]: r["rfm_segment"] for r in segments.with_segments(players, scored).collect()}
    assert got == {"a": "Champions", "b": "Free Player"}


def test_empty_tables(spark):
    txns = _txns(spark, [("a", "2024-01-01", 1)]).limit(0)
    assert features.rfm_scores(features.rfm(txns, OBS)).count() == 0
    assert ltv.clv_summary(txns, OBS).count() == 0
    players = spark.createDataFrame([], "is_payer int, total_spend_usd double")
    assert segments.spend_tiers(players).count() == 0


@pytest.mark.parametrize("parts", [1, 8])
def test_partitioning_does_not_change_tiers(spark, parts):
    df = spark.range(1000).select(
        (F.col("id") % 4 != 0).cast("int").alias("is_payer"),
        F.when(F.col("id") % 4 != 0, F.pow(F.col("id"), 2)).otherwise(0.0).alias("total_spend_usd"),
    )
    got = {r["player_tier"]: r["count"] for r in segments.spend_tiers(df.repartition(parts)).groupBy("player_tier").count().collect()}
    assert got == {"free_rider": 250, "whale": 23, "dolphin": 127, "minnow": 600}


def test_purchase_plans_do_not_multiply_lines(spark):
    """Distinct items and categories come from grouped rows, not from an Expand."""
    txns = _txns(spark, [("a", "2024-01-01", 5), ("a", "2024-01-02", 7)])
    plan = features.purchase_summary(txns)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_purchase_features_read_the_log_once(spark, tmp_path):
    rows = [("a", "i", "x", 5.0), ("a", "i", "y", 2.0), ("a", None, "x", 1.0), ("a", "j", None, 4.0), ("b", None, None, 4.0)]
    txns = spark.createDataFrame(rows, "player_id string, item_name string, item_category string, price_usd double")
    txns.selectExpr("*", "date'2024-01-01' AS transaction_date", "1 AS transaction_id").write.parquet(str(tmp_path / "log"))
    summary = features.purchase_summary(spark.read.parquet(str(tmp_path / "log")))
    assert {r.player_id: (r.unique_items_purchased, r.unique_categories) for r in summary.collect()} == {"a": (2, 2), "b": (0, 0)}
    plan = summary._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation ") == 1


def test_categories_are_discovered(spark):
    rows = [("a", "x", 5.0), ("a", "y", 2.0), ("b", "x", 1.0), ("b", None, 4.0)]
    txns = spark.createDataFrame(rows, "player_id string, item_category string, price_usd double")
    txns = txns.selectExpr("*", "date'2024-01-01' AS transaction_date", "'i' AS item_name", "1 AS transaction_id")
    got = {r["player_id"]: r.asDict() for r in features.category_spend(txns).collect()}
    assert got["a"] == {"player_id": "a", "spend_x": 5.0, "spend_y": 2.0}
    assert got["b"] == {"player_id": "b", "spend_x": 1.0, "spend_y": 0.0}
