"""Published result numbers that need no raw data."""

import pytest
from pyspark.sql import functions as F

from ludometry.operators import experiments, funnel, liveops, resampling, segments

POWER = {
    ("D1", 0.52): [(0.01, 39170), (0.02, 9789), (0.03, 4349), (0.05, 1564)],
    ("D7", 0.21): [(0.01, 26177), (0.02, 6577), (0.03, 2937), (0.05, 1067)],
    ("Conversion", 0.032): [(0.005, 19884), (0.01, 5076), (0.015, 2301), (0.02, 1319)],
}


def _units(spark):
    """Experiment units with the published counts: 45,160 and 44,840 users."""
    i = F.col("id")
    a = spark.range(45160).select(
        F.lit("gate_30").alias("version"), (i < 23455).cast("int").alias("d1"), (i < 9813).cast("int").alias("d7")
    )
    b = spark.range(44840).select(
        F.lit("gate_40").alias("version"), (i < 23256).cast("int").alias("d1"), (i < 9467).cast("int").alias("d7")
    )
    return a.unionByName(b)


def test_power_rows(spark):
    base = spark.createDataFrame(
        [(s, p, [m for m, _ in rows]) for (s, p), rows in POWER.items()],
        "scenario string, baseline double, mdes array<double>",
    )
    got = {(r["scenario"], r["mde"]): r["n_per_group"] for r in experiments.power_report(base, "mdes").collect()}
    assert got == {(s, m): n for (s, _), rows in POWER.items() for m, n in rows}


def test_mde(spark):
    base = spark.createDataFrame([("D1", 0.52)], "scenario string, baseline double")
    row = experiments.mde_report(base, 45000).first()
    assert row["mde"] == pytest.approx(0.009331, abs=1e-5)
    assert row["mde_relative"] == pytest.approx(row["mde"] / 0.52)


def test_z_tests(spark):
    rows = {r["metric"]: r for r in experiments.z_test(_units(spark), "version", "gate_30", "gate_40", ["d1", "d7"]).collect()}
    d1, d7 = rows["d1"], rows["d7"]
    assert d1["z_stat"] == pytest.approx(0.21960314645428597, rel=1e-10)
    assert d1["p_value"] == pytest.approx(0.8261802407128833, rel=1e-9)
    assert not d1["significant"]
    assert d7["p_a"] == pytest.approx(0.21729406554472985)
    assert d7["relative_lift"] == pytest.approx(0.02920311598454493, rel=1e-9)
    assert d7["se"] == pytest.approx(0.0027352285282742856, rel=1e-9)
    assert d7["z_stat"] == pytest.approx(2.2541475953242887, rel=1e-10)
    assert d7["p_value"] == pytest.approx(0.024186884290398503, rel=1e-8)
    assert d7["significant"]


def test_bootstrap_interval(spark):
    row = resampling.bootstrap_ci(_units(spark), "version", "gate_30", "gate_40", "d7").first()
    assert row["n_boot"] == 10_000
    # Ends of 10,000 replicates scatter by 8e-5: against the exact normal interval, and against another sample.
    assert row["ci_lower"] == pytest.approx(0.0061656 - 1.959964 * 0.00273523, abs=2.5e-4)
    assert row["ci_upper"] == pytest.approx(0.0061656 + 1.959964 * 0.00273523, abs=2.5e-4)
    assert row["ci_lower"] == pytest.approx(0.000744, abs=3.5e-4)
    assert row["ci_upper"] == pytest.approx(0.011442, abs=3.5e-4)
    assert row["mean_diff"] == pytest.approx(0.0061656, abs=1e-4)
    assert row["excludes_zero"]


def test_bootstrap_of_many_values(spark):
    """Several blocks of distinct values give the interval of the normal approximation."""
    units = spark.range(6000).selectExpr("id % 2 AS arm", "id + 100.0 * (id % 2) AS v")
    row = resampling.bootstrap_ci(units, "arm", 1, 0, "v", n_boot=4000).first()
    se = (6000**2 / 12 / 3000 * 2) ** 0.5
    assert row["n_boot"] == 4000 and row["mean_diff"] == pytest.approx(101, abs=4 * se / 4000**0.5)
    assert row["ci_upper"] - row["ci_lower"] == pytest.approx(2 * 1.96 * se, rel=0.08)


def test_resampling_does_not_depend_on_partitions(spark):
    units = _units(spark)
    for fn, kw in ((resampling.bootstrap_ci, {"n_boot": 500}), (resampling.bayes_ab, {"draws": 5000})):
        one = fn(units.coalesce(1), "version", "gate_30", "gate_40", "d7", **kw).first()
        many = fn(units.repartition(9), "version", "gate_30", "gate_40", "d7", **kw).first()
        for c in ("ci_lower", "ci_upper"):
            assert one[c] == pytest.approx(many[c], abs=1e-12), c


def test_bayesian(spark):
    row = resampling.bayes_ab(_units(spark), "version", "gate_30", "gate_40", "d7").first()
    assert row["draws"] == 100_000
    assert row["prob_a_better"] == pytest.approx(0.98755, abs=2e-3)
    assert row["expected_loss_a"] == pytest.approx(1.2e-5, abs=4e-6)
    assert row["expected_loss_b"] == pytest.approx(0.006174, abs=5e-5)
    assert row["ci_lower"] == pytest.approx(0.000803, abs=1e-4)
    assert row["ci_upper"] == pytest.approx(0.011528, abs=1e-4)
    assert row["recommendation"] == "gate_30"


STAGES = [310000, 234809, 150500, 46438, 11967, 9851, 8777, 2517]
PCT = [(100.0, 100.0, 0.0), (75.74, 75.74, 24.26), (48.55, 64.09, 35.91), (14.98, 30.86, 69.14)]
PCT += [(3.86, 25.77, 74.23), (3.18, 82.32, 17.68), (2.83, 89.1, 10.9), (0.81, 28.68, 71.32)]


def test_funnel_percentages(spark):
    players = spark.range(310000)
    stages = {str(i): F.col("id") < n for i, n in enumerate(STAGES)}
    rows = funnel.funnel(players, stages).orderBy("stage_no").collect()
    assert [r["count"] for r in rows] == STAGES
    for r, want in zip(rows, PCT):
        assert (r["pct_of_install"], r["pct_of_previous"], r["dropoff_rate"]) == pytest.approx(want, abs=0.0101)


TIERS = [("dolphin", 1675, 54349.84, 27.12), ("free_rider", 300149, 0.0, 0.0)]
TIERS += [("minnow", 7880, 37636.93, 18.78), ("whale", 296, 108434.09, 54.1)]


def test_tier_shares_and_arpu(spark):
    frames = [
        spark.range(n).select(F.lit(t).alias("player_tier"), F.when(F.col("id") == 0, total).otherwise(0.0).alias("total_spend_usd"))
        for t, n, total, _ in TIERS
    ]
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f)
    got = {r["player_tier"]: r for r in segments.tier_revenue(df).collect()}
    for t, n, _, pct in TIERS:
        assert got[t]["n_players"] == n and got[t]["pct_revenue"] == pytest.approx(pct, abs=0.006)
    assert got["whale"]["pct_players"] == pytest.approx(0.1)
    assert [r["player_tier"] for r in segments.pareto(segments.tier_revenue(df)).collect()] == ["whale", "dolphin", "minnow"]
    metrics = df.withColumns(
        {
            "is_payer": (F.col("player_tier") != "free_rider").cast("int"),
            "days_since_last_active": F.lit(0),
            "churn_probability": F.lit(0.0),
            **{c: F.lit(0) for c in ("d1_retained", "d7_retained", "d30_retained")},
        }
    )
    row = liveops.live_metrics(metrics).first()
    assert row["arpu"] == pytest.approx(0.6465) and row["arppu"] == pytest.approx(20.35)
    assert row["conversion_rate"] == pytest.approx(0.0318) and row["whale_pct"] == pytest.approx(0.095)


def test_alert_statuses(spark):
    metrics = spark.createDataFrame(
        [(0.4855, 0.1498, 0.0318, 204)],
        "d1_retention double, d7_retention double, conversion_rate double, whales_at_critical_risk long",
    )
    got = {r["rule"]: r["status"] for r in liveops.alerts(metrics).collect()}
    assert got == {
        "d1_retention_min": "OK",
        "d7_retention_min": "OK",
        "conversion_rate_min": "OK",
        "whale_churn_count": "ALERT",
    }


def test_drop_alerts(spark):
    metrics = spark.createDataFrame(
        [(0.5, 0.5, 0.5, 0)],
        "d1_retention double, d7_retention double, conversion_rate double, whales_at_critical_risk long",
    )
    weekly = spark.createDataFrame(
        [("2024-01-01", 100, 1.0), ("2024-01-08", 80, 0.95)], "week string, active long, arpu double"
    )
    got = {r["rule"]: (r["status"], r["current"]) for r in liveops.alerts(metrics, weekly).collect()}
    assert got["dau_drop_pct"] == ("ALERT", pytest.approx(20.0))
    assert got["arpu_drop_pct"][0] == "OK"


def test_se_reduction_formula():
    assert 1 - 0.010277390238835522 / 0.014306584282074881 == pytest.approx(0.2816, abs=1e-4)
