"""The batch jobs in order, with parquet tables between them.

features → segments → churn scores, and one report per area. Every stage reads
the table the stage before wrote, so any of them can be rerun alone.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attribution, churn, clustering, clv, dbscan, evaluation, experiments, features, funnel
from ..operators import liveops, ltv, resampling, segments, survival
from ..session import materialize
from ..sources import tables


def build_features(
    players: DataFrame,
    txns: DataFrame,
    out: str,
    obs,
    categories: Sequence[str] | None,
    activity: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Write the wide feature table; play streaks come from an activity log when there is one."""
    wide = features.player_features(players, txns, obs, categories, **options)
    if activity is not None:
        streaks = features.play_streaks(activity).drop("n_streaks")
        wide = features.default_fill(
            wide.join(streaks, "player_id", "left"), {"max_play_streak": 0, "avg_play_streak": 0.0}
        )
    tables.write_table(wide, os.path.join(out, "master_features"))
    return tables.read_table(players.sparkSession, os.path.join(out, "master_features"))


def segment_players(
    master: DataFrame,
    out: str,
    ks: Sequence[int] = range(2, 8),
    restarts: int = 10,
    eps: float = 1.5,
    min_samples: int = 5,
) -> DataFrame:
    """Write players with cluster, outlier label, RFM segment and projection; write the segment report."""
    spark = master.sparkSession
    names = [c for c in clustering.SEGMENT_FEATURES if c in master.columns]
    data = materialize(clustering.standard_vectors(master, names, ["player_id"]))
    sweep = clustering.kmeans_sweep(data, ks, restarts, key="player_id")
    assigned = clustering.kmeans_assign(data, sweep.models[sweep.best_k])
    projected, variance = clustering.pca_project(assigned)

    payers = master.where(F.col("is_payer") == 1)
    z = clustering.standardize(payers, clustering.OUTLIER_FEATURES)
    outliers = dbscan.dbscan(z, "player_id", [f"{c}_z" for c in clustering.OUTLIER_FEATURES], eps, min_samples)
    rfm = segments.rfm_segments(payers.where(F.col("recency_score") > 0)).select("player_id", "rfm_segment")

    joined = features.assemble_features(
        master,
        projected.select("player_id", "kmeans_cluster", "pca_1", "pca_2"),
        outliers.select("player_id", F.col("cluster").alias("dbscan_cluster")),
        rfm,
    )
    segmented = features.default_fill(joined, {"dbscan_cluster": -2, "rfm_segment": segments.NO_SEGMENT})
    tables.write_table(segmented, os.path.join(out, "segmented_players"))
    segmented = tables.read_table(spark, os.path.join(out, "segmented_players"))
    tables.write_report(
        {
            "kmeans": sweep.table(spark),
            "cluster_profiles": segments.cluster_profiles(segmented),
            "tier_revenue": segments.tier_revenue(segmented),
            "rfm_distribution": segments.segment_counts(
                segmented.where(F.col("rfm_segment") != segments.NO_SEGMENT), "rfm_segment", ascending=False
            ),
            "outliers": dbscan.dbscan_summary(outliers),
            "pca_variance": spark.createDataFrame([(i + 1, v) for i, v in enumerate(variance)], "component int, share double"),
        },
        os.path.join(out, "segmentation_results"),
    )
    return segmented


def funnel_report(segmented: DataFrame, out: str, encode: Sequence[str], numeric: Sequence[str]) -> None:
    payers = segmented.where(F.col("is_payer") == 1)
    wide, names = funnel.driver_features(segmented, encode, numeric)
    tables.write_report(
        {
            "funnel": funnel.funnel(segmented).orderBy("stage_no"),
            "time_to_convert": funnel.time_to_convert(segmented),
            "distribution": funnel.bucket_distribution(
                payers, "days_to_first_purchase", funnel.CONVERT_BINS, funnel.CONVERT_LABELS
            ),
            "friction_tests": funnel.chi2_tests(
                segmented, ["tutorial_completed", "d1_retained", "fb_connected"], "is_payer"
            ),
            "drivers": funnel.conversion_drivers(wide, names),
            "platform_conversion": funnel.conversion_by(segmented, "platform"),
            "country_conversion": funnel.conversion_by(segmented, "country", 10),
        },
        os.path.join(out, "funnel_results"),
    )


def ltv_report(
    segmented: DataFrame, txns: DataFrame, out: str, obs, covariates: Sequence[str], trees: int = 200
) -> None:
    """Cox model, survival curves, horizon LTV models and CLV."""
    spark = segmented.sparkSession
    cox = survival.cox_ph(segmented, "days_active", "churned_d7", covariates)
    curve = survival.kaplan_meier(segmented, "days_active", "churned_d7", "player_tier")
    ranked = segmented.withColumn("_risk", cox.risk())
    sections = {
        "cox": cox.summary(spark),
        "concordance": survival.concordance(ranked, "days_active", "churned_d7", "_risk"),
        "median_survival": survival.median_survival(curve, "player_tier"),
    }
    tables.write_table(curve, os.path.join(out, "kaplan_meier"))
    training = materialize(segmented.join(ltv.horizon_ltv(txns, segmented), "player_id"))
    names = [f for f in ltv.LTV_FEATURES if f in training.columns]
    for days in ltv.HORIZONS:
        model, pred, used = ltv.ltv_model(training, f"ltv_{days}d", names, trees=trees)
        sections[f"ltv_{days}d"] = ltv.regression_metrics(pred)
        sections[f"ltv_{days}d_importance"] = ltv.feature_importance(spark, model, used)
    summary = materialize(ltv.clv_summary(txns, obs))
    purchases, spend = clv.fit_bgnbd(summary), clv.fit_gamma_gamma(summary)
    valued = materialize(clv.with_clv(clv.with_expected_purchases(summary, purchases), purchases, spend))
    sections["clv"] = ltv.clv_averages(valued, "predicted_clv")
    sections["expected_purchases"] = valued.agg(
        F.avg("pred_purchases_30d").alias("avg_30d"), F.avg("pred_purchases_90d").alias("avg_90d")
    )
    tables.write_report(sections, os.path.join(out, "ltv_results"))


def experiment_report(
    units: DataFrame,
    out: str,
    a: str = "gate_30",
    b: str = "gate_40",
    arm: str = "version",
    outcome: str = "revenue",
    covariate: str = "pre_spend",
) -> None:
    """Tests, intervals and power; with ``outcome`` and its ``covariate`` also the adjusted comparison, ``b`` the treatment."""
    metrics = ["retention_1", "retention_7"]
    baselines = units.agg(*[F.avg(m).alias(m) for m in metrics]).unpivot([], metrics, "scenario", "baseline")
    arms = units.where(F.col(arm).isin(a, b)).groupBy(arm).count().agg(F.min("count").alias("n"))
    adjusted = {}
    if outcome in units.columns and covariate in units.columns:
        adjusted = {
            "mean_difference": experiments.mean_diff(units, arm, b, a, outcome),
            "cuped": experiments.cuped(units, arm, b, a, outcome, covariate),
        }
    tables.write_report(
        {
            **adjusted,
            "mde": experiments.mde_report(baselines.withColumn("n", arms.scalar()), "n"),
            "z_tests": experiments.z_test(units, arm, a, b, metrics),
            "chi2": experiments.arm_chi2(units, arm, metrics),
            "rounds": experiments.t_test(units, arm, a, b, "sum_gamerounds"),
            "bootstrap": resampling.bootstrap_ci(units, arm, a, b, "retention_7"),
            "bayesian": resampling.bayes_ab(units, arm, a, b, "retention_7"),
            "power": experiments.power_report(baselines, [0.01, 0.02, 0.03, 0.05]),
        },
        os.path.join(out, "ab_testing_results"),
    )


def score_churn(
    segmented: DataFrame, out: str, trees: int = 300, exclude_leaky: bool = False, weekly: DataFrame | None = None
) -> DataFrame:
    """Train both configurations, write every player's score, and write the live-ops report."""
    spark = segmented.sparkSession
    names = [f for f in churn.CHURN_FEATURES if f in segmented.columns]
    data, names = churn.churn_frame(segmented, names, exclude_leaky=exclude_leaky)
    data = materialize(data)
    train, test = churn.split_stratified(data, "player_id")
    models = churn.train_configs(train, trees=trees)
    held_out = {n: materialize(churn.score(test, m, "score")) for n, m in models.items()}
    comparison = materialize(evaluation.compare_models(held_out))
    best = comparison.where("is_best").first()["model"]
    scored = churn.with_risk(churn.score(data, models[best]))
    path = os.path.join(out, "churn_scores")
    tables.write_table(scored.select("player_id", "churn_probability", "churn_risk"), path)
    scores = tables.read_table(spark, path)
    everyone = segmented.join(scores, "player_id")
    metrics = liveops.live_metrics(everyone)
    attributed = attribution.attributions(test, models[best], scale=2.0)
    tables.write_report(
        {
            "model_comparison": comparison,
            "classification": evaluation.classification_report(held_out[best]),
            "confusion": evaluation.confusion(held_out[best]),
            "importance": attribution.global_importance(attributed, names),
            "top_churners": attribution.explain_top(
                held_out[best].withColumnRenamed("score", "churn_probability"), models[best], names
            ),
            "risk_distribution": churn.risk_bands(scores),
            "recommendations": liveops.recommendations(everyone),
            "current_metrics": metrics,
            "alerts": liveops.alerts(metrics, weekly),
        },
        os.path.join(out, "churn_results"),
    )
    return scores
