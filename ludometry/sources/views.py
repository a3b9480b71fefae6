"""The four reporting views over ``players``.

``register_views`` makes them available to ``spark.sql``. The DataFrame forms
are the same queries with fewer passes: distinct players are found by one
two-level aggregate instead of an expanded multi-distinct, and the funnel view
counts all stages in one scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.funnel import stage_counts


def daily_kpis(players: DataFrame, key: str = "player_id") -> DataFrame:
    """Per activity date: distinct players, distinct payers, revenue, session averages."""
    day = F.to_date("last_active_date").alias("activity_date")
    per_player = players.groupBy(day, key).agg(
        F.max((F.col("is_payer") == 1).cast("int")).alias("payer"),
        F.sum("total_spend_usd").alias("spend"),
        F.sum("total_sessions").alias("s"),
        F.count("total_sessions").alias("s_n"),
        F.sum("avg_session_minutes").alias("m"),
        F.count("avg_session_minutes").alias("m_n"),
    )
    return per_player.groupBy("activity_date").agg(
        F.count(key).alias("dau"),
        F.count(F.when(F.col("payer") == 1, F.col(key))).alias("paying_dau"),
        F.sum("spend").alias("daily_revenue"),
        F.try_divide(F.sum("s"), F.sum("s_n")).alias("avg_sessions"),
        F.try_divide(F.sum("m"), F.sum("m_n")).alias("avg_session_length"),
    )


def cohort_retention(players: DataFrame, grain: str = "week", key: str = "player_id") -> DataFrame:
    """Per install cohort: size, D1/D7/D30 retention, ARPPU (NULL without payers), ARPU."""
    cohort = F.to_date(F.date_trunc(grain, F.col("install_date").cast("timestamp"))).alias(f"cohort_{grain}")
    flags = ["d1_retained", "d7_retained", "d30_retained"]
    per_player = players.groupBy(cohort, key).agg(
        *[F.sum(f).alias(f"{f}_s") for f in flags],
        *[F.count(f).alias(f"{f}_n") for f in flags],
        F.sum(F.when(F.col("is_payer") == 1, F.col("total_spend_usd"))).alias("paid"),
        F.count(F.when(F.col("is_payer") == 1, F.col("total_spend_usd"))).alias("paid_n"),
        F.sum("total_spend_usd").alias("spend"),
    )
    return per_player.groupBy(f"cohort_{grain}").agg(
        F.count(key).alias("cohort_size"),
        *[
            F.try_divide(F.sum(f"{f}_s"), F.sum(f"{f}_n")).alias(f.replace("retained", "retention"))
            for f in flags
        ],
        F.try_divide(F.sum("paid"), F.sum("paid_n")).alias("arppu"),
        F.try_divide(F.sum("spend"), F.count(key)).alias("arpu"),
    )


def tier_segments(players: DataFrame) -> DataFrame:
    """Payers by spend tier: counts, revenue, their shares, and averages."""
    base = (
        players.where(F.col("is_payer") == 1)
        .groupBy("player_tier")
        .agg(
            F.count("*").alias("player_count"),
            F.sum("total_spend_usd").alias("total_revenue"),
            F.avg("total_spend_usd").alias("avg_spend"),
            F.avg("total_sessions").alias("avg_sessions"),
            F.avg("days_active").alias("avg_days_active"),
            F.avg("max_stage_reached").alias("avg_max_stage"),
        )
    )
    # A handful of tiers: the window is over the aggregate, not over players.
    everything = Window.partitionBy()
    return base.select(
        "player_tier",
        "player_count",
        F.round(100.0 * F.col("player_count") / F.sum("player_count").over(everything), 2).alias("pct_players"),
        "total_revenue",
        F.round(100.0 * F.col("total_revenue") / F.sum("total_revenue").over(everything), 2).alias("pct_revenue"),
        "avg_spend",
        "avg_sessions",
        "avg_days_active",
        "avg_max_stage",
    )


def conversion_funnel_view(players: DataFrame) -> DataFrame:
    """Six labelled stage counts from one scan."""
    stages = {
        "install": F.lit(True),
        "tutorial_complete": F.col("tutorial_completed") == 1,
        "d1_retained": F.col("d1_retained") == 1,
        "d7_retained": F.col("d7_retained") == 1,
        "first_iap": F.col("is_payer") == 1,
        "repeat_purchaser": F.col("num_purchases") >= 2,
    }
    return stage_counts(players, stages).select("stage", F.col("n").alias("players"))


def register_views(spark: SparkSession, players: DataFrame) -> None:
    """Register ``players`` and the four views for ``spark.sql``."""
    players.createOrReplaceTempView("players")
    for name, build in {
        "vw_daily_kpis": daily_kpis,
        "vw_cohort_retention": cohort_retention,
        "vw_whale_segments": tier_segments,
        "vw_conversion_funnel": conversion_funnel_view,
    }.items():
        build(players).createOrReplaceTempView(name)
