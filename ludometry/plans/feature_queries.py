"""Profile features, purchase-log features, RFM, streaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import cut, flag_eq, flag_in
from ..operators import features, segments
from ..sources import retail
from .oracle_tables import ACTIVITY, BOTH, OBS, PLAYERS, TXNS
from .registry import query, tidy

IOS = "BUILDING"
COUNTRIES = [f"NATION_{i}" for i in (1, 3, 5, 7, 11, 13, 17, 19, 23, 24)]
_COUNTRY_SQL = ", ".join(f"'{c}'" for c in COUNTRIES)


@query(
    "engagement_features",
    PLAYERS
    + f""",
 e AS (SELECT *, {OBS} - install_date AS since_install, {OBS} - last_active_date AS idle FROM players)
 SELECT player_id, since_install AS days_since_install, idle AS days_since_last_active,
  round(total_sessions / greatest(since_install, 1), 6) AS session_frequency,
  round(total_play_hours / greatest(days_active, 1) + 1e-8, 6) AS play_intensity,
  round(max_stage_reached / greatest(days_active, 1), 6) AS stage_velocity,
  round(days_active / greatest(since_install, 1), 6) AS engagement_ratio FROM e""",
)
def engagement_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.engagement_features(retail.players_untiered(spark, sf_dir), retail.OBS)
    names = ["days_since_install", "days_since_last_active", "session_frequency", "play_intensity"]
    return tidy(out.select("player_id", *names, "stage_velocity", "engagement_ratio"), averages=["play_intensity"])


@query(
    "progression_features",
    PLAYERS
    + """
 SELECT player_id, round(max_stage_reached / greatest(total_sessions, 1), 6) AS stage_per_session,
  round(max_stage_reached / greatest(total_play_hours, 0.1), 6) AS stage_per_hour FROM players""",
)
def progression_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.progression_features(retail.players_untiered(spark, sf_dir))
    return tidy(out.select("player_id", "stage_per_session", "stage_per_hour"))


@query(
    "revenue_features",
    PLAYERS
    + """
 SELECT player_id, round(total_spend_usd / greatest(total_sessions, 1), 6) AS revenue_per_session,
  round(total_spend_usd / greatest(total_play_hours, 0.1), 6) AS revenue_per_hour,
  round(total_spend_usd / greatest(days_active, 1), 6) AS revenue_per_active_day FROM players""",
)
def revenue_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.revenue_features(retail.players_untiered(spark, sf_dir))
    return tidy(out.select("player_id", "revenue_per_session", "revenue_per_hour", "revenue_per_active_day"))


@query(
    "flags_and_bins",
    f"""
 SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 1 ELSE 0 END AS is_economy,
  CASE WHEN p_brand IN ('Brand#2', 'Brand#17', 'Brand#25') THEN 1 ELSE 0 END AS is_listed,
  CASE WHEN p_size > 0 AND p_size <= 10 THEN 'teen' WHEN p_size > 10 AND p_size <= 20 THEN 'young_adult'
   WHEN p_size > 20 AND p_size <= 34 THEN 'adult' WHEN p_size > 34 AND p_size <= 44 THEN 'middle_aged'
   WHEN p_size > 44 AND p_size <= 48 THEN 'senior' END AS age_bucket
 FROM part""",
)
def flags_and_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = retail.load(spark, sf_dir, "part")
    return tidy(
        part.select(
            "p_partkey",
            flag_eq("p_type", "ECONOMY").alias("is_economy"),
            flag_in("p_brand", ["Brand#2", "Brand#17", "Brand#25"]).alias("is_listed"),
            cut("p_size", [0, 10, 20, 34, 44, 48], features.AGE_LABELS).alias("age_bucket"),
        )
    )


@query(
    "profile_flags",
    PLAYERS
    + f"""
 SELECT player_id, CAST(days_to_first_purchase * 24 AS DOUBLE) AS hours_to_first_purchase,
  round(1 + 0.2 * fb_connected, 6)::DOUBLE AS social_multiplier,
  CASE WHEN platform = '{IOS}' THEN 1 ELSE 0 END AS is_ios,
  CASE WHEN country IN ({_COUNTRY_SQL}) THEN 1 ELSE 0 END AS is_high_spend_country FROM players""",
)
def profile_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.profile_flags(retail.players_untiered(spark, sf_dir), IOS, COUNTRIES)
    return tidy(
        out.select(
            "player_id",
            F.col("hours_to_first_purchase").cast("double").alias("hours_to_first_purchase"),
            "social_multiplier",
            "is_ios",
            "is_high_spend_country",
        )
    )


@query(
    "retention_score",
    PLAYERS + " SELECT player_id, d1_retained + 3 * d7_retained + 7 * d30_retained AS retention_score FROM players",
)
def retention_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.retention_score(retail.players_untiered(spark, sf_dir))
    return tidy(out.select("player_id", "retention_score"))


@query(
    "churn_label",
    PLAYERS
    + f""" SELECT player_id, CASE WHEN {OBS} - last_active_date >= 60 THEN 1 ELSE 0 END AS churned FROM players""",
)
def churn_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.churn_label(retail.players_untiered(spark, sf_dir), retail.OBS, 60, out="churned")
    return tidy(out.select("player_id", "churned"))


@query(
    "zero_fill",
    BOTH
    + f""",
 t AS (SELECT player_id, count(*) AS frequency, sum(price_usd) AS monetary, {OBS} - max(transaction_date) AS recency,
   min(transaction_date) AS first_purchase_date, count(DISTINCT item_category) AS unique_categories
  FROM transactions GROUP BY player_id)
 SELECT p.player_id, coalesce(frequency, 0) AS frequency, round(coalesce(monetary, 0), 4) AS monetary,
  coalesce(recency, 0) AS recency, CAST(first_purchase_date AS VARCHAR) AS first_purchase_date,
  CAST(unique_categories AS DOUBLE) AS unique_categories
 FROM players p LEFT JOIN t ON t.player_id = p.player_id""",
)
def zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    txns = retail.transactions(spark, sf_dir)
    bought = features.rfm(txns, retail.OBS).join(
        features.purchase_summary(txns).select("player_id", "first_purchase_date", "unique_categories"), "player_id"
    )
    base = retail.players_untiered(spark, sf_dir).select("player_id")
    out = features.fill_by_pattern(features.assemble_features(base, bought))
    return tidy(out.withColumn("unique_categories", F.col("unique_categories").cast("double")), 4)


@query(
    "default_fill",
    BOTH
    + """
 SELECT p.player_id, coalesce(t.n, -2) AS n_txns FROM players p
 LEFT JOIN (SELECT player_id, count(*) AS n FROM transactions GROUP BY player_id) t ON t.player_id = p.player_id""",
)
def default_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = retail.transactions(spark, sf_dir).groupBy("player_id").agg(F.count("*").alias("n_txns"))
    base = retail.players_untiered(spark, sf_dir).select("player_id")
    return tidy(features.default_fill(features.assemble_features(base, counts), {"n_txns": -2}))


@query(
    "drop_missing",
    PLAYERS
    + """
 SELECT player_id, CAST(greatest(days_to_first_purchase, 1) AS BIGINT) AS days FROM players
 WHERE days_to_first_purchase IS NOT NULL""",
)
def drop_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retail.players_untiered(spark, sf_dir).select("player_id", F.col("days_to_first_purchase").alias("days"))
    return tidy(features.drop_missing(rows, ["days"], {"days": 1}))


@query(
    "select_features",
    PLAYERS
    + """
 SELECT player_id, CAST(total_sessions AS DOUBLE) AS total_sessions,
  CAST(coalesce(days_to_first_purchase, 0) AS DOUBLE) AS days_to_first_purchase FROM players""",
)
def select_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = retail.players_untiered(spark, sf_dir)
    return tidy(features.select_features(base, ["total_sessions", "days_to_first_purchase"], ["player_id"]))


@query(
    "ordinal_encode",
    PLAYERS
    + """
 SELECT player_id, c1.k AS platform_enc, c2.k AS country_enc FROM players p
 JOIN (SELECT platform, row_number() OVER (ORDER BY platform) - 1 AS k FROM
  (SELECT DISTINCT platform FROM players)) c1 ON c1.platform = p.platform
 JOIN (SELECT country, row_number() OVER (ORDER BY country) - 1 AS k FROM
  (SELECT DISTINCT country FROM players)) c2 ON c2.country = p.country""",
)
def ordinal_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = retail.players_untiered(spark, sf_dir).select("player_id", "platform", "country")
    out = features.ordinal_encode(base, ["platform", "country"])
    return tidy(out.select("player_id", "platform_enc", "country_enc"))


@query(
    "topn_dummies",
    PLAYERS
    + """,
 top AS (SELECT country FROM players GROUP BY country ORDER BY count(*) DESC, country LIMIT 8)
 SELECT p.player_id, t.country AS value, CASE WHEN p.country = t.country THEN 1 ELSE 0 END AS flag
 FROM players p, top t""",
)
def topn_dummies(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = retail.players_untiered(spark, sf_dir).select("player_id", "country")
    wide, names = features.topn_dummies(base, "country", 8)
    long = wide.unpivot("player_id", names, "value", "flag")
    return tidy(long.withColumn("value", F.expr("substring(value, length('country_') + 1)")))


@query(
    "purchase_summary",
    TXNS
    + """
 SELECT player_id, CAST(min(transaction_date) AS VARCHAR) AS first_purchase_date,
  CAST(max(transaction_date) AS VARCHAR) AS last_purchase_date, count(*) AS total_txn_count,
  round(sum(price_usd), 4) AS total_revenue, round(avg(price_usd) + 1e-8, 6) AS avg_txn_value,
  round(max(price_usd), 4) AS max_txn_value, round(min(price_usd), 4) AS min_txn_value,
  round(stddev_samp(price_usd), 4) AS std_txn_value, count(DISTINCT item_name) AS unique_items_purchased,
  count(DISTINCT item_category) AS unique_categories FROM transactions GROUP BY player_id""",
)
def purchase_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(features.purchase_summary(retail.transactions(spark, sf_dir)), 4, averages=["avg_txn_value"], avg_txn_value=6)


@query(
    "purchase_velocity",
    TXNS
    + """
 SELECT player_id, count(*) AS total_txn_count,
  max(transaction_date) - min(transaction_date) + 1 AS purchase_span_days,
  round(count(*) / greatest(max(transaction_date) - min(transaction_date) + 1, 1), 6) AS purchase_velocity
 FROM transactions GROUP BY player_id""",
)
def purchase_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(features.purchase_velocity(retail.transactions(spark, sf_dir)))


_CATEGORY_SQL = ", ".join(
    f"round(coalesce(sum(price_usd) FILTER (WHERE item_category = '{c}'), 0), 4) AS \"spend_{c}\""
    for c in retail.CATEGORIES
)


@query("category_spend", TXNS + f" SELECT player_id, {_CATEGORY_SQL} FROM transactions GROUP BY player_id")
def category_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(features.category_spend(retail.transactions(spark, sf_dir)), 4)


_SPENDS = ", ".join(f"coalesce(\"spend_{c}\", 0.0) AS spend_{c.lower().replace('#', '_')}" for c in retail.CATEGORIES)

_RFM = f""",
 rfm AS (
  SELECT player_id, {OBS} - max(transaction_date) AS recency, count(*) AS frequency, sum(price_usd) AS monetary
  FROM transactions GROUP BY player_id)"""

_SCORED = (
    _RFM
    + """,
 edges AS (SELECT quantile_cont(recency, [0.2, 0.4, 0.6, 0.8]) AS e, count(*) AS n FROM rfm),
 ranked AS (
  SELECT *, row_number() OVER (ORDER BY frequency, player_id) AS fr,
   row_number() OVER (ORDER BY monetary, player_id) AS mr FROM rfm),
 scored AS (
  SELECT r.*, 5 - (CASE WHEN recency > e[1] THEN 1 ELSE 0 END) - (CASE WHEN recency > e[2] THEN 1 ELSE 0 END)
     - (CASE WHEN recency > e[3] THEN 1 ELSE 0 END) - (CASE WHEN recency > e[4] THEN 1 ELSE 0 END) AS recency_score,
   1 + (CASE WHEN 5 * (fr - 1) > n - 1 THEN 1 ELSE 0 END) + (CASE WHEN 5 * (fr - 1) > 2 * (n - 1) THEN 1 ELSE 0 END)
     + (CASE WHEN 5 * (fr - 1) > 3 * (n - 1) THEN 1 ELSE 0 END)
     + (CASE WHEN 5 * (fr - 1) > 4 * (n - 1) THEN 1 ELSE 0 END) AS frequency_score,
   1 + (CASE WHEN 5 * (mr - 1) > n - 1 THEN 1 ELSE 0 END) + (CASE WHEN 5 * (mr - 1) > 2 * (n - 1) THEN 1 ELSE 0 END)
     + (CASE WHEN 5 * (mr - 1) > 3 * (n - 1) THEN 1 ELSE 0 END)
     + (CASE WHEN 5 * (mr - 1) > 4 * (n - 1) THEN 1 ELSE 0 END) AS monetary_score
  FROM ranked r JOIN edges ON TRUE)"""
)

_SEGMENTED = (
    _SCORED
    + """,
 segmented AS (
  SELECT *, CASE
   WHEN recency_score >= 4 AND frequency_score >= 4 AND monetary_score >= 4 THEN 'Champions'
   WHEN recency_score >= 3 AND frequency_score >= 3 AND monetary_score >= 4 THEN 'Loyal Whales'
   WHEN recency_score >= 4 AND frequency_score <= 2 THEN 'New Payers'
   WHEN recency_score <= 2 AND frequency_score >= 3 THEN 'At Risk High Value'
   WHEN recency_score <= 2 AND frequency_score <= 2 AND monetary_score >= 3 THEN 'Lapsed Whales'
   WHEN recency_score >= 3 AND monetary_score <= 2 THEN 'Low Spend Active'
   WHEN recency_score <= 2 THEN 'Churning' ELSE 'Potential Loyalists' END AS rfm_segment FROM scored)"""
)


@query("rfm", TXNS + _RFM + " SELECT player_id, recency, frequency, round(monetary, 4) AS monetary FROM rfm")
def rfm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(features.rfm(retail.transactions(spark, sf_dir), retail.OBS), 4)


@query(
    "rfm_scores",
    TXNS
    + _SCORED
    + """
 SELECT player_id, recency_score, frequency_score, monetary_score,
  100 * recency_score + 10 * frequency_score + monetary_score AS rfm_score FROM scored""",
)
def rfm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = features.rfm_scores(features.rfm(retail.transactions(spark, sf_dir), retail.OBS))
    return tidy(scored.select("player_id", "recency_score", "frequency_score", "monetary_score", "rfm_score"))


@query(
    "rfm_segments",
    TXNS + _SEGMENTED + " SELECT rfm_segment, count(*) AS n FROM segmented GROUP BY rfm_segment",
)
def rfm_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = features.rfm_scores(features.rfm(retail.transactions(spark, sf_dir), retail.OBS))
    return tidy(segments.segment_counts(segments.rfm_segments(scored), "rfm_segment", ascending=False))


@query(
    "player_segments",
    BOTH
    + _SEGMENTED
    + """
 SELECT p.player_id, coalesce(s.rfm_segment, 'Free Player') AS rfm_segment
 FROM players p LEFT JOIN segmented s ON s.player_id = p.player_id""",
)
def player_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = features.rfm_scores(features.rfm(retail.transactions(spark, sf_dir), retail.OBS))
    base = retail.players_untiered(spark, sf_dir).select("player_id")
    return tidy(segments.with_segments(base, scored).select("player_id", "rfm_segment"))


def wide_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.player_features(
        retail.players(spark, sf_dir),
        retail.transactions(spark, sf_dir),
        retail.OBS,
        ios=IOS,
        countries=COUNTRIES,
    )


@query(
    "player_features",
    BOTH
    + _SCORED
    + f""",
 t AS (
  SELECT player_id, min(transaction_date) AS d0, max(transaction_date) AS d1, count(*) AS n, sum(price_usd) AS rev,
   avg(price_usd) AS mean, stddev_samp(price_usd) AS sd, count(DISTINCT item_name) AS items,
   count(DISTINCT item_category) AS cats, {_CATEGORY_SQL} FROM transactions GROUP BY player_id)
 SELECT p.player_id, player_tier, coalesce(t.n, 0) AS total_txn_count, round(coalesce(t.rev, 0), 4) AS total_revenue,
  round(coalesce(t.mean, 0) + 1e-8, 6) AS avg_txn_value, round(coalesce(t.sd, 0), 4) AS std_txn_value,
  coalesce(t.items, 0) AS unique_items_purchased, CAST(t.cats AS DOUBLE) AS unique_categories,
  round(coalesce(t.n / greatest(t.d1 - t.d0 + 1, 1), 0), 6) AS purchase_velocity,
  {_SPENDS}, coalesce(s.recency, 0) AS recency,
  coalesce(100 * recency_score + 10 * frequency_score + monetary_score, 0) AS rfm_score,
  round(total_sessions / greatest({OBS} - install_date, 1), 6) AS session_frequency,
  round(total_spend_usd / greatest(total_play_hours, 0.1), 6) AS revenue_per_hour,
  d1_retained + 3 * d7_retained + 7 * d30_retained AS retention_score,
  coalesce(days_to_first_purchase, 0) AS days_to_first_purchase
 FROM players p LEFT JOIN t ON t.player_id = p.player_id LEFT JOIN scored s ON s.player_id = p.player_id""",
)
def player_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = wide_features(spark, sf_dir)
    picked = wide.select(
        "player_id",
        "player_tier",
        "total_txn_count",
        "total_revenue",
        "avg_txn_value",
        "std_txn_value",
        "unique_items_purchased",
        F.col("unique_categories").cast("double").alias("unique_categories"),
        "purchase_velocity",
        *[F.col(f"`spend_{c}`").alias(f"spend_{c.lower().replace('#', '_')}") for c in retail.CATEGORIES],
        "recency",
        "rfm_score",
        "session_frequency",
        "revenue_per_hour",
        "retention_score",
        "days_to_first_purchase",
    )
    return tidy(picked, averages=["avg_txn_value"], total_revenue=4, std_txn_value=4, spend_brand_1=4)


@query(
    "play_streaks",
    ACTIVITY
    + """,
 d AS (SELECT DISTINCT player_id, day FROM activity),
 g AS (SELECT player_id, day, CASE WHEN day - lag(day) OVER (PARTITION BY player_id ORDER BY day) = 1 THEN 0 ELSE 1
   END AS brk FROM d),
 r AS (SELECT player_id, sum(brk) OVER (PARTITION BY player_id ORDER BY day) AS run FROM g),
 l AS (SELECT player_id, run, count(*) AS len FROM r GROUP BY player_id, run)
 SELECT player_id, max(len) AS max_play_streak, round(avg(len), 6) AS avg_play_streak, count(*) AS n_streaks
 FROM l GROUP BY player_id""",
)
def play_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(features.play_streaks(retail.activity(spark, sf_dir)))


@query(
    "retention_flags",
    ACTIVITY
    + """,
 f AS (SELECT player_id, min(day) AS d0 FROM activity GROUP BY player_id)
 SELECT f.player_id, CAST(d0 AS VARCHAR) AS first_day,
  CASE WHEN EXISTS (SELECT 1 FROM activity a WHERE a.player_id = f.player_id AND a.day = d0 + 1) THEN 1 ELSE 0 END
   AS d1_retained,
  CASE WHEN EXISTS (SELECT 1 FROM activity a WHERE a.player_id = f.player_id AND a.day = d0 + 7) THEN 1 ELSE 0 END
   AS d7_retained,
  CASE WHEN EXISTS (SELECT 1 FROM activity a WHERE a.player_id = f.player_id AND a.day = d0 + 28) THEN 1 ELSE 0 END
   AS d28_retained FROM f""",
)
def retention_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(features.retention_flags(retail.activity(spark, sf_dir), days=(1, 7, 28)))
