"""Views, roll-ups and headline numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import liveops, ordering, segments
from ..sources import retail, views
from .oracle_tables import ACTIVITY, BOTH, OBS, PLAYERS, TXNS
from .registry import query, tidy


@query(
    "daily_kpis",
    PLAYERS
    + """
 SELECT CAST(last_active_date AS VARCHAR) AS activity_date, count(DISTINCT player_id) AS dau,
   count(DISTINCT CASE WHEN is_payer = 1 THEN player_id END) AS paying_dau,
   round(sum(total_spend_usd), 4) AS daily_revenue, round(avg(total_sessions), 6) AS avg_sessions,
   round(avg(avg_session_minutes), 6) AS avg_session_length
 FROM players GROUP BY last_active_date""",
)
def daily_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(views.daily_kpis(retail.players_untiered(spark, sf_dir)), daily_revenue=4)


@query(
    "cohort_retention_week",
    PLAYERS
    + """
 SELECT CAST(CAST(date_trunc('week', install_date) AS DATE) AS VARCHAR) AS cohort_week,
   count(DISTINCT player_id) AS cohort_size, round(avg(d1_retained), 6) AS d1_retention,
   round(avg(d7_retained), 6) AS d7_retention, round(avg(d30_retained), 6) AS d30_retention,
   round(avg(CASE WHEN is_payer = 1 THEN total_spend_usd END) + 1e-8, 6) AS arppu,
   round(sum(total_spend_usd) / count(DISTINCT player_id) + 1e-8, 6) AS arpu
 FROM players GROUP BY date_trunc('week', install_date)""",
)
def cohort_retention_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(views.cohort_retention(retail.players_untiered(spark, sf_dir), "week"), averages=["arppu", "arpu"])


@query(
    "whale_segments",
    PLAYERS
    + """
 SELECT player_tier, count(*) AS player_count,
   CAST(round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS DOUBLE) AS pct_players,
   round(sum(total_spend_usd), 4) AS total_revenue,
   round(100.0 * sum(total_spend_usd) / sum(sum(total_spend_usd)) OVER (), 2) AS pct_revenue,
   round(avg(total_spend_usd) + 1e-8, 6) AS avg_spend, round(avg(total_sessions), 6) AS avg_sessions,
   round(avg(days_active), 6) AS avg_days_active, round(avg(max_stage_reached), 6) AS avg_max_stage
 FROM players WHERE is_payer = 1 GROUP BY player_tier""",
)
def whale_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(views.tier_segments(retail.players(spark, sf_dir)), averages=["avg_spend"], total_revenue=4)


_FUNNEL_VIEW = (
    PLAYERS
    + """
 SELECT 'install' AS stage, count(*) AS players FROM players
 UNION ALL SELECT 'tutorial_complete', count(*) FROM players WHERE tutorial_completed = 1
 UNION ALL SELECT 'd1_retained', count(*) FROM players WHERE d1_retained = 1
 UNION ALL SELECT 'd7_retained', count(*) FROM players WHERE d7_retained = 1
 UNION ALL SELECT 'first_iap', count(*) FROM players WHERE is_payer = 1
 UNION ALL SELECT 'repeat_purchaser', count(*) FROM players WHERE num_purchases >= 2"""
)


@query("funnel_view", _FUNNEL_VIEW)
def funnel_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(views.conversion_funnel_view(retail.players_untiered(spark, sf_dir)))


@query(
    "registered_views",
    PLAYERS
    + """
 SELECT 'vw_daily_kpis' AS view, count(DISTINCT last_active_date) AS n, round(sum(total_spend_usd), 2) AS total FROM players
 UNION ALL SELECT 'vw_cohort_retention', count(DISTINCT date_trunc('week', install_date)), count(*) FROM players
 UNION ALL SELECT 'vw_whale_segments', count(DISTINCT player_tier), round(sum(total_spend_usd), 2) FROM players WHERE is_payer = 1
 UNION ALL SELECT 'vw_conversion_funnel', 6, count(*) + sum(tutorial_completed) + sum(d1_retained) + sum(d7_retained)
  + sum(is_payer) + count(*) FILTER (WHERE num_purchases >= 2) FROM players""",
)
def registered_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four views through ``spark.sql`` after registration: their rows and the sum of one column."""
    views.register_views(spark, retail.players(spark, sf_dir))
    columns = {"daily_kpis": "daily_revenue", "cohort_retention": "cohort_size", "whale_segments": "total_revenue", "conversion_funnel": "players"}
    parts = [f"SELECT 'vw_{v}' AS view, count(*) AS n, CAST(sum({c}) AS DOUBLE) AS total FROM vw_{v}" for v, c in columns.items()]
    return tidy(spark.sql(" UNION ALL ".join(parts)), 2)


@query(
    "weekly_revenue",
    TXNS
    + """
 SELECT CAST(CAST(date_trunc('week', transaction_date) AS DATE) AS VARCHAR) AS week,
   round(sum(price_usd), 4) AS revenue
 FROM transactions GROUP BY date_trunc('week', transaction_date)""",
)
def weekly_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(liveops.weekly_revenue(retail.transactions(spark, sf_dir)), 4)


@query(
    "cohort_heatmap",
    PLAYERS
    + """,
 months AS (
  SELECT strftime(install_date, '%Y-%m') AS month, count(*) AS n, avg(d1_retained) AS d1, avg(d7_retained) AS d7,
    avg(d30_retained) AS d30 FROM players GROUP BY 1 HAVING count(*) >= 20)
 SELECT metric, month, n, round(retention, 6) AS retention FROM (
  SELECT 'D1' AS metric, month, n, d1 AS retention FROM months
  UNION ALL SELECT 'D7', month, n, d7 FROM months
  UNION ALL SELECT 'D30', month, n, d30 FROM months)""",
)
def cohort_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(liveops.cohort_heatmap(retail.players_untiered(spark, sf_dir), min_size=20))


@query(
    "cohort_heatmap_filtered",
    PLAYERS
    + """,
 months AS (
  SELECT strftime(install_date, '%Y-%m') AS month, count(*) AS n, avg(d1_retained) AS d1, avg(d7_retained) AS d7,
    avg(d30_retained) AS d30 FROM players WHERE platform IN ('BUILDING', 'MACHINERY')
  GROUP BY 1 HAVING count(*) >= 5)
 SELECT metric, month, n, round(retention, 6) AS retention FROM (
  SELECT 'D1' AS metric, month, n, d1 AS retention FROM months
  UNION ALL SELECT 'D7', month, n, d7 FROM months
  UNION ALL SELECT 'D30', month, n, d30 FROM months)""",
)
def cohort_heatmap_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = segments.filter_in(retail.players_untiered(spark, sf_dir), "platform", ["BUILDING", "MACHINERY"])
    return tidy(liveops.cohort_heatmap(chosen, min_size=5))


@query(
    "headline",
    BOTH
    + """
 SELECT count(*) AS players, CAST(sum(is_payer) AS BIGINT) AS payers, round(avg(is_payer), 6) AS payer_rate,
   round(sum(total_spend_usd), 4) AS revenue, (SELECT count(*) FROM transactions) AS transactions
 FROM players""",
)
def headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(
        liveops.headline(retail.players_untiered(spark, sf_dir), retail.transactions(spark, sf_dir)), revenue=4
    )


_TIERS = """,
 tiers AS (
  SELECT player_tier, count(*) AS n_players, sum(total_spend_usd) AS total_rev, avg(total_spend_usd) AS avg_rev
  FROM players GROUP BY player_tier),
 tier_shares AS (
  SELECT *, CAST(round(100.0 * n_players / (SELECT sum(n_players) FROM tiers), 2) AS DOUBLE) AS pct_players,
    round(100.0 * total_rev / (SELECT sum(total_rev) FROM tiers), 2) AS pct_revenue FROM tiers)"""


@query(
    "tier_revenue",
    PLAYERS
    + _TIERS
    + """
 SELECT player_tier, n_players, round(total_rev, 4) AS total_rev, round(avg_rev + 1e-8, 6) AS avg_rev, pct_players,
   pct_revenue FROM tier_shares""",
)
def tier_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(segments.tier_revenue(retail.players(spark, sf_dir)), averages=["avg_rev"], total_rev=4)


@query(
    "pareto",
    PLAYERS
    + _TIERS
    + """
 SELECT player_tier, round(total_rev, 4) AS total_rev, pct_revenue, pct_players FROM tier_shares
 WHERE total_rev > 0 ORDER BY total_rev DESC""",
)
def pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(segments.pareto(segments.tier_revenue(retail.players(spark, sf_dir))), 4)


@query(
    "spend_tiers",
    PLAYERS + " SELECT player_id, is_payer, round(total_spend_usd, 4) AS total_spend_usd, player_tier FROM players",
)
def spend_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiered = retail.players(spark, sf_dir)
    return tidy(tiered.select("player_id", "is_payer", "total_spend_usd", "player_tier"), 4)


@query(
    "share_of_total",
    PLAYERS
    + """
 SELECT player_id, round(1e6 * total_spend_usd / (SELECT sum(total_spend_usd) FROM players), 4) AS ppm
 FROM players""",
)
def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    spend = retail.players_untiered(spark, sf_dir).select("player_id", "total_spend_usd")
    return tidy(ordering.share_of_total(spend, "total_spend_usd", "ppm", 1e6).select("player_id", "ppm"), 4)


@query("value_counts", PLAYERS + " SELECT country, count(*) AS n FROM players GROUP BY country")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ordering.value_counts(retail.players_untiered(spark, sf_dir), "country"))


@query(
    "top_k",
    PLAYERS
    + """
 SELECT player_id, round(total_spend_usd, 4) AS total_spend_usd FROM players
 ORDER BY players.total_spend_usd DESC, player_id LIMIT 15""",
)
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    spend = retail.players_untiered(spark, sf_dir).select("player_id", "total_spend_usd")
    return tidy(ordering.top_k(spend, "total_spend_usd", 15, ["player_id"]), 4)


@query("distinct_values", PLAYERS + " SELECT DISTINCT platform FROM players")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.distinct_values(retail.players_untiered(spark, sf_dir), "platform")


@query(
    "segment_counts",
    PLAYERS + " SELECT player_tier, count(*) AS n FROM players GROUP BY player_tier",
)
def segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(segments.segment_counts(retail.players(spark, sf_dir), "player_tier"))


@query("sample_n")
def sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.sample_n(retail.players_untiered(spark, sf_dir), 100, "player_id")


@query(
    "sample_n_counts",
    PLAYERS + " SELECT least(100, count(*)) AS n, least(100, count(*)) AS distinct_players, least(100, count(*)) AS known FROM players",
)
def sample_n_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample has as many rows as asked for, no row twice, and only rows of the table."""
    players = retail.players_untiered(spark, sf_dir).select("player_id")
    drawn = ordering.sample_n(players, 100, "player_id")
    known = drawn.join(players.withColumn("_in", F.lit(1)), "player_id", "left")
    return tidy(known.agg(F.count("*").alias("n"), F.countDistinct("player_id").alias("distinct_players"), F.count("_in").alias("known")))


# A score that is the same on both engines stands in for a model's probability.
_SCORE = f"least(({OBS} - last_active_date) / 400.0, 1.0)"


def scored_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.datediff(F.to_date(F.lit(retail.OBS)), "last_active_date")
    return retail.players(spark, sf_dir).withColumns(
        {"days_since_last_active": days, "churn_probability": F.least(days / F.lit(400.0), F.lit(1.0))}
    )


@query(
    "recommendations",
    PLAYERS
    + f""",
 s AS (SELECT *, {_SCORE} AS p, {OBS} - last_active_date AS idle FROM players),
 r AS (
  SELECT 1 AS rule_no, 'CRITICAL' AS priority, count(*) AS n FROM s WHERE player_tier IN ('whale', 'dolphin')
    AND p > 0.6
  UNION ALL SELECT 2, 'HIGH', count(*) FROM s WHERE idle >= 3 AND idle < 6
  UNION ALL SELECT 3, 'MEDIUM', count(*) FROM s WHERE tutorial_completed = 0 AND total_sessions > 1
  UNION ALL SELECT 4, 'HIGH', count(*) FROM s WHERE player_tier = 'minnow' AND p > 0.7
  UNION ALL SELECT 5, 'MEDIUM', count(*) FROM s WHERE total_sessions > 50 AND is_payer = 0)
 SELECT CAST(rule_no AS BIGINT) AS rule_no, priority, n AS count FROM r""",
)
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(liveops.recommendations(scored_players(spark, sf_dir)).select("rule_no", "priority", "count"))


_METRICS = f""",
 s AS (SELECT *, {_SCORE} AS p, {OBS} - last_active_date AS idle FROM players),
 m AS (
  SELECT count(*) FILTER (WHERE idle <= 1) AS dau_estimate, count(*) FILTER (WHERE idle <= 30) AS mau_estimate,
   round(count(*) FILTER (WHERE idle <= 1) / greatest(count(*) FILTER (WHERE idle <= 30), 1), 4) AS stickiness,
   round(avg(d1_retained), 4) AS d1_retention, round(avg(d7_retained), 4) AS d7_retention,
   round(avg(d30_retained), 4) AS d30_retention, round(sum(total_spend_usd) / count(*), 4) AS arpu,
   round(avg(total_spend_usd) FILTER (WHERE is_payer = 1), 2) AS arppu, round(avg(is_payer), 4) AS conversion_rate,
   round(100.0 * count(*) FILTER (WHERE player_tier = 'whale') / CAST(count(*) AS DOUBLE), 3) AS whale_pct,
   count(*) FILTER (WHERE player_tier = 'whale' AND p > 0.8) AS whales_at_critical_risk FROM s)"""


@query("live_metrics", PLAYERS + _METRICS + " SELECT * FROM m")
def live_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(liveops.live_metrics(scored_players(spark, sf_dir)))


@query(
    "alerts",
    PLAYERS
    + _METRICS
    + """,
 wk AS (
  SELECT date_trunc('week', ts) AS w, count(DISTINCT user_id) AS dau,
   sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) / count(DISTINCT user_id) AS arpu
  FROM events GROUP BY 1),
 last2 AS (
  SELECT w, dau, arpu, lag(dau) OVER (ORDER BY w) AS pdau, lag(arpu) OVER (ORDER BY w) AS parpu FROM wk),
 drops AS (SELECT 100.0 * (pdau - dau) / pdau AS dau_drop, 100.0 * (parpu - arpu) / parpu AS arpu_drop
  FROM last2 WHERE w = (SELECT max(w) FROM wk)),
 a AS (
  SELECT 'd1_retention_min' AS rule, d1_retention AS current, 0.35 AS threshold, d1_retention >= 0.35 AS ok FROM m
  UNION ALL SELECT 'd7_retention_min', d7_retention, 0.12, d7_retention >= 0.12 FROM m
  UNION ALL SELECT 'conversion_rate_min', conversion_rate, 0.02, conversion_rate >= 0.02 FROM m
  UNION ALL SELECT 'whale_churn_count', whales_at_critical_risk, 5, whales_at_critical_risk < 5 FROM m
  UNION ALL SELECT 'dau_drop_pct', dau_drop, 10, dau_drop <= 10 FROM drops
  UNION ALL SELECT 'arpu_drop_pct', arpu_drop, 15, arpu_drop <= 15 FROM drops)
 SELECT rule, round(CAST(current AS DOUBLE), 6) AS current, CAST(threshold AS DOUBLE) AS threshold,
  CASE WHEN ok THEN 'OK' ELSE 'ALERT' END AS status FROM a""",
)
def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = liveops.live_metrics(scored_players(spark, sf_dir))
    weekly = liveops.weekly_kpis(retail.activity(spark, sf_dir), F.col("event_type") == "purchase")
    return tidy(liveops.alerts(metrics, weekly))


@query(
    "weekly_kpis",
    ACTIVITY
    + """
 SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week, count(DISTINCT player_id) AS active,
  round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 4) AS revenue,
  round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) / count(DISTINCT player_id), 6) AS arpu
 FROM activity GROUP BY date_trunc('week', ts)""",
)
def weekly_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(
        liveops.weekly_kpis(retail.activity(spark, sf_dir), F.col("event_type") == "purchase"), revenue=4
    )
