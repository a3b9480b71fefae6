"""Recommendations, live metrics, alerts and dashboard roll-ups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_ratio


@dataclass(frozen=True)
class Rule:
    segment: str
    predicate: Column
    action: str
    priority: str


def default_rules() -> list[Rule]:
    """Five cohorts over tier, churn probability, idle days, tutorial and sessions."""
    p, idle = F.col("churn_probability"), F.col("days_since_last_active")
    # Cohort texts and bounds.
    return [
        Rule(
            "High-value at-risk (whales/dolphins, churn_prob > 0.6)",
            F.col("player_tier").isin("whale", "dolphin") & (p > 0.6),
            "VIP personal outreach + exclusive limited-time offers",
            "CRITICAL",
        ),
        Rule(
            "Inactive 3-5 days",
            (idle >= 3) & (idle < 6),
            "Push notification with comeback bonus (free gems/energy)",
            "HIGH",
        ),
        Rule(
            "Tutorial dropoffs (no tutorial completion, sessions > 0)",
            (F.col("tutorial_completed") == 0) & (F.col("total_sessions") > 1),
            "Simplified onboarding flow + tutorial skip option",
            "MEDIUM",
        ),
        Rule(
            "Minnows at risk of churning (low spend, high churn prob)",
            (F.col("player_tier") == "minnow") & (p > 0.7),
            "Targeted discount: 30% off first IAP bundle > $4.99",
            "HIGH",
        ),
        Rule(
            "Engaged non-payers (high sessions, zero spend)",
            (F.col("total_sessions") > 50) & (F.col("is_payer") == 0),
            "Starter pack popup at session milestone (limited offer)",
            "MEDIUM",
        ),
    ]


def recommendations(df: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Cohort size, action and priority per rule, all counted in one scan."""
    rules = default_rules() if rules is None else rules
    counts = df.agg(*[F.count(F.when(r.predicate, 1)).alias(f"_{i}") for i, r in enumerate(rules)])
    rows = [
        F.struct(
            F.lit(i + 1).alias("rule_no"),
            F.lit(r.segment).alias("segment"),
            F.col(f"_{i}").alias("count"),
            F.lit(r.action).alias("action"),
            F.lit(r.priority).alias("priority"),
        )
        for i, r in enumerate(rules)
    ]
    return counts.select(F.inline(F.array(*rows)))


def live_metrics(df: DataFrame) -> DataFrame:
    """Current KPIs in one aggregate: activity, retention, revenue, whales at risk."""

    def share(predicate: Column) -> Column:
        return F.avg(F.coalesce(predicate.cast("int"), F.lit(0)))

    idle, whale = F.col("days_since_last_active"), F.col("player_tier") == "whale"
    sums = df.agg(
        F.count(F.when(idle <= 1, 1)).alias("dau_estimate"),
        F.count(F.when(idle <= 30, 1)).alias("mau_estimate"),
        F.round(F.avg("d1_retained"), 4).alias("d1_retention"),
        F.round(F.avg("d7_retained"), 4).alias("d7_retention"),
        F.round(F.avg("d30_retained"), 4).alias("d30_retention"),
        F.round(F.try_divide(F.sum("total_spend_usd"), F.count("*")), 4).alias("arpu"),
        F.round(F.avg(F.when(F.col("is_payer") == 1, F.col("total_spend_usd"))), 2).alias("arppu"),
        F.round(F.avg("is_payer"), 4).alias("conversion_rate"),
        F.round(100 * share(whale), 3).alias("whale_pct"),
        F.count(F.when(whale & (F.col("churn_probability") > 0.8), 1)).alias("whales_at_critical_risk"),
    )
    return sums.select(
        "dau_estimate",
        "mau_estimate",
        F.round(safe_ratio("dau_estimate", "mau_estimate"), 4).alias("stickiness"),
        *[c for c in sums.columns if c not in ("dau_estimate", "mau_estimate")],
    )


def weekly_kpis(
    activity: DataFrame, is_purchase: Column, key: str = "player_id", ts: str = "ts", value: str = "value"
) -> DataFrame:
    """Active players, revenue and revenue per active player by Monday week.

    Grouped by (week, player) first: no task ever holds a whole week.
    """
    week = F.to_date(F.date_trunc("week", ts)).alias("week")
    per_player = activity.groupBy(week, key).agg(
        F.sum(F.when(is_purchase, F.col(value)).otherwise(0.0)).alias("revenue")
    )
    return (
        per_player.groupBy("week")
        .agg(F.count(key).alias("active"), F.sum("revenue").alias("revenue"))
        .withColumn("arpu", F.try_divide("revenue", "active"))
    )


# Alert thresholds.
THRESHOLDS = {
    "dau_drop_pct": 10,
    "d1_retention_min": 0.35,
    "d7_retention_min": 0.12,
    "arpu_drop_pct": 15,
    "conversion_rate_min": 0.02,
    "whale_churn_count": 5,
}


def alerts(
    metrics: DataFrame, weekly: DataFrame | None = None, thresholds: Mapping[str, float] = THRESHOLDS
) -> DataFrame:
    """Metric, threshold and OK/ALERT per rule.

    Rates must reach their minimum and the whale count must stay below its
    limit. The two drop rules compare the last week with the one before it and
    need ``weekly`` (from ``weekly_kpis``); without a previous week they are OK.
    """

    def row(rule: str, current: Column, ok: Column) -> Column:
        return F.struct(
            F.lit(rule).alias("rule"),
            current.cast("double").alias("current"),
            F.lit(float(thresholds[rule])).alias("threshold"),
            F.when(ok, "OK").otherwise("ALERT").alias("status"),
        )

    def at_least(rule: str, col: str) -> Column:
        return row(rule, F.col(col), F.col(col) >= thresholds[rule])

    out = metrics.select(
        F.inline(
            F.array(
                at_least("d1_retention_min", "d1_retention"),
                at_least("d7_retention_min", "d7_retention"),
                at_least("conversion_rate_min", "conversion_rate"),
                row(
                    "whale_churn_count",
                    F.col("whales_at_critical_risk"),
                    F.col("whales_at_critical_risk") < thresholds["whale_churn_count"],
                ),
            )
        )
    )
    if weekly is None:
        return out
    order = Window.orderBy("week")  # one row per week

    def drop(col: str) -> Column:
        before = F.lag(col).over(order)
        return F.try_divide(100.0 * (before - F.col(col)), before)

    changes = weekly.select("week", drop("active").alias("dau"), drop("arpu").alias("arpu"))
    latest = changes.orderBy(F.desc("week")).limit(1)

    def at_most(rule: str, col: str) -> Column:
        return row(rule, F.col(col), F.coalesce(F.col(col) <= thresholds[rule], F.lit(True)))

    drops = latest.select(F.inline(F.array(at_most("dau_drop_pct", "dau"), at_most("arpu_drop_pct", "arpu"))))
    return out.unionByName(drops)


def weekly_revenue(txns: DataFrame, ts: str = "transaction_date", price: str = "price_usd") -> DataFrame:
    """Revenue per Monday-to-Sunday week."""
    week = F.to_date(F.date_trunc("week", F.col(ts).cast("timestamp"))).alias("week")
    return txns.groupBy(week).agg(F.sum(price).alias("revenue"))


def cohort_heatmap(players: DataFrame, min_size: int = 100) -> DataFrame:
    """Retention per metric and install month, small months dropped; long form."""
    months = (
        players.groupBy(F.date_format("install_date", "yyyy-MM").alias("month"))
        .agg(
            F.count("*").alias("n"),
            F.avg("d1_retained").alias("D1"),
            F.avg("d7_retained").alias("D7"),
            F.avg("d30_retained").alias("D30"),
        )
        .where(F.col("n") >= min_size)
    )
    return months.unpivot(["month", "n"], ["D1", "D7", "D30"], "metric", "retention").select(
        "metric", "month", "n", "retention"
    )


def headline(players: DataFrame, txns: DataFrame) -> DataFrame:
    """Players, payers, payer rate, revenue, transactions."""
    n_txns = txns.agg(F.count("*").alias("n")).scalar()
    return players.agg(
        F.count("*").alias("players"),
        F.sum("is_payer").alias("payers"),
        F.avg("is_payer").alias("payer_rate"),
        F.sum("total_spend_usd").alias("revenue"),
    ).withColumn("transactions", n_txns)
