"""Spend tiers, RFM segments, revenue concentration, cluster profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import first_match
from .ordering import exact_quantiles

# Tier names and the spender percentiles where they start.
TIER_CUTS = {"whale": 0.97, "dolphin": 0.80}
LOWEST_TIER = "minnow"
FREE_TIER = "free_rider"


def spend_tiers(
    df: DataFrame,
    spend: str = "total_spend_usd",
    payer: str = "is_payer",
    cuts: Mapping[str, float] = TIER_CUTS,
    out: str = "player_tier",
) -> DataFrame:
    """Tier by exact percentile of spend among spenders; non-payers form their own tier."""
    names = sorted(cuts, key=lambda n: -cuts[n])
    edges = exact_quantiles(df.where(F.col(spend) > 0).select(spend), spend, [cuts[n] for n in names])
    rules: list[tuple[Column, str]] = [(F.col(payer) == 0, FREE_TIER)]
    rules += [(F.col(spend) >= F.lit(e), n) for n, e in zip(names, edges) if e is not None]
    return df.withColumn(out, first_match(rules, LOWEST_TIER))


def rfm_segment_rules(r: str = "recency_score", f: str = "frequency_score", m: str = "monetary_score"):
    """Segment names with their score predicates; the first that holds wins."""
    r, f, m = F.col(r), F.col(f), F.col(m)
    # Segment names and score bounds.
    return [
        ((r >= 4) & (f >= 4) & (m >= 4), "Champions"),
        ((r >= 3) & (f >= 3) & (m >= 4), "Loyal Whales"),
        ((r >= 4) & (f <= 2), "New Payers"),
        ((r <= 2) & (f >= 3), "At Risk High Value"),
        ((r <= 2) & (f <= 2) & (m >= 3), "Lapsed Whales"),
        ((r >= 3) & (m <= 2), "Low Spend Active"),
        (r <= 2, "Churning"),
    ]


OTHER_SEGMENT = "Potential Loyalists"
NO_SEGMENT = "Free Player"


def rfm_segments(scored: DataFrame, out: str = "rfm_segment") -> DataFrame:
    """Segment of each scored payer."""
    return scored.withColumn(out, first_match(rfm_segment_rules(), OTHER_SEGMENT))


def with_segments(players: DataFrame, scored: DataFrame, key: str = "player_id") -> DataFrame:
    """Players with their RFM segment; players without purchases get the default."""
    segments = rfm_segments(scored).select(key, "rfm_segment")
    return players.join(segments, key, "left").withColumn(
        "rfm_segment", F.coalesce("rfm_segment", F.lit(NO_SEGMENT))
    )


def tier_revenue(df: DataFrame, tier: str = "player_tier", spend: str = "total_spend_usd") -> DataFrame:
    """Players, revenue, mean spend and both shares per tier, free tier included."""
    base = df.groupBy(tier).agg(
        F.count("*").alias("n_players"),
        F.sum(spend).alias("total_rev"),
        F.avg(spend).alias("avg_rev"),
    )
    everything = Window.partitionBy()  # one row per tier
    return base.select(
        "*",
        F.round(F.try_divide(100.0 * F.col("n_players"), F.sum("n_players").over(everything)), 2).alias("pct_players"),
        F.round(F.try_divide(100.0 * F.col("total_rev"), F.sum("total_rev").over(everything)), 2).alias("pct_revenue"),
    )


def pareto(tiers: DataFrame) -> DataFrame:
    """Revenue-bearing tiers, highest revenue first."""
    return (
        tiers.where(F.col("total_rev") > 0)
        .orderBy(F.desc("total_rev"))
        .select("player_tier", "total_rev", "pct_revenue", "pct_players")
    )


# Profile names and the columns they average.
PROFILE_MEANS = {
    "avg_sessions": "total_sessions",
    "avg_spend": "total_spend_usd",
    "payer_rate": "is_payer",
    "avg_retention_d7": "d7_retained",
    "avg_stage": "max_stage_reached",
    "avg_engagement": "engagement_ratio",
}


def cluster_profiles(
    df: DataFrame, cluster: str = "kmeans_cluster", means: Mapping[str, str] = PROFILE_MEANS, digits: int = 3
) -> DataFrame:
    """Size and mean measures per cluster."""
    return df.groupBy(cluster).agg(
        F.count("*").alias("count"),
        *[F.round(F.avg(c), digits).alias(n) for n, c in means.items()],
    )


def segment_counts(df: DataFrame, col: str, ascending: bool = True) -> DataFrame:
    """Group sizes in size order."""
    n = F.col("n")
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(n.asc() if ascending else n.desc(), col)


def filter_in(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Rows whose value is one of the chosen ones."""
    return df.where(F.col(col).isin(list(values)))
