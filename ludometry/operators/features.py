"""Per-player features from the profile and the purchase log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import StringIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import affine, as_date, cut, days_since, flag_eq, flag_in, safe_ratio, weighted_score
from ..session import materialize
from ..sources.schemas import require_columns
from .ordering import exact_quantiles, rank_cuts, rank_score, running_totals, value_score

# High-spend country codes, age bins, retention weights, name patterns to zero-fill.
HIGH_SPEND_COUNTRIES = ["US", "JP", "KR", "UK", "DE", "AU", "CA", "SG", "TW", "FR"]
AGE_BINS = [0, 17, 24, 34, 44, 100]
AGE_LABELS = ["teen", "young_adult", "adult", "middle_aged", "senior"]
RETENTION_WEIGHTS = {"d1_retained": 1, "d7_retained": 3, "d30_retained": 7}
ZERO_FILL_CONTAINS = ["spend_", "revenue", "txn", "rfm", "purchase"]
ZERO_FILL_PREFIXES = ["recency", "frequency", "monetary"]


# ── profile features ────────────────────────────────────────────────────────


def engagement_features(df: DataFrame, obs) -> DataFrame:
    """Days since install and last activity, and four activity ratios."""
    return df.withColumns(
        {
            "days_since_install": days_since("install_date", obs),
            "days_since_last_active": days_since("last_active_date", obs),
        }
    ).withColumns(
        {
            "session_frequency": safe_ratio("total_sessions", "days_since_install"),
            "play_intensity": safe_ratio("total_play_hours", "days_active"),
            "stage_velocity": safe_ratio("max_stage_reached", "days_active"),
            "engagement_ratio": safe_ratio("days_active", "days_since_install"),
        }
    )


def progression_features(df: DataFrame) -> DataFrame:
    """Stages per session and per hour."""
    return df.withColumns(
        {
            "stage_per_session": safe_ratio("max_stage_reached", "total_sessions"),
            "stage_per_hour": safe_ratio("max_stage_reached", "total_play_hours", 0.1),
        }
    )


def revenue_features(df: DataFrame) -> DataFrame:
    """Spend per session, per hour and per active day."""
    return df.withColumns(
        {
            "revenue_per_session": safe_ratio("total_spend_usd", "total_sessions"),
            "revenue_per_hour": safe_ratio("total_spend_usd", "total_play_hours", 0.1),
            "revenue_per_active_day": safe_ratio("total_spend_usd", "days_active"),
        }
    )


def profile_flags(
    df: DataFrame,
    ios: str = "iOS",
    countries: Sequence[str] = HIGH_SPEND_COUNTRIES,
    social: str = "fb_connected",
) -> DataFrame:
    """Platform and country flags, social multiplier, hours to first purchase, age bucket."""
    out = df.withColumns(
        {
            "hours_to_first_purchase": affine("days_to_first_purchase", 24),
            "social_multiplier": affine(social, 0.2, 1),
            "is_ios": flag_eq("platform", ios),
            "is_high_spend_country": flag_in("country", countries),
        }
    )
    if "age" in df.columns:
        out = out.withColumn("age_bucket", cut("age", AGE_BINS, AGE_LABELS))
    return out


def retention_score(df: DataFrame, weights: Mapping[str, float] = RETENTION_WEIGHTS) -> DataFrame:
    return df.withColumn("retention_score", weighted_score(weights))


def churn_label(df: DataFrame, obs, days: int = 7, last_active: str = "last_active_date", out: str = "churned_d7"):
    """1 when the last activity is at least ``days`` before the observation date."""
    return df.withColumn(out, (days_since(last_active, obs) >= days).cast("int"))


def fill_by_pattern(
    df: DataFrame,
    contains: Sequence[str] = tuple(ZERO_FILL_CONTAINS),
    prefixes: Sequence[str] = tuple(ZERO_FILL_PREFIXES),
    value: float = 0,
) -> DataFrame:
    """Fill NULLs in numeric columns whose name matches; dates stay NULL."""

    def matches(name: str) -> bool:
        low = name.lower()
        return any(p in low for p in contains) or any(name.startswith(p) for p in prefixes)

    names = [f.name for f in df.schema if matches(f.name) and isinstance(f.dataType, T.NumericType)]
    return df.fillna(value, subset=names) if names else df


def default_fill(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Replace NULL by a per-column default."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def drop_missing(df: DataFrame, subset: Sequence[str], clip: Mapping[str, float] | None = None) -> DataFrame:
    """Rows with every listed column present; optional lower bounds."""
    out = df.na.drop(subset=list(subset))
    return out.withColumns({c: F.greatest(F.col(c), F.lit(v)) for c, v in (clip or {}).items()})


def select_features(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Feature projection as doubles with NULL → 0; missing columns raise."""
    require_columns(df, [*keep, *names])
    return df.select(
        *keep, *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names if n not in keep]
    )


def round_cols(df: DataFrame, digits: Mapping[str, int]) -> DataFrame:
    """Round reported measures (half up)."""
    return df.withColumns({c: F.round(F.col(c), d) for c, d in digits.items()})


def ordinal_encode(df: DataFrame, cols: Sequence[str], suffix: str = "_enc") -> DataFrame:
    """0-based code of each category in alphabetical order, via ``StringIndexer``."""
    codes = [f"{c}{suffix}" for c in cols]
    indexer = StringIndexer(
        inputCols=list(cols), outputCols=codes, stringOrderType="alphabetAsc", handleInvalid="keep"
    )
    return indexer.fit(df).transform(df).withColumns({c: F.col(c).cast("int") for c in codes})


def topn_dummies(df: DataFrame, col: str, n: int = 8) -> tuple[DataFrame, list[str]]:
    """One 0/1 column for each of the ``n`` most frequent values, and their names."""
    top = df.groupBy(col).count().orderBy(F.desc("count"), col).limit(n).collect()
    names = {f"{col}_{r[col]}": r[col] for r in top if r[col] is not None}
    return df.withColumns({name: flag_eq(col, v) for name, v in names.items()}), list(names)


# ── purchase-log features ───────────────────────────────────────────────────


#: More categories than this are no columns.
MOST_CATEGORIES = 10_000


def _by_item(txns: DataFrame, key: str) -> DataFrame:
    """One row per player, item and category: what every purchase feature is a sum, a count or an end of.

    Distinct items and categories are then counts over groups, so no line is
    multiplied for them, and a player with very many purchases is split by item
    on the way. ``items`` is 1 in one of the rows of each item, so that distinct
    items are a sum further on and the log is read once.
    """
    price = F.col("price_usd")
    grouped = txns.groupBy(key, "item_name", "item_category").agg(
        F.min("transaction_date").alias("first"),
        F.max("transaction_date").alias("last"),
        F.count("transaction_id").alias("n_ids"),
        F.count(price).alias("n"),
        F.sum(price).alias("s"),
        F.avg(price).alias("mean"),
        F.coalesce(F.var_pop(price) * F.count(price), F.lit(0.0)).alias("m2"),
        F.max(price).alias("hi"),
        F.min(price).alias("lo"),
    )
    number = F.row_number().over(Window.partitionBy(key, "item_name").orderBy("item_category"))
    return grouped.withColumn("items", ((number == 1) & F.col("item_name").isNotNull()).cast("long"))


def _by_category(items: DataFrame, key: str) -> DataFrame:
    return items.groupBy(key, "item_category").agg(
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.sum("n_ids").alias("n_ids"),
        F.sum("n").alias("n"),
        F.sum("s").alias("s"),
        F.sum("m2").alias("m2"),
        F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("q"),
        F.max("hi").alias("hi"),
        F.min("lo").alias("lo"),
        F.sum("items").alias("items"),
    )


def _summary_aggs() -> list[Column]:
    n, total = F.sum("n"), F.sum("s")
    spread = F.greatest(F.sum("m2") + F.sum("q") - total * total / n, F.lit(0.0))
    return [
        F.min("first").alias("first_purchase_date"),
        F.max("last").alias("last_purchase_date"),
        F.sum("n_ids").alias("total_txn_count"),
        total.alias("total_revenue"),
        F.try_divide(total, n).alias("avg_txn_value"),
        F.max("hi").alias("max_txn_value"),
        F.min("lo").alias("min_txn_value"),
        F.when(n > 1, F.sqrt(spread / (n - 1))).alias("std_txn_value"),
        F.sum("items").alias("unique_items_purchased"),
        F.count("item_category").alias("unique_categories"),
    ]


def _velocity(df: DataFrame) -> DataFrame:
    span = F.datediff("last_purchase_date", "first_purchase_date") + 1
    return df.withColumn("purchase_span_days", span).withColumn(
        "purchase_velocity", safe_ratio("total_txn_count", "purchase_span_days")
    )


def discover_categories(txns: DataFrame) -> list[str]:
    """The item categories of a purchase log, in order; an error beyond ``MOST_CATEGORIES``."""
    rows = txns.where(F.col("item_category").isNotNull()).select("item_category").distinct().limit(MOST_CATEGORIES + 1)
    found = sorted(r[0] for r in rows.collect())
    if len(found) > MOST_CATEGORIES:
        raise ValueError(f"more than {MOST_CATEGORIES} categories")
    return found


def _category_aggs(categories: Sequence[str]) -> list[Column]:
    return [
        F.sum(F.when(F.col("item_category") == c, F.col("s")).otherwise(0.0)).alias(f"spend_{c}") for c in categories
    ]


def _rfm_aggs(obs) -> list[Column]:
    return [
        F.datediff(as_date(obs), F.max("last")).alias("recency"),
        F.sum("n_ids").alias("frequency"),
        F.sum("s").alias("monetary"),
    ]


def purchase_summary(txns: DataFrame, key: str = "player_id") -> DataFrame:
    """Dates, counts, price statistics and distinct items per player."""
    return _by_category(_by_item(txns, key), key).groupBy(key).agg(*_summary_aggs())


def purchase_velocity(txns: DataFrame, key: str = "player_id") -> DataFrame:
    """Purchase span in days and purchases per day of it."""
    dates = txns.groupBy(key).agg(
        F.min("transaction_date").alias("first_purchase_date"),
        F.max("transaction_date").alias("last_purchase_date"),
        F.count("transaction_id").alias("total_txn_count"),
    )
    return _velocity(dates).select(key, "total_txn_count", "purchase_span_days", "purchase_velocity")


def category_spend(txns: DataFrame, categories: Sequence[str] | None = None, key: str = "player_id") -> DataFrame:
    """Spend per item category as columns, zero when absent.

    Without a list every category of the log gets a column. With one, other
    categories are left out by choice.
    """
    categories = discover_categories(txns) if categories is None else categories
    return _by_category(_by_item(txns, key), key).groupBy(key).agg(*_category_aggs(categories))


def rfm(txns: DataFrame, obs, key: str = "player_id") -> DataFrame:
    """Recency in days, purchase count, total spend per player.

    Purchases after the observation date count and give a negative recency.
    """
    return txns.groupBy(key).agg(
        F.datediff(as_date(obs), F.max("transaction_date")).alias("recency"),
        F.count("transaction_id").alias("frequency"),
        F.sum("price_usd").alias("monetary"),
    )


def rfm_scores(rfm_table: DataFrame, q: int = 5, key: str = "player_id") -> DataFrame:
    """Quantile scores 1..q and the combined score ``100·r + 10·f + m``.

    Recency uses value quantiles, most recent highest. Frequency and monetary
    use ranks with ties split in key order. The cut points are a few literals,
    so scoring itself is a map over the table.
    """
    table = materialize(rfm_table)
    edges = [
        e for e in exact_quantiles(table, "recency", [i / q for i in range(1, q)]) if e is not None
    ]
    cuts = {c: rank_cuts(table, c, key, q) for c in ("frequency", "monetary")}
    return table.withColumns(
        {
            "recency_score": F.lit(q + 1) - value_score("recency", edges),
            "frequency_score": rank_score("frequency", key, cuts["frequency"]),
            "monetary_score": rank_score("monetary", key, cuts["monetary"]),
        }
    ).withColumn(
        "rfm_score", F.col("recency_score") * 100 + F.col("frequency_score") * 10 + F.col("monetary_score")
    )


def player_features(
    players: DataFrame,
    txns: DataFrame,
    obs,
    categories: Sequence[str] | None = None,
    ios: str = "iOS",
    countries: Sequence[str] = HIGH_SPEND_COUNTRIES,
    key: str = "player_id",
) -> DataFrame:
    """The wide feature table: profile features plus all purchase-log features.

    One chain of aggregates over the purchase log and one join, instead of a
    join per feature group. Without a list of categories all are discovered.
    """
    categories = discover_categories(txns) if categories is None else categories
    groups = _by_category(_by_item(txns, key), key)
    per_player = groups.groupBy(key).agg(*_summary_aggs(), *_category_aggs(categories), *_rfm_aggs(obs))
    bought = rfm_scores(_velocity(per_player), key=key)
    wide = players.join(bought, key, "left")
    wide = profile_flags(engagement_features(wide, obs), ios, countries)
    wide = retention_score(revenue_features(progression_features(wide)))
    return fill_by_pattern(wide)


def assemble_features(players: DataFrame, *tables: DataFrame, key: str = "player_id") -> DataFrame:
    """Left-join per-player tables; each must have one row per key."""
    out = players
    for t in tables:
        out = out.join(t, key, "left")
    return out


# ── activity-log features ───────────────────────────────────────────────────


def play_streaks(activity: DataFrame, key: str = "player_id", ts: str = "ts") -> DataFrame:
    """Longest and mean run of consecutive active days per player.

    Events are reduced to distinct days before the window, so the window's
    group size is bounded by the calendar, not by a player's event count.
    """
    days = activity.select(key, F.to_date(ts).alias("day")).distinct()
    order = Window.partitionBy(key).orderBy("day")
    runs = (
        days.withColumn("island", F.date_sub("day", F.row_number().over(order)))
        .groupBy(key, "island")
        .agg(F.count("*").alias("len"))
    )
    return runs.groupBy(key).agg(
        F.max("len").alias("max_play_streak"),
        F.avg("len").alias("avg_play_streak"),
        F.count("*").alias("n_streaks"),
    )


def retention_flags(
    activity: DataFrame, key: str = "player_id", ts: str = "ts", days: Sequence[int] = (1, 7, 30)
) -> DataFrame:
    """1 when the player was active exactly N days after the first active day."""
    seen = activity.select(key, F.to_date(ts).alias("day")).distinct()
    first = F.min("day").over(Window.partitionBy(key))
    since = F.datediff("day", "first_day")
    return (
        seen.withColumn("first_day", first)
        .groupBy(key, "first_day")
        .agg(*[F.max((since == n).cast("int")).alias(f"d{n}_retained") for n in days])
    )
