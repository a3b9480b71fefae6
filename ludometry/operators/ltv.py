"""Horizon LTV targets, LTV regression, and CLV summaries."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import as_date, safe_ratio
from ..session import checkpoint_dir, few_tasks, materialize, side_by_side
from .features import select_features
from .ordering import exact_quantiles

# Horizons and regression features.
HORIZONS = (7, 30, 90)
LTV_FEATURES = [
    "total_sessions",
    "avg_session_minutes",
    "days_active",
    "max_stage_reached",
    "session_frequency",
    "play_intensity",
    "engagement_ratio",
    "tutorial_completed",
    "fb_connected",
    "is_ios",
    "is_high_spend_country",
    "age",
    "d1_retained",
    "d7_retained",
    "d30_retained",
    "num_purchases",
    "total_spend_usd",
    "avg_txn_value",
    "purchase_velocity",
]
# Lifetime totals contain the purchases that make up the target.
LEAKY = ["num_purchases", "total_spend_usd", "avg_txn_value", "purchase_velocity"]


def with_install_date(txns: DataFrame, players: DataFrame, key: str = "player_id") -> DataFrame:
    """Purchases with the player's install date and the days since it."""
    installs = players.select(key, F.to_date("install_date").alias("install_date"))
    return txns.join(installs, key, "left").withColumn(
        "days_from_install", F.datediff("transaction_date", "install_date")
    )


def horizon_ltv(
    txns: DataFrame, players: DataFrame, days: Sequence[int] = HORIZONS, key: str = "player_id"
) -> DataFrame:
    """Spend of each payer within N days of install, day N included, 0 when none.

    Purchases are summed per player and day before the join, so a player with
    very many purchases contributes at most one row per day. Only the upper
    bound is tested: purchases dated before the install count.
    """
    daily = txns.groupBy(key, "transaction_date").agg(F.sum("price_usd").alias("price_usd"))
    payers = players.where(F.col("is_payer") == 1).select(key, "install_date")
    since = F.datediff("transaction_date", "install_date")
    return (
        payers.join(daily, key, "left")
        .groupBy(key)
        .agg(*[F.coalesce(F.sum(F.when(since <= n, F.col("price_usd"))), F.lit(0.0)).alias(f"ltv_{n}d") for n in days])
    )


def hash_split(df: DataFrame, key: str, holdout: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the key: the same split for any partitioning."""
    bucket = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000))
    edge = int(round(holdout * 1_000_000))
    return df.where(bucket >= edge), df.where(bucket < edge)


def vectors(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Kept columns and a ``features`` vector (NULL → 0)."""
    flat = select_features(df, features, keep)
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(flat).select(*keep, "features")


def ltv_model(
    df: DataFrame,
    target: str,
    features: Sequence[str] = tuple(LTV_FEATURES),
    key: str = "player_id",
    trees: int = 200,
    depth: int = 6,
    rate: float = 0.1,
    seed: int = 42,
    exclude_leaky: bool = False,
    params: Mapping[str, object] | None = None,
    split: Callable[[DataFrame, str], tuple[DataFrame, DataFrame]] | None = None,
    fits: int = 1,
):
    """Boosted regression of a horizon target; returns the model, test predictions and the features used.

    ``split`` gives train and test rows, by default ``hash_split``. ``fits`` is
    the number of models that are fitted at the same time.
    """
    checkpoint_dir(df.sparkSession)
    features = [f for f in features if not (exclude_leaky and f in LEAKY)]
    data = vectors(df, features, [key, target])
    train, test = split(data, key) if split else hash_split(data, key, seed=seed)
    model = GBTRegressor(
        labelCol=target,
        featuresCol="features",
        maxIter=trees,
        maxDepth=depth,
        stepSize=rate,
        seed=seed,
        **(params or {"subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}),
    ).fit(few_tasks(train, fits))
    return model, model.transform(test).select(key, F.col(target).alias("label"), "prediction"), features


def ltv_models(df: DataFrame, targets: Sequence[str], **options) -> dict[str, tuple]:
    """``ltv_model`` of each target, all fitted at the same time."""
    options = {"fits": len(targets), **options}
    return side_by_side(df.sparkSession, {t: (lambda t=t: ltv_model(df, t, **options)) for t in targets})


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """RMSE, MAE and R² in one pass.

    The total sum of squares comes from the variance aggregate, which is stable
    for labels far from zero.
    """
    gap = F.col(prediction).cast("double") - F.col(label).cast("double")
    sums = pred.agg(
        F.count(label).alias("n"),
        F.sum(gap * gap).alias("sse"),
        F.avg(F.abs(gap)).alias("mae"),
        F.var_pop(label).alias("var"),
    )
    return sums.select(
        "n",
        F.sqrt(F.try_divide("sse", "n")).alias("rmse"),
        "mae",
        (1 - F.try_divide(F.col("sse"), F.col("var") * F.col("n"))).alias("r2"),
    )


def feature_importance(spark: SparkSession, model, features: Sequence[str], k: int = 10) -> DataFrame:
    """Top ``k`` features by impurity importance."""
    rows = [(f, float(w)) for f, w in zip(features, model.featureImportances.toArray())]
    out = spark.createDataFrame(rows, "feature string, importance double")
    return out.orderBy(F.desc("importance"), "feature").limit(k)


def clv_summary(txns: DataFrame, obs, key: str = "player_id", repeat_only: bool = True) -> DataFrame:
    """Repeat-purchase summary per customer, purchases after ``obs`` left out.

    frequency: purchase days after the first; recency: last − first day; T: end
    − first day; monetary: mean daily spend on repeat days (0 without any).
    """
    daily = (
        txns.where(F.to_date("transaction_date") <= as_date(obs))
        .groupBy(key, F.to_date("transaction_date").alias("day"))
        .agg(F.sum("price_usd").alias("spend"))
    )
    per = daily.groupBy(key).agg(
        (F.count("*") - 1).alias("frequency"),
        F.datediff(F.max("day"), F.min("day")).alias("recency"),
        F.datediff(as_date(obs), F.min("day")).alias("T"),
        F.sum("spend").alias("_all"),
        F.min_by("spend", "day").alias("_first"),
    )
    repeat = F.when(F.col("frequency") > 0, (F.col("_all") - F.col("_first")) / F.col("frequency"))
    out = per.select(key, "frequency", "recency", "T", F.coalesce(repeat, F.lit(0.0)).alias("monetary"))
    return out.where(F.col("frequency") > 0) if repeat_only else out


def simple_clv(rfm_table: DataFrame, days: int = 90) -> DataFrame:
    """Per-player CLV as mean purchase value × purchase rate × days."""
    value = safe_ratio("monetary", "frequency")
    rate = safe_ratio("frequency", "recency")
    return rfm_table.withColumn(f"clv_{days}d", value * rate * F.lit(days))


def clv_averages(df: DataFrame, col: str) -> DataFrame:
    """Mean and exact median of a CLV column, written first since several passes read it."""
    df = materialize(df.select(col))
    (median,) = exact_quantiles(df, col, [0.5])
    return df.agg(
        F.count(col).alias("n_customers"),
        F.avg(col).alias("avg_clv"),
        F.lit(median).cast("double").alias("median_clv"),
    )
