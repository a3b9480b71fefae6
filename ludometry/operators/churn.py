"""Churn classifiers, scoring, risk bands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import cut
from ..session import checkpoint_dir, few_tasks, materialize, side_by_side
from .funnel import bucket_distribution
from .ltv import vectors
from .places import join_sized, placed

# Classifier features, risk bands.
CHURN_FEATURES = [
    "total_sessions",
    "avg_session_minutes",
    "total_play_hours",
    "days_active",
    "max_stage_reached",
    "session_frequency",
    "play_intensity",
    "engagement_ratio",
    "max_play_streak",
    "stage_velocity",
    "stage_per_session",
    "stage_per_hour",
    "is_payer",
    "total_spend_usd",
    "num_purchases",
    "tutorial_completed",
    "fb_connected",
    "is_ios",
    "is_high_spend_country",
    "age",
    "retention_score",
    "d1_retained",
    "d7_retained",
    "d30_retained",
    "days_since_install",
    "days_since_last_active",
]
RISK_BINS = [0, 0.3, 0.6, 0.8, 1.0]
RISK_LABELS = ["Low", "Medium", "High", "Critical"]
# The label is a threshold on this feature.
LEAKY = ["days_since_last_active"]

# Two tree-growing styles to compare: few coarse bins, or fine bins with a minimum leaf size.
CONFIGS: dict[str, dict[str, object]] = {
    "coarse_bins": {"maxBins": 32, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"},
    "fine_bins": {"maxBins": 255, "minInstancesPerNode": 20, "featureSubsetStrategy": "0.8"},
}


def balanced_weights(train: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Weight positives by negatives ÷ positives."""
    ratio = F.try_divide(
        F.count(F.when(F.col(label) == 0, 1)), F.count(F.when(F.col(label) == 1, 1))
    )
    weight = train.agg(F.coalesce(ratio, F.lit(1.0)).alias("r")).scalar()
    return train.withColumn(out, F.when(F.col(label) == 1, weight).otherwise(F.lit(1.0)))


def train_churn(
    train: DataFrame,
    label: str = "label",
    trees: int = 300,
    depth: int = 6,
    rate: float = 0.1,
    seed: int = 42,
    params: Mapping[str, object] | None = None,
) -> GBTClassificationModel:
    """Class-weighted boosted trees."""
    checkpoint_dir(train.sparkSession)
    weighted = balanced_weights(train, label).cache()
    try:
        return GBTClassifier(
            labelCol=label,
            featuresCol="features",
            weightCol="weight",
            maxIter=trees,
            maxDepth=depth,
            stepSize=rate,
            seed=seed,
            **(params or CONFIGS["coarse_bins"]),
        ).fit(weighted)
    finally:
        weighted.unpersist()


def churn_frame(
    df: DataFrame,
    features: Sequence[str],
    label: str = "churned_d7",
    key: str = "player_id",
    exclude_leaky: bool = False,
) -> tuple[DataFrame, list[str]]:
    """``(key, label, features)`` vectors and the feature names used."""
    names = [f for f in features if not (exclude_leaky and f in LEAKY)]
    data = vectors(df, names, [key, label])
    return data.select(key, F.col(label).cast("double").alias("label"), "features"), names


def split_stratified(
    df: DataFrame, key: str, label: str = "label", holdout: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows; of each class the ``holdout`` share of smallest hash, exact to half a row.

    Rows without a label train. ``key`` identifies a row. Every row gets its
    place in its class from one sort by ranges, whatever the number of classes;
    the last held-out row of each class is then one row of a table that is
    joined by class, so a hot class is neither sorted nor joined in one task.
    """
    own = F.xxhash64(F.col(key), F.lit(seed))
    hashed = materialize(df.where(F.col(label).isNotNull()).select(F.col(label).alias("_class"), own.alias("_h"), F.col(key).alias("_k")))
    ranked = placed(hashed, "_class", ["_h", "_k"])
    take = F.floor(F.lit(holdout) * F.col("total") + 0.5)
    last = F.max(F.when(F.col("place") == take - 1, F.struct("_h", "_k"))).alias("_last")
    ends = ranked.groupBy("_class").agg(F.count("*").alias("_size"), last)
    rows = join_sized(df.withColumn("_class", F.col(label)), ends, ["_class"], "_size", hashed.count())
    held = F.coalesce(F.struct(own.alias("_h"), F.col(key).alias("_k")) <= F.col("_last"), F.lit(False))
    train = rows.where(~held).select(*df.columns).unionByName(df.where(F.col(label).isNull()))
    return train, rows.where(held).select(*df.columns)


def train_configs(train: DataFrame, configs: Mapping[str, Mapping[str, object]] | None = None, **options) -> dict[str, GBTClassificationModel]:
    """A model of each configuration, fitted at the same time on the same rows."""
    configs = configs or CONFIGS
    rows = few_tasks(train, fits=len(configs))
    return side_by_side(
        train.sparkSession,
        {name: (lambda p=params: train_churn(rows, params=p, **options)) for name, params in configs.items()},
    )


def score(data: DataFrame, model: GBTClassificationModel, out: str = "churn_probability") -> DataFrame:
    """Probability and predicted class for every row."""
    scored = model.transform(data)
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("rawPrediction", "probability")


def with_risk(df: DataFrame, prob: str = "churn_probability", out: str = "churn_risk") -> DataFrame:
    """Risk band of each row; a probability of exactly 0 is in no band."""
    return df.withColumn(out, cut(prob, RISK_BINS, RISK_LABELS))


def risk_bands(df: DataFrame, prob: str = "churn_probability", include_lowest: bool = False) -> DataFrame:
    """Rows per risk band in band order, empty bands included."""
    return bucket_distribution(df, prob, RISK_BINS, RISK_LABELS, include_lowest)
