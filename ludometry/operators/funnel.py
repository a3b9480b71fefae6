"""Conversion funnel, time to convert, contingency tests, conversion drivers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import cut
from ..functions.special import chi2_sf
from .features import ordinal_encode, select_features, topn_dummies
from .ordering import exact_quantiles


def funnel_stages() -> dict[str, Column]:
    """The eight stages. They are independent predicates, not nested steps."""
    # Stage names and bounds.
    return {
        "Install": F.lit(True),
        "Tutorial Complete": F.col("tutorial_completed") == 1,
        "D1 Retained": F.col("d1_retained") == 1,
        "D7 Retained": F.col("d7_retained") == 1,
        "D30 Retained": F.col("d30_retained") == 1,
        "First IAP": F.col("is_payer") == 1,
        "Repeat Purchaser (2+)": F.col("num_purchases") >= 2,
        "High Value (5+ purchases)": F.col("num_purchases") >= 5,
    }


def stage_counts(df: DataFrame, stages: Mapping[str, Column]) -> DataFrame:
    """``(stage_no, stage, n)`` from one conditional aggregate."""
    counts = df.agg(*[F.count(F.when(p, 1)).alias(f"_{i}") for i, p in enumerate(stages.values())])
    rows = F.array(
        *[
            F.struct(F.lit(i + 1).alias("stage_no"), F.lit(s).alias("stage"), F.col(f"_{i}").alias("n"))
            for i, s in enumerate(stages)
        ]
    )
    return counts.select(F.inline(rows))


def funnel(df: DataFrame, stages: Mapping[str, Column] | None = None) -> DataFrame:
    """Count, share of the first stage, share of the previous stage, drop-off.

    Shares of the previous stage can exceed 100 because stages are independent.
    """
    counts = stage_counts(df, stages or funnel_stages())
    order = Window.orderBy("stage_no")  # one row per stage
    first, prev = F.first("n").over(order), F.lag("n").over(order)
    of_prev = F.when(F.coalesce(prev, F.lit(0)) == 0, F.lit(100.0)).otherwise(100.0 * F.col("n") / prev)
    return counts.select(
        "stage_no",
        "stage",
        F.col("n").alias("count"),
        F.round(F.try_divide(100.0 * F.col("n"), first), 2).alias("pct_of_install"),
        F.round(of_prev, 2).alias("pct_of_previous"),
        F.round(F.when(F.coalesce(prev, F.lit(0)) == 0, F.lit(0.0)).otherwise(100.0 - of_prev), 2).alias(
            "dropoff_rate"
        ),
    )


def dropoffs(funnel_table: DataFrame) -> DataFrame:
    """Stages that lose players."""
    return funnel_table.where(F.col("dropoff_rate") > 0)


# Day bins and their labels.
CONVERT_BINS = [0, 1, 3, 7, 14, 30, 90, float("inf")]
CONVERT_LABELS = ["Day 0-1", "Day 2-3", "Day 4-7", "Day 8-14", "Day 15-30", "Day 31-90", "Day 91+"]


def time_to_convert(
    df: DataFrame, col: str = "days_to_first_purchase", payer: str = "is_payer"
) -> DataFrame:
    """Median, mean and quartiles of days to first purchase among payers."""
    paid = df.where((F.col(payer) == 1) & F.col(col).isNotNull())
    p25, p50, p75, p90 = exact_quantiles(paid, col, [0.25, 0.5, 0.75, 0.9])
    return paid.agg(
        F.count("*").alias("n"),
        F.lit(p50).cast("double").alias("median_days"),
        F.avg(col).alias("mean_days"),
        F.lit(p25).cast("double").alias("p25_days"),
        F.lit(p75).cast("double").alias("p75_days"),
        F.lit(p90).cast("double").alias("p90_days"),
    )


def bucket_distribution(
    df: DataFrame,
    col: str,
    bins: Sequence[float],
    labels: Sequence[str],
    include_lowest: bool = False,
) -> DataFrame:
    """Row count per right-closed bin in bin order, empty bins included.

    The lowest edge is open by default, so a value equal to it is in no bin.
    The last row, ``unbinned``, counts the rows of no bin, NULLs included, so
    the counts sum to the rows.
    """
    bin_of = cut(col, bins, labels, include_lowest)
    stages = {label: bin_of == label for label in labels} | {"unbinned": bin_of.isNull()}
    counts = stage_counts(df, stages)
    return counts.select(F.col("stage_no").alias("bucket_no"), F.col("stage").alias("bucket"), "n")


def conversion_by(
    df: DataFrame, dim: str, limit: int | None = None, payer: str = "is_payer"
) -> DataFrame:
    """Conversion rate and size per value; ``limit`` keeps the best-converting ones."""
    out = df.where(F.col(dim).isNotNull()).groupBy(dim).agg(
        F.avg(payer).alias("conversion_rate"), F.count(payer).alias("n_players")
    )
    return out.orderBy(F.desc("conversion_rate"), dim).limit(limit) if limit else out


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long-form contingency table."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))


def chi2_tests(df: DataFrame, features: Sequence[str], target: str, yates: bool = True) -> DataFrame:
    """Chi-squared independence of each feature and ``target``.

    All tables come from one scan: features are unpivoted and counted together,
    with the partial aggregate on the map side. χ² = N(Σ O²/(R·C) − 1) needs no
    rows for empty cells. For a 2×2 table the continuity correction lowers each
    |O − E| by at most 0.5; |O − E| is the same in all four cells.
    """
    long = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f).alias("feature"),
                        F.col(f).cast("string").alias("level"),
                        F.col(target).cast("string").alias("outcome"),
                    )
                    for f in features
                ]
            )
        )
    ).where(F.col("level").isNotNull() & F.col("outcome").isNotNull())
    cells = long.groupBy("feature", "level", "outcome").agg(F.count("*").alias("o"))
    rows = cells.groupBy("feature", "level").agg(F.sum("o").alias("r"))
    cols = cells.groupBy("feature", "outcome").agg(F.sum("o").alias("c"))
    total = rows.groupBy("feature").agg(
        F.sum("r").alias("n"), F.count("*").alias("n_r"), F.sum(1 / F.col("r")).alias("inv_r")
    )
    total_c = cols.groupBy("feature").agg(F.count("*").alias("n_c"), F.sum(1 / F.col("c")).alias("inv_c"))
    terms = (
        cells.join(rows, ["feature", "level"])
        .join(cols, ["feature", "outcome"])
        .join(total, "feature")
        .join(total_c, "feature")
    )
    ratio = F.col("o") / F.col("r") * F.col("o") / F.col("c")
    gap = F.abs(F.col("o") - F.col("r") * F.col("c") / F.col("n"))
    stats = terms.groupBy("feature").agg(
        F.first("n").alias("n"),
        ((F.first("n_r") - 1) * (F.first("n_c") - 1)).cast("int").alias("dof"),
        (F.first("n") * (F.sum(ratio) - 1)).alias("plain"),
        F.max(gap).alias("gap"),
        (F.first("n") * F.first("inv_r") * F.first("inv_c")).alias("inv_e"),
    )
    corrected = F.pow(F.col("gap") - F.least(F.lit(0.5), F.col("gap")), 2) * F.col("inv_e")
    use = (F.col("dof") == 1) & F.lit(yates)
    chi2 = F.when(F.col("dof") == 0, F.lit(0.0)).when(use, corrected).otherwise(F.greatest("plain", F.lit(0.0)))
    out = stats.select("feature", "n", "dof", chi2.alias("chi2"))
    return out.withColumn("p_value", chi2_sf("chi2", F.col("dof").cast("double"))).withColumn(
        "significant", F.col("p_value") < 0.05
    )


# Numeric drivers used next to the encoded platform, gender and countries.
DRIVER_NUMERIC = [
    "age",
    "tutorial_completed",
    "d1_retained",
    "fb_connected",
    "total_sessions",
    "max_stage_reached",
]


def driver_features(
    df: DataFrame,
    encode: Sequence[str] = ("platform", "gender"),
    numeric: Sequence[str] = tuple(DRIVER_NUMERIC),
    dummies: str = "country",
    n_dummies: int = 8,
) -> tuple[DataFrame, list[str]]:
    """Encoded categories, numeric columns and top-value dummies, with their names."""
    coded = ordinal_encode(df, encode)
    wide, names = topn_dummies(coded, dummies, n_dummies)
    return wide, [f"{c}_enc" for c in encode] + list(numeric) + names


def conversion_drivers(
    df: DataFrame, features: Sequence[str], target: str = "is_payer", c: float = 1.0, max_iter: int = 1000
) -> DataFrame:
    """L2-penalised logistic regression: coefficient, odds ratio, accuracy.

    ``c`` is the inverse penalty on the summed loss. MLlib averages the loss
    over rows, hence ``regParam = 1 / (c·n)``.
    """
    data = select_features(df, features, keep=[target])
    data = VectorAssembler(inputCols=list(features), outputCol="features").transform(data)
    data = data.select(F.col(target).cast("double").alias("label"), "features").cache()
    try:
        model = LogisticRegression(
            maxIter=max_iter, regParam=1.0 / (c * max(data.count(), 1)), elasticNetParam=0.0, standardization=False
        ).fit(data)
        accuracy = model.summary.accuracy
    finally:
        data.unpersist()
    rows = [(f, float(b), accuracy) for f, b in zip(features, model.coefficients)]
    coefs = df.sparkSession.createDataFrame(rows, "feature string, coefficient double, accuracy double")
    return coefs.select(
        "feature", "coefficient", F.exp("coefficient").alias("odds_ratio"), "accuracy"
    ).orderBy(F.desc("coefficient"))


def driver_terms(
    df: DataFrame, features: Sequence[str], intercept: float, beta: Sequence[float], target: str = "is_payer", c: float = 1.0
) -> DataFrame:
    """``term, value``: the penalised log likelihood of ``conversion_drivers`` and its slopes, at given coefficients.

    One aggregate over the rows. The intercept is not penalised.
    """
    data = select_features(df, features, keep=[target])
    z = F.lit(float(intercept))
    for name, b in zip(features, beta):
        z = z + F.col(name) * F.lit(float(b))
    y = F.col(target).cast("double")
    gap = y - 1 / (1 + F.exp(-z))
    # ln(1 + e^z) without overflow.
    value = y * z - F.greatest(z, F.lit(0.0)) - F.log1p(F.exp(-F.abs(z)))
    row = data.agg(
        (F.sum(value) - F.lit(sum(b * b for b in beta) / (2 * c))).alias("log_likelihood"),
        F.sum(gap).alias("intercept"),
        *[(F.sum(gap * F.col(name)) - F.lit(b / c)).alias(f"_{i}") for i, (name, b) in enumerate(zip(features, beta))],
    )
    named = [("log_likelihood", "log_likelihood"), ("intercept", "intercept"), *((name, f"_{i}") for i, name in enumerate(features))]
    terms = F.array(*[F.struct(F.lit(n).alias("term"), F.col(c).alias("value")) for n, c in named])
    return row.select(F.inline(terms))
