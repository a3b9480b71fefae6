"""Scoring of binary predictions: ranking quality, confusion, per-class report."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import running_totals
from .places import WINDOW


def auc_ap(
    pred: DataFrame, label: str = "label", score: str = "score", most: int = WINDOW
) -> DataFrame:
    """Exact ROC-AUC and average precision.

    Rows are counted per distinct score, and running counts over the score
    order give both measures: AUC as the share of (positive, negative) pairs in
    the right order, ties one half; average precision as the step sum of
    precision over recall gains.
    """
    hist = (
        pred.where(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(
            F.count(F.when(F.col(label) == 1, 1)).alias("pos"),
            F.count(F.when(F.col(label) == 0, 1)).alias("neg"),
        )
    )
    run = running_totals(hist, ["score"], {"pos_below": "pos", "neg_below": "neg"}, most)
    totals = run.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n")).alias("t")).scalar()
    rows = run.withColumn("_t", totals)
    hits = (F.col("_t.p") - F.col("pos_below")).cast("double")
    shown = hits + F.col("_t.n") - F.col("neg_below")
    return rows.agg(
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        F.sum(F.col("pos") * (F.col("neg_below").cast("double") + F.col("neg") / 2)).alias("_u"),
        F.sum(F.col("pos") * F.try_divide(hits, shown)).alias("_s"),
    ).select(
        "n_pos",
        "n_neg",
        F.try_divide(F.col("_u"), F.col("n_pos").cast("double") * F.col("n_neg")).alias("auc"),
        F.try_divide("_s", "n_pos").alias("ap"),
    )


def compare_models(preds: Mapping[str, DataFrame], label: str = "label", score: str = "score") -> DataFrame:
    """AUC and AP per model, the best by AUC marked; on a tie the first one wins."""
    out = None
    for i, (name, pred) in enumerate(preds.items()):
        row = auc_ap(pred, label, score).select(F.lit(i).alias("model_no"), F.lit(name).alias("model"), "auc", "ap")
        out = row if out is None else out.unionByName(row)
    best = out.agg(F.min_by("model_no", F.struct(-F.col("auc"), "model_no")).alias("b")).scalar()
    return out.withColumn("is_best", F.col("model_no") == best)


def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts per (label, prediction)."""
    return pred.groupBy(F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")).agg(
        F.count("*").alias("n")
    )


def classification_report(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class (0 where undefined)."""
    cells = confusion(pred, label, prediction)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), zero.alias("predicted"), hit.alias("tp")),
        F.struct(F.col("prediction").alias("class"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp")),
    )
    sums = cells.select(F.inline(sides)).groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp")
    )
    precision = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    both = precision + recall
    return sums.select(
        "class",
        precision.alias("precision"),
        recall.alias("recall"),
        F.when(both > 0, 2 * precision * recall / both).otherwise(0.0).alias("f1"),
        "support",
    )
