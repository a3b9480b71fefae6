"""Bootstrap intervals and Bayesian comparison of two arms.

Units are never resampled row by row on one machine. They are collapsed to
(arm, value, count), and blocks of values or draws are what Spark distributes.
Random streams are keyed by block, so results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

_BLOCK = 1000
#: Distinct values that one generator serves, and replicates drawn at once.
_VALUES, _REPLICATES = 1024, 250


def bootstrap_ci(
    df: DataFrame, arm: str, a, b, metric: str, n_boot: int = 10_000, seed: int = 42, level: float = 0.95
) -> DataFrame:
    """Percentile interval of the difference of means, arm ``a`` minus ``b``.

    A Poisson bootstrap: every unit gets weight Poisson(1) in each replicate,
    and the weights of the units that share a value add up to Poisson(count).
    The counts stay distributed, in blocks by a hash of the value; a block
    draws whole tables of weights from a generator of its own and sends sums
    over its values, one row for ``_REPLICATES`` replicates.
    """
    hist = materialize(
        df.where(F.col(arm).isin(a, b) & F.col(metric).isNotNull())
        .groupBy((F.col(arm) == F.lit(a)).alias("is_a"), F.col(metric).cast("double").alias("v"))
        .agg(F.count("*").alias("n"))
    )
    blocks = max(1, -(-hist.count() // _VALUES))
    keyed = hist.withColumn("block", F.pmod(F.xxhash64("is_a", "v", F.lit(seed)), F.lit(blocks)))

    def weigh(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.Generator(np.random.Philox(key=[seed, int(key[0])]))
        rows = rows.sort_values(["is_a", "v"])
        side, v, n = rows["is_a"].to_numpy(), rows["v"].to_numpy(), rows["n"].to_numpy()
        out = []
        for first in range(0, n_boot, _REPLICATES):
            w = rng.poisson(n[:, None], (len(n), min(_REPLICATES, n_boot - first))).astype(float)
            sums = [w[side].sum(axis=0), v[side] @ w[side], w[~side].sum(axis=0), v[~side] @ w[~side]]
            out.append((first, np.concatenate(sums).tolist()))
        return pd.DataFrame(out, columns=["first", "s"])

    sums = keyed.groupBy("block").applyInPandas(weigh, "first long, s array<double>")
    total = sums.groupBy("first").agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))
    m = (F.size("s") / 4).cast("int")
    parts = [F.slice("s", i * m + 1, m) for i in range(4)]
    each = total.select(F.explode(F.arrays_zip(*[p.alias(c) for p, c in zip(parts, ("wa", "va", "wb", "vb"))])).alias("r"))
    diffs = each.select((F.try_divide("r.va", "r.wa") - F.try_divide("r.vb", "r.wb")).alias("diff")).where("diff IS NOT NULL")
    tail = (1 - level) / 2
    return diffs.agg(
        F.count("*").alias("n_boot"),
        F.avg("diff").alias("mean_diff"),
        F.percentile("diff", tail).alias("ci_lower"),
        F.percentile("diff", 1 - tail).alias("ci_upper"),
    ).withColumn("excludes_zero", (F.col("ci_lower") > 0) | (F.col("ci_upper") < 0))


def bayes_ab(df: DataFrame, arm: str, a, b, metric: str, draws: int = 100_000, seed: int = 42) -> DataFrame:
    """Beta posterior (uniform prior) comparison of two rates.

    P(A > B), expected loss of choosing each arm, 95 % credible interval of the
    difference, and the arm to choose.
    """
    counts = df.where(F.col(arm).isin(a, b)).agg(
        *[
            f(F.when(F.col(arm) == F.lit(v), e)).alias(n)
            for v, s in ((a, "a"), (b, "b"))
            for f, e, n in ((F.count, F.lit(1), f"n_{s}"), (F.sum, F.col(metric), f"s_{s}"))
        ]
    )
    row = counts.first()
    s_a, n_a, s_b, n_b = (int(row[c] or 0) for c in ("s_a", "n_a", "s_b", "n_b"))

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in batch["id"]:
                size = min(_BLOCK, draws - int(block) * _BLOCK)
                rng = np.random.default_rng([seed, int(block)])
                p_a = rng.beta(s_a + 1, n_a - s_a + 1, size)
                p_b = rng.beta(s_b + 1, n_b - s_b + 1, size)
                yield pd.DataFrame({"d": p_a - p_b})

    posterior = df.sparkSession.range(-(-draws // _BLOCK)).mapInPandas(sample, "d double")
    d = F.col("d")
    out = posterior.agg(
        F.count("*").alias("draws"),
        F.avg((d > 0).cast("int")).alias("prob_a_better"),
        F.avg(F.greatest(-d, F.lit(0.0))).alias("expected_loss_a"),
        F.avg(F.greatest(d, F.lit(0.0))).alias("expected_loss_b"),
        F.percentile("d", 0.025).alias("ci_lower"),
        F.percentile("d", 0.975).alias("ci_upper"),
    )
    return out.withColumn(
        "recommendation", F.when(F.col("prob_a_better") > 0.5, F.lit(str(a))).otherwise(F.lit(str(b)))
    )
