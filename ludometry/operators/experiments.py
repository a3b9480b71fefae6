"""Two-arm experiment analysis.

Every test reads one row of sufficient statistics from a single aggregate over
the units; what follows is arithmetic on that row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import normal_quantile, normal_two_sided, student_two_sided
from .funnel import chi2_tests

ALPHA = 0.05


def _arm(arm: str, value, expr: Column) -> Column:
    return F.when(F.col(arm) == F.lit(value), expr)


def z_test(df: DataFrame, arm: str, a, b, metrics: Sequence[str]) -> DataFrame:
    """Pooled two-proportion z-test of 0/1 metrics, all in one scan."""
    one = F.lit(1)
    aggs = [F.count(_arm(arm, a, one)).alias("n_a"), F.count(_arm(arm, b, one)).alias("n_b")]
    for i, m in enumerate(metrics):
        aggs += [F.sum(_arm(arm, v, F.col(m))).cast("double").alias(f"s{i}{s}") for v, s in ((a, "a"), (b, "b"))]
    rows = [
        F.struct(
            F.lit(m).alias("metric"), "n_a", "n_b", F.col(f"s{i}a").alias("s_a"), F.col(f"s{i}b").alias("s_b")
        )
        for i, m in enumerate(metrics)
    ]
    base = df.where(F.col(arm).isin(a, b)).agg(*aggs).select(F.inline(F.array(*rows)))
    p_a, p_b = F.try_divide("s_a", "n_a"), F.try_divide("s_b", "n_b")
    pool = F.try_divide(F.col("s_a") + F.col("s_b"), F.col("n_a") + F.col("n_b"))
    se = F.sqrt(pool * (1 - pool) * (F.try_divide(one, "n_a") + F.try_divide(one, "n_b")))
    out = base.select("metric", "n_a", "n_b", p_a.alias("p_a"), p_b.alias("p_b"), se.alias("se"))
    diff = F.col("p_a") - F.col("p_b")
    out = out.select(
        "metric",
        "n_a",
        "n_b",
        "p_a",
        "p_b",
        diff.alias("diff"),
        F.try_divide(diff, F.col("p_b")).alias("relative_lift"),
        F.try_divide(diff, F.col("se")).alias("z_stat"),
        "se",
    )
    return out.withColumn("p_value", normal_two_sided("z_stat")).withColumn(
        "significant", F.col("p_value") < ALPHA
    )


def arm_chi2(df: DataFrame, arm: str, outcomes: Sequence[str], yates: bool = True) -> DataFrame:
    """Chi-squared independence of the arm and each outcome."""
    return chi2_tests(df.where(F.col(arm).isNotNull()), outcomes, arm, yates).withColumnRenamed("feature", "outcome")


def _moments(df: DataFrame, arm: str, a, b, y: str, x: str | None = None) -> DataFrame:
    """One row: n, means, variances and covariances per arm (suffix a / b)."""
    aggs = []
    for value, s in ((a, "a"), (b, "b")):
        yy = _arm(arm, value, F.col(y).cast("double"))
        aggs += [F.count(yy).alias(f"n_{s}"), F.avg(yy).alias(f"my_{s}"), F.var_samp(yy).alias(f"vy_{s}")]
        if x:
            xx = _arm(arm, value, F.col(x).cast("double"))
            aggs += [
                F.avg(xx).alias(f"mx_{s}"),
                F.var_samp(xx).alias(f"vx_{s}"),
                F.covar_samp(yy, xx).alias(f"c_{s}"),
            ]
    rows = df.where(F.col(arm).isin(a, b) & F.col(y).isNotNull())
    if x:
        rows = rows.where(F.col(x).isNotNull())
    return rows.agg(*aggs)


def _compare(
    moments: DataFrame,
    equal_var: bool,
    mean_a: Column,
    mean_b: Column,
    var_a: Column,
    var_b: Column,
    suffix: str = "",
) -> DataFrame:
    """Add difference of means, unpooled SE, t, degrees of freedom and p to the moments row."""

    def c(name: str) -> Column:
        return F.col(f"{name}{suffix}")

    n_a, n_b = F.col("n_a"), F.col("n_b")
    named = {"mean_a": mean_a, "mean_b": mean_b, "_va": var_a, "_vb": var_b}
    base = moments.withColumns({f"{k}{suffix}": v for k, v in named.items()})
    q_a, q_b = F.try_divide(c("_va"), n_a), F.try_divide(c("_vb"), n_b)
    base = base.withColumns({f"diff{suffix}": c("mean_a") - c("mean_b"), f"se{suffix}": F.sqrt(q_a + q_b)})
    if equal_var:
        dof = (n_a + n_b - 2).cast("double")
        pooled = F.try_divide((n_a - 1) * c("_va") + (n_b - 1) * c("_vb"), dof)
        scale = F.sqrt(pooled * (F.try_divide(F.lit(1), n_a) + F.try_divide(F.lit(1), n_b)))
    else:
        spread = F.try_divide(q_a * q_a, n_a - 1) + F.try_divide(q_b * q_b, n_b - 1)
        dof = F.try_divide((q_a + q_b) * (q_a + q_b), spread)
        scale = c("se")
    base = base.withColumns({f"t_stat{suffix}": F.try_divide(c("diff"), scale), f"dof{suffix}": dof})
    return base.withColumn(f"p_value{suffix}", student_two_sided(c("t_stat"), c("dof")))


_OUT = ["n_a", "n_b", "mean_a", "mean_b", "diff", "se", "t_stat", "dof", "p_value"]


def t_test(df: DataFrame, arm: str, a, b, metric: str, equal_var: bool = True) -> DataFrame:
    """Two-sample t-test. Pooled variance by default, Welch with ``equal_var=False``.

    ``se`` is the unpooled standard error in both cases. Arms without variance
    have no statistic (NULL).
    """
    m = _moments(df, arm, a, b, metric)
    out = _compare(m, equal_var, F.col("my_a"), F.col("my_b"), F.col("vy_a"), F.col("vy_b"))
    return out.select(F.lit(metric).alias("metric"), *_OUT)


def mean_diff(df: DataFrame, arm: str, treatment, control, metric: str) -> DataFrame:
    """Treatment minus control: means, difference, unpooled SE, t, p."""
    out = t_test(df, arm, treatment, control, metric)
    return out.select(
        "metric",
        F.col("mean_b").alias("control_mean"),
        F.col("mean_a").alias("treatment_mean"),
        "diff",
        "se",
        "t_stat",
        "p_value",
    )


def cuped(df: DataFrame, arm: str, treatment, control, metric: str, covariate: str) -> DataFrame:
    """Raw and covariate-adjusted comparison, with the variance and SE reduction.

    One pass: the adjusted metric is linear in the covariate, so its moments
    follow from the arms' means, variances and covariances. theta divides the
    sample covariance by the population variance of the covariate.
    """
    m = _moments(df, arm, treatment, control, metric, covariate)
    n_a, n_b = F.col("n_a"), F.col("n_b")
    n = n_a + n_b
    cross = n_a * n_b / n

    def total(stat: str, d1: Column, d2: Column) -> Column:
        return (n_a - 1) * F.col(f"{stat}_a") + (n_b - 1) * F.col(f"{stat}_b") + cross * d1 * d2

    dx, dy = F.col("mx_a") - F.col("mx_b"), F.col("my_a") - F.col("my_b")
    m = m.withColumns(
        {
            "sxx": total("vx", dx, dx),
            "syy": total("vy", dy, dy),
            "sxy": total("c", dx, dy),
            "mx": (n_a * F.col("mx_a") + n_b * F.col("mx_b")) / n,
        }
    )
    m = m.withColumn("theta", F.try_divide(F.col("sxy") / (n - 1), F.col("sxx") / n))
    theta = F.col("theta")
    left = F.col("syy") - 2 * theta * F.col("sxy") + theta * theta * F.col("sxx")
    m = m.withColumn("variance_reduction", 1 - F.try_divide(left, F.col("syy")))

    def mean(s: str) -> Column:
        return F.col(f"my_{s}") - theta * (F.col(f"mx_{s}") - F.col("mx"))

    def var(s: str) -> Column:
        return F.col(f"vy_{s}") - 2 * theta * F.col(f"c_{s}") + theta * theta * F.col(f"vx_{s}")

    names = {c: f"{c}_cuped" for c in _OUT if c not in ("n_a", "n_b")}
    both = _compare(m, True, F.col("my_a"), F.col("my_b"), F.col("vy_a"), F.col("vy_b"))
    both = _compare(both, True, mean("a"), mean("b"), var("a"), var("b"), suffix="_cuped")
    return both.select(
        F.lit(metric).alias("metric"),
        "n_a",
        "n_b",
        F.inline(
            F.array(
                _method("raw", {c: c for c in names}),
                _method("cuped", names),
            )
        ),
        "theta",
        "variance_reduction",
        (1 - F.try_divide(F.col("se_cuped"), F.col("se"))).alias("se_reduction"),
    )


def _method(name: str, columns: dict[str, str]) -> Column:
    return F.struct(F.lit(name).alias("method"), *[F.col(src).alias(out) for out, src in columns.items()])


def segment_baselines(df: DataFrame, dim: str, metric: str) -> DataFrame:
    """Baseline rate per segment, the input of the power reports."""
    return df.groupBy(F.col(dim).alias("scenario")).agg(F.avg(metric).alias("baseline"))


def power_report(
    baselines: DataFrame, mdes: Sequence[float] | str, alpha: float = 0.05, power: float = 0.80
) -> DataFrame:
    """Required units per group for each baseline and minimum effect.

    ``baselines`` has ``scenario`` and ``baseline``; ``mdes`` is a list for all
    scenarios or the name of an array column.
    """
    z_a, z_b = normal_quantile(1 - alpha / 2), normal_quantile(power)
    effects = F.col(mdes) if isinstance(mdes, str) else F.array(*[F.lit(float(m)) for m in mdes])
    rows = baselines.select("scenario", "baseline", F.explode(effects).alias("mde"))
    p1, p2 = F.col("baseline"), F.col("baseline") + F.col("mde")
    root = z_a * F.sqrt(2 * p1 * (1 - p1)) + z_b * F.sqrt(p1 * (1 - p1) + p2 * (1 - p2))
    return rows.withColumn("n_per_group", F.ceil(F.pow(root / F.col("mde"), 2)).cast("bigint"))


def mde_report(baselines: DataFrame, n: int | str, alpha: float = 0.05, power: float = 0.80) -> DataFrame:
    """Smallest detectable effect for ``n`` units per group, absolute and relative."""
    z = normal_quantile(1 - alpha / 2) + normal_quantile(power)
    size = F.col(n) if isinstance(n, str) else F.lit(int(n))
    p = F.col("baseline")
    out = baselines.withColumn("mde", z * F.sqrt(2 * p * (1 - p) / size))
    return out.withColumn("mde_relative", F.try_divide("mde", "baseline"))
