"""Experiment analysis queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.special import normal_quantile
from ..operators import experiments as ops
from ..operators import resampling
from ..sources import retail
from .funnel_queries import chi2_sql
from .oracle_tables import PLAYERS, UNITS
from .registry import query, tidy

A, B = "gate_30", "gate_40"


def _z_sql(metric: str) -> str:
    return f"""
 SELECT '{metric}' AS metric, n_a, n_b, round(s_a / n_a, 6) AS p_a, round(s_b / n_b, 6) AS p_b,
  round(s_a / n_a - s_b / n_b, 6) AS diff, round((s_a / n_a - s_b / n_b) / (s_b / n_b), 6) AS relative_lift,
  round((s_a / n_a - s_b / n_b) / sqrt((s_a + s_b) / (n_a + n_b) * (1 - (s_a + s_b) / (n_a + n_b))
   * (1.0 / n_a + 1.0 / n_b)), 6) AS z_stat,
  round(sqrt((s_a + s_b) / (n_a + n_b) * (1 - (s_a + s_b) / (n_a + n_b)) * (1.0 / n_a + 1.0 / n_b)), 6) AS se,
  CASE WHEN abs((s_a / n_a - s_b / n_b) / sqrt((s_a + s_b) / (n_a + n_b) * (1 - (s_a + s_b) / (n_a + n_b))
   * (1.0 / n_a + 1.0 / n_b))) > {normal_quantile(0.975)} THEN 1 ELSE 0 END AS significant
 FROM (SELECT count(*) FILTER (WHERE version = '{A}') AS n_a, count(*) FILTER (WHERE version = '{B}') AS n_b,
  CAST(sum({metric}) FILTER (WHERE version = '{A}') AS DOUBLE) AS s_a,
  CAST(sum({metric}) FILTER (WHERE version = '{B}') AS DOUBLE) AS s_b FROM units)"""


@query("z_test", UNITS + _z_sql("retention_1") + " UNION ALL " + _z_sql("retention_7"))
def z_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.z_test(retail.ab_units(spark, sf_dir), "version", A, B, ["retention_1", "retention_7"])
    return tidy(out.drop("p_value"))


@query(
    "arm_chi2",
    UNITS + chi2_sql("units", {"retention_1": True, "retention_7": True}, "version").replace("AS feature", "AS outcome"),
)
def arm_chi2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.arm_chi2(retail.ab_units(spark, sf_dir), "version", ["retention_1", "retention_7"])
    return tidy(out.select("outcome", "n", "dof", "chi2"), 5)


def _moment_sql(metric: str) -> str:
    return f""",
 g AS (SELECT version, CAST(count(*) AS DOUBLE) AS n, avg({metric}) AS m, var_samp({metric}) AS v FROM units
  GROUP BY version),
 ab AS (SELECT a.n AS n_a, a.m AS m_a, a.v AS v_a, b.n AS n_b, b.m AS m_b, b.v AS v_b
  FROM g a JOIN g b ON a.version = '{A}' AND b.version = '{B}')"""


_POOLED_T = "(m_a - m_b) / sqrt(((n_a - 1) * v_a + (n_b - 1) * v_b) / (n_a + n_b - 2) * (1 / n_a + 1 / n_b))"


@query(
    "t_test",
    UNITS
    + _moment_sql("sum_gamerounds")
    + f"""
 SELECT 'sum_gamerounds' AS metric, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b, round(m_a, 6) AS mean_a,
  round(m_b, 6) AS mean_b, round(m_a - m_b, 6) AS diff, round(sqrt(v_a / n_a + v_b / n_b), 6) AS se,
  round({_POOLED_T}, 6) AS t_stat, round(n_a + n_b - 2, 6) AS dof FROM ab""",
)
def t_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.t_test(retail.ab_units(spark, sf_dir), "version", A, B, "sum_gamerounds")
    return tidy(out.drop("p_value"))


@query(
    "t_test_welch",
    UNITS
    + _moment_sql("revenue")
    + """
 SELECT 'revenue' AS metric, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b, round(m_a, 4) AS mean_a,
  round(m_b, 4) AS mean_b, round(m_a - m_b, 4) AS diff, round(sqrt(v_a / n_a + v_b / n_b), 4) AS se,
  round((m_a - m_b) / sqrt(v_a / n_a + v_b / n_b), 4) AS t_stat,
  round(pow(v_a / n_a + v_b / n_b, 2) / (pow(v_a / n_a, 2) / (n_a - 1) + pow(v_b / n_b, 2) / (n_b - 1)), 4) AS dof
 FROM ab""",
)
def t_test_welch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.t_test(retail.ab_units(spark, sf_dir), "version", A, B, "revenue", equal_var=False)
    return tidy(out.drop("p_value"), 4)


@query(
    "mean_diff",
    UNITS
    + _moment_sql("revenue")
    + f"""
 SELECT 'revenue' AS metric, round(m_b, 4) AS control_mean, round(m_a, 4) AS treatment_mean,
  round(m_a - m_b, 4) AS diff, round(sqrt(v_a / n_a + v_b / n_b), 4) AS se, round({_POOLED_T}, 4) AS t_stat
 FROM ab""",
)
def mean_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.mean_diff(retail.ab_units(spark, sf_dir), "version", A, B, "revenue")
    return tidy(out.drop("p_value"), 4)


@query(
    "cuped",
    UNITS
    + f""",
 th AS (SELECT covar_samp(revenue, pre_spend) / var_pop(pre_spend) AS theta, avg(pre_spend) AS mx FROM units),
 adj AS (SELECT version, revenue AS y, revenue - (SELECT theta FROM th) * (pre_spend - (SELECT mx FROM th)) AS z
  FROM units),
 red AS (SELECT 1 - var_samp(z) / var_samp(y) AS vr FROM adj),
 long AS (SELECT version, 'raw' AS method, y AS v FROM adj UNION ALL SELECT version, 'cuped', z FROM adj),
 g AS (SELECT method, version, CAST(count(*) AS DOUBLE) AS n, avg(v) AS m, var_samp(v) AS s FROM long
  GROUP BY method, version),
 ab AS (SELECT a.method, a.n AS n_a, b.n AS n_b, a.m AS m_a, b.m AS m_b, a.s AS v_a, b.s AS v_b
  FROM g a JOIN g b ON a.method = b.method AND a.version = '{A}' AND b.version = '{B}'),
 se AS (SELECT *, sqrt(v_a / n_a + v_b / n_b) AS se FROM ab)
 SELECT 'revenue' AS metric, method, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b, round(m_a, 3) AS mean_a,
  round(m_b, 3) AS mean_b, round(m_a - m_b, 3) AS diff, round(se, 3) AS se, round({_POOLED_T}, 3) AS t_stat,
  round(n_a + n_b - 2, 3) AS dof, round((SELECT theta FROM th), 3) AS theta,
  round((SELECT vr FROM red), 6) AS variance_reduction,
  round(1 - (SELECT se FROM se WHERE method = 'cuped') / (SELECT se FROM se WHERE method = 'raw'), 6) AS se_reduction
 FROM se""",
)
def cuped(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.cuped(retail.ab_units(spark, sf_dir), "version", A, B, "revenue", "pre_spend")
    return tidy(out.drop("p_value"), 3, variance_reduction=6, se_reduction=6)


_MDES = [0.01, 0.02, 0.03, 0.05]
_ZA, _ZB = normal_quantile(0.975), normal_quantile(0.8)


@query(
    "power_report",
    PLAYERS
    + f""",
 b AS (SELECT platform AS scenario, avg(d1_retained) AS p FROM players GROUP BY platform),
 e AS (SELECT unnest({_MDES}::DOUBLE[]) AS mde)
 SELECT scenario, round(p, 6) AS baseline, mde, CAST(ceil(pow(({_ZA} * sqrt(2 * p * (1 - p))
  + {_ZB} * sqrt(p * (1 - p) + (p + mde) * (1 - p - mde))) / mde, 2)) AS BIGINT) AS n_per_group
 FROM b, e""",
)
def power_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ops.segment_baselines(retail.players_untiered(spark, sf_dir), "platform", "d1_retained")
    return tidy(ops.power_report(base, _MDES))


@query(
    "mde_report",
    PLAYERS
    + f""",
 b AS (SELECT platform AS scenario, avg(d1_retained) AS p FROM players GROUP BY platform)
 SELECT scenario, round(p, 6) AS baseline, round({_ZA + _ZB} * sqrt(2 * p * (1 - p) / 45000), 6) AS mde,
  round({_ZA + _ZB} * sqrt(2 * p * (1 - p) / 45000) / p, 6) AS mde_relative FROM b""",
)
def mde_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ops.segment_baselines(retail.players_untiered(spark, sf_dir), "platform", "d1_retained")
    return tidy(ops.mde_report(base, 45_000))


@query(
    "bootstrap_interval",
    UNITS
    + """,
 m AS (
  SELECT avg(revenue) FILTER (WHERE version = 'gate_30') - avg(revenue) FILTER (WHERE version = 'gate_40') AS diff FROM units)
 SELECT round(diff, 2) AS exact_diff, 10000::BIGINT AS n_boot, 1::BIGINT AS mean_within, 1::BIGINT AS ends_within FROM m""",
)
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bootstrap against the exact difference and its normal interval."""
    units = retail.ab_units(spark, sf_dir)
    boot = resampling.bootstrap_ci(units, "version", A, B, "revenue")
    exact = ops.t_test(units, "version", A, B, "revenue").select("diff", "se")
    z = (F.col("ci_lower") - F.col("diff")) / F.col("se"), (F.col("ci_upper") - F.col("diff")) / F.col("se")
    near = (F.abs(z[0] + 1.959964) < 0.15) & (F.abs(z[1] - 1.959964) < 0.15)
    mean = F.abs(F.col("mean_diff") - F.col("diff")) < 0.05 * F.col("se")
    one = boot.withColumn("_k", F.lit(1)).join(exact.withColumn("_k", F.lit(1)), "_k")
    return tidy(
        one.select(
            F.col("diff").alias("exact_diff"), "n_boot", mean.alias("mean_within"), near.alias("ends_within")
        ),
        2,
    )


@query(
    "bayes_interval",
    UNITS
    + """,
 c AS (SELECT version, count(*) + 2 AS n, sum(retention_7) + 1 AS a FROM units GROUP BY version),
 m AS (SELECT version, a / n AS p, (a / n) * (1 - a / n) / (n + 1) AS v FROM c)
 SELECT round(x.p - y.p, 6) AS posterior_diff, 1::BIGINT AS ends_within
 FROM m x JOIN m y ON x.version = 'gate_30' AND y.version = 'gate_40'""",
)
def bayes_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled credible interval against the exact posterior mean and a normal interval around it."""
    units = retail.ab_units(spark, sf_dir)
    sampled = resampling.bayes_ab(units, "version", A, B, "retention_7").withColumn("_k", F.lit(1))
    counts = units.groupBy("version").agg((F.count("*") + 2).alias("n"), (F.sum("retention_7") + 1).alias("a"))
    p = F.col("a") / F.col("n")
    exact = counts.select("version", p.alias("p"), (p * (1 - p) / (F.col("n") + 1)).alias("v"))
    side = [F.max(F.when(F.col("version") == v, F.col(c))).alias(f"{c}_{s}") for v, s in ((A, "a"), (B, "b")) for c in "pv"]
    one = exact.agg(*side).withColumn("_k", F.lit(1)).join(sampled, "_k")
    diff, se = F.col("p_a") - F.col("p_b"), F.sqrt(F.col("v_a") + F.col("v_b"))
    near = [F.abs((F.col(c) - diff) / se - z) < 0.1 for c, z in (("ci_lower", -1.959964), ("ci_upper", 1.959964))]
    return tidy(one.select(diff.alias("posterior_diff"), (near[0] & near[1]).alias("ends_within")))


@query("bootstrap_ci")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.bootstrap_ci(retail.ab_units(spark, sf_dir), "version", A, B, "retention_7")


@query("bootstrap_ci_continuous")
def bootstrap_ci_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric with many distinct values: counts stay distributed."""
    units = retail.ab_units(spark, sf_dir)
    return resampling.bootstrap_ci(units, "version", A, B, "revenue")


@query("bayes_ab")
def bayes_ab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.bayes_ab(retail.ab_units(spark, sf_dir), "version", A, B, "retention_7")
