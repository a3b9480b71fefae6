"""Funnel, conversion and contingency queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import funnel as ops
from ..sources import retail
from .oracle_tables import PLAYERS
from .registry import query, tidy

_FUNNEL = """,
 c AS (
  SELECT 1 AS i, 'Install' AS stage, count(*) AS n FROM players
  UNION ALL SELECT 2, 'Tutorial Complete', sum(tutorial_completed) FROM players
  UNION ALL SELECT 3, 'D1 Retained', sum(d1_retained) FROM players
  UNION ALL SELECT 4, 'D7 Retained', sum(d7_retained) FROM players
  UNION ALL SELECT 5, 'D30 Retained', sum(d30_retained) FROM players
  UNION ALL SELECT 6, 'First IAP', sum(is_payer) FROM players
  UNION ALL SELECT 7, 'Repeat Purchaser (2+)', count(*) FROM players WHERE num_purchases >= 2
  UNION ALL SELECT 8, 'High Value (5+ purchases)', count(*) FROM players WHERE num_purchases >= 5),
 p AS (SELECT i, stage, CAST(n AS DOUBLE) AS n, lag(CAST(n AS DOUBLE)) OVER (ORDER BY i) AS pn,
   (SELECT CAST(n AS DOUBLE) FROM c WHERE i = 1) AS n1 FROM c),
 f AS (
  SELECT CAST(i AS BIGINT) AS stage_no, stage, CAST(n AS BIGINT) AS count, round(n / n1 * 100, 2) AS pct_of_install,
   CASE WHEN coalesce(pn, 0) = 0 THEN 100.0::DOUBLE ELSE round(100.0 * n / pn, 2) END AS pct_of_previous,
   CASE WHEN coalesce(pn, 0) = 0 THEN 0.0::DOUBLE ELSE round(100.0 - 100.0 * n / pn, 2) END AS dropoff_rate FROM p)"""


@query("funnel", PLAYERS + _FUNNEL + " SELECT * FROM f")
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ops.funnel(retail.players_untiered(spark, sf_dir)))


@query("funnel_dropoffs", PLAYERS + _FUNNEL + " SELECT stage, dropoff_rate FROM f WHERE dropoff_rate > 0")
def funnel_dropoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ops.dropoffs(ops.funnel(retail.players_untiered(spark, sf_dir))).select("stage", "dropoff_rate"))


@query(
    "time_to_convert",
    PLAYERS
    + """
 SELECT count(*) AS n, round(quantile_cont(days_to_first_purchase, 0.5), 6) AS median_days,
  round(avg(days_to_first_purchase), 6) AS mean_days, round(quantile_cont(days_to_first_purchase, 0.25), 6) AS p25_days,
  round(quantile_cont(days_to_first_purchase, 0.75), 6) AS p75_days,
  round(quantile_cont(days_to_first_purchase, 0.9), 6) AS p90_days
 FROM players WHERE is_payer = 1 AND days_to_first_purchase IS NOT NULL""",
)
def time_to_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ops.time_to_convert(retail.players_untiered(spark, sf_dir)))


def _bins_sql(low: str) -> str:
    edges = ops.CONVERT_BINS
    parts = []
    for i, label in enumerate(ops.CONVERT_LABELS):
        op = low if i == 0 else ">"
        high = "" if edges[i + 1] == float("inf") else f" AND days_to_first_purchase <= {edges[i + 1]}"
        parts.append(
            f"SELECT CAST({i + 1} AS BIGINT) AS bucket_no, '{label}' AS bucket, count(*) AS n FROM players "
            f"WHERE is_payer = 1 AND days_to_first_purchase {op} {edges[i]}{high}"
        )
    parts.append(
        f"SELECT CAST({len(edges)} AS BIGINT) AS bucket_no, 'unbinned' AS bucket, count(*) AS n FROM players "
        f"WHERE is_payer = 1 AND NOT coalesce(days_to_first_purchase {low} {edges[0]}, false)"
    )
    return " " + " UNION ALL ".join(parts)


@query("convert_buckets", PLAYERS + _bins_sql(">"))
def convert_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    payers = retail.players_untiered(spark, sf_dir).where(F.col("is_payer") == 1)
    return tidy(ops.bucket_distribution(payers, "days_to_first_purchase", ops.CONVERT_BINS, ops.CONVERT_LABELS))


@query("convert_buckets_closed", PLAYERS + _bins_sql(">="))
def convert_buckets_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    payers = retail.players_untiered(spark, sf_dir).where(F.col("is_payer") == 1)
    return tidy(
        ops.bucket_distribution(payers, "days_to_first_purchase", ops.CONVERT_BINS, ops.CONVERT_LABELS, True)
    )


@query(
    "conversion_by_platform",
    PLAYERS
    + """
 SELECT platform, round(avg(is_payer), 6) AS conversion_rate, count(*) AS n_players FROM players GROUP BY platform""",
)
def conversion_by_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ops.conversion_by(retail.players_untiered(spark, sf_dir), "platform"))


@query(
    "conversion_by_country",
    PLAYERS
    + """
 SELECT country, round(avg(is_payer), 6) AS conversion_rate, count(*) AS n_players FROM players GROUP BY country
 ORDER BY avg(is_payer) DESC, country LIMIT 10""",
)
def conversion_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ops.conversion_by(retail.players_untiered(spark, sf_dir), "country", 10))


@query(
    "crosstab",
    PLAYERS
    + " SELECT tutorial_completed, is_payer, count(*) AS n FROM players GROUP BY tutorial_completed, is_payer",
)
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ops.crosstab(retail.players_untiered(spark, sf_dir), "tutorial_completed", "is_payer"))


def chi2_sql(table: str, features: dict[str, bool], target: str) -> str:
    """Observed against expected, cell by cell; ``True`` marks a 2×2 table."""
    parts = []
    for f, two in features.items():
        gap = "abs(o - e)"
        gap = f"({gap} - least(0.5, {gap}))" if two else gap
        parts.append(f"""
  SELECT '{f}' AS feature, CAST(max(n) AS BIGINT) AS n,
   CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS BIGINT) AS dof, round(sum({gap} * {gap} / e), 5) AS chi2
  FROM (
   SELECT x.a, x.b, count(t.{f}) AS o, any_value(x.e) AS e, any_value(x.n) AS n FROM (
    SELECT r.a, c.b, r.r * c.c / n.n AS e, n.n FROM
     (SELECT {f} AS a, CAST(count(*) AS DOUBLE) AS r FROM {table} GROUP BY 1) r,
     (SELECT {target} AS b, CAST(count(*) AS DOUBLE) AS c FROM {table} GROUP BY 1) c,
     (SELECT CAST(count(*) AS DOUBLE) AS n FROM {table}) n) x
   LEFT JOIN {table} t ON t.{f} = x.a AND t.{target} = x.b GROUP BY x.a, x.b)""")
    return " UNION ALL ".join(parts)


@query(
    "chi2_tests",
    PLAYERS
    + chi2_sql(
        "players",
        {"tutorial_completed": True, "d1_retained": True, "fb_connected": True, "country": False, "platform": False},
        "is_payer",
    ),
)
def chi2_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics only: DuckDB has no χ² tail to compare p-values with."""
    tests = ops.chi2_tests(
        retail.players_untiered(spark, sf_dir),
        ["tutorial_completed", "d1_retained", "fb_connected", "country", "platform"],
        "is_payer",
    )
    return tidy(tests.select("feature", "n", "dof", "chi2"), 5)


@query("conversion_drivers")
def conversion_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    numeric = ["tutorial_completed", "d1_retained", "fb_connected", "total_sessions", "max_stage_reached"]
    wide, names = ops.driver_features(retail.players_untiered(spark, sf_dir), encode=("platform",), numeric=numeric)
    return ops.conversion_drivers(wide, names)


_DRIVERS = {"fb_connected": 0.3, "tutorial_completed": -0.2, "total_sessions": 0.01}
_DRIVER_Z = " + ".join(["-0.5", *(f"{b} * {c}" for c, b in _DRIVERS.items())])


@query(
    "driver_terms",
    PLAYERS
    + f""",
 u AS (SELECT *, {_DRIVER_Z} AS z, is_payer - 1 / (1 + exp(-({_DRIVER_Z}))) AS gap FROM players)
 SELECT 'log_likelihood' AS term, round(sum(is_payer * z - ln(1 + exp(z))) - {sum(b * b for b in _DRIVERS.values()) / 2}, 4) AS value FROM u
 UNION ALL SELECT 'intercept', round(sum(gap), 4) FROM u
 """
    + " ".join(f"UNION ALL SELECT '{c}', round(sum(gap * {c}) - {b}, 4) FROM u" for c, b in _DRIVERS.items()),
)
def driver_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood of the conversion drivers and its slopes at fixed coefficients."""
    return tidy(ops.driver_terms(retail.players_untiered(spark, sf_dir), list(_DRIVERS), -0.5, list(_DRIVERS.values())), 4)
