"""Survival, LTV and CLV queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clv, features, ltv, survival
from ..session import materialize
from ..sources import retail
from .feature_queries import _RFM, COUNTRIES, IOS, wide_features
from .oracle_tables import BOTH, OBS, PLAYERS, TXNS
from .registry import query, tidy

_CURVE = """,
 obs AS (SELECT player_tier, greatest(days_active, 1) AS t, churned_d7 AS e FROM players),
 steps AS (
  SELECT g.player_tier, g.t, (SELECT count(*) FROM obs o WHERE o.player_tier = g.player_tier AND o.t >= g.t) AS r,
   (SELECT count(*) FROM obs o WHERE o.player_tier = g.player_tier AND o.t = g.t AND o.e = 1) AS d
  FROM (SELECT DISTINCT player_tier, t FROM obs UNION SELECT DISTINCT player_tier, 0 FROM obs) g),
 curve AS (
  SELECT player_tier, t, r, d, row_number() OVER w AS point, product(1 - d / r) OVER w AS s FROM steps
  WINDOW w AS (PARTITION BY player_tier ORDER BY t))"""


@query(
    "kaplan_meier",
    PLAYERS
    + _CURVE
    + """
 SELECT player_tier, point, t, r AS n_at_risk, d, round(s, 6) AS survival FROM curve""",
)
def kaplan_meier(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = retail.players(spark, sf_dir)
    return tidy(survival.kaplan_meier(base, "days_active", "churned_d7", "player_tier"))


@query(
    "median_survival",
    PLAYERS
    + _CURVE
    + """
 SELECT player_tier, CAST(coalesce(min(t) FILTER (WHERE s <= 0.5), 365) AS DOUBLE) AS median FROM curve
 GROUP BY player_tier""",
)
def median_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = survival.kaplan_meier(retail.players(spark, sf_dir), "days_active", "churned_d7", "player_tier")
    return tidy(survival.median_survival(curve, "player_tier"))


COX_COVARIATES = [
    "total_sessions",
    "avg_session_minutes",
    "max_stage_reached",
    "is_payer",
    "tutorial_completed",
    "fb_connected",
    "is_ios",
    "is_high_spend_country",
    "total_spend_usd",
]


def _lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from install to last activity, with the Cox covariates."""
    base = features.profile_flags(retail.players_untiered(spark, sf_dir), IOS, COUNTRIES)
    return base.withColumn("lifetime", F.datediff("last_active_date", "install_date"))


@query("cox_ph")
def cox_ph(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = survival.cox_ph(_lifetimes(spark, sf_dir), "lifetime", "churned_d7", COX_COVARIATES)
    return model.summary(spark)


_NULL_COVARIATES = ["total_sessions", "is_payer"]


@query(
    "cox_null_terms",
    PLAYERS
    + """,
 u AS (
  SELECT greatest(last_active_date - install_date, 1) AS t, churned_d7 AS e, total_sessions AS x1, is_payer AS x2
  FROM players),
 days AS (SELECT t, sum(e) AS d, sum(e * x1) AS f1, sum(e * x2) AS f2, count(*) AS n, sum(x1) AS s1, sum(x2) AS s2 FROM u GROUP BY t),
 risk AS (
  SELECT t, d, f1, f2, sum(n) OVER w AS n, sum(s1) OVER w AS s1, sum(s2) OVER w AS s2 FROM days
  WINDOW w AS (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 ties AS (SELECT *, unnest(range(d::BIGINT)) AS l FROM risk WHERE d > 0),
 sums AS (
  SELECT sum(ln(n - l)) AS logs, sum((s1 - l / d * f1) / (n - l)) AS g1, sum((s2 - l / d * f2) / (n - l)) AS g2 FROM ties),
 total AS (SELECT sum(f1) AS f1, sum(f2) AS f2 FROM days)
 SELECT 'log_likelihood' AS term, round(-logs, 4) AS value FROM sums
 UNION ALL SELECT 'total_sessions', round(f1 - g1, 4) FROM total, sums
 UNION ALL SELECT 'is_payer', round(f2 - g2, 4) FROM total, sums""",
)
def cox_null_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Efron log likelihood and gradient of the Cox model where no covariate matters."""
    ll, gradient = survival.cox_terms(_lifetimes(spark, sf_dir), "lifetime", "churned_d7", _NULL_COVARIATES, [0.0, 0.0])
    rows = [("log_likelihood", ll), *zip(_NULL_COVARIATES, map(float, gradient))]
    return tidy(spark.createDataFrame(rows, "term string, value double"), 4)


_BETAS = [[0.02, -0.3], [-0.05, 0.4]]


def _cox_sql(no: int, b1: float, b2: float) -> str:
    return f"""
 u{no} AS (
  SELECT greatest(last_active_date - install_date, 1) AS t, churned_d7 AS e, total_sessions AS x1, is_payer AS x2,
   exp({b1} * total_sessions + {b2} * is_payer) AS r FROM players),
 days{no} AS (
  SELECT t, sum(e) AS d, sum(e * x1) AS f1, sum(e * x2) AS f2, sum(r) AS s0, sum(r * x1) AS s1, sum(r * x2) AS s2,
   sum(e * r) AS t0, sum(e * r * x1) AS t1, sum(e * r * x2) AS t2 FROM u{no} GROUP BY t),
 risk{no} AS (
  SELECT * REPLACE (sum(s0) OVER w AS s0, sum(s1) OVER w AS s1, sum(s2) OVER w AS s2) FROM days{no}
  WINDOW w AS (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 ties{no} AS (SELECT *, unnest(range(d::BIGINT)) / d AS l FROM risk{no} WHERE d > 0),
 sums{no} AS (
  SELECT sum(ln(s0 - l * t0)) AS logs, sum((s1 - l * t1) / (s0 - l * t0)) AS g1, sum((s2 - l * t2) / (s0 - l * t0)) AS g2 FROM ties{no}),
 terms{no} AS (
  SELECT {no}::BIGINT AS beta_no, unnest([('log_likelihood', {b1} * f1 + {b2} * f2 - logs), ('total_sessions', f1 - g1), ('is_payer', f2 - g2)]) AS v
  FROM (SELECT sum(f1) AS f1, sum(f2) AS f2 FROM days{no}), sums{no})"""


@query(
    "cox_terms",
    PLAYERS
    + "".join("," + _cox_sql(i, *b) for i, b in enumerate(_BETAS))
    + " UNION ALL".join(f" SELECT beta_no, v[1] AS term, round(v[2], 4) AS value FROM terms{i}" for i in range(len(_BETAS))),
)
def cox_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Efron log likelihood and gradient of the Cox model at two sets of coefficients."""
    units = materialize(_lifetimes(spark, sf_dir))
    rows = []
    for i, beta in enumerate(_BETAS):
        ll, gradient = survival.cox_terms(units, "lifetime", "churned_d7", _NULL_COVARIATES, beta)
        rows += [(i, "log_likelihood", ll), *((i, c, float(g)) for c, g in zip(_NULL_COVARIATES, gradient))]
    return tidy(spark.createDataFrame(rows, "beta_no int, term string, value double"), 4)


@query("cox_stationary", PLAYERS + f" SELECT {len(COX_COVARIATES)}::BIGINT AS covariates, 0::BIGINT AS sloped FROM (SELECT count(*) FROM players)")
def cox_stationary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariates of the fitted Cox model whose slope is not zero."""
    model = survival.cox_ph(_lifetimes(spark, sf_dir), "lifetime", "churned_d7", COX_COVARIATES)
    return tidy(spark.createDataFrame([(len(model.covariates), sum(abs(g) > 1e-6 for g in model.gradient.tolist()))], "covariates int, sloped int"))


@query(
    "concordance",
    PLAYERS
    + """,
 u AS (SELECT last_active_date - install_date AS t, churned_d7 AS e, -total_sessions AS risk FROM players),
 c AS (
  SELECT sum(CASE WHEN i.risk > j.risk THEN 1 ELSE 0 END) AS conc, sum(CASE WHEN i.risk = j.risk THEN 1 ELSE 0 END)
   AS ties, count(*) AS n
  FROM u i JOIN u j ON i.e = 1 AND (i.t < j.t OR (i.t = j.t AND j.e = 0)))
 SELECT CAST(conc AS DOUBLE) AS concordant, CAST(ties AS DOUBLE) AS tied, CAST(n AS DOUBLE) AS comparable,
  round((conc + 0.5 * ties) / n, 6) AS concordance FROM c""",
)
def concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _lifetimes(spark, sf_dir).withColumn("risk", -F.col("total_sessions"))
    return tidy(survival.concordance(units, "lifetime", "churned_d7", "risk"))


@query(
    "concordance_fractional",
    PLAYERS
    + """,
 u AS (SELECT avg_session_minutes AS t, churned_d7 AS e, -total_sessions AS risk FROM players),
 c AS (
  SELECT sum(CASE WHEN i.risk > j.risk THEN 1 ELSE 0 END) AS conc, sum(CASE WHEN i.risk = j.risk THEN 1 ELSE 0 END)
   AS ties, count(*) AS n
  FROM u i JOIN u j ON i.e = 1 AND (i.t < j.t OR (i.t = j.t AND j.e = 0)))
 SELECT CAST(conc AS DOUBLE) AS concordant, CAST(ties AS DOUBLE) AS tied, CAST(n AS DOUBLE) AS comparable,
  round((conc + 0.5 * ties) / n, 6) AS concordance FROM c""",
)
def concordance_fractional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations with fractions: the average session."""
    units = retail.players_untiered(spark, sf_dir).withColumn("risk", -F.col("total_sessions"))
    return tidy(survival.concordance(units, "avg_session_minutes", "churned_d7", "risk"))


@query(
    "install_days",
    BOTH
    + """
 SELECT t.transaction_id, p.install_date::VARCHAR AS install_date,
  t.transaction_date - p.install_date AS days_from_install
 FROM transactions t LEFT JOIN players p ON p.player_id = t.player_id""",
)
def install_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ltv.with_install_date(retail.transactions(spark, sf_dir), retail.players_untiered(spark, sf_dir))
    return tidy(joined.select("transaction_id", "install_date", "days_from_install"))


@query(
    "horizon_ltv",
    BOTH
    + """
 SELECT p.player_id,
  round(coalesce(sum(price_usd) FILTER (WHERE transaction_date - install_date <= 7), 0), 4) AS ltv_7d,
  round(coalesce(sum(price_usd) FILTER (WHERE transaction_date - install_date <= 30), 0), 4) AS ltv_30d,
  round(coalesce(sum(price_usd) FILTER (WHERE transaction_date - install_date <= 90), 0), 4) AS ltv_90d
 FROM players p LEFT JOIN transactions t ON t.player_id = p.player_id WHERE is_payer = 1 GROUP BY p.player_id""",
)
def horizon_ltv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ltv.horizon_ltv(retail.transactions(spark, sf_dir), retail.players_untiered(spark, sf_dir)), 4)


_SUMMARY = f""",
 daily AS (SELECT player_id, transaction_date AS d, sum(price_usd) AS v FROM transactions
  WHERE transaction_date <= {OBS} GROUP BY 1, 2),
 k AS (SELECT player_id, min(d) AS d0, max(d) AS d1, count(*) - 1 AS frequency FROM daily GROUP BY 1),
 summary AS (
  SELECT k.player_id, frequency, d1 - d0 AS recency, {OBS} - d0 AS T, avg(v) AS monetary
  FROM k JOIN daily x ON x.player_id = k.player_id AND x.d > k.d0 GROUP BY ALL)"""


@query(
    "clv_summary",
    TXNS + _SUMMARY + " SELECT player_id, frequency, recency, T, round(monetary + 1e-8, 6) AS monetary FROM summary",
)
def clv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ltv.clv_summary(retail.transactions(spark, sf_dir), retail.OBS), averages=["monetary"])


@query(
    "simple_clv",
    TXNS
    + _RFM
    + """,
 c AS (SELECT monetary / greatest(frequency, 1) * (frequency / greatest(recency, 1)) * 90 AS clv FROM rfm)
 SELECT count(*) AS n_customers, round(avg(clv), 3) AS avg_clv, round(quantile_cont(clv, 0.5), 3) AS median_clv
 FROM c""",
)
def simple_clv(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ltv.simple_clv(features.rfm(retail.transactions(spark, sf_dir), retail.OBS))
    return tidy(ltv.clv_averages(scored, "clv_90d"), 3)


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once: fits, checks and scoring all read it."""
    return materialize(ltv.clv_summary(retail.transactions(spark, sf_dir), retail.OBS))


@query("bgnbd")
def bgnbd(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = _summary(spark, sf_dir)
    model = clv.fit_bgnbd(summary)
    scored = clv.with_expected_purchases(summary, model)
    return scored.agg(
        F.count("*").alias("n_customers"),
        F.avg("pred_purchases_30d").alias("avg_pred_purchases_30d"),
        F.avg("pred_purchases_90d").alias("avg_pred_purchases_90d"),
    )


@query("gamma_gamma_clv")
def gamma_gamma_clv(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = _summary(spark, sf_dir)
    scored = clv.with_clv(summary, clv.fit_bgnbd(summary), clv.fit_gamma_gamma(summary))
    return ltv.clv_averages(scored, "predicted_clv")


_STEP = 1e-5
_BG = {"r": 0.8, "alpha": 40.0, "a": 0.9, "b": 2.5}
_GG = {"p": 2.0, "q": 3.0, "v": 50000.0}


def _bg_sql(r: float, alpha: float, a: float, b: float) -> str:
    alive = f"(-({r} + x) * ln({alpha} + t))"
    gone = f"(ln({a}) - ln({b} + x - 1) - ({r} + x) * ln({alpha} + tx))"
    return (
        f"sum(lgamma({r} + x) - lgamma({r}) + {r} * ln({alpha}) + lgamma({b} + x) - lgamma({b}) - lgamma({a} + {b} + x) + lgamma({a} + {b})"
        f" + greatest({alive}, {gone}) + ln(1 + exp(-abs({alive} - {gone}))))"
    )


def _gg_sql(p: float, q: float, v: float) -> str:
    return (
        f"sum(lgamma({p} * x + {q}) - lgamma({p} * x) - lgamma({q}) + {q} * ln({v}) + ({p} * x - 1) * ln(m) + {p} * x * ln(x)"
        f" - ({p} * x + {q}) * ln(x * m + {v}))"
    )


def _slopes_sql(text, at: dict[str, float]) -> str:
    """The value, and central differences by each parameter."""
    rows = [f"SELECT 'log_likelihood' AS term, round({text(**at)}, 3) AS value FROM u"]
    for name, value in at.items():
        h = _STEP * max(1.0, value)
        up, down = (text(**{**at, name: value + s * h}) for s in (1, -1))
        rows.append(f"SELECT '{name}', round(({up} - {down}) / {2 * h}, 3) FROM u")
    return " UNION ALL ".join(rows)


_UNITS_SQL = TXNS + _SUMMARY + ", u AS (SELECT frequency::DOUBLE AS x, recency::DOUBLE AS tx, T::DOUBLE AS t, monetary AS m FROM summary) "


def _terms_table(spark: SparkSession, names, value: float, gradient) -> DataFrame:
    rows = [("log_likelihood", value), *zip(names, map(float, gradient))]
    return tidy(spark.createDataFrame(rows, "term string, value double"), 3)


@query("bgnbd_terms", _UNITS_SQL + _slopes_sql(_bg_sql, _BG))
def bgnbd_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood of the purchase model and its slopes at fixed parameters."""
    return _terms_table(spark, _BG, *clv.bgnbd_terms(_summary(spark, sf_dir), **_BG))


@query("gamma_gamma_terms", _UNITS_SQL + _slopes_sql(_gg_sql, _GG))
def gamma_gamma_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood of the spend model and its slopes at fixed parameters."""
    return _terms_table(spark, _GG, *clv.gamma_gamma_terms(_summary(spark, sf_dir), **_GG))


LTV_FEATURES = [f for f in ltv.LTV_FEATURES if f != "age"]


def _ltv_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = ltv.horizon_ltv(retail.transactions(spark, sf_dir), retail.players_untiered(spark, sf_dir))
    return wide_features(spark, sf_dir).join(targets, "player_id")


def _by_horizon(tables: dict[int, DataFrame]) -> DataFrame:
    """The tables of all horizons under each other, with a ``horizon`` in days."""
    return reduce(DataFrame.unionByName, [t.withColumn("horizon", F.lit(days)) for days, t in tables.items()])


@query("ltv_model")
def ltv_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdout metrics of each horizon's model."""
    training = materialize(_ltv_training(spark, sf_dir))
    fits = ltv.ltv_models(training, [f"ltv_{d}d" for d in ltv.HORIZONS], features=LTV_FEATURES)
    return _by_horizon({d: ltv.regression_metrics(fits[f"ltv_{d}d"][1]) for d in ltv.HORIZONS})


@query("ltv_importance")
def ltv_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top features of each horizon's model."""
    training = materialize(_ltv_training(spark, sf_dir))
    fits = ltv.ltv_models(training, [f"ltv_{d}d" for d in ltv.HORIZONS], features=LTV_FEATURES, exclude_leaky=True)
    found = {d: fits[f"ltv_{d}d"] for d in ltv.HORIZONS}
    return _by_horizon({d: ltv.feature_importance(spark, model, names) for d, (model, _, names) in found.items()})


_STUMP_FEATURES = ["d1_retained", "d30_retained", "d7_retained", "fb_connected", "tutorial_completed"]
_STUMP = (
    BOTH
    + """,
 y AS (
  SELECT p.player_id, any_value(fb_connected) AS fb_connected, any_value(tutorial_completed) AS tutorial_completed,
   any_value(d1_retained) AS d1_retained, any_value(d7_retained) AS d7_retained, any_value(d30_retained) AS d30_retained,
   coalesce(sum(price_usd) FILTER (WHERE transaction_date - install_date <= 90), 0) AS y
  FROM players p LEFT JOIN transactions t ON t.player_id = p.player_id WHERE is_payer = 1 GROUP BY p.player_id),
 long AS ("""
    + " UNION ALL ".join(f"SELECT player_id, y, {i} AS no, '{f}' AS feature, {f} AS x FROM y" for i, f in enumerate(_STUMP_FEATURES))
    + """),
 sides AS (SELECT no, feature, x, count(*) AS n, avg(y) AS m FROM long WHERE player_id % 5 <> 0 GROUP BY ALL),
 best AS (SELECT no, feature FROM sides GROUP BY ALL HAVING count(*) = 2 ORDER BY sum(n * m * m) DESC, no LIMIT 1)"""
)


def _stump(spark: SparkSession, sf_dir: str):
    """One split, whose place both engines can work out: the feature that leaves the least variance."""
    players = retail.players_untiered(spark, sf_dir)
    targets = ltv.horizon_ltv(retail.transactions(spark, sf_dir), players)
    held = F.col("player_id") % 5 == 0
    return ltv.ltv_model(
        players.join(targets, "player_id"), "ltv_90d", _STUMP_FEATURES, trees=1, depth=1,
        params={"maxBins": 32}, split=lambda data, key: (data.where(~held), data.where(held)),
    )


@query(
    "ltv_stump",
    _STUMP
    + """,
 pred AS (SELECT l.player_id, y, m FROM long l JOIN best b ON b.no = l.no JOIN sides s ON s.no = l.no AND s.x = l.x WHERE l.player_id % 5 = 0)
 SELECT player_id, round(y, 4) AS label, round(m, 4) AS prediction FROM pred""",
)
def ltv_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out predictions of the LTV regression with a single split."""
    return tidy(_stump(spark, sf_dir)[1], 4)


@query("ltv_stump_importance", _STUMP + " SELECT DISTINCT l.feature, CASE WHEN l.no = b.no THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS importance FROM long l, best b")
def ltv_stump_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _, names = _stump(spark, sf_dir)
    return tidy(ltv.feature_importance(spark, model, names))


@query(
    "regression_metrics",
    PLAYERS
    + """,
 p AS (SELECT CAST(total_sessions AS DOUBLE) AS y, 3.0 * num_purchases + 2 AS f FROM players)
 SELECT count(*) AS n, round(sqrt(avg((f - y) * (f - y))), 6) AS rmse, round(avg(abs(f - y)), 6) AS mae,
  round(1 - sum((f - y) * (f - y)) / sum((y - (SELECT avg(y) FROM p)) * (y - (SELECT avg(y) FROM p))), 6) AS r2
 FROM p""",
)
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = retail.players_untiered(spark, sf_dir).select(
        F.col("total_sessions").cast("double").alias("label"), (3.0 * F.col("num_purchases") + 2).alias("prediction")
    )
    return tidy(ltv.regression_metrics(pred))
