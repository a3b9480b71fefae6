"""Clustering, churn models, evaluation and attribution queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attribution, churn, clustering, dbscan, evaluation, features, segments
from ..session import few_tasks, materialize
from ..sources import retail
from .feature_queries import COUNTRIES, IOS
from .oracle_tables import OBS, PLAYERS
from .registry import query, tidy

SEGMENT_FEATURES = [f for f in clustering.SEGMENT_FEATURES if f not in ("max_play_streak", "age")]
CHURN_FEATURES = [f for f in churn.CHURN_FEATURES if f not in ("max_play_streak", "age")]


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile features only; nothing here needs the purchase log."""
    base = features.profile_flags(retail.players_untiered(spark, sf_dir), IOS, COUNTRIES)
    wide = features.progression_features(features.engagement_features(base, retail.OBS))
    return features.retention_score(wide)


@query(
    "standardize",
    PLAYERS
    + """,
 s AS (SELECT avg(total_sessions) AS m1, stddev_pop(total_sessions) AS s1,
  avg(coalesce(days_to_first_purchase, 0)) AS m2, stddev_pop(coalesce(days_to_first_purchase, 0)) AS s2 FROM players)
 SELECT player_id, round((total_sessions - m1) / s1, 6) AS total_sessions_z,
  round((coalesce(days_to_first_purchase, 0) - m2) / s2, 6) AS days_to_first_purchase_z FROM players JOIN s ON TRUE""",
)
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["total_sessions", "days_to_first_purchase"]
    out = clustering.standardize(retail.players_untiered(spark, sf_dir), cols)
    return tidy(out.select("player_id", *[f"{c}_z" for c in cols]))


def _vectors(spark: SparkSession, sf_dir: str, keep: list[str]) -> DataFrame:
    """Written once: statistics, fits and assignment all read it."""
    return materialize(clustering.standard_vectors(materialize(_profiles(spark, sf_dir)), SEGMENT_FEATURES, keep))


@query("kmeans_sweep")
def kmeans_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.kmeans_sweep(_vectors(spark, sf_dir, ["player_id"]), key="player_id").table(spark)


@query(
    "kmeans_nearest",
    PLAYERS + " SELECT count(*) AS n, 0::BIGINT AS not_nearest, 4::BIGINT AS clusters FROM players",
)
def kmeans_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose cluster's centre is not the nearest one."""
    data = _vectors(spark, sf_dir, ["player_id"])
    model = clustering.kmeans_sweep(data, ks=[4], key="player_id").models[4]
    x = vector_to_array("features")
    centres = [F.array(*[F.lit(float(v)) for v in c]) for c in model.centres]

    def gap(c):
        return F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)

    gaps = clustering.kmeans_assign(data, model).select("kmeans_cluster", F.array(*map(gap, centres)).alias("gaps"))
    own = F.get("gaps", F.col("kmeans_cluster"))
    return tidy(
        gaps.agg(
            F.count("*").alias("n"),
            F.count_if(own > F.array_min("gaps") * (1 + 1e-9) + 1e-9).alias("not_nearest"),
            F.countDistinct("kmeans_cluster").alias("clusters"),
        )
    )


_STEP_FEATURES = ["total_sessions", "days_active", "max_stage_reached"]
_GAP = " + ".join(f"(z.z{i} - c.z{i}) * (z.z{i} - c.z{i})" for i in range(3))


def _steps_sql(steps: int) -> str:
    """K-Means steps from the rows of the three smallest keys; ``a`` and ``c`` are the last assignment and centres."""
    scaled = ", ".join(f"(coalesce({c}, 0) - avg(coalesce({c}, 0)) OVER ()) / stddev_pop(coalesce({c}, 0)) OVER () AS z{i}" for i, c in enumerate(_STEP_FEATURES))
    text = f""",
 z AS MATERIALIZED (SELECT player_id, {scaled} FROM players),
 c0 AS (SELECT row_number() OVER (ORDER BY player_id) - 1 AS k, z0, z1, z2 FROM z QUALIFY k < 3)"""
    for i in range(steps + 1):
        text += f""",
 a{i} AS MATERIALIZED (SELECT z.*, c.k, {_GAP} AS gap FROM z, c{i} c QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY gap, c.k) = 1),
 c{i + 1} AS MATERIALIZED (SELECT k, avg(z0) AS z0, avg(z1) AS z1, avg(z2) AS z2 FROM a{i} GROUP BY k)"""
    return text


def _stepped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, clustering.KMeansFit]:
    data = materialize(clustering.standard_vectors(retail.players_untiered(spark, sf_dir), _STEP_FEATURES, ["player_id"]))
    starts = [r["features"].toArray() for r in data.orderBy("player_id").limit(3).collect()]
    return data, clustering.lloyd(data, [starts], max_iter=3)[0]


@query(
    "kmeans_steps",
    PLAYERS
    + _steps_sql(3)
    + " SELECT k, round(z0, 6) AS z0, round(z1, 6) AS z1, round(z2, 6) AS z2, (SELECT round(sum(gap), 4) FROM a3) AS inertia FROM c3",
)
def kmeans_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres after three K-Means steps from given ones, and the inertia at them."""
    _, fit = _stepped(spark, sf_dir)
    rows = [(k, *map(float, c), fit.cost) for k, c in enumerate(fit.centres)]
    return tidy(spark.createDataFrame(rows, "k int, z0 double, z1 double, z2 double, inertia double"), inertia=4)


@query(
    "kmeans_silhouette",
    PLAYERS
    + _steps_sql(3)
    + """,
 s AS MATERIALIZED (SELECT * FROM a3 ORDER BY md5(player_id::VARCHAR) LIMIT 400),
 sums AS (
  SELECT z.player_id, z.k AS own, c.k, sum(sqrt("""
    + _GAP
    + """)) AS s, count(*) AS n FROM s z, s c GROUP BY ALL),
 v AS (
  SELECT player_id, max(s / greatest(n - 1, 1)) FILTER (WHERE k = own) AS a, min(s / n) FILTER (WHERE k <> own) AS b,
   max(n) FILTER (WHERE k = own) AS m FROM sums GROUP BY player_id)
 SELECT count(*) AS n, round(avg(CASE WHEN m > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette FROM v""",
)
def kmeans_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Euclidean silhouette of those clusters within a sample of 400 rows."""
    data, fit = _stepped(spark, sf_dir)
    rows = materialize(clustering.hashed_rows(data, "player_id").orderBy("h", "x").limit(400))
    (value,) = clustering.silhouettes(rows, [fit])
    return tidy(spark.createDataFrame([(min(400, data.count()), value)], "n long, silhouette double"))


@query(
    "pca_moments",
    PLAYERS + " SELECT count(*) AS n, 0.0 AS covariance, 0.0 AS share_gap_1, 0.0 AS share_gap_2 FROM players",
)
def pca_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projections do not covary, and their variances are the explained shares of the whole variance."""
    data = _vectors(spark, sf_dir, ["player_id"])
    projected, shares = clustering.pca_project(data)
    x = vector_to_array("features")
    total = sum((F.var_samp(x[i]) for i in range(1, len(SEGMENT_FEATURES))), F.var_samp(x[0]))
    gaps = [F.abs(F.var_samp(f"pca_{j + 1}") / total - s).alias(f"share_gap_{j + 1}") for j, s in enumerate(shares)]
    return tidy(projected.agg(F.count("*").alias("n"), F.abs(F.covar_samp("pca_1", "pca_2")).alias("covariance"), *gaps))


@query("cluster_profiles")
def cluster_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = ["player_id", *segments.PROFILE_MEANS.values()]
    data = _vectors(spark, sf_dir, keep)
    sweep = clustering.kmeans_sweep(data, key="player_id")
    return segments.cluster_profiles(clustering.kmeans_assign(data, sweep.models[sweep.best_k]))


@query(
    "tier_profiles",
    PLAYERS
    + f"""
 SELECT player_tier, count(*) AS count, round(avg(total_sessions), 3) AS avg_sessions,
  round(avg(is_payer), 3) AS payer_rate, round(avg(days_active / greatest({OBS} - install_date, 1)), 3) AS avg_engagement
 FROM players GROUP BY player_tier""",
)
def tier_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group profiles over a grouping both engines can compute."""
    base = features.engagement_features(retail.players(spark, sf_dir), retail.OBS)
    means = {"avg_sessions": "total_sessions", "payer_rate": "is_payer", "avg_engagement": "engagement_ratio"}
    return tidy(segments.cluster_profiles(base, "player_tier", means))


@query("pca_project")
def pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    projected, shares = clustering.pca_project(_vectors(spark, sf_dir, ["player_id"]))
    return projected.select(
        "player_id", "pca_1", "pca_2", F.lit(shares[0]).alias("variance_1"), F.lit(shares[1]).alias("variance_2")
    )


def _outlier_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    payers = retail.players_untiered(spark, sf_dir).where(F.col("is_payer") == 1)
    return clustering.standardize(payers, clustering.OUTLIER_FEATURES)


_OUTLIER_Z = [f"{c}_z" for c in clustering.OUTLIER_FEATURES]


def _dbscan_sql(eps: float) -> str:
    """Neighbour pairs by self-join, then smallest core key spread along core links."""
    scaled = ", ".join(
        f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z{i}" for i, c in enumerate(clustering.OUTLIER_FEATURES)
    )
    distance = " + ".join(f"(a.z{i} - b.z{i}) * (a.z{i} - b.z{i})" for i in range(len(clustering.OUTLIER_FEATURES)))
    return (
        PLAYERS.replace("WITH", "WITH RECURSIVE", 1)
        + f""",
 pay AS (SELECT * FROM players WHERE is_payer = 1),
 z AS (SELECT player_id, {scaled} FROM pay),
 near AS MATERIALIZED (SELECT a.player_id AS a, b.player_id AS b FROM z a JOIN z b ON {distance} <= {eps} * {eps}),
 core AS MATERIALIZED (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 5),
 links AS MATERIALIZED (SELECT n.a, n.b FROM near n JOIN core x ON x.id = n.a JOIN core y ON y.id = n.b),
 comp(id, lead) USING KEY (id) AS (
  SELECT id, id FROM core
  UNION
  SELECT l.a, min(c.lead) FROM comp c JOIN links l ON l.b = c.id JOIN recurring.comp r ON r.id = l.a
  WHERE c.lead < r.lead GROUP BY l.a),
 numbered AS (SELECT id, dense_rank() OVER (ORDER BY lead) - 1 AS k FROM comp),
 labels AS (
  SELECT n.a AS id, min(m.k) AS k FROM near n JOIN numbered m ON m.id = n.b
  WHERE n.a = n.b OR n.a NOT IN (SELECT id FROM core) GROUP BY n.a)"""
    )


@query(
    "dbscan_flags",
    _dbscan_sql(0.5)
    + """
 SELECT z.player_id, coalesce(l.k, -1) AS cluster,
  CASE WHEN z.player_id IN (SELECT id FROM core) THEN 1 ELSE 0 END AS is_core,
  CASE WHEN l.k IS NULL THEN 1 ELSE 0 END AS is_noise
 FROM z LEFT JOIN labels l ON l.id = z.player_id""",
)
def dbscan_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small radius, which gives many clusters and much noise."""
    labels = dbscan.dbscan(_outlier_input(spark, sf_dir), "player_id", _OUTLIER_Z, eps=0.5, min_samples=5)
    noise = (F.col("cluster") == dbscan.NOISE).alias("is_noise")
    return tidy(labels.select("player_id", "cluster", "is_core", noise))


@query(
    "dbscan_labels",
    _dbscan_sql(1.5)
    + """
 SELECT p.player_id, CASE WHEN p.is_payer = 0 THEN -2 ELSE coalesce(l.k, -1) END AS dbscan_cluster
 FROM players p LEFT JOIN labels l ON l.id = p.player_id""",
)
def dbscan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default radius; players who never paid get −2."""
    labels = dbscan.dbscan(_outlier_input(spark, sf_dir), "player_id", _OUTLIER_Z)
    everyone = retail.players_untiered(spark, sf_dir).select("player_id")
    joined = everyone.join(labels.select("player_id", F.col("cluster").alias("dbscan_cluster")), "player_id", "left")
    return tidy(features.default_fill(joined, {"dbscan_cluster": -2}))


@query(
    "dbscan_chain",
    """
 WITH g AS (SELECT p_partkey, p_partkey // 50 AS g, count(*) OVER (PARTITION BY p_partkey // 50) AS n FROM part)
 SELECT p_partkey, CASE WHEN n = 1 THEN -1 ELSE dense_rank() OVER (PARTITION BY n > 1 ORDER BY g) - 1 END AS cluster,
  CASE WHEN n = 1 THEN 0 ELSE 1 END AS is_core FROM g""",
)
def dbscan_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts on a line one apart, with a gap after every fifty keys: long thin clusters."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    x = F.col("p_partkey") + 10 * F.floor(F.col("p_partkey") / 50)
    placed = parts.select("p_partkey", x.cast("double").alias("x"), F.lit(0.0).alias("y"))
    return tidy(dbscan.dbscan(placed, "p_partkey", ["x", "y"], eps=1.2, min_samples=2))


# ── evaluation over a score both engines can compute ────────────────────────


def _simple_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = 1.0 / (1.0 + F.col("total_sessions"))
    return retail.players_untiered(spark, sf_dir).select(
        "player_id",
        F.col("churned_d7").alias("label"),
        score.alias("score"),
        (score > 0.095).cast("int").alias("prediction"),
    )


_SIMPLE = """,
 s AS (SELECT player_id, churned_d7 AS label, 1.0 / (1.0 + total_sessions) AS score,
  CASE WHEN 1.0 / (1.0 + total_sessions) > 0.095 THEN 1 ELSE 0 END AS prediction FROM players)"""


@query(
    "auc_ap",
    PLAYERS
    + _SIMPLE
    + """,
 pairs AS (SELECT sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END)
   / count(*) AS auc FROM s p JOIN s n ON p.label = 1 AND n.label = 0),
 thr AS (SELECT t.score, count(*) FILTER (WHERE s.label = 1) AS tp, count(*) AS shown
  FROM (SELECT DISTINCT score FROM s) t JOIN s ON s.score >= t.score GROUP BY t.score),
 steps AS (SELECT (tp - coalesce(lag(tp) OVER (ORDER BY score DESC), 0)) * (tp / shown) AS v FROM thr)
 SELECT (SELECT count(*) FROM s WHERE label = 1) AS n_pos, (SELECT count(*) FROM s WHERE label = 0) AS n_neg,
  round((SELECT auc FROM pairs), 6) AS auc,
  round((SELECT sum(v) FROM steps) / (SELECT count(*) FROM s WHERE label = 1), 6) AS ap""",
)
def auc_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(evaluation.auc_ap(_simple_score(spark, sf_dir)))


@query("confusion", PLAYERS + _SIMPLE + " SELECT label, prediction, count(*) AS n FROM s GROUP BY label, prediction")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(evaluation.confusion(_simple_score(spark, sf_dir)))


@query(
    "classification_report",
    PLAYERS
    + _SIMPLE
    + """,
 c AS (SELECT k.class, (SELECT count(*) FROM s WHERE label = k.class) AS support,
   (SELECT count(*) FROM s WHERE prediction = k.class) AS predicted,
   (SELECT count(*) FROM s WHERE prediction = k.class AND label = k.class) AS tp
  FROM (SELECT 0 AS class UNION ALL SELECT 1) k),
 r AS (SELECT class, tp / predicted AS p, tp / support AS r, support FROM c)
 SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1, support FROM r""",
)
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(evaluation.classification_report(_simple_score(spark, sf_dir)))


@query(
    "risk_bands",
    PLAYERS
    + f""",
 s AS (SELECT least(({OBS} - last_active_date) / 400.0, 1.0) AS p FROM players)
 SELECT 1 AS bucket_no, 'Low' AS bucket, count(*) AS n FROM s WHERE p > 0 AND p <= 0.3
 UNION ALL SELECT 2, 'Medium', count(*) FROM s WHERE p > 0.3 AND p <= 0.6
 UNION ALL SELECT 3, 'High', count(*) FROM s WHERE p > 0.6 AND p <= 0.8
 UNION ALL SELECT 4, 'Critical', count(*) FROM s WHERE p > 0.8 AND p <= 1
 UNION ALL SELECT 5, 'unbinned', count(*) FROM s WHERE NOT coalesce(p > 0 AND p <= 1, false)""",
)
def risk_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.datediff(F.to_date(F.lit(retail.OBS)), "last_active_date")
    scored = retail.players_untiered(spark, sf_dir).select(F.least(days / F.lit(400.0), F.lit(1.0)).alias("p"))
    return tidy(churn.risk_bands(scored, "p"))


# ── models ──────────────────────────────────────────────────────────────────


def _churn_data(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Feature vectors, written once: training, holdout and scoring all read them."""
    data, names = churn.churn_frame(_profiles(spark, sf_dir), CHURN_FEATURES, exclude_leaky=True)
    return materialize(data), names


@query(
    "churn_split",
    PLAYERS
    + """
 SELECT CAST(churned_d7 AS DOUBLE) AS label, count(*) AS n, CAST(floor(0.2 * count(*) + 0.5) AS BIGINT) AS held_out
 FROM players GROUP BY churned_d7""",
)
def churn_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out rows per class."""
    players = retail.players_untiered(spark, sf_dir).select("player_id", F.col("churned_d7").cast("double").alias("label"))
    train, test = churn.split_stratified(materialize(players), "player_id")
    rows = train.withColumn("held", F.lit(0)).union(test.withColumn("held", F.lit(1)))
    return tidy(rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("held").alias("held_out")))


def _trained(spark: SparkSession, sf_dir: str):
    data, names = _churn_data(spark, sf_dir)
    train, _ = churn.split_stratified(data, "player_id")
    return churn.train_churn(few_tasks(train)), data, names


@query("churn_model")
def churn_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two configurations on the same split, compared on the holdout."""
    data, _ = _churn_data(spark, sf_dir)
    train, test = churn.split_stratified(data, "player_id")
    models = churn.train_configs(train)
    return evaluation.compare_models({name: churn.score(test, m, "score") for name, m in models.items()})


@query("churn_scores")
def churn_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, data, _ = _trained(spark, sf_dir)
    return churn.with_risk(churn.score(data, model)).select("player_id", "churn_probability", "churn_risk")


@query("attributions")
def attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, data, names = _trained(spark, sf_dir)
    return attribution.global_importance(attribution.attributions(data, model, scale=2.0), names)


@query(
    "attribution_sums",
    PLAYERS + " SELECT count(*) AS n, 0::BIGINT AS violations FROM players",
)
def attribution_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose attributions and base do not add up to the model's log odds."""
    model, data, _ = _trained(spark, sf_dir)
    scored = churn.score(attribution.attributions(data, model, scale=2.0), model)
    total = F.aggregate("attribution", F.lit(0.0), lambda a, v: a + v) + F.col("base")
    gap = F.abs(1 / (1 + F.exp(-total)) - F.col("churn_probability"))
    return tidy(scored.agg(F.count("*").alias("n"), F.count_if(gap > 1e-6).alias("violations")))


@query("explain_top")
def explain_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, data, names = _trained(spark, sf_dir)
    return attribution.explain_top(churn.score(data, model), model, names)


_STUMP_FEATURES = ["d1_retained", "d30_retained", "d7_retained", "fb_connected", "is_payer", "tutorial_completed"]
_STUMP = (
    PLAYERS
    + """,
 w AS (
  SELECT *, 2.0 * churned_d7 - 1 AS y,
   CASE WHEN churned_d7 = 1 THEN (SELECT count(*) FILTER (WHERE churned_d7 = 0) / count(*) FILTER (WHERE churned_d7 = 1) FROM players) ELSE 1.0 END AS w
  FROM players),
 long AS ("""
    + " UNION ALL ".join(f"SELECT player_id, y, w, {i} AS no, '{f}' AS feature, {f} AS x FROM w" for i, f in enumerate(_STUMP_FEATURES))
    + """),
 sides AS (SELECT no, feature, x, sum(w) AS n, sum(w * y) / sum(w) AS m FROM long GROUP BY ALL),
 best AS (SELECT no, feature, sum(n * m) / sum(n) AS base FROM sides GROUP BY ALL HAVING count(*) = 2 ORDER BY sum(n * m * m) DESC, no LIMIT 1),
 scored AS (
  SELECT l.player_id, l.feature, l.x, 1 / (1 + exp(-2 * s.m)) AS p, 2 * (s.m - b.base) AS phi
  FROM long l JOIN best b ON b.no = l.no JOIN sides s ON s.no = l.no AND s.x = l.x)"""
)


def _stump(spark: SparkSession, sf_dir: str):
    """One split, whose place both engines can work out: the feature that leaves the least weighted variance."""
    data, names = churn.churn_frame(retail.players_untiered(spark, sf_dir), _STUMP_FEATURES)
    data = materialize(data)
    return churn.train_churn(data, trees=1, depth=1, params={"maxBins": 32}), data, names


@query(
    "churn_stump",
    _STUMP
    + """
 SELECT player_id, round(p, 6) AS churn_probability,
  CASE WHEN p <= 0 THEN NULL WHEN p <= 0.3 THEN 'Low' WHEN p <= 0.6 THEN 'Medium' WHEN p <= 0.8 THEN 'High' ELSE 'Critical' END AS churn_risk
 FROM scored""",
)
def churn_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and bands of the weighted churn classifier with a single split."""
    model, data, _ = _stump(spark, sf_dir)
    return tidy(churn.with_risk(churn.score(data, model)).select("player_id", "churn_probability", "churn_risk"))


@query(
    "explain_stump",
    _STUMP
    + f""",
 top AS (SELECT * FROM scored ORDER BY round(p, 9) DESC, player_id LIMIT 3),
 reasons AS (
  SELECT t.player_id, t.p, l.feature, CASE WHEN l.feature = t.feature THEN t.phi ELSE 0.0 END AS phi, l.x
  FROM top t JOIN long l ON l.player_id = t.player_id)
 SELECT player_id, round(p, 6) AS churn_probability, row_number() OVER (PARTITION BY player_id ORDER BY abs(phi) DESC, feature) AS reason_no,
  feature, round(phi, 6) AS attribution, x::DOUBLE AS value FROM reasons QUALIFY reason_no <= 3""",
)
def explain_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest scores of that classifier and the reasons for them."""
    model, data, names = _stump(spark, sf_dir)
    return tidy(attribution.explain_top(churn.score(data, model), model, names))
