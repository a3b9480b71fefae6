"""Survival, CLV, clustering, attribution and evaluation against brute force."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ludometry.functions import special
from ludometry.operators import attribution, churn, clustering, clv, components, dbscan, evaluation, funnel, places, survival
from ludometry.session import materialize


# ── tail probabilities ──────────────────────────────────────────────────────


def test_tail_probabilities():
    # Fixed values from statistical tables.
    assert special.gamma_upper(0.5, 3.841458820694124 / 2) == pytest.approx(0.05, rel=1e-10)
    assert special.gamma_upper(5, 18.307038053275146 / 2) == pytest.approx(0.05, rel=1e-10)
    assert special.beta_reg(10 / 2, 0.5, 10 / (10 + 2.2281388519649385**2)) == pytest.approx(0.05, rel=1e-9)
    assert special.normal_quantile(0.975) == pytest.approx(1.959963984540054)
    assert special.hyp2f1(np.array([1.0]), np.array([1.0]), np.array([2.0]), np.array([0.5]))[0] == pytest.approx(2 * math.log(2))


def test_chi2_yates_and_plain(spark):
    cells = {("x", 0): 30, ("x", 1): 10, ("y", 0): 20, ("y", 1): 40}
    df = spark.createDataFrame([(a, b) for (a, b), n in cells.items() for _ in range(n)], "a string, b int")
    o = np.array([[30, 10], [20, 40]], float)
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    for yates in (True, False):
        row = funnel.chi2_tests(df, ["a"], "b", yates).first()
        gap = np.abs(o - e) - (0.5 if yates else 0)
        assert row["chi2"] == pytest.approx((gap**2 / e).sum())
        assert row["p_value"] == pytest.approx(math.erfc(math.sqrt(row["chi2"] / 2)))


def test_chi2_with_an_empty_cell(spark):
    df = spark.createDataFrame([("x", "p")] * 5 + [("y", "q")] * 7 + [("z", "q")] * 2 + [("z", "p")], "a string, b string")
    o = np.array([[5, 0], [0, 7], [1, 2]], float)
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    row = funnel.chi2_tests(df, ["a"], "b").first()
    assert row["dof"] == 2 and row["chi2"] == pytest.approx(((o - e) ** 2 / e).sum())


# ── survival ────────────────────────────────────────────────────────────────


def test_kaplan_meier_edges(spark):
    rows = [("all", 3, 1), ("all", 3, 1), ("none", 5, 0), ("none", 9, 0), ("mix", 0, 1), ("mix", 2, 1), ("mix", 4, 0)]
    curve = survival.kaplan_meier(spark.createDataFrame(rows, "g string, t int, e int"), "t", "e", "g")
    got = {(r["g"], r["t"]): r["survival"] for r in curve.collect()}
    assert got[("all", 0)] == 1.0 and got[("all", 3)] == 0.0
    assert got[("none", 9)] == 1.0
    assert got[("mix", 1)] == pytest.approx(2 / 3) and got[("mix", 2)] == pytest.approx(1 / 3)
    medians = {r["g"]: r["median"] for r in survival.median_survival(curve, "g").collect()}
    assert medians == {"all": 3.0, "none": 365.0, "mix": 2.0}


@pytest.fixture(scope="module")
def lifetimes():
    rng = np.random.default_rng(11)
    n = 900
    x = rng.normal(size=(n, 2)) * [1.0, 3.0]
    t = np.maximum(1, np.ceil(rng.exponential(20 * np.exp(-0.6 * x[:, 0] + 0.1 * x[:, 1])))).astype(int)
    c = rng.integers(5, 60, n)
    return pd.DataFrame({"t": np.minimum(t, c), "e": (t <= c).astype(int), "a": x[:, 0], "b": x[:, 1]})


def _efron(data, beta, penalizer):
    x = data[["a", "b"]].to_numpy()
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    ll = 0.0
    for day in np.unique(data["t"][data["e"] == 1]):
        dead = ((data["t"] == day) & (data["e"] == 1)).to_numpy()
        risk = (data["t"] >= day).to_numpy()
        d, s0, t0 = dead.sum(), np.exp(x[risk] @ beta).sum(), np.exp(x[dead] @ beta).sum()
        ll += (x[dead] @ beta).sum() - np.log(s0 - np.arange(d) / d * t0).sum()
    return ll / len(data) - penalizer / 2 * beta @ beta


@pytest.mark.parametrize("penalizer", [0.0, 0.01])
def test_cox_maximises_the_efron_likelihood(spark, lifetimes, penalizer):
    model = survival.cox_ph(spark.createDataFrame(lifetimes), "t", "e", ["a", "b"], penalizer)
    sd = lifetimes[["a", "b"]].std(ddof=1).to_numpy()
    at = model.coef * sd
    for i in range(2):
        h = np.eye(2)[i] * 1e-4
        slope = (_efron(lifetimes, at + h, penalizer) - _efron(lifetimes, at - h, penalizer)) / 2e-4
        assert abs(slope) < 1e-6
    assert model.coef[0] > 0.4 and model.coef[1] < -0.05
    top = model.summary(spark).first()
    assert top["covariate"] == "a" and top["p"] < 1e-10


@pytest.mark.parametrize("d,s0,t0", [(30_000, 95_000.0, 31_000.0), (50_000, 50_000.0, 50_000.0), (3_000_000, 1e11, 2.9e6)])
def test_many_ties_equal_the_written_out_sums(d, s0, t0):
    w = np.arange(d) / d
    den = s0 - w * t0
    want = (np.log(den).sum(), (1 / den).sum(), (1 / den**2).sum(), (w / den).sum(), (w / den**2).sum(), (w**2 / den**2).sum())
    assert survival._tie_sums(d, s0, t0) == pytest.approx(want, rel=1e-11)


def test_a_billion_ties_keep_precision():
    """Where few of very many units fail, every denominator is nearly the same."""
    got = survival._tie_sums(10**9, 1e14, 1e9)
    w1, w2 = (10**9 - 1) / 2, (10**9 - 1) * (2 * 10**9 - 1) / 6 / 10**9
    assert got[1] == pytest.approx(10**9 / 1e14 * (1 + w1 / 1e14), rel=1e-10)
    assert got[3] == pytest.approx(w1 / 1e14, rel=1e-4) and got[5] == pytest.approx(w2 / 1e28, rel=1e-4)


def test_fractional_durations_in_curves_and_pairs(spark):
    df = spark.createDataFrame([("x", 1.2, 1, 2.0), ("x", 1.8, 1, 1.0), ("x", 2.5, 0, 0.5)], "g string, t double, e int, risk double")
    row = survival.concordance(df, "t", "e", "risk").first()
    assert (row["comparable"], row["concordance"]) == (3.0, 1.0)
    curve = survival.kaplan_meier(df, "t", "e", "g", floor=0).orderBy("t").collect()
    assert [(r["t"], round(r["survival"], 6)) for r in curve] == [(0.0, 1.0), (1.2, 0.666667), (1.8, 0.333333), (2.5, 0.333333)]


@pytest.mark.parametrize("size", [None, 7])
def test_cox_terms_of_fractional_durations(spark, lifetimes, size, monkeypatch):
    """Durations in seconds, ties among them, in one range and in many."""
    if size:
        monkeypatch.setattr(survival, "_RANGE", size)
        monkeypatch.setattr(survival, "_GATHERED", 20)
    data = lifetimes.assign(t=1 + lifetimes["t"] / 7)
    z = data.assign(a=(data["a"] - data["a"].mean()) / data["a"].std(ddof=1), b=(data["b"] - data["b"].mean()) / data["b"].std(ddof=1))
    for beta in ([0.0, 0.0], [0.5, -0.3]):
        ll, gradient = survival.cox_terms(spark.createDataFrame(z), "t", "e", ["a", "b"], beta)
        assert ll == pytest.approx(len(z) * _efron(z, np.array(beta), 0.0), rel=1e-10)
        for i in range(2):
            h = np.eye(2)[i] * 1e-5
            slope = (_efron(z, beta + h, 0.0) - _efron(z, beta - h, 0.0)) / 2e-5 * len(z)
            assert gradient[i] == pytest.approx(slope, abs=1e-4)
    if size:
        model, whole = (survival.cox_ph(spark.createDataFrame(d), "t", "e", ["a", "b"]) for d in (data, lifetimes))
        assert np.allclose(model.coef, whole.coef, atol=1e-6) and np.abs(model.gradient).max() < 1e-6


def test_cox_of_a_million_durations(spark):
    """The driver gets a vector per range, not one per duration."""
    n = 1_000_000
    t = F.floor((F.col("id") * 7919 % n) / 1.01) / 16 + n
    df = spark.range(n).select(t.alias("t"), (F.col("id") % 3 > 0).cast("double").alias("e"), F.array((F.col("id") % 7) / 7).alias("x"))
    units = survival._CoxRows(materialize(df))
    assert 60 <= len(units.edges) <= 110
    ll, gradient, info = units.terms(np.array([0.3]))
    i = np.arange(n)
    at, e, x = np.floor((i * 7919 % n) / 1.01) / 16 + n, i % 3 > 0, (i % 7) / 7
    order = np.argsort(at, kind="stable")
    x, e, at = x[order], e[order], at[order]
    risk = np.exp(0.3 * x)
    s0 = np.cumsum(risk[::-1])[::-1][np.searchsorted(at, at)]
    # Of failures at one time, the l-th loses l / d of the failing risk.
    fails = np.flatnonzero(e == 1)
    _, start, d = np.unique(at[fails], return_index=True, return_counts=True)
    place = np.arange(len(fails)) - np.repeat(start, d)
    den = s0[fails] - place / np.repeat(d, d) * np.repeat(np.add.reduceat(risk[fails], start), d)
    assert d.max() > 1 and ll == pytest.approx((0.3 * x[fails] - np.log(den)).sum(), rel=1e-9)


@pytest.mark.parametrize("rows", [1, 40])
def test_curves_carried_over_ranges(spark, monkeypatch, lifetimes, rows):
    """Cut into ranges of a few durations, a curve is the same as in one window."""
    df = spark.createDataFrame(lifetimes.assign(g=np.where(np.arange(len(lifetimes)) % 3 == 0, None, "x")))
    whole = survival.kaplan_meier(df, "t", "e", "g").collect()
    monkeypatch.setattr(places.in_ranges, "__defaults__", (rows,))
    cut = survival.kaplan_meier(df, "t", "e", "g").collect()
    key = lambda r: (r.g is None, r.point)
    for a, b in zip(sorted(whole, key=key), sorted(cut, key=key), strict=True):
        assert a[:5] == b[:5] and a.survival == pytest.approx(b.survival, rel=1e-12)


def test_a_curve_of_a_million_durations_runs_in_many_tasks(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit("x").alias("g"), F.col("id").alias("t"), F.lit(1).alias("e"))
    curve = survival.kaplan_meier(df, "t", "e", "g", floor=0).select("t", "survival", "n_at_risk", F.spark_partition_id().alias("p"))
    found = curve.agg(F.max(F.abs(F.col("survival") - (n - 1 - F.col("t")) / n)).alias("gap"), F.count("*").alias("n"), F.countDistinct("p").alias("tasks")).first()
    assert found["gap"] < 1e-9 and found["n"] == n + 1 and found["tasks"] > 1


def test_concordance_equals_all_pairs(spark, lifetimes):
    data = lifetimes.assign(risk=lifetimes["a"].round(1))
    row = survival.concordance(spark.createDataFrame(data), "t", "e", "risk", most=64).first()
    t, e, r = (data[c].to_numpy() for c in ("t", "e", "risk"))
    earlier = (e[:, None] == 1) & ((t[:, None] < t[None, :]) | ((t[:, None] == t[None, :]) & (e[None, :] == 0)))
    conc = (earlier & (r[:, None] > r[None, :])).sum()
    ties = (earlier & (r[:, None] == r[None, :])).sum()
    assert (row["concordant"], row["tied"], row["comparable"]) == (conc, ties, earlier.sum())
    assert row["concordance"] == pytest.approx((conc + ties / 2) / earlier.sum())


# ── CLV ─────────────────────────────────────────────────────────────────────


@pytest.fixture(scope="module")
def customers(spark):
    """Simulated from the model itself: r=.8, alpha=6, a=.9, b=2.5; p=6, q=4, v=15."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(3000):
        end = rng.integers(100, 300)
        rate, drop = rng.gamma(0.8, 1 / 6), rng.beta(0.9, 2.5)
        t, x, last = 0.0, 0, 0.0
        while True:
            t += rng.exponential(1 / rate)
            if t > end:
                break
            x, last = x + 1, t
            if rng.random() < drop:
                break
        nu = rng.gamma(4, 1 / 15)
        m = rng.gamma(6 * x, 1 / (nu * x)) if x else 0.0
        rows.append((i, x, int(math.ceil(last)), int(end), float(m)))
    return spark.createDataFrame(rows, "player_id int, frequency long, recency int, T int, monetary double")


def test_bgnbd_recovers_parameters(spark, customers):
    model = clv.fit_bgnbd(customers, penalizer=0.0)
    assert model.r == pytest.approx(0.8, rel=0.2) and model.alpha == pytest.approx(6, rel=0.3)
    assert model.a / (model.a + model.b) == pytest.approx(0.9 / 3.4, rel=0.2)
    alive = customers.select(model.p_alive().alias("p")).agg(F.min("p"), F.max("p")).first()
    assert 0 <= alive[0] and alive[1] <= 1
    scored = clv.with_expected_purchases(customers, model)
    low = scored.agg(F.min("pred_purchases_30d"), F.min(F.col("pred_purchases_90d") - F.col("pred_purchases_30d"))).first()
    assert low[0] >= 0 and low[1] >= 0


def test_bgnbd_expectation_by_simulation(spark):
    """Expected purchases of a new customer against direct simulation."""
    model = clv.BetaGeo(0.8, 6.0, 0.9, 2.5, 0.0)
    df = spark.createDataFrame([(0, 0, 0)], "frequency long, recency int, T int")
    got = df.select(model.expected(60.0).alias("e")).first()["e"]
    rng = np.random.default_rng(1)
    total, n = 0, 40_000
    for rate, drop in zip(rng.gamma(0.8, 1 / 6, n), rng.beta(0.9, 2.5, n)):
        t = 0.0
        while True:
            t += rng.exponential(1 / rate)
            if t > 60:
                break
            total += 1
            if rng.random() < drop:
                break
    assert got == pytest.approx(total / n, rel=0.03)


def test_gamma_gamma(spark, customers):
    buyers = customers.where("frequency > 0")
    model = clv.fit_gamma_gamma(buyers, penalizer=0.0)
    mean = model.p * model.v / (model.q - 1)
    assert mean == pytest.approx(6 * 15 / 3, rel=0.1)
    one = buyers.select(model.expected_value().alias("v"), "monetary").first()
    assert min(one["monetary"], mean) - 1e-9 <= one["v"] <= max(one["monetary"], mean) + 1e-9
    value = clv.with_clv(buyers, clv.BetaGeo(0.8, 6.0, 0.9, 2.5, 0.0), model)
    assert value.where("predicted_clv < 0").isEmpty()
    with pytest.raises(ValueError, match="positive"):
        clv.fit_gamma_gamma(customers)


# ── clustering ──────────────────────────────────────────────────────────────


def _brute_dbscan(x, eps, min_samples):
    near = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= min_samples
    label = np.full(len(x), -1)
    n = 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo, label[i] = [i], n
            while todo:
                j = todo.pop()
                for k in np.where(near[j] & core & (label < 0))[0]:
                    label[k] = n
                    todo.append(k)
            n += 1
    for i in np.where(~core)[0]:
        reach = label[near[i] & core]
        label[i] = reach.min() if len(reach) else -1
    return label, core


@pytest.mark.parametrize("d,eps,min_samples,parts", [(2, 0.3, 5, 1), (4, 0.8, 4, 6)])
def test_dbscan_equals_brute_force(spark, d, eps, min_samples, parts):
    rng = np.random.default_rng(d)
    x = np.vstack([rng.normal(rng.uniform(-2, 2, d), 0.35, (90, d)) for _ in range(3)] + [rng.uniform(-3, 3, (90, d))])
    x[:120:3] = x[0]  # a third of the first rows are copies
    pdf = pd.DataFrame(x, columns=[f"f{i}" for i in range(d)]).assign(k=np.arange(len(x)))
    df = spark.createDataFrame(pdf).repartition(parts)
    got = dbscan.dbscan(df, "k", list(pdf.columns[:-1]), eps, min_samples).toPandas().sort_values("k")
    label, core = _brute_dbscan(x, eps, min_samples)
    assert (got["cluster"].to_numpy() == label).all() and (got["is_core"].to_numpy() == core).all()
    summary = dbscan.dbscan_summary(spark.createDataFrame(got)).first()
    assert (summary["n_clusters"], summary["n_noise"]) == (label.max() + 1, (label < 0).sum())


@pytest.mark.parametrize("n", [10, 1500])
def test_dbscan_follows_a_long_chain(spark, n):
    places = np.random.default_rng(n).permutation(n)
    df = spark.createDataFrame([(int(i), float(p), 0.0) for i, p in enumerate(places)], "k long, x double, y double")
    labels = dbscan.dbscan(df, "k", ["x", "y"], 1.2, 2).collect()
    assert len(labels) == n and {r["cluster"] for r in labels} == {0}


def test_dbscan_in_twelve_dimensions(spark):
    rng = np.random.default_rng(12)
    x = np.vstack([rng.normal(rng.uniform(-3, 3, 12), 0.3, (60, 12)) for _ in range(3)] + [rng.uniform(-4, 4, (60, 12))])
    pdf = pd.DataFrame(x, columns=[f"f{i}" for i in range(12)]).assign(k=np.arange(len(x)))
    got = dbscan.dbscan(spark.createDataFrame(pdf), "k", list(pdf.columns[:-1]), 1.5, 5).toPandas().sort_values("k")
    label, core = _brute_dbscan(x, 1.5, 5)
    assert (got["cluster"].to_numpy() == label).all() and (got["is_core"].to_numpy() == core).all() and label.max() >= 2


def test_dbscan_opens_boxes_level_by_level(spark, monkeypatch):
    """Boxes of four, so cells and trees have several levels; light cells next to heavy ones."""
    monkeypatch.setattr(dbscan, "FAN", 4)
    monkeypatch.setattr(dbscan, "CELL_FAN", 4)
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 0.15, (150, 2)), rng.normal((1.1, 0), 0.1, (80, 2)), rng.uniform(-2, 3, (150, 2))])
    pdf = pd.DataFrame(x, columns=["a", "b"]).assign(k=np.arange(len(x)))
    for eps, least in ((0.3, 12), (0.15, 4)):
        got = dbscan.dbscan(spark.createDataFrame(pdf), "k", ["a", "b"], eps, least).toPandas().sort_values("k")
        label, core = _brute_dbscan(x, eps, least)
        assert (got["cluster"].to_numpy() == label).all() and (got["is_core"].to_numpy() == core).all()


def test_dbscan_of_two_dense_boxes_an_eps_apart(spark, monkeypatch):
    """Whether they touch is decided near their faces, not by all pairs of their points."""
    seen = []
    whole = dbscan._Grid._witnessed

    def counted(self, pairs, left, right):
        before = dbscan.materialize

        def watch(df):
            out = before(df)
            if "met" in out.columns:
                seen.append(out.count())
            return out

        monkeypatch.setattr(dbscan, "materialize", watch)
        found = whole(self, pairs, left, right)
        monkeypatch.setattr(dbscan, "materialize", before)
        return found

    monkeypatch.setattr(dbscan._Grid, "_witnessed", counted)
    rng = np.random.default_rng(1)
    n, side = 20_000, 0.7
    left, right = rng.uniform(0, side, (n, 2)), rng.uniform(0, side, (n, 2))
    left[:, 0] = np.minimum(left[:, 0], side - 1e-9)
    right[:, 0] += side + 1.0 + 1e-6  # nothing is within one of the other box
    pdf = pd.DataFrame(np.vstack([left, right]), columns=["a", "b"]).assign(k=np.arange(2 * n))
    labels = dbscan.dbscan(spark.createDataFrame(pdf), "k", ["a", "b"], 1.0, 5)
    assert labels.agg(F.countDistinct("cluster").alias("c"), F.min("cluster").alias("m")).first() == (2, 0)
    assert sum(seen) < 20_000


def test_dbscan_of_nothing(spark):
    empty = spark.createDataFrame([], "k long, x double")
    assert dbscan.dbscan(empty, "k", ["x"], 1.0, 2).count() == 0


def test_dbscan_calls_null_rows_noise(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 0.1), (3, None), (4, float("nan")), (5, float("inf"))], "k long, x double")
    got = {r["k"]: (r["cluster"], r["is_core"]) for r in dbscan.dbscan(df, "k", ["x"], 1.0, 2).collect()}
    assert got == {1: (0, True), 2: (0, True), 3: (-1, False), 4: (-1, False), 5: (-1, False)}


@pytest.mark.parametrize("last", [0, 700, 100_000])
def test_components_of_a_shuffled_chain(spark, monkeypatch, last):
    """Contracted to the end, finished by one task after some rounds, and at once."""
    monkeypatch.setattr(components, "LAST", last)
    ids = np.random.default_rng(1).permutation(5000).tolist()
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    got = components.connected_components(spark.range(5003), edges).collect()
    assert len(got) == 5003 and {r["component"] for r in got} == {0, 5000, 5001, 5002}


def test_dbscan_distance_equal_to_eps_is_inside(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.5, 0.0), (2, 3.0, 0.0), (3, 9.0, 9.0)], "k int, x double, y double")
    got = {r["k"]: (r["cluster"], r["is_core"]) for r in dbscan.dbscan(df, "k", ["x", "y"], 1.5, 2).collect()}
    assert got == {0: (0, True), 1: (0, True), 2: (0, True), 3: (-1, False)}


def test_standardize(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, c double")
    z = np.array([tuple(r) for r in clustering.standardize(df, ["a", "c"]).select("a_z", "c_z").collect()])
    raw = np.array([1.0, 3.0, 0.0])
    assert np.allclose(z[:, 0], (raw - raw.mean()) / raw.std()) and np.allclose(z[:, 1], 0)


def test_kmeans_and_pca(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c, 0.2, (60, 3)) for c in ((0, 0, 0), (4, 4, 0), (0, 5, 5))])
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(k=np.arange(180)))
    data = clustering.standard_vectors(df, list("abc"), ["k"])
    sweep = clustering.kmeans_sweep(data, ks=(2, 3, 4), restarts=2, key="k")
    assert sweep.best_k == 3
    assert [s[1] for s in sweep.scores] == sorted((s[1] for s in sweep.scores), reverse=True)
    assert clustering.kmeans_assign(data, sweep.models[3]).select("kmeans_cluster").distinct().count() == 3
    projected, shares = clustering.pca_project(data, 2)
    z = (x - x.mean(0)) / x.std(0)
    values = np.linalg.eigvalsh(np.cov(z.T))[::-1]
    assert np.allclose(shares, values[:2] / values.sum())
    p = projected.toPandas()
    assert abs(p["pca_1"].corr(p["pca_2"])) < 1e-9 and abs(p["pca_1"].mean()) < 1e-9


# ── churn, evaluation, attribution ──────────────────────────────────────────


@pytest.fixture(scope="module")
def churn_data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 3))
    p = 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] * (x[:, 0] > 0))))
    pdf = pd.DataFrame(x, columns=list("abc")).assign(player_id=np.arange(1200), churned_d7=(rng.random(1200) < p).astype(int))
    return churn.churn_frame(spark.createDataFrame(pdf), list("abc"))


@pytest.fixture(scope="module")
def churn_fit(churn_data):
    data, _ = churn_data
    train, _ = churn.split_stratified(data, "player_id")
    return churn.train_churn(train, trees=6, depth=3)


def test_split_is_stable_and_complete(churn_data):
    data, _ = churn_data
    train, test = churn.split_stratified(data, "player_id")
    again = churn.split_stratified(data.repartition(5), "player_id")[1]
    ids = {r["player_id"] for r in test.collect()}
    assert ids == {r["player_id"] for r in again.collect()}
    assert train.count() + len(ids) == 1200
    sizes = {r["label"]: r["count"] for r in data.groupBy("label").count().collect()}
    held = {r["label"]: r["count"] for r in test.groupBy("label").count().collect()}
    assert all(abs(held[y] - 0.2 * n) <= 0.5 for y, n in sizes.items())


def test_attributions_sum_to_the_log_odds(churn_data, churn_fit):
    data, _ = churn_data
    scored = churn.score(attribution.attributions(data, churn_fit, scale=2.0), churn_fit)
    total = F.aggregate("attribution", F.lit(0.0), lambda a, v: a + v) + F.col("base")
    worst = scored.agg(F.max(F.abs(1 / (1 + F.exp(-total)) - F.col("churn_probability")))).first()[0]
    assert worst < 1e-9


@pytest.mark.parametrize("conditions", [1, 2, 7])
def test_attributions_equal_shapley_by_definition(spark, churn_data, churn_fit, monkeypatch, conditions):
    """Paths of one piece and of several, sibling leaves and lone ones."""
    monkeypatch.setattr(attribution, "_PIECE", conditions)
    data, _ = churn_data
    table = attribution.leaf_table(spark, churn_fit)
    x = np.array([r["features"].toArray() for r in data.limit(5).collect()])
    got = attribution.shapley(x, table)
    assert table.twin.any() and not table.twin.all()

    def value(row, coalition):
        inside = (row[table.feature] > table.low) & (row[table.feature] <= table.high)
        known = np.isin(table.feature, list(coalition))
        padded = np.isinf(table.low) & np.isinf(table.high)
        return (table.value * np.where(known & ~padded, inside, table.share).prod(axis=1)).sum()

    for row, phi in zip(x, got):
        for i in range(3):
            rest = [j for j in range(3) if j != i]
            want = 0.0
            for k in range(3):
                for s in itertools.combinations(rest, k):
                    w = math.factorial(k) * math.factorial(2 - k) / 6
                    want += w * (value(row, (*s, i)) - value(row, s))
            assert phi[i] == pytest.approx(want, abs=1e-12)


def test_explanations(churn_data, churn_fit):
    data, names = churn_data
    top = attribution.explain_top(churn.score(data, churn_fit), churn_fit, names, k=3, reasons=2)
    rows = top.collect()
    assert len(rows) == 6
    assert {r["reason_no"] for r in rows} == {1, 2}
    ranking = attribution.global_importance(attribution.attributions(data, churn_fit), names).collect()
    assert ranking[0]["feature"] == "a"


def test_auc_and_average_precision(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 800)
    s = np.round(rng.normal(y, 1.5), 1)
    row = evaluation.auc_ap(spark.createDataFrame(pd.DataFrame({"label": y, "score": s})), most=64).first()
    pos, neg = s[y == 1], s[y == 0]
    auc = (pos[:, None] > neg[None, :]).mean() + (pos[:, None] == neg[None, :]).mean() / 2
    ap, seen = 0.0, 0
    for v in sorted(set(s), reverse=True):
        tp, shown = ((s >= v) & (y == 1)).sum(), (s >= v).sum()
        ap, seen = ap + (tp - seen) * tp / shown, tp
    assert row["auc"] == pytest.approx(auc) and row["ap"] == pytest.approx(ap / y.sum())


def test_model_comparison_ties_go_to_the_first(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.9)], "label int, score double")
    rows = evaluation.compare_models({"x": df, "y": df}).orderBy("model_no").collect()
    assert [r["is_best"] for r in rows] == [True, False]


def test_report_with_a_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (0, 0)], "label int, prediction int")
    rows = {r["class"]: r for r in evaluation.classification_report(df).collect()}
    assert (rows[1]["precision"], rows[1]["recall"], rows[1]["f1"], rows[1]["support"]) == (0.0, 0.0, 0.0, 1)
    assert rows[0]["recall"] == 1.0


def test_conversion_drivers(spark):
    rng = np.random.default_rng(6)
    n = 2000
    pdf = pd.DataFrame(
        {
            "platform": rng.choice(["iOS", "Android"], n),
            "gender": rng.choice(["M", "F"], n),
            "country": rng.choice(["US", "UK", "JP"], n),
            "age": rng.integers(13, 60, n),
        }
    )
    pdf["is_payer"] = (rng.random(n) < 1 / (1 + np.exp(-(1.5 * (pdf["platform"] == "iOS") - 1)))).astype(int)
    wide, names = funnel.driver_features(spark.createDataFrame(pdf), numeric=["age"], n_dummies=2)
    assert names[:3] == ["platform_enc", "gender_enc", "age"] and len(names) == 5
    coefs = {r["feature"]: r for r in funnel.conversion_drivers(wide, names).collect()}
    assert coefs["platform_enc"]["coefficient"] == pytest.approx(1.5, abs=0.25)
    assert coefs["platform_enc"]["odds_ratio"] == pytest.approx(math.exp(coefs["platform_enc"]["coefficient"]))


_CHURN_QUERIES = ["churn_model", "churn_scores", "attributions", "attribution_sums", "explain_top"]


@pytest.mark.parametrize("name", [*_CHURN_QUERIES, "kmeans_sweep", "kmeans_nearest", "cluster_profiles", "ltv_model", "ltv_importance"])
def test_model_queries_use_the_defaults(spark, monkeypatch, name):
    """What a query asks of its operator is not below the operator's default."""
    import inspect

    from ludometry.operators import ltv
    from ludometry.plans.catalog import QUERIES

    module, function, what, default = (
        (churn, "train_churn", "trees", 300) if name in _CHURN_QUERIES else (ltv, "ltv_model", "trees", 200) if name.startswith("ltv") else (clustering, "kmeans_sweep", "restarts", 10)
    )
    operator, asked = getattr(module, function), []

    def small(*args, **kwargs):
        bound = inspect.signature(operator).bind(*args, **kwargs)
        bound.apply_defaults()
        asked.append((bound.arguments[what], bound.arguments.get("target")))
        bound.arguments[what] = 1
        return operator(*bound.args, **bound.kwargs)

    monkeypatch.setattr(module, function, small)
    out = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert asked and all(n == default for n, _ in asked)
    if name.startswith("ltv"):
        assert sorted(t for _, t in asked) == ["ltv_30d", "ltv_7d", "ltv_90d"] and {r.horizon for r in out.collect()} == {7, 30, 90}


def test_dbscan_of_a_dense_field_asks_little(spark, monkeypatch):
    """Cells that others have connected are not compared, so few members are opened in a field of dense cells."""
    asked, plain = [], dbscan.materialize

    def watch(df):
        out = plain(df)
        if "met" in out.columns:
            asked.append(out.count())
        return out

    monkeypatch.setattr(dbscan, "materialize", watch)
    monkeypatch.setattr(dbscan, "FAN", 8)
    n, cells = 6000, 36
    x = np.random.default_rng(4).uniform(0, cells**0.5 / 2**0.5, (n, 2))
    pdf = pd.DataFrame(x, columns=["a", "b"]).assign(k=np.arange(n))
    got = dbscan.dbscan(spark.createDataFrame(pdf), "k", ["a", "b"], 1.0, 5).toPandas()
    assert (got["cluster"] == 0).all() and got["is_core"].all()
    assert sum(asked) <= n, asked


def test_purchase_summaries_are_written_once(spark, monkeypatch):
    """What fits, checks and scoring read is a written table, not the purchase log again."""
    from ludometry.plans import ltv_queries

    rows = [(i, 1 + i % 3, i % 5, 9, 1.5 + i) for i in range(6)]
    summary = spark.createDataFrame(rows, "player_id long, frequency long, recency int, T int, monetary double")
    monkeypatch.setattr(ltv_queries.retail, "transactions", lambda *_: None)
    monkeypatch.setattr(ltv_queries.ltv, "clv_summary", lambda *_: summary)
    got = ltv_queries._summary(spark, "")
    assert got.inputFiles() and all("/stage-" in f for f in got.inputFiles())
    assert sorted(map(tuple, got.collect())) == rows


def test_kmeans_members_are_those_of_the_nearest_centres():
    """Models of several sizes at once; of equal centres the first one counts."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3))
    models = [rng.normal(size=(k, 3)) for k in (2, 5, 2, 3)]
    models[3][2] = models[3][0]
    starts = np.cumsum([0, *map(len, models)])
    mine = clustering._members(x, models, starts)
    for start, c in zip(starts, models):
        gaps = ((x[:, None, :] - c) ** 2).sum(axis=2)
        assert (mine[start : start + len(c)].T == np.eye(len(c))[gaps.argmin(axis=1)]).all()


def test_fits_at_the_same_time_share_the_slots(spark, monkeypatch):
    """Their parts are equal, no more than the slots together, and bounded; few rows stay one part."""
    from ludometry import session

    slots = spark.sparkContext.defaultParallelism
    rows = spark.range(2000).coalesce(1)
    sizes = lambda df: df.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert session.few_tasks(rows, fits=2).rdd.getNumPartitions() == 1
    monkeypatch.setattr(session, "_ROWS_A_TASK", 10)
    for fits in (2, 3, 10 * slots):
        parts = sizes(session.few_tasks(rows, fits=fits))
        assert len(parts) == max(1, slots // fits) and sum(parts) == 2000 and max(parts) - min(parts) <= slots
    monkeypatch.setattr(session, "_ROWS_AT_MOST", 100)
    parts = sizes(session.few_tasks(rows, fits=10 * slots))
    assert len(parts) == 20 and max(parts) <= 100 + slots
    assert sorted(r.id for r in session.few_tasks(rows, fits=2).collect()) == list(range(2000))


def test_models_of_one_query_know_of_each_other(spark, monkeypatch):
    """Configurations and horizons ask for training rows as fits at the same time."""
    from ludometry.operators import ltv

    asked = []
    for module in (churn, ltv):
        plain = module.few_tasks
        monkeypatch.setattr(module, "few_tasks", lambda rows, fits=1, plain=plain: asked.append(fits) or plain(rows, fits))
    wide = spark.range(60).select(F.col("id").alias("player_id"), (F.col("id") % 7).alias("a"), (F.col("id") % 2).alias("y"), (F.col("id") % 5).alias("z"))
    ltv.ltv_models(wide, ["y", "z"], features=["a"], trees=1, depth=1, params={})
    data, _ = churn.churn_frame(wide, ["a"], "y")
    churn.train_configs(data, trees=1, depth=1)
    assert asked == [2, 2, 2]


def _silhouette_by_definition(x, centres):
    label = ((x[:, None, :] - centres) ** 2).sum(axis=2).argmin(axis=1)
    values = []
    for row, own in zip(x, label):
        gaps = np.sqrt(((x - row) ** 2).sum(axis=1))
        sums, sizes = (np.bincount(label, weights=w, minlength=len(centres)) for w in (gaps, None))
        if sizes[own] == 1 or np.count_nonzero(sizes) == 1:
            values.append(0.0)
            continue
        a = sums[own] / (sizes[own] - 1)
        b = min(s / n for k, (s, n) in enumerate(zip(sums, sizes)) if n and k != own)
        values.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.mean(values)


def test_kmeans_sweep_scores_all_rows(spark):
    """Also those beyond the first thousands, and keys that repeat or are null."""
    x = np.random.default_rng(5).normal(size=(5600, 2))
    keys = [None if i % 3 == 0 else i // 5 for i in range(len(x))]
    data = clustering.standard_vectors(spark.createDataFrame([(k, *map(float, r)) for k, r in zip(keys, x)], "k long, a double, b double"), ["a", "b"], ["k"])
    sweep = clustering.kmeans_sweep(data, ks=(2, 3), restarts=1, max_iter=5, key="k")
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    assert [s for *_, s in sweep.scores] == pytest.approx([_silhouette_by_definition(z, sweep.models[k].centres) for k in (2, 3)], abs=1e-9)


@pytest.mark.parametrize("side, piece", [(1, 7), (5000, 16), (1 << 20, 1024)])
def test_silhouettes_by_definition(spark, monkeypatch, side, piece):
    """Many blocks and one; crowds of equal and of close rows far from 0, a cluster of one, an empty one, a model of one."""
    monkeypatch.setattr(clustering, "_SIDE_BYTES", side)
    monkeypatch.setattr(clustering, "_PIECE_ROWS", piece)
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(60, 3)), np.full((50, 3), 4.0), 1000 + 1e-3 * rng.normal(size=(30, 3)), [[-50.0, 0, 0]]])
    models = [
        np.array([[0.0, 0, 0], [1000, 1000, 1000], [-50, 0, 0], [-50, 1, 0]]),
        np.array([[0.5, 0, 0], [4, 4, 4], [1000, 1000, 1000 - 1e-3], [1000, 1000, 1000 + 1e-3], [1e6, 0, 0]]),
        np.array([[0.0, 0, 0]]),
    ]
    rows = materialize(spark.createDataFrame([(r,) for r in x.tolist()], "x array<double>"))
    got = clustering.silhouettes(rows, [clustering.KMeansFit(c, 0.0, 1) for c in models])
    assert got == pytest.approx([_silhouette_by_definition(x, c) for c in models], abs=1e-7)
    assert clustering.silhouettes(rows.limit(0), [clustering.KMeansFit(models[0], 0.0, 1)]) == [0.0]
