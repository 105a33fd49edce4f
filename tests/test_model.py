import datetime as dt
import math
import re
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from geopanel.operators import em, mesh, spde, suffstat
from geopanel.operators.kalman import StateSpace
from geopanel.operators.model import LowRankModel
from geopanel.plans.panel import PanelSpec

SQUARE = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]]
SPEC = PanelSpec()


def table(spark, n=25, t=30, missing=0.1, seed=0):
    r = np.random.default_rng(seed)
    xy = r.uniform(1, 9, (n, 2))
    ar = np.zeros((n, t))
    rows = []
    for k in range(t):
        ar[:, k] = (0.8 * ar[:, k - 1] if k else 0) + 0.4 * r.normal(0, 1, n)
    x = r.normal(0, 1, (n, t))
    y = 2 + 0.5 * x + np.sin(xy[:, :1] / 2) * np.cos(np.arange(t) / 5) + ar + 0.3 * r.normal(0, 1, (n, t))
    y[r.uniform(0, 1, (n, t)) < missing] = np.nan
    for i in range(n):
        for k in range(t):
            rows.append((i, dt.datetime(2020, 1, 1) + dt.timedelta(days=k), float(xy[i, 0]), float(xy[i, 1]), float(y[i, k]), float(x[i, k])))
    return spark.createDataFrame(rows, "site long, ts timestamp, x double, y double, v double, w double")


@pytest.fixture(scope="module")
def cov():
    return spde.Spde.of(mesh.grid_mesh([SQUARE], 1.5, 7, 7))


@pytest.fixture(scope="module")
def model(spark, cov):
    return LowRankModel.of(table(spark), "v ~ w", SPEC).setup(cov)


@pytest.fixture(scope="module")
def stats(model):
    return model.statistics()


@pytest.fixture(scope="module")
def results(model, stats):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return model.fit(options=em.FitOptions(max_iter=15, tol_relat=1e-5, f_update="weighted"), stats=stats)


def dense_model(model, stats, p):
    """The same system on dense arrays."""
    panel = model.panels[0]
    n, t, q = panel.n_sites, panel.n_times, stats.q
    y, x, h = np.full((n, t), np.nan), np.zeros((n, 2, t)), np.zeros((n, q))
    for r in panel.rows.collect():
        y[r.site_id, r.t_idx] = np.nan if r.obs is None else r.obs
        x[r.site_id, :, r.t_idx] = r.cov
    for r in model.basis(panel, 0).collect():
        h[r.site_id, r.node] = r.h
    s = em.system(p, list(model.covs), stats.factor)
    return StateSpace(h * p.A[0, 0], np.full(n, p.s2e[0]), s.f, s.q, p.x0, p.Sigma0, x, p.beta), y


def test_statistics_replace_the_panel(model, stats):
    p = em.start(stats, list(model.covs))
    ss, y = dense_model(model, stats, p)
    s = em.system(p, list(model.covs), stats.factor)
    a, b = em.e_step(stats, p, s), ss.smoother(y)
    assert a.loglik == pytest.approx(b.loglik, rel=1e-10)
    assert np.allclose(a.x, b.x, atol=1e-8) and np.allclose(a.p, b.p, atol=1e-8) and np.allclose(a.s10, b.s10, atol=1e-6)


def test_start_is_pooled_least_squares(model, stats):
    p = em.start(stats, list(model.covs))
    _, y = dense_model(model, stats, p)
    ok = np.isfinite(y)
    x = np.zeros((2, *y.shape))
    for r in model.panels[0].rows.collect():
        x[:, r.site_id, r.t_idx] = r.cov
    b = np.linalg.lstsq(x[:, ok].T, y[ok], rcond=None)[0]
    res = y[ok] - b @ x[:, ok]
    assert np.allclose(p.beta, b) and p.s2e[0] == pytest.approx(0.2 * res.var()) and p.A[0, 0] == pytest.approx(math.sqrt(0.8 * res.var()))
    assert p.f[0] == 0.7 and (p.Sigma0 == 10 * np.eye(stats.q)).all()


def test_weighted_em_climbs_and_finds_the_slope(results):
    ll = [r["loglik"] for r in results.fit.trace[1:]]
    assert all(b >= a - 1e-6 for a, b in zip(ll, ll[1:]))
    assert results.params.beta[1] == pytest.approx(0.5, abs=0.06)
    assert math.isnan(results.fit.trace[0]["loglik"]) and 0 < results.params.f[0] < 1 and results.params.s2e[0] > 0


def test_m_step_equals_per_time_formulas(model, stats):
    p = em.start(stats, list(model.covs))
    s = em.system(p, list(model.covs), stats.factor)
    sm = em.e_step(stats, p, s)
    new = em.m_step(stats, p, s, sm, list(model.covs), em.FitOptions())
    ss, y = dense_model(model, stats, p)
    h, x = ss.H / p.A[0, 0], ss.X
    ok = np.isfinite(y)
    xx, xy, s2, g, r = np.zeros((2, 2)), np.zeros(2), 0.0, 0.0, 0.0
    for t in range(y.shape[1]):
        k = ok[:, t]
        z = ss.H[k] @ sm.x[t + 1]
        xx += x[k, :, t].T @ x[k, :, t]
        xy += x[k, :, t].T @ (y[k, t] - z)
        e = y[k, t] - x[k, :, t] @ p.beta - z
        s2 += e @ e + np.einsum("ij,jk,ik->", ss.H[k], sm.p[t + 1], ss.H[k])
    beta = np.linalg.solve(xx, xy)
    for t in range(y.shape[1]):
        k = ok[:, t]
        u = h[k] @ sm.x[t + 1]
        g += u @ (y[k, t] - x[k, :, t] @ beta)
        r += u @ u + np.einsum("ij,jk,ik->", h[k], sm.p[t + 1], h[k])
    assert np.allclose(new.beta, beta) and new.s2e[0] == pytest.approx(s2 / ok.sum()) and new.A[0, 0] == pytest.approx(g / r)
    assert new.f[0] == pytest.approx(np.trace(sm.s10) / np.trace(sm.s00))


def test_kappa_step_finds_a_stationary_point(cov):
    r = np.random.default_rng(0)
    low = cov.marginal(0.9)
    x = np.linalg.solve(np.linalg.cholesky(low).T, r.normal(0, 1, (len(low), 4000)))
    k = em.minimise_kappa(cov, x @ x.T, 4000, 0.4, 1e-8)
    assert k == pytest.approx(0.9, rel=0.05)


def scripted(values):
    it = iter(values)

    def e(stats, p, s):
        class S:
            loglik = next(it)
            x = np.zeros((2, 1))

        return S()

    return e


@pytest.mark.parametrize(
    "values,mode,force,want",
    [
        ([-100, -50, -49.9, -49.9], "unweighted", False, ("tolerance", True, 3)),
        ([-100, -50, -80, -79.99, -79], "unweighted", False, ("tolerance", True, 4)),
        ([-100, -50, -80, -50], "weighted", False, ("decrease", False, 3)),
        ([-100, -50, -80, -80, -50], "weighted", True, ("tolerance", True, 4)),
        ([-100, float("nan"), -100], "unweighted", False, ("invalid", False, 2)),
        ([-100, -50, -50.01, -50], "weighted", False, ("tolerance", True, 3)),
        ([-100, -90, -80, -70, -60, -50], "unweighted", False, ("max_iter", False, 5)),
    ],
)
def test_stopping_rule(model, stats, values, mode, force, want):
    p = em.start(stats, list(model.covs))
    opt = em.FitOptions(max_iter=5, tol_relat=0.1 / max(1, stats.m.sum()) * 1.5, f_update=mode, force_iter=force)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        fit = em.fit(stats, list(model.covs), p, opt, scripted([*values, -1.0, -1.0]), lambda st, q, *a: q)
    assert (fit.termination, fit.converged, len(fit.trace) - 1) == want


def test_fixed_parameters_stay(model, stats):
    p = em.start(stats, list(model.covs)).freeze("beta", "ks")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        r = model.fit(p, em.FitOptions(max_iter=2), stats)
    assert np.array_equal(r.params.beta, p.beta) and np.array_equal(r.params.ks, p.ks) and r.params.free() == ["s2e", "f", "A"]
    bad = p.unfreeze("ks")
    with pytest.raises(ValueError, match="f is not within"):
        model.fit(em.replace(bad, f=np.array([1.2])), stats=stats)
    with pytest.raises(ValueError, match="max_iter"):
        em.FitOptions(max_iter=0)


def test_fitted_values_equal_the_dense_ones(model, stats, results):
    ss, _ = dense_model(model, stats, results.params)
    mu, var = ss.predict(results.fit.smoothed)
    for r in results.fitted().collect():
        assert r["mean"] == pytest.approx(mu[r.site_id, r.t_idx], abs=1e-8) and r.variance == pytest.approx(var[r.site_id, r.t_idx], abs=1e-8)


def test_prediction_support_and_export(spark, results):
    new = table(spark, n=3, seed=5).drop("v")
    far = new.where("site = 0").withColumns({"site": F.lit(9).cast("long"), "x": F.lit(50.0)})
    lost = new.withColumn("w", F.when(F.col("site") != 1, F.col("w")))
    pred = results.predict(lost.unionByName(far))
    rows = pred.rows.collect()
    assert {r.in_support for r in rows if r.site == 9} == {False} and {r.variance for r in rows if r.site == 9} == {0.0}
    assert {r["mean"] for r in rows if r.site == 1} == {None}
    out = pred.back_transform("exp").export()
    assert {"point_id", "timestamp", "y_pred_0", "std_y_pred_0", "in_support_0"} <= set(out.columns) and out.count() == 120
    poly = pred.to_poly([SQUARE], ["square"]).collect()
    assert len(poly) == 30 and all(r.n_points == 2 for r in poly)
    std = pred.to_poly_std([SQUARE]).collect()
    assert len(std) == 30 and all(r["std"] >= 0 for r in std)


def test_standard_errors(spark, results):
    r = results.with_errors(spark)
    e = {(x.name, x.i): x for x in r.estimates(spark).collect()}
    b = e["beta", 1]
    assert 0.005 < b.bse < 0.2 and b.lower < b.value < b.upper and b.p < 0.01
    assert e["s2e", 0].lower > 0 and -1 < e["f", 0].lower < e["f", 0].upper < 1
    assert r.aic == pytest.approx(2 * 6 - 2 * r.loglik) and "beta[1]" in r.summary(spark) and r"\toprule" in r.latex(spark)


def test_two_responses(spark, cov):
    df = table(spark, n=15, t=12)
    small = spde.Spde.of(mesh.grid_mesh([SQUARE], 1.5, 5, 5))
    m = LowRankModel.of(df, ["v ~ w", "w ~ 1"], SPEC).setup([cov, small])
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        r = m.fit(options=em.FitOptions(max_iter=4, tol_relat=0, f_update="weighted", force_iter=True))
    ll = [x["loglik"] for x in r.fit.trace[1:]]
    assert ll[-1] > ll[0] and r.params.A.shape == (2, 2)
    assert r.export().columns[4:] == ["y_hat_0", "std_y_hat_0", "in_support_0", "y_hat_1", "std_y_hat_1", "in_support_1"]


def test_site_sums_add_up(spark, model):
    """Statistics of two halves of the sites sum to those of all."""
    panel, basis = model._stacked()
    a = suffstat.collect(panel, basis, 1, 30, [2], model.factor)
    halves = [suffstat.collect(panel.where(f"site_id % 2 = {k}"), basis.where(f"site_id % 2 = {k}"), 1, 30, [2], model.factor) for k in (0, 1)]
    assert np.allclose(a.c, halves[0].c + halves[1].c) and np.allclose(a.full[0], halves[0].full[0] + halves[1].full[0])
    assert np.allclose(a.d(0, 7), halves[0].d(0, 7) + halves[1].d(0, 7))


def test_sites_are_not_dealt_by_node(results):
    """Few states go to the sites; rows of the sites are not shuffled by the few nodes they share."""
    plan = results.fitted()._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\((node|a|b)#", plan)


def test_statistics_read_a_written_basis(model):
    """The basis is evaluated once, not by each of the sums, nor held in memory."""
    _, basis = model._stacked()
    plan = basis._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "InMemoryRelation" not in plan
