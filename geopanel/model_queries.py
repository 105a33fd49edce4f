"""Queries of the fitted model: filters, moments, EM steps, fitted values, predictions and areal means by the library, each
with DuckDB SQL that derives the same values by itself from the bundled tables.

Two settings keep SQL possible. The small model has two latent nodes, at the left and the right end of the area, between
which a site interpolates: 2 x 2 algebra written out. The given model has a lattice of latent nodes with states and
covariances stated by a formula, as if a fit had ended there.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geopanel.functions import special
from geopanel.operators import em, kalman, mesh, spde, suffstat, work
from geopanel.operators.model import LowRankModel, Results
from geopanel.plans import panel as pn
from geopanel.queries import _BASIS_SQL, _NAMES, _POLYS, _SPEC, _events_long, _hits_sql, r6
from geopanel.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


# --- two latent nodes ----------------------------------------------------------------------------------------------------

_WIDE = 10.1
_B0, _B1, _NOISE, _F, _LOAD = 0.5, 0.25, 0.3, 0.7, 0.8
_Q11, _Q12, _Q22 = 1.0, 0.3, 0.8
_LN2PI = math.log(2 * math.pi)
_INFO = _LOAD**2 / _NOISE


class _Nodes:
    """Stands for a mesh of the two nodes where only a starting range is asked for."""

    def start_kappa(self) -> float:
        return 0.5


def _small(spark: SparkSession, d: str, panel: pn.Panel | None = None) -> tuple[suffstat.Stats, em.Params, em.System]:
    """Statistics of the events panel on the two nodes, parameters and transition of the small model."""
    rows = (panel or pn.build(_events_long(spark, d), "obs ~ x1", _SPEC)).rows
    panel = rows.select(F.lit(0).alias("var"), "site_id", "t_idx", "obs", "cov")
    right = F.col("x") / _WIDE
    h = F.explode(F.array(F.struct(F.lit(0).alias("node"), (1 - right).alias("h")), F.struct(F.lit(1).alias("node"), right.alias("h")))).alias("p")
    basis = rows.select("site_id", "x").distinct().select(F.lit(0).alias("var"), "site_id", h).select("var", "site_id", "p.node", "p.h")
    stats = suffstat.collect(panel, basis, 1, T.DAYS, [2], np.array([0, 0]))
    p = em.Params(np.array([_B0, _B1]), np.array([_NOISE]), np.array([_F]), np.array([[_LOAD]]), np.array([1.0]), np.zeros(2), np.eye(2), frozenset({"ks"}))
    q = np.array([[_Q11, _Q12], [_Q12, _Q22]])
    return stats, p, em.System(np.full(2, _F), q, [np.linalg.inv(q)])


_OBS_SQL = f"""{T.PANEL_SQL},
o AS (SELECT site, t, x1, obs, 1 - px / {_WIDE} AS h1, px / {_WIDE} AS h2, obs - {_B0} - {_B1} * x1 AS e FROM panel WHERE obs IS NOT NULL),
s AS (SELECT g.t AS t, count(obs) AS n, {_INFO!r} * coalesce(sum(h1 * h1), 0) AS i1, {_INFO!r} * coalesce(sum(h1 * h2), 0) AS i2, {_INFO!r} * coalesce(sum(h2 * h2), 0) AS i3,
  {_LOAD / _NOISE!r} * coalesce(sum(h1 * e), 0) AS v1, {_LOAD / _NOISE!r} * coalesce(sum(h2 * e), 0) AS v2, coalesce(sum(e * e), 0) / {_NOISE} AS qd
  FROM generate_series(0, {T.DAYS - 1}) AS g(t) LEFT JOIN o ON o.t = g.t GROUP BY g.t)"""
_FILTER_SQL = f"""{_OBS_SQL},
f(t, x1, x2, p1, p2, p3, a1, a2, c1, c2, c3, ll) AS (
  SELECT -1::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT t, a1 + (k1 * w1 + k2 * w2), a2 + (k2 * w1 + k3 * w2), k1, k2, k3, a1, a2, c1, c2, c3,
    ll - CASE WHEN n > 0 THEN 0.5 * (ln(dpost) + ln(dprior) + n * {math.log(_NOISE)!r} + qd - 2 * (a1 * v1 + a2 * v2) + a1 * (i1 * a1 + i2 * a2) + a2 * (i2 * a1 + i3 * a2) - (w1 * (k1 * w1 + k2 * w2) + w2 * (k2 * w1 + k3 * w2)) + n * {_LN2PI!r}) ELSE 0 END
  FROM (SELECT *, r3 / dpost AS k1, -r2 / dpost AS k2, r1 / dpost AS k3, v1 - (i1 * a1 + i2 * a2) AS w1, v2 - (i2 * a1 + i3 * a2) AS w2 FROM (
    SELECT *, r1 * r3 - r2 * r2 AS dpost FROM (
      SELECT *, c3 / dprior + i1 AS r1, -c2 / dprior + i2 AS r2, c1 / dprior + i3 AS r3 FROM (
        SELECT *, c1 * c3 - c2 * c2 AS dprior FROM (
          SELECT s.*, f.ll, {_F} * f.x1 AS a1, {_F} * f.x2 AS a2, {_F * _F!r} * f.p1 + {_Q11} AS c1, {_F * _F!r} * f.p2 + {_Q12} AS c2, {_F * _F!r} * f.p3 + {_Q22} AS c3
          FROM f JOIN s ON s.t = f.t + 1)))))
)"""
#: Smoothed states from the last step back; l1 .. l4 are the covariances of a state with the one before it.
_SMOOTH_SQL = f"""{_FILTER_SQL},
b(t, x1, x2, p1, p2, p3, l1, l2, l3, l4) AS (
  SELECT t, x1, x2, p1, p2, p3, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM f WHERE t = {T.DAYS - 1}
  UNION ALL
  SELECT t, m1 + j1 * d1 + j2 * d2, m2 + j3 * d1 + j4 * d2,
    g1 + j1 * (e1 * j1 + e2 * j2) + j2 * (e2 * j1 + e3 * j2), g2 + j1 * (e1 * j3 + e2 * j4) + j2 * (e2 * j3 + e3 * j4), g3 + j3 * (e1 * j3 + e2 * j4) + j4 * (e2 * j3 + e3 * j4),
    n1 * j1 + n2 * j2, n1 * j3 + n2 * j4, n2 * j1 + n3 * j2, n2 * j3 + n3 * j4
  FROM (SELECT u.t, u.x1 AS m1, u.x2 AS m2, u.p1 AS g1, u.p2 AS g2, u.p3 AS g3, b.p1 AS n1, b.p2 AS n2, b.p3 AS n3,
      {_F} * (u.p1 * w.c3 - u.p2 * w.c2) / (w.c1 * w.c3 - w.c2 * w.c2) AS j1, {_F} * (u.p2 * w.c1 - u.p1 * w.c2) / (w.c1 * w.c3 - w.c2 * w.c2) AS j2,
      {_F} * (u.p2 * w.c3 - u.p3 * w.c2) / (w.c1 * w.c3 - w.c2 * w.c2) AS j3, {_F} * (u.p3 * w.c1 - u.p2 * w.c2) / (w.c1 * w.c3 - w.c2 * w.c2) AS j4,
      b.x1 - w.a1 AS d1, b.x2 - w.a2 AS d2, b.p1 - w.c1 AS e1, b.p2 - w.c2 AS e2, b.p3 - w.c3 AS e3
    FROM b JOIN f u ON u.t = b.t - 1 JOIN f w ON w.t = b.t)
)"""


def _states(spark: SparkSession, x: np.ndarray, p: np.ndarray, *more: tuple[str, np.ndarray]) -> DataFrame:
    """t from -1 on, both states, their covariances, and further columns."""
    cols = [x[:, 0], x[:, 1], p[:, 0, 0], p[:, 0, 1], p[:, 1, 1], *[v for _, v in more]]
    names = ["x1", "x2", "p1", "p2", "p3", *[n for n, _ in more]]
    rows = [(t - 1, *[round(float(c[t]), 5) + 0.0 for c in cols]) for t in range(len(x))]
    return spark.createDataFrame(rows, "t long, " + ", ".join(f"{n} double" for n in names))


def _r(*names: str, digits: int = 5) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)


@query(f"WITH RECURSIVE {_FILTER_SQL} SELECT t, {_r('x1', 'x2', 'p1', 'p2', 'p3')} FROM f")
def filter_two_nodes(spark: SparkSession, d: str) -> DataFrame:
    stats, p, s = _small(spark, d)
    f = kalman.information_filter(lambda t: stats.step(t, p.beta, p.s2e, p.A), stats.n_steps, s.f, s.q, p.x0, p.Sigma0)
    return _states(spark, f.x, f.p)


@query(f"WITH RECURSIVE {_FILTER_SQL} SELECT t, {_r('a1', 'a2', 'c1', 'c2', 'c3')} FROM f WHERE t >= 0")
def filter_one_step_ahead(spark: SparkSession, d: str) -> DataFrame:
    stats, p, s = _small(spark, d)
    f = kalman.information_filter(lambda t: stats.step(t, p.beta, p.s2e, p.A), stats.n_steps, s.f, s.q, p.x0, p.Sigma0)
    return _states(spark, f.xp, f.pp).where("t >= 0").toDF("t", "a1", "a2", "c1", "c2", "c3")


_AIC_SQL = f"SELECT round(ll, 4) AS loglik, n AS nobs, 6::BIGINT AS n_params, n - 6 AS df_resid, round(12 - 2 * ll, 4) AS aic, round(6 * ln(n) - 2 * ll, 4) AS bic, {T.DAYS} * sites - n AS missing FROM (SELECT ll FROM f WHERE t = {T.DAYS - 1}), (SELECT count(*) AS n FROM o), (SELECT count(DISTINCT site) AS sites FROM panel)"


def _ended(stats: suffstat.Stats, p: em.Params, s: em.System, model: LowRankModel) -> Results:
    sm = em.e_step(stats, p, s)
    return Results(model, stats, em.Fit(p, sm, sm.loglik, True, "tolerance", []), em.FitOptions())


@query(f"WITH RECURSIVE {_FILTER_SQL} {_AIC_SQL}")
def information_criteria(spark: SparkSession, d: str) -> DataFrame:
    panel = pn.build(_events_long(spark, d), "obs ~ x1", _SPEC)
    stats, p, s = _small(spark, d, panel)
    r = _ended(stats, p.unfreeze("ks"), s, LowRankModel((panel,), (None,)))
    row = (round(r.loglik, 4), r.nobs, r.n_params, r.df_resid, round(r.aic, 4), round(r.bic, 4), r.missing)
    return spark.createDataFrame([row], "loglik double, nobs long, n_params long, df_resid long, aic double, bic double, missing long")


@query(f"WITH RECURSIVE {_SMOOTH_SQL} SELECT t, {_r('x1', 'x2', 'p1', 'p2', 'p3')} FROM b")
def smoother_two_nodes(spark: SparkSession, d: str) -> DataFrame:
    stats, p, s = _small(spark, d)
    sm = em.e_step(stats, p, s)
    return _states(spark, sm.x, sm.p)


@query(f"WITH RECURSIVE {_SMOOTH_SQL} SELECT t + 1 AS t, {_r('l1', 'l2', 'l3', 'l4')} FROM b WHERE t < {T.DAYS - 1}")
def smoother_lag_one(spark: SparkSession, d: str) -> DataFrame:
    stats, p, s = _small(spark, d)
    lag = em.e_step(stats, p, s).lag
    rows = [(t, *[round(float(v), 5) + 0.0 for v in lag[t].ravel()]) for t in range(len(lag))]
    return spark.createDataFrame(rows, "t long, l1 double, l2 double, l3 double, l4 double")


#: Moment sums of the E-step: of states, of each with the one before, and of those before.
_MOMENT_SQL = f"""{_SMOOTH_SQL},
z AS (SELECT n.t, n.x1, n.x2, n.p1, n.p2, n.p3, o.x1 AS y1, o.x2 AS y2, o.p1 AS q1, o.p2 AS q2, o.p3 AS q3, o.l1, o.l2, o.l3, o.l4 FROM b n JOIN b o ON o.t = n.t - 1),
mo AS (SELECT sum(x1 * x1 + p1) AS a1, sum(x1 * x2 + p2) AS a2, sum(x2 * x2 + p3) AS a3, sum(x1 * y1 + l1) AS b1, sum(x1 * y2 + l2) AS b2, sum(x2 * y1 + l3) AS b3, sum(x2 * y2 + l4) AS b4, sum(y1 * y1 + q1) AS c1, sum(y1 * y2 + q2) AS c2, sum(y2 * y2 + q3) AS c3 FROM z)"""


@query(f"WITH RECURSIVE {_MOMENT_SQL} SELECT {_r('a1', 'a2', 'a3', 'b1', 'b2', 'b3', 'b4', 'c1', 'c2', 'c3', digits=4)} FROM mo")
def e_step_moments(spark: SparkSession, d: str) -> DataFrame:
    stats, p, s = _small(spark, d)
    m = em.e_step(stats, p, s)
    v = [m.s11[0, 0], m.s11[0, 1], m.s11[1, 1], *m.s10.ravel(), m.s00[0, 0], m.s00[0, 1], m.s00[1, 1]]
    names = "a1 a2 a3 b1 b2 b3 b4 c1 c2 c3".split()
    return spark.createDataFrame([tuple(round(float(x), 4) for x in v)], ", ".join(f"{n} double" for n in names))


_DET = _Q11 * _Q22 - _Q12**2
_W = (_Q22 / _DET, -_Q12 / _DET, _Q11 / _DET)
#: One EM step: the observed rows with their smoothed signal, then each parameter's update.
_EM_SQL = f"""{_MOMENT_SQL},
y AS (SELECT o.*, h1 * b.x1 + h2 * b.x2 AS u, h1 * h1 * b.p1 + 2 * h1 * h2 * b.p2 + h2 * h2 * b.p3 AS v FROM o JOIN b ON b.t = o.t),
m AS (SELECT count(*) AS n, sum(x1) AS sx, sum(x1 * x1) AS sxx, sum(obs - {_LOAD} * u) AS sy, sum(x1 * (obs - {_LOAD} * u)) AS sxy, sum((e - {_LOAD} * u) ** 2 + {_LOAD**2!r} * v) / count(*) AS s2e FROM y),
beta AS (SELECT (sxx * sy - sx * sxy) / (n * sxx - sx * sx) AS beta0, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS beta1, s2e FROM m),
load AS (SELECT sum(u * (obs - beta0 - beta1 * x1)) / sum(u * u + v) AS load FROM y, beta)"""


@query(f"WITH RECURSIVE {_EM_SQL} SELECT round((b1 + b4) / (c1 + c3), 6) AS f, round(({_W[0]!r} * b1 + {_W[1]!r} * (b2 + b3) + {_W[2]!r} * b4) / ({_W[0]!r} * c1 + 2 * {_W[1]!r} * c2 + {_W[2]!r} * c3), 6) AS f_weighted, round(beta0, 6) AS beta0, round(beta1, 6) AS beta1, round(s2e, 6) AS s2e, round(load, 6) AS load, round(b.x1, 6) + 0.0 AS x0_1, round(b.x2, 6) + 0.0 AS x0_2, round(b.p1, 6) AS s0_1, round(b.p2, 6) + 0.0 AS s0_2, round(b.p3, 6) AS s0_3 FROM mo, beta, load, b WHERE b.t = -1")
def em_step_two_nodes(spark: SparkSession, d: str) -> DataFrame:
    stats, p, s = _small(spark, d)
    sm = em.e_step(stats, p, s)
    n = em.m_step(stats, p, s, sm, [_Nodes()], em.FitOptions())
    w = em.m_step(stats, p, s, sm, [_Nodes()], em.FitOptions(f_update="weighted"))
    v = [n.f[0], w.f[0], *n.beta, n.s2e[0], n.A[0, 0], *n.x0, n.Sigma0[0, 0], n.Sigma0[0, 1], n.Sigma0[1, 1]]
    names = "f f_weighted beta0 beta1 s2e load x0_1 x0_2 s0_1 s0_2 s0_3".split()
    return spark.createDataFrame([tuple(round(float(x), 6) + 0.0 for x in v)], ", ".join(f"{k} double" for k in names))


@query(f"WITH RECURSIVE {_EM_SQL} SELECT {_F}::DOUBLE AS f, round(beta0, 6) AS beta0, round(beta1, 6) AS beta1, {_NOISE}::DOUBLE AS s2e FROM beta")
def em_step_with_fixed_parameters(spark: SparkSession, d: str) -> DataFrame:
    stats, p, s = _small(spark, d)
    n = em.m_step(stats, p.freeze("f", "s2e", "A", "x0", "Sigma0"), s, em.e_step(stats, p, s), [_Nodes()], em.FitOptions())
    return spark.createDataFrame([(float(n.f[0]), *[round(float(v), 6) for v in n.beta], float(n.s2e[0]))], "f double, beta0 double, beta1 double, s2e double")


_START_SQL = f"""{T.PANEL_SQL}, m AS (SELECT count(obs) AS n, sum(x1) AS sx, sum(x1 * x1) AS sxx, sum(obs) AS sy, sum(x1 * obs) AS sxy FROM panel WHERE obs IS NOT NULL),
c AS (SELECT *, (sxx * sy - sx * sxy) / (n * sxx - sx * sx) AS beta0, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS beta1 FROM m),
st AS (SELECT n, any_value(beta0) AS beta0, any_value(beta1) AS beta1, 0.2 * sum((obs - beta0 - beta1 * x1) ** 2) / n AS s2e FROM panel, c WHERE obs IS NOT NULL GROUP BY n)"""


@query(f"WITH {_START_SQL} SELECT round(beta0, 6) AS beta0, round(beta1, 6) AS beta1, round(s2e, 6) AS s2e, round(2 * sqrt(s2e), 6) AS load, 0.7::DOUBLE AS f FROM st")
def em_start_values(spark: SparkSession, d: str) -> DataFrame:
    stats, _, _ = _small(spark, d)
    p = em.start(stats, [_Nodes()])
    row = [*[round(float(v), 6) for v in p.beta], round(float(p.s2e[0]), 6), round(float(p.A[0, 0]), 6), float(p.f[0])]
    return spark.createDataFrame([tuple(row)], "beta0 double, beta1 double, s2e double, load double, f double")


#: Standard errors of the six parameters, as if a Hessian had given them.
_SE = [0.1, 0.05, 0.02, 0.04, 0.03, 0.06]
_Z = special.z_quantile(0.975)
#: Student's quantile by its expansion about the normal one, exact to nine digits from some hundred degrees of freedom on.
_TQ = f"({_Z!r} + {(_Z**3 + _Z) / 4!r} / df + {(5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96!r} / (df * df) + {(3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384!r} / (df * df * df))"


@query(
    f"""WITH {_START_SQL}, v AS (SELECT *, n - 6 AS df FROM st), q AS (SELECT *, {_TQ} AS q FROM v),
r AS (SELECT 'beta' AS name, 0 AS i, beta0 AS value, {_SE[0]} AS bse, q FROM q UNION ALL SELECT 'beta', 1, beta1, {_SE[1]}, q FROM q UNION ALL SELECT 's2e', 0, s2e, {_SE[2]}, q FROM q UNION ALL SELECT 'f', 0, 0.7, {_SE[3]}, q FROM q UNION ALL SELECT 'A', 0, 2 * sqrt(s2e), {_SE[4]}, q FROM q UNION ALL SELECT 'ks', 0, 0.5, {_SE[5]}, q FROM q)
SELECT name, i::INT AS i, round(value, 5)::DOUBLE AS value, bse::DOUBLE AS bse, round(value / bse, 4)::DOUBLE AS t,
  round(CASE WHEN name IN ('s2e', 'ks') THEN value * exp(-q * bse / value) WHEN name = 'f' THEN tanh(atanh(value) - q * bse / (1 - value * value)) ELSE value - q * bse END, 5)::DOUBLE AS lower,
  round(CASE WHEN name IN ('s2e', 'ks') THEN value * exp(q * bse / value) WHEN name = 'f' THEN tanh(atanh(value) + q * bse / (1 - value * value)) ELSE value + q * bse END, 5)::DOUBLE AS upper FROM r"""
)
def parameter_intervals(spark: SparkSession, d: str) -> DataFrame:
    stats, _, s = _small(spark, d)
    p = em.start(stats, [_Nodes()])
    r = replace(_ended(stats, replace(p, x0=np.zeros(2), Sigma0=np.eye(2)), s, LowRankModel(())), cov_params=np.diag(np.square(_SE)))
    e = r.estimates(spark)
    return e.select("name", "i", F.round("value", 5).alias("value"), F.round("bse", 6).alias("bse"), F.round("t", 4).alias("t"), F.round("lower", 5).alias("lower"), F.round("upper", 5).alias("upper"))


@query(f"SELECT i::INT AS i, j::INT AS j, round((CASE WHEN i = j THEN CASE WHEN i = 0 THEN {_Q11} ELSE {_Q22} END ELSE {_Q12} END) / {1 - _F * _F!r}, 8)::DOUBLE AS p FROM generate_series(0, 1) AS a(i), generate_series(0, 1) AS b(j)")
def stationary_states(spark: SparkSession, d: str) -> DataFrame:
    _, p, s = _small(spark, d)
    v = em.stationary_variances(p, s, np.array([0, 0]))
    return spark.createDataFrame([(i, j, round(float(v[i, j]), 8)) for i in range(2) for j in range(2)], "i int, j int, p double")


# --- given states on a lattice -------------------------------------------------------------------------------------------


def _given(spark: SparkSession, d: str) -> Results:
    """A fit of the events panel that ended in the states of _GIVEN_SQL."""
    panel = pn.build(_events_long(spark, d), "obs ~ x1", _SPEC)
    cov = spde.Spde.of(mesh.grid_mesh([T.SQUARE], 3.0, 9, 9))
    model = LowRankModel((panel,), (None,)).setup(cov)
    xy = cov.mesh.xy[np.flatnonzero(cov.mesh.inner)]
    t, q = np.arange(-1, T.DAYS), len(xy)
    x = ((7 * (t + 1)[:, None] + np.rint(xy[:, 0] + 2 * xy[:, 1])[None, :]) % 11) / 10.0
    p = np.full((len(t), q, q), 0.25) + 0.75 * np.eye(q) + (t / 100.0)[:, None, None]
    sm = kalman.Smoothed(x, p, np.zeros((T.DAYS, q, q)), *(np.zeros((q, q)) for _ in range(3)), 0.0)
    params = em.Params(np.array([_B0, _B1]), np.array([_NOISE]), np.array([_F]), np.array([[_LOAD]]), np.array([1.0]), np.zeros(q), np.eye(q))
    none = np.zeros((1, T.DAYS))
    stats = suffstat.Stats([], [], none, [], none, none, none, [], [], [slice(0, 2)], np.zeros(q, int))
    return Results(model, stats, em.Fit(params, sm, 0.0, True, "tolerance", []), em.FitOptions())


def _given_sql(panel: str, sites: str) -> str:
    """CTEs k (normalised basis) and fit (site, t, px, py, obs, mean, variance, ok) of a panel."""
    return f"""k AS (SELECT site, v, vx, vy, h / sum(h) OVER (PARTITION BY site) AS h FROM (SELECT h.site, h.v, h.h, v.x AS vx, v.y AS vy FROM h JOIN v ON v.v = h.v WHERE {T.inside_sql(T.SQUARE, 'v.x', 'v.y')})),
st AS (SELECT g.t AS t, v, ((7 * (g.t + 1) + CAST(x + 2 * y AS INT)) % 11) / 10.0 AS x FROM generate_series(0, {T.DAYS - 1}) AS g(t), v),
hx AS (SELECT site, st.t AS t, {_LOAD} * sum(h * st.x) AS hx FROM k JOIN st ON st.v = k.v GROUP BY 1, 2),
hp AS (SELECT site, sum(h * h) AS hh, sum(h) AS hs FROM k GROUP BY 1),
fit AS (SELECT p.site, p.t, p.px, p.py, p.obs, {_B0} + {_B1} * p.x1 + coalesce(hx, 0) AS mean, CASE WHEN hx IS NOT NULL THEN {_LOAD**2!r} * (0.75 * hh + (0.25 + p.t / 100.0) * hs * hs) ELSE 0 END AS variance, hx IS NOT NULL AS ok FROM {panel} p LEFT JOIN hx ON hx.site = p.site AND hx.t = p.t LEFT JOIN hp ON hp.site = p.site)"""


_FIT_SQL = f"{_BASIS_SQL}, seen AS (SELECT user_id AS site, date_diff('day', DATE '{T.START}', CAST(ts AS DATE)) AS t, avg(value) AS m, count(*) AS n FROM events GROUP BY 1, 2), panel AS (SELECT s.site, s.x AS px, s.y AS py, CAST(g.t AS INT) AS t, CASE WHEN m > 0 THEN ln(m) END AS obs, ln(1.0 + coalesce(n, 0)) AS x1 FROM sites s CROSS JOIN generate_series(0, {T.DAYS - 1}) AS g(t) LEFT JOIN seen ON seen.site = s.site AND seen.t = g.t), {_given_sql('panel', 'sites')}"


@query(f"WITH {_FIT_SQL} SELECT site, t, round(mean, 6) AS mean, round(variance, 6)::DOUBLE AS variance, round(obs - mean, 6) AS residual, ok AS in_support FROM fit")
def fitted_values(spark: SparkSession, d: str) -> DataFrame:
    f = _given(spark, d).fitted()
    return f.select("site", F.col("t_idx").cast("int").alias("t"), r6(F.col("mean"), "mean"), r6(F.col("variance"), "variance"), r6(F.col("residual"), "residual"), "in_support")


@query(f"WITH {_FIT_SQL} SELECT site, t, round(mean - {_Z!r} * sqrt(variance + {_NOISE}), 5) AS y_lower, round(mean + {_Z!r} * sqrt(variance + {_NOISE}), 5) AS y_upper FROM fit")
def fitted_intervals(spark: SparkSession, d: str) -> DataFrame:
    f = _given(spark, d).intervals()
    return f.select("site", F.col("t_idx").cast("int").alias("t"), F.round("y_lower", 5).alias("y_lower"), F.round("y_upper", 5).alias("y_upper"))


@query(f"WITH {_FIT_SQL} SELECT site, t, round(exp(mean) * (1 + variance / 2), 4) AS mean_back, round(exp(2 * mean) * variance, 3) AS variance_back, round(exp(obs), 4) AS obs_back, round(exp(obs) - exp(mean) * (1 + variance / 2), 4) AS residual_back FROM fit")
def fitted_back_transform(spark: SparkSession, d: str) -> DataFrame:
    f = _given(spark, d).back_transform("exp")
    return f.select("site", F.col("t_idx").cast("int").alias("t"), F.round("mean_back", 4).alias("mean_back"), (F.round("variance_back", 3) + F.lit(0.0)).alias("variance_back"), F.round("obs_back", 4).alias("obs_back"), (F.round("residual_back", 4) + F.lit(0.0)).alias("residual_back"))


@query(f"WITH {_FIT_SQL} SELECT site AS point_id, t, round(mean, 6) AS y_hat_0, round(sqrt(variance), 6) AS std_y_hat_0, ok AS in_support_0 FROM fit")
def fitted_table(spark: SparkSession, d: str) -> DataFrame:
    e = _given(spark, d).export()
    t = F.datediff("timestamp", F.lit(T.START).cast("date")).alias("t")
    return e.select("point_id", t, r6(F.col("y_hat_0"), "y_hat_0"), r6(F.col("std_y_hat_0"), "std_y_hat_0"), "in_support_0")


def _new_sites(spark: SparkSession, d: str) -> DataFrame:
    """New sites a little to the upper right of the old ones, on the first ten days."""
    return _events_long(spark, d).where("t < 10").withColumns({"px": F.col("px") * 0.9 + 0.05, "py": F.col("py") * 0.9 + 0.05})


def _predicted(spark: SparkSession, d: str):
    return _given(spark, d).predict(_new_sites(spark, d), _SPEC)


_PRED_SQL = _FIT_SQL.replace("((37 * user_id) % 101) / 10.0 AS x", "((37 * user_id) % 101) / 10.0 * 0.9 + 0.05 AS x").replace("((53 * user_id) % 97) / 10.0 AS y", "((53 * user_id) % 97) / 10.0 * 0.9 + 0.05 AS y")


@query(f"WITH {_PRED_SQL} SELECT site AS point_id, t, round(exp(mean) * (1 + variance / 2), 4) AS y_pred_0, round(sqrt(exp(2 * mean) * variance), 4)::DOUBLE AS std_y_pred_0, ok AS in_support_0 FROM fit WHERE t < 10")
def prediction_table(spark: SparkSession, d: str) -> DataFrame:
    e = _predicted(spark, d).back_transform("exp").export()
    t = F.datediff("timestamp", F.lit(T.START).cast("date")).alias("t")
    return e.select("point_id", t, F.round("y_pred_0", 4).alias("y_pred_0"), F.round("std_y_pred_0", 4).alias("std_y_pred_0"), "in_support_0")


@query(f"WITH {_PRED_SQL} SELECT site AS point_id, t, round(mean, 6) AS y_pred_0, round(sqrt(variance), 6)::DOUBLE AS std_y_pred_0, ok AS in_support_0 FROM fit WHERE t < 10")
def prediction_from_folder(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of results that were written as tables and read again, without the training table."""
    folder = f"{work.shared(spark)}/results-{uuid.uuid4()}"
    _given(spark, d).save(folder)
    e = Results.load(folder, spark=spark).predict(_new_sites(spark, d), _SPEC).export()
    t = F.datediff("timestamp", F.lit(T.START).cast("date")).alias("t")
    return e.select("point_id", t, r6(F.col("y_pred_0"), "y_pred_0"), r6(F.col("std_y_pred_0"), "std_y_pred_0"), "in_support_0")


_FAR = [[(20.0, 20.0), (21.0, 20.0), (21.0, 21.0)]]
_AREAL_SQL = f"""{_PRED_SQL}, hit AS ({_hits_sql(True)}), n AS (SELECT poly_id, t, count(*) AS n, avg(mean) AS mean FROM hit JOIN fit USING (site) WHERE ok AND t < 10 GROUP BY 1, 2)"""
_EVERY_SQL = "(SELECT poly_id, name, g.t AS t FROM (" + " UNION ALL ".join(f"SELECT {k} AS poly_id, '{n}' AS name" for k, n in enumerate([*_NAMES, "far"])) + ") CROSS JOIN generate_series(0, 9) AS g(t)) e"


@query(f"WITH {_AREAL_SQL} SELECT e.poly_id, e.name, e.t::INT AS t, coalesce(n.n, 0) AS n_points, round(n.mean, 6) AS mean FROM {_EVERY_SQL} LEFT JOIN n ON n.poly_id = e.poly_id AND n.t = e.t")
def prediction_areal_means(spark: SparkSession, d: str) -> DataFrame:
    out = _predicted(spark, d).to_poly([*_POLYS, _FAR], [*_NAMES, "far"])
    return out.select("poly_id", "name", F.datediff("ts", F.lit(T.START).cast("date")).alias("t"), "n_points", r6(F.col("mean"), "mean"))


def _areal_std_sql(slope: str, digits: int) -> str:
    return f"""WITH {_AREAL_SQL}, w AS (SELECT hit.poly_id, fit.t AS t, k.v, sum({_LOAD} * k.h * {slope}) AS w FROM hit JOIN fit USING (site) JOIN k USING (site) WHERE ok AND fit.t < 10 GROUP BY 1, 2, 3)
SELECT w.poly_id, w.t::INT AS t, round(sqrt(0.75 * sum((w.w / n.n) ** 2) + (0.25 + any_value(w.t) / 100.0) * sum(w.w / n.n) ** 2), {digits})::DOUBLE AS std FROM w JOIN n ON n.poly_id = w.poly_id AND n.t = w.t GROUP BY 1, 2"""


@query(_areal_std_sql("1", 6))
def prediction_areal_std(spark: SparkSession, d: str) -> DataFrame:
    out = _predicted(spark, d).to_poly_std(_POLYS)
    return out.select("poly_id", F.col("t_idx").cast("int").alias("t"), r6(F.col("std"), "std"))


@query(_areal_std_sql("exp(mean)", 4).replace("avg(mean)", "avg(fit.mean)").replace("exp(mean)", "exp(fit.mean)"))
def prediction_areal_std_back(spark: SparkSession, d: str) -> DataFrame:
    out = _predicted(spark, d).back_transform("exp").to_poly_std(_POLYS)
    return out.select("poly_id", F.col("t_idx").cast("int").alias("t"), F.round("std", 4).alias("std"))


@query(f"WITH {_FIT_SQL}, w AS (SELECT st.t AS t, v.x AS vx, v.y AS vy, st.x AS x FROM st JOIN v USING (v) WHERE {T.inside_sql(T.SQUARE, 'v.x', 'v.y')}) SELECT t, round(vx, 3)::DOUBLE AS vx, round(vy, 3)::DOUBLE AS vy, round(x - {_Z!r} * sqrt(1 + t / 100.0), 6)::DOUBLE AS lower, round(x + {_Z!r} * sqrt(1 + t / 100.0), 6)::DOUBLE AS upper FROM w")
def state_bounds(spark: SparkSession, d: str) -> DataFrame:
    r = _given(spark, d)
    m = r.model.covs[0].mesh
    at = spark.createDataFrame([(n, round(float(x), 3), round(float(y), 3)) for n, (x, y) in enumerate(m.xy[np.flatnonzero(m.inner)])], "node int, vx double, vy double")
    s = r.state_intervals(spark).where("t_idx >= 0").join(F.broadcast(at), "node")
    return s.select(F.col("t_idx").cast("long").alias("t"), "vx", "vy", r6(F.col("lower"), "lower"), r6(F.col("upper"), "upper"))
