"""The space-time model: panels, latent fields, fit, results and prediction, as tables in and tables out."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geopanel.functions import geo, special
from geopanel.functions.semantics import missing, std_of_variance
from geopanel.operators import em, store, suffstat
from geopanel.operators.areal import BACK, areal_mean, delta_method, polygon_table
from geopanel.operators.kalman import StateSpace
from geopanel.operators.spde import Spde
from geopanel.operators.work import small, written
from geopanel.plans.panel import Panel, PanelSpec, build, build_predict
from geopanel.sources.geotext import reproject_polygons


@dataclass(frozen=True)
class LowRankModel:
    """One formula a response over the same time axis; domains bound the responses' sites."""

    panels: tuple[Panel, ...]
    domains: tuple = ()
    covs: tuple[Spde, ...] = ()

    @staticmethod
    def of(df: DataFrame, formulas: str | Sequence[str], spec: PanelSpec | None = None, domains=None, **window) -> LowRankModel:
        formulas = [formulas] if isinstance(formulas, str) else list(formulas)
        domains = list(domains) if domains is not None else [None] * len(formulas)
        if len(domains) != len(formulas):
            raise ValueError("as many domains as formulas are needed")
        panels = tuple(build(df, f, spec, domain=d, **window) for f, d in zip(formulas, domains, strict=True))
        first = panels[0]
        for p in panels[1:]:
            if p.span != first.span or p.n_times != first.n_times:
                raise ValueError("responses need the same time axis")
        return LowRankModel(panels, tuple(domains))

    def setup(self, covs: Spde | Sequence[Spde]) -> LowRankModel:
        covs = (covs,) if isinstance(covs, Spde) else tuple(covs)
        for c in covs:
            if not c.n_latent:
                raise ValueError("a mesh without inner vertices")
            if c.mesh.domain and not c.mesh.covers_domain():
                warnings.warn("the mesh does not cover its domain", stacklevel=2)
        return replace(self, covs=covs)

    @property
    def factor(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.covs)), [c.n_latent for c in self.covs])

    def with_default_domains(self) -> LowRankModel:
        """Responses without a domain get the convex hull of their sites."""
        return replace(self, domains=tuple(site_hull(p.rows) if d is None else d for p, d in zip(self.panels, self.domains, strict=True)))

    def _offsets(self) -> list[int]:
        return np.cumsum([0, *[c.n_latent for c in self.covs]]).tolist()

    def basis(self, panel: Panel, var: int) -> DataFrame:
        """(var, site_id, node, h) over the nodes of all factors."""
        sites = panel.rows.select("site_id", "x", "y").distinct()
        out = None
        for c, off in zip(self.covs, self._offsets()[:-1], strict=True):
            b = c.basis(sites).select(F.lit(var).alias("var"), "site_id", (F.col("node") + off).cast("int").alias("node"), "h")
            out = b if out is None else out.unionByName(b)
        return out

    def _stacked(self) -> tuple[DataFrame, DataFrame]:
        """Panel and basis of all responses; responses outside the support or with a missing covariate are NULL."""
        panel = basis = None
        for i, p in enumerate(self.panels):
            b = written(self.basis(p, i))
            seen = b.select("site_id").distinct().withColumn("in_support", F.lit(True))
            r = p.rows.select("site_id", "t_idx", "obs", "cov").join(seen.hint("merge"), "site_id", "left")
            lost = F.exists("cov", lambda v: v.isNull() | F.isnan(v))
            r = r.select(F.lit(i).alias("var"), "site_id", "t_idx", F.when(F.col("in_support") & ~F.coalesce(lost, F.lit(False)), F.col("obs")).alias("obs"), "cov")
            panel = r if panel is None else panel.unionByName(r)
            basis = b if basis is None else basis.unionByName(b)
        return panel, basis

    def statistics(self) -> suffstat.Stats:
        """The one pass over the data."""
        panel, basis = self._stacked()
        out = suffstat.collect(written(panel), basis, len(self.panels), self.panels[0].n_times, [len(p.names) for p in self.panels], self.factor)
        if any(not out.m[i].sum() for i in range(len(self.panels))):
            raise ValueError("a response has no observation inside the latent domain")
        return out

    def fit(self, params0: em.Params | None = None, options: em.FitOptions | None = None, stats: suffstat.Stats | None = None) -> Results:
        if not self.covs:
            raise ValueError("set up the latent fields first")
        opt, stats = options or em.FitOptions(), stats or self.statistics()
        p = params0 or em.start(stats, list(self.covs))
        em.check_params(p, stats, len(self.covs))
        return Results(self, stats, em.fit(stats, list(self.covs), p, opt), opt)

    def simulate(self, params: em.Params, n_sites_basis: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Draws (y, x) of the latent part and noise at sites with a dense basis (p, q) of the first response."""
        s = em.system(params, list(self.covs), self.factor)
        a = params.A[0][self.factor]
        ss = StateSpace(n_sites_basis * a, np.full(len(n_sites_basis), params.s2e[0]), s.f, s.q, params.x0, params.Sigma0)
        return ss.simulate(n, seed)


def site_hull(rows: DataFrame, x: str = "x", y: str = "y") -> list:
    """Convex hull of the sites, as a polygon: hulls of partitions first, whose corners alone go to the driver."""
    import pandas as pd

    def corners(frames):
        kept: list[tuple[float, float]] = []
        for f in frames:
            pts = {*kept, *zip(f["x"], f["y"], strict=True)}
            kept = geo.hull(pts)[:-1] if len(pts) > 2 else sorted(pts)
        yield pd.DataFrame(kept, columns=["x", "y"])

    pts = rows.select(F.col(x).alias("x"), F.col(y).alias("y")).distinct().mapInPandas(corners, "x double, y double").collect()
    if len(pts) < 3:
        raise ValueError("a hull takes three sites")
    return [geo.hull((r.x, r.y) for r in pts)[:-1]]


def _pair(g):
    """One back-transformation: a name of areal.BACK, or its value and two derivatives as functions of Columns."""
    if isinstance(g, str) and g not in BACK:
        raise ValueError(f"unknown back-transformation {g!r}")
    if not isinstance(g, str) and (len(g) != 3 or not all(callable(f) for f in g)):
        raise ValueError("a back-transformation is a name, or (g, g', g'')")
    return g


def _back_all(g, n: int) -> list:
    g = [g] * n if isinstance(g, str) or (isinstance(g, tuple) and len(g) == 3 and all(callable(f) for f in g)) else list(g)
    if len(g) != n:
        raise ValueError("one back-transformation, or one a response")
    return [_pair(v) for v in g]


def _by_var(choices: list, var: str = "var"):
    """The column of choices that belongs to the row's response."""
    out = F.lit(None).cast("double")
    for i, c in enumerate(choices):
        out = F.when(F.col(var) == i, c).otherwise(out)
    return out


def y_intervals(rows: DataFrame, noise: Sequence[float] | None, alpha: float = 0.05) -> DataFrame:
    """rows with y_lower and y_upper: mean -+ z sqrt(variance), plus the response's noise variance if given."""
    if not 0 < alpha < 1:
        raise ValueError("alpha is between 0 and 1")
    z = special.z_quantile(1 - alpha / 2)
    r = _by_var([F.lit(float(v)) for v in noise]) if noise is not None else F.lit(0.0)
    half = z * std_of_variance(F.col("variance") + r)
    return rows.withColumns({"y_lower": F.col("mean") - half, "y_upper": F.col("mean") + half})


def _loglik_at(stats, covs, p, theta) -> float:
    try:
        return em.loglik(stats, p.unpack(np.asarray(theta)), covs)
    except np.linalg.LinAlgError:
        return float("nan")


@dataclass(frozen=True)
class Results:
    model: LowRankModel
    stats: suffstat.Stats
    fit: em.Fit
    options: em.FitOptions
    cov_params: np.ndarray | None = None

    @property
    def params(self) -> em.Params:
        return self.fit.params

    @property
    def loglik(self) -> float:
        return self.fit.loglik

    @property
    def nobs(self) -> int:
        return int(self.stats.m.sum())

    @property
    def ntime(self) -> int:
        return self.stats.n_steps

    @property
    def nspace(self) -> tuple[int, ...]:
        """Sites of each response."""
        return tuple(p.n_sites for p in self.model.panels)

    @property
    def missing(self) -> int:
        """Entries of the panels that the fit has not seen."""
        return sum(n * self.ntime for n in self.nspace) - self.nobs

    def update(self, **changes) -> Results:
        """A copy with other attributes; parameters given as params are filtered and smoothed anew."""
        known = {"model", "stats", "fit", "options", "cov_params", "params"}
        if set(changes) - known:
            raise AttributeError(f"no attribute {', '.join(sorted(set(changes) - known))}")
        params = changes.pop("params", None)
        out = replace(self, **changes)
        if params is not None:
            covs = list(out.model.covs)
            em.check_params(params, out.stats, len(covs))
            sm = em.e_step(out.stats, params, em.system(params, covs, out.stats.factor))
            out = replace(out, fit=replace(out.fit, params=params, smoothed=sm, loglik=sm.loglik), cov_params=changes.get("cov_params"))
        return out

    def as_dict(self, spark: SparkSession) -> dict:
        """A flat snapshot: numbers, parameters by name, and states, fitted values and trace as tables."""
        numbers = {k: getattr(self, k) for k in ("loglik", "nobs", "missing", "ntime", "n_params", "df_resid", "aic", "bic")}
        return numbers | self.params.as_dict() | {"x0_mean": float(self.params.x0.mean()), "Sigma0_mean": float(np.diag(self.params.Sigma0).mean()), "states": self.states(spark), "fitted": self.fitted(), "trace": self.trace(spark)}

    @property
    def n_params(self) -> int:
        return len(self.params.pack())

    @property
    def df_resid(self) -> int:
        return self.nobs - self.n_params

    @property
    def aic(self) -> float:
        return 2 * self.n_params - 2 * self.loglik

    @property
    def bic(self) -> float:
        return self.n_params * math.log(self.nobs) - 2 * self.loglik

    def trace(self, spark: SparkSession) -> DataFrame:
        rows = self.fit.trace
        names = list(rows[0])
        return spark.createDataFrame([tuple(float(r[k]) for k in names) for r in rows], ", ".join(f"`{k}` double" for k in names))

    def states(self, spark: SparkSession) -> DataFrame:
        """(t_idx, node, x, p): smoothed means and variances, from t_idx -1, the initial state."""
        n, q = self.fit.smoothed.x.shape
        t, node = np.divmod(np.arange(n * q), q)
        p = np.diagonal(self.fit.smoothed.p, axis1=1, axis2=2).ravel()
        import pandas as pd

        return spark.createDataFrame(pd.DataFrame({"t_idx": t - 1, "node": node, "x": self.fit.smoothed.x.ravel(), "p": p}))

    def state_intervals(self, spark: SparkSession, alpha: float = 0.05) -> DataFrame:
        z = special.z_quantile(1 - alpha / 2)
        s = std_of_variance(F.col("p"))
        return self.states(spark).select("t_idx", "node", "x", (F.col("x") - z * s).alias("lower"), (F.col("x") + z * s).alias("upper"))

    # --- fitted values and prediction ---------------------------------------------------------------------------------

    def _states_of_pairs(self, spark: SparkSession, steps: DataFrame) -> DataFrame:
        """(pair, t_idx, x, p) of the given steps (t_idx) for pairs a * q + b of nodes that share a triangle or belong to
        different factors: the only ones a site's basis can touch. x is the state of node a. Their number follows T and the
        mesh, not the sites; few of them are broadcast, so that sites are not dealt by node."""
        import pandas as pd

        sm, fac = self.fit.smoothed, self.model.factor
        n, q = sm.x.shape
        near = np.zeros((q, q), bool)
        for j, c in enumerate(self.model.covs):
            at = np.flatnonzero(fac == j)
            inner = np.flatnonzero(c.mesh.inner)
            adj = np.eye(len(c.g), dtype=bool)
            for a, b in ((0, 1), (1, 2), (2, 0)):
                adj[c.mesh.tri[:, a], c.mesh.tri[:, b]] = adj[c.mesh.tri[:, b], c.mesh.tri[:, a]] = True
            near[np.ix_(at, at)] = adj[np.ix_(inner, inner)]
        near |= fac[:, None] != fac[None, :]
        a, b = np.nonzero(near)
        t = np.repeat(np.arange(n - 1), len(a))
        table = pd.DataFrame({"pair": np.tile(a * q + b, n - 1), "t_idx": t, "x": sm.x[1:][:, a].ravel(), "p": sm.p[1:][:, a, b].ravel()})
        return small(spark.createDataFrame(table).join(F.broadcast(steps), "t_idx", "left_semi"), len(table))

    def _predicted(self, panel: Panel, var: int, variance: bool = True) -> DataFrame:
        """Rows of a panel with mean, var and in_support; no measurement error. Outside the support the mean is the
        regression alone and the variance zero; a missing covariate gives NULL."""
        if "site_id" not in panel.rows.columns:
            raise ValueError("results read from a folder hold no training rows: load them onto a model of the data")
        spark, p = panel.rows.sparkSession, self.params
        load, beta = p.A[var], p.beta[self.stats.covs[var]]
        fac = self.model.factor
        table = spark.createDataFrame([(n, float(load[j])) for n, j in enumerate(fac)], "node int, a double")
        b = self.model.basis(panel, var).join(F.broadcast(table), "node").select("site_id", "node", (F.col("h") * F.col("a")).alias("w"))
        nodes = b.groupBy("site_id").agg(F.collect_list(F.struct("node", "w")).alias("a")).select("site_id", F.explode("a").alias("a"), F.col("a").alias("b"))
        # A node with itself carries the mean; pairs of all nodes of a site carry the variance.
        with_ = F.explode("b") if variance else F.explode(F.array("a"))
        pair = nodes.select("site_id", "a", with_.alias("b")).select("site_id", (F.col("a.node") * len(fac) + F.col("b.node")).cast("long").alias("pair"), F.col("a.w").alias("wa"), F.col("b.w").alias("wb"), (F.col("a.node") == F.col("b.node")).alias("own"))
        states = self._states_of_pairs(spark, panel.rows.select(F.col("t_idx").cast("long")).distinct())  # a row a step
        signal = pair.join(states, "pair").groupBy("site_id", "t_idx").agg(F.sum(F.when(F.col("own"), F.col("wa") * F.col("x"))).alias("hx"), F.sum(F.col("wa") * F.col("p") * F.col("wb")).alias("hph"))
        xb = F.aggregate(F.zip_with("cov", F.array(*[F.lit(float(v)) for v in beta]) if len(beta) else F.array().cast("array<double>"), lambda a, c: a * c), F.lit(0.0), lambda s, v: s + v)
        out = panel.rows.join(signal.hint("merge"), ["site_id", "t_idx"], "left")
        inside = F.col("hx").isNotNull() & (F.col("in_domain") if "in_domain" in panel.rows.columns else F.lit(True))
        mean = xb + F.when(inside, F.col("hx")).otherwise(0.0)
        var_ = F.when(mean.isNotNull(), F.when(inside, F.col("hph")).otherwise(0.0)) if variance else F.lit(None).cast("double")
        return out.select(F.lit(var).alias("var"), "site_id", "site", "t_idx", "ts", "x", "y", "obs", mean.alias("mean"), var_.alias("variance"), inside.alias("in_support"))

    def fitted(self) -> DataFrame:
        """Fitted values of all responses: var, site_id, .., obs, mean, variance, residual."""
        out = None
        for i, p in enumerate(self.model.panels):
            f = self._predicted(p, i, self.options.std is not False)
            out = f if out is None else out.unionByName(f)
        return out.withColumn("residual", F.col("obs") - F.col("mean"))

    def view(self, var: int) -> DataFrame:
        """Fitted values, variances, observations and residuals of one response."""
        if not 0 <= var < len(self.model.panels):
            raise ValueError(f"there are {len(self.model.panels)} responses")
        f = self._predicted(self.model.panels[var], var, self.options.std is not False)
        return f.withColumn("residual", F.col("obs") - F.col("mean"))

    def intervals(self, alpha: float = 0.05, prediction: bool = True) -> DataFrame:
        """Fitted values with intervals: of new observations, or of the signal alone."""
        if self.options.std is False:
            raise ValueError("the fit has no variances")
        return y_intervals(self.fitted(), self.params.s2e if prediction else None, alpha)

    def back_transform(self, g) -> DataFrame:
        """Fitted values with columns on the original scale: mean_back and variance_back by the delta method, obs_back by
        the function itself, and residual_back, their difference. g as in Prediction.back_transform."""
        g = _back_all(g, len(self.model.panels))
        if self.options.std is False:
            warnings.warn("without variances, back-transformed means have no correction", stacklevel=2)
        f = self.fitted()
        var = F.coalesce(F.col("variance"), F.lit(0.0))
        both = [delta_method(v, F.col("mean"), var) for v in g]
        h = [(BACK[v] if isinstance(v, str) else v)[0] for v in g]
        f = f.withColumns({"mean_back": _by_var([m for m, _ in both]), "variance_back": F.when(F.col("variance").isNotNull(), _by_var([v for _, v in both])), "obs_back": _by_var([k(F.col("obs")) for k in h])})
        return f.withColumn("residual_back", F.col("obs_back") - F.col("mean_back"))

    def covariance(self, sites: DataFrame, var: int = 0) -> DataFrame:
        """(t_idx, site_a, site_b, cov): full covariances of the signal over a table of sites (site_id, x, y) whose pairs
        are wanted, site_a <= site_b. Sites outside the support have none."""
        spark = sites.sparkSession
        panel = replace(self.model.panels[var], rows=sites)
        table = spark.createDataFrame([(n, float(self.params.A[var][j])) for n, j in enumerate(self.model.factor)], "node int, a double")
        b = self.model.basis(panel, var).join(F.broadcast(table), "node").select("site_id", "node", (F.col("h") * F.col("a")).alias("w"))
        p = _full_states(spark, self.fit.smoothed.p)
        half = b.select(F.col("site_id").alias("site_a"), F.col("node").alias("a"), F.col("w").alias("wa")).join(F.broadcast(p), "a")
        half = half.groupBy("t_idx", "site_a", "b").agg(F.sum(F.col("wa") * F.col("p")).alias("u"))
        other = b.select(F.col("site_id").alias("site_b"), F.col("node").alias("b"), F.col("w").alias("wb"))
        return half.join(other, "b").where("site_a <= site_b").groupBy("t_idx", "site_a", "site_b").agg(F.sum(F.col("u") * F.col("wb")).alias("cov"))

    def predict(self, df: DataFrame | Sequence[DataFrame], spec: PanelSpec | None = None, domains=None, variance: bool = True) -> Prediction:
        """New sites at training times, which all responses share; one table for all responses, or one each. Sites outside
        the support, which get the regression alone and no variance, and missing covariates are counted in warnings."""
        frames = list(df) if isinstance(df, (list, tuple)) else [df] * len(self.model.panels)
        if len(frames) != len(self.model.panels):
            raise ValueError("one table for all responses, or one each")
        doms = list(domains) if domains is not None else list(self.model.domains) or [None] * len(frames)
        out = None
        for i, (p, d, dom) in enumerate(zip(self.model.panels, frames, doms, strict=True)):
            f = self._predicted(build_predict(p, d, spec, dom), i, variance)
            out = f if out is None else out.unionByName(f)
        out = written(out)
        n = out.agg(F.countDistinct(F.when(~F.col("in_support"), F.struct("var", "site_id"))).alias("off"), F.count(F.when(F.col("mean").isNull(), 1)).alias("lost")).first()
        if n.off:
            warnings.warn(f"{n.off} sites lie outside the latent support: their means are the regression alone", stacklevel=2)
        if n.lost:
            warnings.warn(f"{n.lost} predictions lack a covariate", stacklevel=2)
        if len(frames) > 1 and isinstance(df, (list, tuple)):
            per = out.groupBy("var").agg(F.sort_array(F.collect_set("ts")).alias("ts"))  # a row a step
            if per.select("ts").distinct().count() > 1:
                raise ValueError("all responses are predicted at the same times")
        return Prediction(self, out)

    def design_matrix(self, df: DataFrame, spec: PanelSpec | None = None) -> DataFrame:
        """Held-out covariates and responses under the training transformations."""
        out = None
        for i, p in enumerate(self.model.panels):
            r = build_predict(p, df, spec, include_response=True).rows.withColumn("var", F.lit(i))
            out = r if out is None else out.unionByName(r)
        return out

    # --- inference ------------------------------------------------------------------------------------------------------

    def hessian(self, spark: SparkSession, step: float = 1e-3) -> np.ndarray:
        """Central second differences of the log-likelihood: one row a perturbed parameter vector, evaluated in parallel
        over the cached statistics."""
        import pandas as pd

        p, covs, stats = self.params, list(self.model.covs), self.stats
        theta = p.pack()
        n = len(theta)
        h = step * np.maximum(np.abs(theta), 0.1)
        rows, at = [theta.tolist()], {}
        for i in range(n):
            for j in range(i + 1):
                for si in (1, -1):
                    for sj in (1, -1):
                        v = theta.copy()
                        v[i] += si * h[i]
                        v[j] += sj * h[j]
                        at[i, j, si, sj] = len(rows)
                        rows.append(v.tolist())
        shared = spark.sparkContext.broadcast((stats, covs, p))  # statistics of bounded size: see suffstat.collect
        table = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "k int, theta array<double>").repartition(min(len(rows), 4 * spark.sparkContext.defaultParallelism))

        def run(frames):
            stats, covs, p = shared.value
            for f in frames:
                yield pd.DataFrame({"k": f["k"], "ll": [_loglik_at(stats, covs, p, v) for v in f["theta"]]})

        ll = np.zeros(len(rows))
        for r in table.mapInPandas(run, "k int, ll double").collect():
            ll[r.k] = r.ll
        out = np.zeros((n, n))
        for i in range(n):
            for j in range(i + 1):
                d = [ll[at[i, j, a, b]] * a * b for a in (1, -1) for b in (1, -1)]
                out[i, j] = out[j, i] = sum(d) / (4 * h[i] * h[j])
        shared.unpersist()
        return out

    def with_errors(self, spark: SparkSession) -> Results:
        h = self.hessian(spark)
        return replace(self, cov_params=-np.linalg.inv((h + h.T) / 2))

    def estimates(self, spark: SparkSession, alpha: float = 0.05) -> DataFrame:
        """name, i, value, fixed, bse, t, p, lower, upper. Intervals are Wald for beta and A, on the log scale for s2e and
        ks and on the atanh scale for f."""
        p, rows = self.params, []
        se = np.sqrt(np.where(np.diag(self.cov_params) > 0, np.diag(self.cov_params), np.nan)) if self.cov_params is not None else np.full(self.n_params, np.nan)
        spot = {lab: k for k, lab in enumerate(p.labels())}
        q = special.t_quantile(1 - alpha / 2, max(self.df_resid, 1))
        for name in p.NAMES[:5]:
            for i, v in enumerate(np.ravel(getattr(p, name))):
                k = spot.get((name, i))
                s = float(se[k]) if k is not None else float("nan")
                rows.append((name, i, float(v), k is None, *_inference(name, float(v), s, q, max(self.df_resid, 1))))
        clean = [tuple(None if isinstance(c, float) and math.isnan(c) else c for c in r) for r in rows]
        return spark.createDataFrame(clean, "name string, i int, value double, fixed boolean, bse double, t double, p double, lower double, upper double")

    def export(self) -> DataFrame:
        return export(self.fitted(), "hat")

    def summary(self, spark: SparkSession, alpha: float = 0.05) -> str:
        head = [("observations", self.nobs), ("sites", self.model.panels[0].n_sites), ("steps", self.stats.n_steps), ("latent nodes", self.stats.q), ("log-likelihood", f"{self.loglik:.4f}"), ("AIC", f"{self.aic:.4f}"), ("BIC", f"{self.bic:.4f}"), ("EM", f"{len(self.fit.trace) - 1} iterations, {self.fit.termination}")]
        rows = [(f"{r.name}[{r.i}]", f"{r.value:.5g}", "" if r.bse is None else f"{r.bse:.3g}", "" if r.lower is None else f"[{r.lower:.4g}, {r.upper:.4g}]") for r in self.estimates(spark, alpha).collect()]
        return text_table([(k, str(v)) for k, v in head]) + "\n\n" + text_table([("parameter", "value", "se", "interval"), *rows])

    def latex(self, spark: SparkSession) -> str:
        lines = [r"\begin{tabular}{lrr}", r"\toprule", r"Parameter & Estimate & (se) \\", r"\midrule"]
        for r in self.estimates(spark).collect():
            name = f"{r.name}[{r.i}]".replace("_", r"\_")
            lines.append(f"{name} & {r.value:.4f} & {'' if r.bse is None else f'({r.bse:.4f})'} " + r"\\")
        return "\n".join([*lines, r"\bottomrule", r"\end{tabular}"])

    def save(self, path: str, spark: SparkSession | None = None) -> int:
        """Write the next version of a folder of tables (see operators.store) and return its number. The folder holds
        parameters, states, meshes and training times, and nothing else of the data."""
        return store.save(self, path, spark or self.model.panels[0].rows.sparkSession)

    @staticmethod
    def load(path: str, model: LowRankModel | None = None, spark: SparkSession | None = None, version: int | None = None) -> Results:
        """Saved results; no fit is run. They predict without the training table; what reads training rows, such as fitted
        values, takes a model of the same formulas and latent fields, set up again."""
        spark = spark or (model.panels[0].rows.sparkSession if model else SparkSession.active())
        kept = store.load(path, spark, version)
        panels, covs, domains = (kept.pop(k) for k in ("panels", "covs", "domains"))
        if model is None:
            model = LowRankModel(panels, domains, covs)
        texts, own = [p.formula.text for p in model.panels], [p.formula.text for p in panels]
        if texts != own:
            raise ValueError(f"the results are of {own}, the model of {texts}")
        if len(model.factor) != len(kept["stats"].factor):
            raise ValueError(f"the results have {len(kept['stats'].factor)} latent nodes, the model {len(model.factor)}")
        return Results(model, **kept)


def _full_states(spark: SparkSession, p: np.ndarray) -> DataFrame:
    """(t_idx, a, b, p) of all pairs of nodes after the initial state: steps times nodes squared, whatever the sites."""
    import pandas as pd

    n, q = len(p) - 1, p.shape[1]
    a, b = np.divmod(np.arange(q * q), q)
    return spark.createDataFrame(pd.DataFrame({"t_idx": np.repeat(np.arange(n), q * q), "a": np.tile(a, n), "b": np.tile(b, n), "p": p[1:].ravel()}))


def _inference(name: str, v: float, s: float, q: float, df: int) -> tuple[float, float, float, float, float]:
    """(se, t, p, lower, upper)."""
    if math.isnan(s) or s == 0:
        return (s,) + (float("nan"),) * 4
    t = v / s
    if name in ("s2e", "ks") and v > 0:
        lo, hi = v * math.exp(-q * s / v), v * math.exp(q * s / v)
    elif name == "f" and abs(v) < 1:
        w = q * s / (1 - v * v)
        lo, hi = math.tanh(math.atanh(v) - w), math.tanh(math.atanh(v) + w)
    else:
        lo, hi = v - q * s, v + q * s
    return s, t, special.t_tail(t, df), lo, hi


def text_table(rows: list[tuple[str, ...]]) -> str:
    wide = [max(len(r[k]) for r in rows) for k in range(len(rows[0]))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, wide, strict=True)).rstrip() for r in rows)


def export(rows: DataFrame, tag: str) -> DataFrame:
    """Wide long-table export: site, timestamp, coordinates, and for each response its value, std and support flag."""
    vars_ = sorted(r["var"] for r in rows.select("var").distinct().collect())  # one a response
    cols = []
    for v in vars_:
        on = F.col("var") == v
        cols += [F.max(F.when(on, F.col("mean"))).alias(f"y_{tag}_{v}"), F.max(F.when(on, std_of_variance(F.col("variance")))).alias(f"std_y_{tag}_{v}"), F.max(F.when(on, F.col("in_support"))).alias(f"in_support_{v}")]
    return rows.groupBy(F.col("site").alias("point_id"), F.col("ts").alias("timestamp"), "x", "y").agg(*cols)


@dataclass(frozen=True)
class Prediction:
    results: Results
    rows: DataFrame
    back: tuple | None = None

    def export(self) -> DataFrame:
        return export(self.rows, "pred")

    def back_transform(self, g) -> Prediction:
        """Delta-method means and variances on the original scale; g is a name of areal.BACK or (g, g', g''), functions of
        Columns, for all responses, or one each. mean_link and variance_link keep the scale of the model."""
        g = _back_all(g, len(self.results.model.panels))
        mean, var = F.col("mean"), F.col("variance")
        both = [delta_method(v, mean, var) for v in g]
        return replace(self, rows=self.rows.withColumns({"mean_link": mean, "variance_link": var, "mean": _by_var([m for m, _ in both]), "variance": _by_var([v for _, v in both])}), back=tuple(g))

    def intervals(self, alpha: float = 0.05, prediction: bool = True) -> DataFrame:
        """Rows with y_lower and y_upper on the scale of the model, of new observations or of the signal alone."""
        if self.back is not None:
            raise ValueError("intervals are those of the scale of the model")
        return y_intervals(self.rows, self.results.params.s2e if prediction else None, alpha)

    def to_poly(self, polygons: DataFrame | list, names: list[str] | None = None, std: bool = False, crs: str | None = None) -> DataFrame:
        """(var, ts, poly_id, name, n_points, mean[, std]): means over the points in support of each polygon, on the
        scale of the rows. Polygons without points have n_points 0 and null values, with a warning.

        polygons is a list, or a table (poly_id, name, geom) such as sources.geotext reads; those of another coordinate
        system, named by crs, are reprojected with a warning."""
        polygons = self._polygons(polygons, names, crs)
        ok = self.rows.where("in_support and mean is not null")
        got = areal_mean(ok, polygons, by=["var", "ts"])
        grid = self.rows.select("var", "ts").distinct()  # a row a response and step
        every = polygons.select("poly_id", "name")
        empty = every.join(got.select("poly_id").distinct(), "poly_id", "left_anti").count()
        if empty:
            warnings.warn(f"{empty} polygons hold no point in support", stacklevel=2)
        out = every.crossJoin(F.broadcast(grid)).join(got.drop("name"), ["var", "ts", "poly_id"], "left")
        out = out.select("var", "ts", "poly_id", "name", F.coalesce("n_points", F.lit(0)).cast("long").alias("n_points"), "mean")
        if not std:
            return out
        both = None
        for i in range(len(self.results.model.panels)):
            s = self.to_poly_std(polygons, i).withColumn("var", F.lit(i))
            both = s if both is None else both.unionByName(s)
        times = self.rows.select("ts", "t_idx").distinct()
        both = both.join(F.broadcast(times), "t_idx").select("var", "ts", "poly_id", "std")
        return out.join(both, ["var", "ts", "poly_id"], "left")

    def _polygons(self, polygons: DataFrame | list, names: list[str] | None = None, crs: str | None = None) -> DataFrame:
        if not isinstance(polygons, DataFrame):
            polygons = polygon_table(self.rows, polygons, names)
        if polygons.isEmpty():
            raise ValueError("no polygons")
        mine = self.results.model.panels[0].crs
        if crs and mine and crs != mine:
            warnings.warn(f"polygons are reprojected from {crs} to {mine}, that of the training panel", stacklevel=3)
            polygons = polygons.withColumn("geom", reproject_polygons(F.col("geom"), crs, mine))
        return polygons

    def to_poly_std(self, polygons: DataFrame | list, var: int = 0) -> DataFrame:
        """(poly_id, t_idx, std) of areal means: the basis is averaged over each polygon's points first, so that the
        variance is that of one weighted row a polygon. After back_transform a point weighs by the slope of the
        back-transformation at its mean, which goes with the step."""
        from geopanel.operators.areal import points_in_polygons

        spark = self.rows.sparkSession
        mine = self.rows.where(F.col("var") == var).where("in_support and mean is not null")
        pts = mine.select("site_id", "x", "y").distinct()
        hit = points_in_polygons(pts, polygons).select("poly_id", "site_id")
        load = self.results.params.A[var]
        table = spark.createDataFrame([(k, float(load[j])) for k, j in enumerate(self.results.model.factor)], "node int, a double")
        panel = replace(self.results.model.panels[var], rows=pts)
        b = self.results.model.basis(panel, var).join(F.broadcast(table), "node").select("site_id", "node", (F.col("h") * F.col("a")).alias("w"))
        g = self.back[var] if self.back is not None else "identity"
        slope = (BACK[g] if isinstance(g, str) else g)[1](F.col("mean_link" if self.back is not None else "mean"))
        at = mine.select("site_id", "t_idx", slope.alias("slope"))
        per = hit.hint("merge").join(at, "site_id")
        n = per.groupBy("poly_id", "t_idx").agg(F.count("*").alias("n"))
        w = per.join(b.hint("merge"), "site_id").groupBy("poly_id", "t_idx", "node").agg(F.sum(F.col("slope") * F.col("w")).alias("w"))
        w = w.join(n, ["poly_id", "t_idx"]).select("poly_id", "t_idx", "node", (F.col("w") / F.col("n")).alias("w"))
        full = _full_states(spark, self.results.fit.smoothed.p)
        pair = w.select("poly_id", "t_idx", F.col("node").alias("a"), F.col("w").alias("wa")).join(w.select("poly_id", "t_idx", F.col("node").alias("b"), F.col("w").alias("wb")), ["poly_id", "t_idx"])
        v = pair.join(full, ["t_idx", "a", "b"]).groupBy("poly_id", "t_idx").agg(F.sum(F.col("wa") * F.col("p") * F.col("wb")).alias("v"))
        return v.select("poly_id", "t_idx", std_of_variance(F.col("v")).alias("std"))

    def summary(self) -> DataFrame:
        """One row a response: spread of the means, mean std, counts."""
        return self.rows.groupBy("var").agg(F.min("mean").alias("min"), F.percentile("mean", 0.5).alias("median"), F.max("mean").alias("max"), F.avg(std_of_variance(F.col("variance"))).alias("mean_std"), F.count("mean").alias("n"), F.sum(F.col("in_support").cast("int")).alias("n_in_support"))


__all__ = ["LowRankModel", "Prediction", "Results", "export", "geo", "missing", "text_table"]
