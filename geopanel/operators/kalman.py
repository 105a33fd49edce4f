"""Kalman filtering and smoothing.

Three forms: scalar recursions of many series as one higher-order aggregate a series (no Python); a q-dimensional
information filter over per-step statistics, sequential in time and independent of the number of sites; and a plain
state-space facade over dense arrays for small problems.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_2PI = float(np.log(2 * np.pi))

# --- scalar series ----------------------------------------------------------------------------------------------------


def scalar_series(df: DataFrame, by: list[str], t: str, y: str) -> DataFrame:
    """One row a series with ys, its values in time order. A series is as long as the time axis, which is bounded."""
    s = df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(t).alias("t"), F.col(y).cast("double").alias("y")))).alias("s"))
    return s.select(*by, F.transform("s", lambda v: v["y"]).alias("ys"))


#: Steps that a scan of an array takes before it appends them to its result.
CHUNK = 64


def scan(xs: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The states after each element of xs from the state start on. Appending copies an array, so that steps are
    gathered in chunks first, which divides the copying by CHUNK."""
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(xs) / CHUNK).cast("int") - 1)), lambda k: F.slice(xs, k * CHUNK + 1, F.lit(CHUNK)))

    def some(acc: Column, chunk: Column) -> Column:
        new = F.aggregate(chunk, F.slice(acc, -1, 1), lambda a, x: F.concat(a, F.array(step(F.element_at(a, -1), x))))
        return F.concat(acc, F.slice(new, 2, CHUNK))

    return F.slice(F.aggregate(chunks, F.array(start), some), 2, 1 << 30)


def filter_scalar(ys: Column, f: float, q: float, r: float, x0: float, p0: float) -> Column:
    """Array of (xp, pp, x, p, ll) a step for x_t = f x + N(0, q), y = x + N(0, r); NULL observations only predict."""
    start = F.struct(F.lit(x0).alias("xp"), F.lit(p0).alias("pp"), F.lit(x0).alias("x"), F.lit(p0).alias("p"), F.lit(0.0).alias("ll"))

    def step(last: Column, y: Column) -> Column:
        xp, pp = F.lit(f) * last["x"], F.lit(f) * F.lit(f) * last["p"] + F.lit(q)
        s = pp + F.lit(r)
        gain = pp / s
        seen = y.isNotNull()
        e = y - xp
        x = F.when(seen, xp + gain * e).otherwise(xp)
        p = F.when(seen, (1 - gain) * pp).otherwise(pp)
        ll = last["ll"] - F.when(seen, 0.5 * (F.lit(LOG_2PI) + F.ln(s) + e * e / s)).otherwise(0.0)
        return F.struct(xp.alias("xp"), pp.alias("pp"), x.alias("x"), p.alias("p"), ll.alias("ll"))

    return scan(ys, start, step)


def filter_scalar_last(ys: Column, f: float, q: float, r: float, x0: float, p0: float) -> Column:
    """(x, p, ll) after the last step: a constant-size state."""
    start = F.struct(F.lit(x0).alias("x"), F.lit(p0).alias("p"), F.lit(0.0).alias("ll"))

    def step(a: Column, y: Column) -> Column:
        xp, pp = F.lit(f) * a["x"], F.lit(f) * F.lit(f) * a["p"] + F.lit(q)
        s = pp + F.lit(r)
        seen, e = y.isNotNull(), y - xp
        return F.struct(
            F.when(seen, xp + pp / s * e).otherwise(xp).alias("x"),
            F.when(seen, (1 - pp / s) * pp).otherwise(pp).alias("p"),
            (a["ll"] - F.when(seen, 0.5 * (F.lit(LOG_2PI) + F.ln(s) + e * e / s)).otherwise(0.0)).alias("ll"),
        )

    return F.aggregate(ys, start, step)


def smooth_scalar(filtered: Column, f: float) -> Column:
    """Array of (x, p) smoothed, in time order, from filter_scalar's output."""
    back = F.reverse(filtered)
    first = F.element_at(filtered, -1)
    start = F.struct(first["x"].alias("x"), first["p"].alias("p"), first["xp"].alias("xp"), first["pp"].alias("pp"))

    def step(n: Column, s: Column) -> Column:
        j = s["p"] * F.lit(f) / n["pp"]
        return F.struct((s["x"] + j * (n["x"] - n["xp"])).alias("x"), (s["p"] + j * j * (n["p"] - n["pp"])).alias("p"), s["xp"].alias("xp"), s["pp"].alias("pp"))

    every = F.concat(F.array(start), scan(F.slice(back, 2, 1 << 30), start, step))
    return F.transform(F.reverse(every), lambda v: F.struct(v["x"].alias("x"), v["p"].alias("p")))


# --- information form over per-step statistics --------------------------------------------------------------------------


@dataclass(frozen=True)
class Step:
    """What the observations of one step say: info = H'R^-1 H, vec = H'R^-1 e, quad = e'R^-1 e, logdet = log |R|, n."""

    info: np.ndarray
    vec: np.ndarray
    quad: float
    logdet: float
    n: int


@dataclass(frozen=True)
class Filtered:
    x: np.ndarray  # (T + 1, q), index 0 the prior
    p: np.ndarray
    xp: np.ndarray
    pp: np.ndarray
    loglik: float


def information_filter(steps: Callable[[int], Step], n_steps: int, f: np.ndarray, q: np.ndarray, x0: np.ndarray, s0: np.ndarray, keep: bool = True) -> Filtered:
    """Filter of x_t = diag(f) x_{t-1} + N(0, q). With keep false only the log-likelihood is returned."""
    m = len(f)
    x, p = x0.copy(), s0.copy()
    size = n_steps + 1 if keep else 1
    xs, ps, xps, pps = np.zeros((size, m)), np.zeros((size, m, m)), np.zeros((size, m)), np.zeros((size, m, m))
    xs[0], ps[0] = x, p
    ff, eye, ll = np.outer(f, f), np.eye(m), 0.0
    for t in range(n_steps):
        s = steps(t)
        xp, pp = f * x, ff * p + q
        prior = np.linalg.inv(pp)
        post = (prior + prior.T) / 2 + s.info
        chol = np.linalg.cholesky((post + post.T) / 2)
        inv = np.linalg.solve(chol, eye)
        p = inv.T @ inv
        v = s.vec - s.info @ xp
        x = xp + p @ v
        if s.n:
            quad = s.quad - 2 * float(xp @ s.vec) + float(xp @ s.info @ xp)
            ll -= 0.5 * (2 * np.log(np.diag(chol)).sum() + np.linalg.slogdet(pp)[1] + s.logdet + quad - float(v @ p @ v) + s.n * LOG_2PI)
        if keep:
            xs[t + 1], ps[t + 1], xps[t + 1], pps[t + 1] = x, p, xp, pp
    return Filtered(xs, ps, xps, pps, float(ll))


@dataclass(frozen=True)
class Smoothed:
    x: np.ndarray
    p: np.ndarray
    lag: np.ndarray  # (T, q, q): Cov(x_t, x_{t-1})
    s11: np.ndarray
    s10: np.ndarray
    s00: np.ndarray
    loglik: float


def smoother(fl: Filtered, f: np.ndarray) -> Smoothed:
    """Rauch-Tung-Striebel pass, lag-one covariances P_t J_{t-1}', and the moment sums of the E-step."""
    n, m = len(fl.x) - 1, fl.x.shape[1]
    x, p, lag = fl.x.copy(), fl.p.copy(), np.zeros((n, m, m))
    for t in range(n - 1, -1, -1):
        j = np.linalg.solve(fl.pp[t + 1], (fl.p[t] * f).T).T
        x[t] = fl.x[t] + j @ (x[t + 1] - fl.xp[t + 1])
        p[t] = fl.p[t] + j @ (p[t + 1] - fl.pp[t + 1]) @ j.T
        p[t] = (p[t] + p[t].T) / 2
        lag[t] = p[t + 1] @ j.T
    s11 = np.einsum("ti,tj->ij", x[1:], x[1:]) + p[1:].sum(0)
    s10 = np.einsum("ti,tj->ij", x[1:], x[:-1]) + lag.sum(0)
    s00 = np.einsum("ti,tj->ij", x[:-1], x[:-1]) + p[:-1].sum(0)
    return Smoothed(x, p, lag, s11, s10, s00, fl.loglik)


# --- dense facade -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class StateSpace:
    """y_t = H x_t + X_t beta + e, e ~ N(0, diag R); x_t = diag(F) x_{t-1} + N(0, Q). NaN in y is missing.

    Full R and F are reduced to their diagonals; x0 defaults to zeros, Sigma0 to the identity, regressors to none.
    """

    H: np.ndarray
    R: np.ndarray
    F: np.ndarray
    Q: np.ndarray
    x0: np.ndarray | None = None
    Sigma0: np.ndarray | None = None
    X: np.ndarray | None = None
    beta: np.ndarray | None = None
    names: tuple[str, ...] = field(default=())

    def __post_init__(self):
        def diagonal(v):
            v = np.asarray(v, float)
            return np.diag(v).copy() if v.ndim == 2 else v

        put = lambda k, v: object.__setattr__(self, k, v)
        put("H", np.atleast_2d(np.asarray(self.H, float)))
        put("R", diagonal(self.R)), put("F", diagonal(self.F)), put("Q", np.atleast_2d(np.asarray(self.Q, float)))
        q = self.H.shape[1]
        put("x0", np.zeros(q) if self.x0 is None else np.asarray(self.x0, float))
        put("Sigma0", np.eye(q) if self.Sigma0 is None else np.asarray(self.Sigma0, float))
        put("beta", np.zeros(0) if self.beta is None else np.asarray(self.beta, float))
        wrong = []
        p = self.H.shape[0]
        for k, want in (("R", (p,)), ("F", (q,)), ("Q", (q, q)), ("x0", (q,)), ("Sigma0", (q, q))):
            if getattr(self, k).shape != want:
                wrong.append(f"{k} has shape {getattr(self, k).shape}, not {want}")
        if (self.R < -1e-8).any():
            wrong.append("R has negative variances")
        if self.X is not None and (np.asarray(self.X).ndim != 3 or np.asarray(self.X).shape[:2] != (p, len(self.beta))):
            wrong.append(f"X has shape {np.asarray(self.X).shape}, not ({p}, {len(self.beta)}, T)")
        if self.X is None and len(self.beta):
            wrong.append("beta without X")
        if wrong:
            raise ValueError("; ".join(wrong))

    def set(self, **changes) -> StateSpace:
        return replace(self, **changes)

    def mean(self, n: int) -> np.ndarray:
        return np.zeros((self.H.shape[0], n)) if self.X is None else np.einsum("pbt,b->pt", np.asarray(self.X, float)[:, :, :n], self.beta)

    def _steps(self, y: np.ndarray):
        y = np.asarray(y, float)
        if y.ndim != 2 or y.shape[0] != self.H.shape[0]:
            raise ValueError(f"y has shape {y.shape}; {self.H.shape[0]} rows are needed")
        e = y - self.mean(y.shape[1])

        def at(t: int) -> Step:
            ok = np.isfinite(e[:, t])
            h, r, d = self.H[ok], self.R[ok], e[ok, t]
            return Step(h.T @ (h / r[:, None]), h.T @ (d / r), float((d * d / r).sum()), float(np.log(r).sum()), int(ok.sum()))

        return at

    def filter(self, y: np.ndarray) -> Filtered:
        return information_filter(self._steps(y), np.asarray(y).shape[1], self.F, self.Q, self.x0, self.Sigma0)

    def smoother(self, y: np.ndarray) -> Smoothed:
        return smoother(self.filter(y), self.F)

    estimate = __call__ = smoother

    def predict(self, s: Smoothed, variance: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Fitted means (p, T) and pointwise variances of the signal."""
        mu = self.mean(len(s.x) - 1) + self.H @ s.x[1:].T
        return mu, np.einsum("pi,tij,pj->pt", self.H, s.p[1:], self.H) if variance else None

    def predict_cov(self, s: Smoothed) -> np.ndarray:
        """Full covariances (p, p, T); on request only."""
        return np.einsum("pi,tij,rj->prt", self.H, s.p[1:], self.H)

    def simulate(self, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(y, x) with y (p, n) and x (q, n + 1); the first observation is of the initial state."""
        rng = np.random.default_rng(seed)
        x = np.zeros((n + 1, len(self.F)))
        x[0] = rng.multivariate_normal(self.x0, self.Sigma0)
        y, mu = np.zeros((self.H.shape[0], n)), self.mean(n)
        for t in range(n):
            y[:, t] = mu[:, t] + self.H @ x[t] + rng.normal(0, np.sqrt(self.R))
            x[t + 1] = self.F * x[t] + rng.multivariate_normal(np.zeros(len(self.F)), self.Q)
        return y, x.T

    def stationary(self) -> np.ndarray:
        """Stationary state covariance Q_ij / (1 - f_i f_j)."""
        return self.Q / (1 - np.outer(self.F, self.F))
