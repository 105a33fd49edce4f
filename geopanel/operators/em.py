"""EM for the low-rank space-time model, on statistics alone."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np

from geopanel.operators.kalman import Smoothed, information_filter, smoother
from geopanel.operators.spde import Spde
from geopanel.operators.suffstat import Stats


@dataclass(frozen=True)
class FitOptions:
    """std: True for pointwise variances, "full" for covariances on request, False for none."""

    max_iter: int = 20
    tol_relat: float = 1e-3
    verbose: bool = False
    force_iter: bool = False
    std: bool | str = True
    ks_tol: float = 1e-6
    f_update: str = "unweighted"

    def __post_init__(self):
        wrong = []
        if not isinstance(self.max_iter, int) or isinstance(self.max_iter, bool) or self.max_iter < 1:
            wrong.append("max_iter is a positive whole number")
        if not self.tol_relat >= 0:
            wrong.append("tol_relat is not negative")
        if self.std not in (True, False, "full"):
            wrong.append('std is True, False or "full"')
        if not self.ks_tol > 0:
            wrong.append("ks_tol is positive")
        if self.f_update not in ("unweighted", "weighted"):
            wrong.append('f_update is "unweighted" or "weighted"')
        if wrong:
            raise ValueError("; ".join(wrong))


@dataclass(frozen=True)
class Params:
    """Parameter values and the names of those held fixed."""

    beta: np.ndarray
    s2e: np.ndarray
    f: np.ndarray
    A: np.ndarray
    ks: np.ndarray
    x0: np.ndarray
    Sigma0: np.ndarray
    fixed: frozenset[str] = field(default_factory=frozenset)

    NAMES = ("beta", "s2e", "f", "A", "ks", "x0", "Sigma0")

    def as_dict(self) -> dict[str, np.ndarray]:
        return {k: getattr(self, k) for k in self.NAMES}

    def freeze(self, *names: str) -> Params:
        return replace(self, fixed=self.fixed | set(names))

    def unfreeze(self, *names: str) -> Params:
        return replace(self, fixed=self.fixed - set(names))

    def set(self, **values) -> Params:
        """New values for what is not fixed."""
        return replace(self, **{k: np.asarray(v, float) for k, v in values.items() if k not in self.fixed})

    def free(self) -> list[str]:
        return [k for k in self.NAMES[:5] if k not in self.fixed]

    def pack(self) -> np.ndarray:
        return np.concatenate([np.ravel(getattr(self, k)) for k in self.free()]) if self.free() else np.zeros(0)

    def unpack(self, theta: np.ndarray) -> Params:
        out, at = {}, 0
        for k in self.free():
            v = getattr(self, k)
            out[k] = np.asarray(theta[at : at + v.size], float).reshape(v.shape)
            at += v.size
        return replace(self, **out)

    def labels(self) -> list[tuple[str, int]]:
        return [(k, i) for k in self.free() for i in range(getattr(self, k).size)]


def check_params(p: Params, stats: Stats, n_factors: int) -> None:
    n_vars, b = stats.m.shape[0], stats.covs[-1].stop
    shapes = {"beta": (b,), "s2e": (n_vars,), "f": (n_factors,), "A": (n_vars, n_factors), "ks": (n_factors,), "x0": (stats.q,), "Sigma0": (stats.q, stats.q)}
    wrong = [f"{k} has shape {getattr(p, k).shape}, not {s}" for k, s in shapes.items() if getattr(p, k).shape != s]
    wrong += [f"{k} is not finite" for k in shapes if not np.isfinite(getattr(p, k)).all()]
    wrong += [f"{k} is not positive" for k in ("s2e", "ks") if (getattr(p, k) <= 0).any()]
    wrong += ["f is not within (-1, 1)"] if (np.abs(p.f) >= 1).any() else []
    if wrong:
        raise ValueError("; ".join(wrong))


def start(stats: Stats, covs: list[Spde]) -> Params:
    """Pooled least squares; a fifth of the residual variance to the noise, the rest to the leading loadings."""
    n_vars, n_f = stats.m.shape[0], len(covs)
    beta, s2e, load = np.zeros(stats.covs[-1].stop), np.zeros(n_vars), np.zeros((n_vars, n_f))
    for i, k in enumerate(stats.covs):
        xx, xy, n = stats.xx[i].sum(0), stats.xy[i].sum(0), stats.m[i].sum()
        b = np.linalg.lstsq(xx, xy, rcond=None)[0] if len(xy) else np.zeros(0)
        beta[k] = b
        ss = stats.yy[i].sum() - 2 * b @ xy + b @ xx @ b
        x1 = _column_sums(stats, i)
        mean = (stats.y1[i].sum() - (b @ x1 if x1 is not None else 0.0)) / max(n, 1)
        var = max(ss / max(n, 1) - (mean**2 if x1 is not None or not len(b) else 0.0), 1e-12)
        s2e[i] = 0.2 * var
        if i < n_f:
            load[i, i] = math.sqrt(0.8 * var)
    for j in range(n_vars, n_f):
        load[:, j] = 0.1
    return Params(beta, s2e, np.full(n_f, 0.7), load, np.array([c.start_kappa() for c in covs]), np.zeros(stats.q), 10 * np.eye(stats.q))


def _column_sums(stats: Stats, i: int) -> np.ndarray | None:
    """Column sums of X where one of its columns is constant 1 (then residuals have mean zero and this is exact)."""
    xx, n = stats.xx[i].sum(0), stats.m[i].sum()
    for k in range(len(xx)):
        if abs(xx[k, k] - n) < 1e-9 * max(n, 1):
            return xx[k]
    return None


@dataclass(frozen=True)
class System:
    f: np.ndarray
    q: np.ndarray
    inv_q: list[np.ndarray]


def system(p: Params, covs: list[Spde], factor: np.ndarray) -> System:
    n = len(factor)
    q, inv = np.zeros((n, n)), []
    for j, c in enumerate(covs):
        low = c.marginal(float(p.ks[j]))
        at = np.flatnonzero(factor == j)
        q[np.ix_(at, at)] = np.linalg.inv(low)
        inv.append(low)
    return System(p.f[factor], (q + q.T) / 2, inv)


def e_step(stats: Stats, p: Params, s: System) -> Smoothed:
    steps = lambda t: stats.step(t, p.beta, p.s2e, p.A)
    return smoother(information_filter(steps, stats.n_steps, s.f, s.q, p.x0, p.Sigma0), s.f)


def loglik(stats: Stats, p: Params, covs: list[Spde]) -> float:
    s = system(p, covs, stats.factor)
    return information_filter(lambda t: stats.step(t, p.beta, p.s2e, p.A), stats.n_steps, s.f, s.q, p.x0, p.Sigma0, keep=False).loglik


def minimise_kappa(cov: Spde, omega: np.ndarray, n: int, start_at: float, tol: float, max_iter: int = 50) -> float:
    """Least of -n log|L(k)| + tr(L(k) omega): the sign of the slope in log k is bracketed and bisected."""

    def value_slope(u: float) -> tuple[float, float]:
        k = math.exp(u)
        low, d = cov.marginal(k, gradient=True)
        sign, logdet = np.linalg.slogdet(low)
        return -n * logdet + float((low * omega).sum()), k * (-n * float(np.trace(np.linalg.solve(low, d))) + float((d * omega).sum()))

    u = math.log(start_at)
    v, g = value_slope(u)
    goal = tol * max(abs(v), 1e-300)
    if abs(g) <= goal:
        return start_at
    step, lo, hi = 0.25, None, None
    for _ in range(max_iter):
        if g > 0:
            hi = u
        else:
            lo = u
        u = (lo + hi) / 2 if lo is not None and hi is not None else u + (step if g < 0 else -step)
        step *= 2 if lo is None or hi is None else 1
        step = min(step, 2.0)
        _, g = value_slope(u)
        if abs(g) <= goal or (lo is not None and hi is not None and hi - lo < 1e-12):
            break
    return math.exp(u)


def m_step(stats: Stats, p: Params, s: System, sm: Smoothed, covs: list[Spde], opt: FitOptions) -> Params:
    """New parameters in the order f, beta, s2e, A, ks, x0 and Sigma0; what is fixed keeps its value for later steps."""
    fac, n_f, x, pt = stats.factor, len(covs), sm.x[1:], sm.p[1:]
    blocks = [np.flatnonzero(fac == j) for j in range(n_f)]
    f = np.empty(n_f)
    for j, at in enumerate(blocks):
        s10, s00 = sm.s10[np.ix_(at, at)], sm.s00[np.ix_(at, at)]
        w = s.inv_q[j] if opt.f_update == "weighted" else None
        f[j] = float((w * s10).sum() / (w * s00).sum()) if w is not None else float(np.trace(s10) / np.trace(s00))
    new = p.set(f=f)
    beta, s2e, load = new.beta.copy(), new.s2e.copy(), new.A.copy()
    for i, k in enumerate(stats.covs):
        a, m = p.A[i][fac], stats.m[i].sum()
        z = x * a
        xx, xy = stats.xx[i].sum(0), stats.xy[i].sum(0)
        ez = np.einsum("tqb,tq->b", stats.e[i], z)
        if "beta" not in p.fixed and len(xy):
            beta[k] = np.linalg.solve(xx, xy - ez)
        if "s2e" not in p.fixed:
            b = p.beta[k]
            ss = stats.yy[i].sum() - 2 * b @ xy + b @ xx @ b
            aa = np.outer(a, a)
            for t in range(stats.n_steps):
                if stats.m[i, t]:
                    d = stats.d(i, t)
                    ss += -2 * z[t] @ (stats.c[i, t] - stats.e[i][t] @ b) + z[t] @ d @ z[t] + float((aa * d * pt[t]).sum())
            s2e[i] = ss / m if m else 0.0
        if "A" not in p.fixed:
            b = beta[k]
            g, r = np.zeros(n_f), np.zeros((n_f, n_f))
            for t in range(stats.n_steps):
                if not stats.m[i, t]:
                    continue
                w = x[t] * (stats.c[i, t] - stats.e[i][t] @ b)
                v = stats.d(i, t) * (np.outer(x[t], x[t]) + pt[t])
                for j, at in enumerate(blocks):
                    g[j] += w[at].sum()
                    for l, bt in enumerate(blocks[: j + 1]):
                        r[j, l] = r[l, j] = r[j, l] + v[np.ix_(at, bt)].sum()
            load[i] = np.linalg.solve(r + 1e-12 * np.trace(r) * np.eye(n_f), g)
    new = new.set(beta=beta, s2e=s2e, A=load)
    if "ks" not in p.fixed:
        ks = new.ks.copy()
        fd = new.f[fac]
        omega = sm.s11 - sm.s10 * fd[None, :] - (sm.s10 * fd[None, :]).T + np.outer(fd, fd) * sm.s00
        for j, at in enumerate(blocks):
            ks[j] = minimise_kappa(covs[j], omega[np.ix_(at, at)], stats.n_steps, float(p.ks[j]), opt.ks_tol)
        new = new.set(ks=ks)
    return new.set(x0=sm.x[0], Sigma0=sm.p[0])


@dataclass(frozen=True)
class Fit:
    params: Params
    smoothed: Smoothed
    loglik: float
    converged: bool
    termination: str
    trace: list[dict]


def fit(stats: Stats, covs: list[Spde], p: Params, opt: FitOptions, e: Callable = e_step, m: Callable = m_step) -> Fit:
    """EM with the stopping rule on the log-likelihood gain per observation."""
    n_obs = max(1, int(stats.m.sum()))
    best: tuple[float, Params] | None = None
    trace = [{"iteration": 0, "loglik": float("nan"), "relat": float("nan"), **_flat(p)}]
    last, k, why, converged, restore = float("nan"), 0, "", False, False
    while True:
        k += 1
        s = system(p, covs, stats.factor)
        sm = e(stats, p, s)
        ll = sm.loglik
        delta = ll - last
        relat = math.inf if k == 1 else delta / n_obs
        trace.append({"iteration": k, "loglik": ll, "relat": relat, **_flat(p)})
        if opt.verbose:
            print(f"EM {k}: log-likelihood {ll:.6f}, gain an observation {relat:.3g}")
        if k > 1 and not math.isfinite(delta):
            warnings.warn("the log-likelihood is not finite; the best iterate is returned", RuntimeWarning, stacklevel=2)
            why, restore = "invalid", True
            break
        if k > 1 and opt.f_update == "weighted" and delta < 0:
            if abs(relat) <= opt.tol_relat:
                why, converged, restore = "tolerance", True, True
                break
            warnings.warn("the log-likelihood fell", RuntimeWarning, stacklevel=2)
            if not opt.force_iter:
                why, restore = "decrease", True
                break
        if best is None or ll >= best[0]:
            best = (ll, p)
        p = m(stats, p, s, sm, covs, opt)
        last = ll
        if abs(relat) <= opt.tol_relat:
            why, converged = "tolerance", True
            break
        if k >= opt.max_iter:
            warnings.warn("EM stopped at max_iter", RuntimeWarning, stacklevel=2)
            why = "max_iter"
            break
    if not restore:
        sm = e(stats, p, system(p, covs, stats.factor))
        if not math.isfinite(sm.loglik) or (opt.f_update == "weighted" and best and sm.loglik < best[0]):
            restore = True
    if restore and best:
        p = best[1]
        sm = e(stats, p, system(p, covs, stats.factor))
    return Fit(p, sm, sm.loglik, converged, why, trace)


def _flat(p: Params) -> dict[str, float]:
    out = {}
    for k in ("beta", "s2e", "f", "A", "ks"):
        for i, v in enumerate(np.ravel(getattr(p, k))):
            out[f"{k}_{i}"] = float(v)
    return out


def stationary_variances(p: Params, s: System, factor: np.ndarray) -> np.ndarray:
    """Stationary state covariance of the fitted system."""
    return s.q / (1 - np.outer(s.f, s.f))
