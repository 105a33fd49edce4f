"""One pass over the panel: per-step statistics by which the whole EM fit runs without touching the panel again.

For each response i and step t, over observed rows with basis row h and covariates x:
D = sum h h', c = sum h y, E = sum h x', and m, yy, Xy, XX = count and second moments of (y, x).
D is the sum over all sites less that of the missing rows, so work on D follows the missing data.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopanel.operators.kalman import Step


def pair_sums(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by.., a, b, d): sums of h_a h_b over sites, a <= b; rows has by.., site_id, hs = array of (node, h)."""
    r = rows.select(*by, F.explode("hs").alias("p"), "hs").select(*by, F.col("p.node").alias("a"), F.col("p.h").alias("ha"), F.explode("hs").alias("q"))
    r = r.where("q.node >= a").select(*by, "a", F.col("q.node").alias("b"), (F.col("ha") * F.col("q.h")).alias("d"))
    return r.groupBy(*by, "a", "b").agg(F.sum("d").alias("d"))


def step_sums(panel: DataFrame, basis: DataFrame, n_cov: int) -> DataFrame:
    """(var, t_idx, node, c, e0..): sums of h y and h x over observed rows."""
    j = panel.where("obs is not null").join(basis.hint("merge"), ["var", "site_id"])
    return j.groupBy("var", "t_idx", "node").agg(F.sum(F.col("h") * F.col("obs")).alias("c"), *[F.sum(F.col("h") * F.get(F.col("cov"), F.lit(k))).alias(f"e{k}") for k in range(n_cov)])


def moments(panel: DataFrame, n_cov: int) -> DataFrame:
    """(var, t_idx, m, yy, xy0.., xx00..) over observed rows."""
    x = [F.get(F.col("cov"), F.lit(k)) for k in range(n_cov)]
    y = F.col("obs")
    sums = [F.count("*").alias("m"), F.sum(y * y).alias("yy"), F.sum(y).alias("y1")]
    sums += [F.sum(y * x[k]).alias(f"xy{k}") for k in range(n_cov)]
    sums += [F.sum(x[k] * x[j]).alias(f"xx{k}_{j}") for k in range(n_cov) for j in range(k + 1)]
    return panel.where("obs is not null").groupBy("var", "t_idx").agg(*sums)


@dataclass(frozen=True)
class Stats:
    """Statistics as arrays: full[i] (q, q), gone[i][t] = (a, b, d) of missing rows, c (V, T, q), e (V, T, q, B),
    m (V, T), yy (V, T), xy (V, T, B), xx (V, T, B, B); covs[i] slices response i's coefficients."""

    full: list[np.ndarray]
    gone: list[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]
    c: np.ndarray
    e: list[np.ndarray]
    m: np.ndarray
    yy: np.ndarray
    y1: np.ndarray
    xy: list[np.ndarray]
    xx: list[np.ndarray]
    covs: list[slice]
    factor: np.ndarray

    @property
    def n_steps(self) -> int:
        return self.m.shape[1]

    @property
    def q(self) -> int:
        return len(self.factor)

    def d(self, i: int, t: int) -> np.ndarray:
        gone = self.gone[i].get(t)
        if gone is None:
            return self.full[i]
        a, b, v = gone
        out = self.full[i].copy()
        np.subtract.at(out, (a, b), v)
        off = a != b
        np.subtract.at(out, (b[off], a[off]), v[off])
        return out

    def step(self, t: int, beta: np.ndarray, s2e: np.ndarray, load: np.ndarray) -> Step:
        """load: (V, n factors)."""
        q = self.q
        info, vec, quad, logdet, n = np.zeros((q, q)), np.zeros(q), 0.0, 0.0, 0
        for i, k in enumerate(self.covs):
            m = int(self.m[i, t])
            if not m:
                continue
            a, b = load[i][self.factor], beta[k]
            info += np.outer(a, a) * self.d(i, t) / s2e[i]
            vec += a * (self.c[i, t] - self.e[i][t] @ b) / s2e[i]
            quad += (self.yy[i, t] - 2 * b @ self.xy[i][t] + b @ self.xx[i][t] @ b) / s2e[i]
            logdet += m * float(np.log(s2e[i]))
            n += m
        return Step(info, vec, quad, logdet, n)


def collect(panel: DataFrame, basis: DataFrame, n_vars: int, n_steps: int, n_covs: list[int], factor: np.ndarray) -> Stats:
    """Aggregate in Spark and bring the statistics to the driver: about T (3 B q + q) numbers a response and the nonzeros
    of D, whatever the number of sites.

    panel: var, site_id, t_idx, obs, cov (the response's own covariates); basis: var, site_id, node, h.
    """
    q, width = len(factor), max([1, *n_covs])
    hs = basis.groupBy("var", "site_id").agg(F.collect_list(F.struct("node", "h")).alias("hs"))
    full = [np.zeros((q, q)) for _ in range(n_vars)]
    for r in pair_sums(hs, ["var"]).collect():
        full[r["var"]][r.a, r.b] = full[r["var"]][r.b, r.a] = r.d
    lost = panel.where("obs is null").select("var", "site_id", "t_idx").join(hs.hint("merge"), ["var", "site_id"])
    gone: list[dict] = [{} for _ in range(n_vars)]
    lists: dict[tuple[int, int], list] = {}
    for r in pair_sums(lost, ["var", "t_idx"]).toArrow().to_pylist():
        lists.setdefault((r["var"], r["t_idx"]), []).append((r["a"], r["b"], r["d"]))
    for (i, t), v in lists.items():
        a, b, d = zip(*v, strict=True)
        gone[i][t] = (np.array(a), np.array(b), np.array(d))
    c = np.zeros((n_vars, n_steps, q))
    e = [np.zeros((n_steps, q, n)) for n in n_covs]
    got = step_sums(panel, basis, width).toArrow()
    v, t, node = (got.column(k).to_numpy() for k in ("var", "t_idx", "node"))
    c[v, t, node] = got.column("c").to_numpy()
    for i, n in enumerate(n_covs):
        on = v == i
        for k in range(n):
            e[i][t[on], node[on], k] = got.column(f"e{k}").to_numpy(zero_copy_only=False)[on]
    m, yy, y1 = (np.zeros((n_vars, n_steps)) for _ in range(3))
    xy, xx = [np.zeros((n_steps, n)) for n in n_covs], [np.zeros((n_steps, n, n)) for n in n_covs]
    for r in moments(panel, width).collect():
        i, t = r["var"], r.t_idx
        m[i, t], yy[i, t], y1[i, t] = r.m, r.yy, r.y1
        for k in range(n_covs[i]):
            xy[i][t, k] = r[f"xy{k}"]
            for j in range(k + 1):
                xx[i][t, k, j] = xx[i][t, j, k] = r[f"xx{k}_{j}"]
    ends = np.cumsum([0, *n_covs])
    return Stats(full, gone, c, e, m, yy, y1, xy, xx, [slice(int(ends[i]), int(ends[i + 1])) for i in range(n_vars)], factor)
