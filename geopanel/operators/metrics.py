"""Residual metrics, coverage, diagnostics and least squares."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geopanel.functions import special
from geopanel.functions.semantics import std_of_variance
from geopanel.plans.ordering import with_previous


def grouped_mse(df: DataFrame, residual: str, site: str = "site", t: str = "t") -> DataFrame:
    """Mean squared residual over everything, by site and by step in one aggregation: (site, t, n, mse, rmse)."""
    r = F.col(residual)
    sets = df.groupingSets([[], [site], [t]], site, t)
    out = sets.agg(F.count(r).alias("n"), F.avg(r * r).alias("mse"))
    return out.select(site, t, "n", "mse", F.sqrt("mse").alias("rmse"))


def coverage(df: DataFrame, obs: str, mean: str, var: str, noise: str | Column, alpha: float = 0.05, site: str = "site", t: str = "t") -> DataFrame:
    """Share of observed values inside the prediction interval mean +- z sqrt(var + noise), as grouped_mse groups."""
    z = special.z_quantile(1 - alpha / 2)
    noise = F.col(noise) if isinstance(noise, str) else noise
    half = z * std_of_variance(F.col(var) + noise)
    inside = F.when(F.col(obs).isNotNull(), (F.abs(F.col(obs) - F.col(mean)) <= half).cast("double"))
    d = df.withColumn("__in", inside)
    return d.groupingSets([[], [site], [t]], site, t).agg(F.count("__in").alias("n"), F.avg("__in").alias("coverage")).select(site, t, "n", "coverage")


def diagnostics(df: DataFrame, residual: str, site: str = "site", t: str = "t") -> DataFrame:
    """One row: n, skewness, excess kurtosis, Jarque-Bera with its p-value, Durbin-Watson.

    Durbin-Watson runs over non-null residuals in site-major order: differences inside sites come from a window by site,
    those between sites from the first and last residual of each.
    """
    r = df.where(F.col(residual).isNotNull()).select(site, t, F.col(residual).alias("r"))
    w = Window.partitionBy(site).orderBy(t)
    d = r.withColumn("d", F.col("r") - F.lag("r").over(w))
    per = d.groupBy(site).agg(F.sum(F.col("d") * F.col("d")).alias("dd"), F.min_by("r", t).alias("first"), F.max_by("r", t).alias("last"))
    ends = with_previous(per, [site], "last", "__end").withColumn("jump", F.col("first") - F.col("__end")).agg((F.coalesce(F.sum("dd"), F.lit(0.0)) + F.coalesce(F.sum(F.col("jump") * F.col("jump")), F.lit(0.0))).alias("dd"))
    m = r.agg(F.count("r").alias("n"), F.skewness("r").alias("skew"), F.kurtosis("r").alias("kurt"), F.sum(F.col("r") * F.col("r")).alias("ss"))
    jb = F.col("n") / 6 * (F.col("skew") * F.col("skew") + F.col("kurt") * F.col("kurt") / 4)
    return m.crossJoin(F.broadcast(ends)).select("n", "skew", "kurt", jb.alias("jarque_bera"), F.exp(-jb / 2).alias("jb_p"), (F.col("dd") / F.col("ss")).alias("durbin_watson"))


def omnibus(df: DataFrame, residual: str) -> tuple[float, float]:
    r = df.agg(F.count(residual).alias("n"), F.skewness(residual).alias("s"), F.kurtosis(residual).alias("k")).first()
    return special.omnibus(r.n, r.s, r.k)


def normal_equations(df: DataFrame, xs: list[str], y: str) -> DataFrame:
    """(i, j, xx, xy) over complete rows, i <= j; xy on the diagonal rows."""
    ok = df.where(" and ".join(f"`{c}` is not null" for c in [*xs, y]))
    pairs = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]
    row = ok.agg(*[F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"xx_{i}_{j}") for i, j in pairs], *[F.sum(F.col(c) * F.col(y)).alias(f"xy_{i}") for i, c in enumerate(xs)])
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"xx_{i}_{j}").alias("xx"), (F.col(f"xy_{i}") if i == j else F.lit(None).cast("double")).alias("xy")) for i, j in pairs]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def ols(df: DataFrame, xs: list[str], y: str, alpha: float = 0.05) -> dict[str, np.ndarray | float]:
    """Pooled least squares with standard errors and intervals, from one aggregation."""
    ok = df.where(" and ".join(f"`{c}` is not null" for c in [*xs, y]))
    n = len(xs)
    r = ok.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"x{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate(xs) if j <= i], *[F.sum(F.col(a) * F.col(y)).alias(f"y{i}") for i, a in enumerate(xs)], F.sum(F.col(y) * F.col(y)).alias("yy"), F.count("*").alias("n")).first()
    xx = np.array([[r[f"x{max(i, j)}_{min(i, j)}"] for j in range(n)] for i in range(n)])
    xy = np.array([r[f"y{i}"] for i in range(n)])
    beta = np.linalg.solve(xx, xy)
    s2 = (r.yy - beta @ xy) / (r.n - n)
    se = np.sqrt(np.diag(np.linalg.inv(xx)) * s2)
    q = special.t_quantile(1 - alpha / 2, r.n - n)
    return {"beta": beta, "se": se, "lower": beta - q * se, "upper": beta + q * se, "s2": s2, "n": r.n}
