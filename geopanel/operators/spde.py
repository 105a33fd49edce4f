"""Matern fields of smoothness 1 on a mesh: Q = s2 K C^-1 K with K = kappa^2 C + G and s2 = 1 / (4 pi kappa^2)."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopanel.functions import geo
from geopanel.functions.special import matern1
from geopanel.operators import fem
from geopanel.operators.mesh import Mesh


def precision(mass: DataFrame, stiffness: DataFrame, kappa: float) -> DataFrame:
    """(i, j, q): the precision as s2 (kappa^4 C + 2 kappa^2 G + G C^-1 G), one self-join of the stiffness."""
    s2 = 1 / (4 * math.pi * kappa**2)
    diag = mass.select(F.col("v").alias("i"), F.col("v").alias("j"), (F.lit(kappa**4) * F.col("c")).alias("q"))
    lin = stiffness.select("i", "j", (2 * kappa**2 * F.col("g")).alias("q"))
    left = stiffness.select("i", F.col("j").alias("k"), F.col("g").alias("a"))
    right = stiffness.select(F.col("i").alias("k"), "j", F.col("g").alias("b"))
    quad = left.join(mass.select(F.col("v").alias("k"), "c"), "k").join(right, "k").select("i", "j", (F.col("a") * F.col("b") / F.col("c")).alias("q"))
    return diag.unionByName(lin).unionByName(quad).groupBy("i", "j").agg((s2 * F.sum("q")).alias("q"))


@dataclass(frozen=True)
class Spde:
    """A mesh with its dense element matrices, for the driver's q x q algebra."""

    mesh: Mesh
    c: np.ndarray
    g: np.ndarray
    latlon: bool = False

    @staticmethod
    def of(mesh: Mesh, nu: float = 1.0, var: float = 1.0, latlon: bool = False) -> Spde:
        if nu != 1 or var != 1:
            raise ValueError("smoothness and variance are fixed at 1; scale by the loadings instead")
        n, (a, b, c) = len(mesh.xy), (mesh.xy[mesh.tri[:, k]] for k in range(3))
        area = 0.5 * ((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (c[:, 0] - a[:, 0]) * (b[:, 1] - a[:, 1]))
        m, g = np.zeros(n), np.zeros((n, n))
        for k in range(3):
            np.add.at(m, mesh.tri[:, k], area / 3)
        bb = np.stack([b[:, 1] - c[:, 1], c[:, 1] - a[:, 1], a[:, 1] - b[:, 1]])
        dd = np.stack([c[:, 0] - b[:, 0], a[:, 0] - c[:, 0], b[:, 0] - a[:, 0]])
        for i in range(3):
            for j in range(3):
                np.add.at(g, (mesh.tri[:, i], mesh.tri[:, j]), (bb[i] * bb[j] + dd[i] * dd[j]) / (4 * area))
        return Spde(mesh, m, g, latlon)

    @property
    def n_latent(self) -> int:
        return self.mesh.n_inner

    def precision(self, kappa: float) -> np.ndarray:
        k = kappa**2 * np.diag(self.c) + self.g
        return k @ (k / self.c[:, None]) / (4 * math.pi * kappa**2)

    def marginal(self, kappa: float, gradient: bool = False):
        """Precision of the inner vertices with the outer ones integrated out, and its derivative in kappa."""
        q = self.precision(kappa)
        i, o = np.flatnonzero(self.mesh.inner), np.flatnonzero(~self.mesh.inner)
        z = np.linalg.solve(q[np.ix_(o, o)], q[np.ix_(o, i)]) if len(o) else np.zeros((0, len(i)))
        low = q[np.ix_(i, i)] - q[np.ix_(i, o)] @ z
        low = (low + low.T) / 2
        if not gradient:
            return low
        s2 = 1 / (4 * math.pi * kappa**2)
        d = -2 / kappa * q + 4 * kappa * s2 * (kappa**2 * np.diag(self.c) + self.g)
        dl = d[np.ix_(i, i)] - d[np.ix_(i, o)] @ z - z.T @ d[np.ix_(o, i)] + z.T @ d[np.ix_(o, o)] @ z
        return low, (dl + dl.T) / 2

    def start_kappa(self) -> float:
        lo, hi = self.mesh.xy.min(0), self.mesh.xy.max(0)
        return math.sqrt(8) / (float((hi - lo).min()) / 3)

    def range_of(self, kappa: float) -> float:
        """Distance at which the correlation is about 0.14."""
        return math.sqrt(8) / kappa

    def tables(self, spark):
        v, t = self.mesh.tables(spark)
        return v, t, fem.mass(v, t), fem.stiffness(v, t)

    def basis(self, points: DataFrame, site: str = "site_id") -> DataFrame:
        """(site, node, h) with nodes numbered among the inner vertices."""
        v, t = self.mesh.tables(points.sparkSession)
        number = points.sparkSession.createDataFrame([(int(k), n) for n, k in enumerate(np.flatnonzero(self.mesh.inner))], "v int, node int")
        return fem.latent_basis(fem.basis(points, v, t, site), v, site).join(number, "v").select(site, "node", "h")


def correlation(distance: Column, kappa: float) -> Column:
    """Nominal Matern correlation."""
    return matern1(kappa * distance)


def variogram(distance: Column, kappa: float, var: float = 1.0) -> Column:
    return var * (1 - correlation(distance, kappa))


#: Points that may stand on the right of a table of all distances.
MOST = 10_000


def distances(a: DataFrame, b: DataFrame, latlon: bool = False) -> DataFrame:
    """(a, b, d) of all points a (id, x, y) to a fixed set of points b, such as the nodes of a mesh, of MOST at most."""
    n = b.limit(MOST + 1).count()
    if n > MOST:
        raise ValueError(f"distances to more than {MOST} points; take neighbours by cells instead")
    p = a.select(F.col("id").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    q = b.select(F.struct(F.col("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).alias("q")).agg(F.collect_list("q").alias("q"))
    f = geo.great_circle if latlon else geo.euclid
    out = p.crossJoin(F.broadcast(q)).select("a", "xa", "ya", F.explode("q").alias("q"))  # one row with all of b
    return out.select("a", F.col("q.id").alias("b"), f(F.col("xa"), F.col("ya"), F.col("q.x"), F.col("q.y")).alias("d"))
