"""Triangular meshes: structured lattices as DataFrames, adaptive meshes on the driver, and mesh quality.

A mesh is two tables, vertex(v, x, y, inner) and triangle(e, v1, v2, v3), counter-clockwise. A mesh has at most some
thousand vertices whatever the data, because the latent state has one dimension a vertex.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geopanel.functions import geo


@dataclass(frozen=True)
class Mesh:
    """Driver-side mesh: xy (n, 2), tri (m, 3), inner (n,)."""

    xy: np.ndarray
    tri: np.ndarray
    inner: np.ndarray
    domain: tuple = ()

    @property
    def n_inner(self) -> int:
        return int(self.inner.sum())

    @property
    def box(self) -> tuple[float, float, float, float]:
        lo, hi = self.xy.min(0), self.xy.max(0)
        return tuple(round(float(v), 2) for v in (*lo, *hi))

    @property
    def inner_points(self) -> np.ndarray:
        return self.xy[self.inner]

    @property
    def outer_points(self) -> np.ndarray:
        return self.xy[~self.inner]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct edges (k, 2), and whether each lies on the boundary (in one triangle only)."""
        e = np.sort(np.concatenate([self.tri[:, [0, 1]], self.tri[:, [1, 2]], self.tri[:, [2, 0]]]), axis=1)
        u, n = np.unique(e, axis=0, return_counts=True)
        return u, n == 1

    def covers_domain(self) -> bool:
        """Whether the hull of the vertices covers the hull of the domain."""
        ring = geo.hull(map(tuple, self.xy))
        return all(geo.contains(ring, x, y) for x, y in geo.domain_hull(list(self.domain)))

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        v = spark.createDataFrame([(i, float(x), float(y), bool(k)) for i, ((x, y), k) in enumerate(zip(self.xy, self.inner, strict=True))], "v int, x double, y double, inner boolean")
        t = spark.createDataFrame([(i, int(a), int(b), int(c)) for i, (a, b, c) in enumerate(self.tri)], "e int, v1 int, v2 int, v3 int")
        return v, t


def from_tables(vertex: DataFrame, triangle: DataFrame, domain=()) -> Mesh:
    v = sorted(vertex.select("v", "x", "y", "inner").collect())
    t = sorted(triangle.select("e", "v1", "v2", "v3").collect())
    number = {r.v: i for i, r in enumerate(v)}
    return Mesh(np.array([(r.x, r.y) for r in v]), np.array([[number[r.v1], number[r.v2], number[r.v3]] for r in t]), np.array([r.inner for r in v]), tuple(geo.as_polygons(list(domain)) if domain else ()))


def lattice(spark: SparkSession, box: tuple[float, float, float, float], nx: int, ny: int, domain=None) -> tuple[DataFrame, DataFrame]:
    """vertex and triangle tables of an nx x ny lattice over a box (x0, y0, x1, y1): two triangles a cell."""
    x0, y0, x1, y1 = box
    dx, dy = (x1 - x0) / (nx - 1), (y1 - y0) / (ny - 1)
    v = spark.range(nx * ny).select(F.col("id").cast("int").alias("v"), (F.lit(x0) + (F.col("id") % nx) * F.lit(dx)).alias("x"), (F.lit(y0) + F.floor(F.col("id") / nx) * F.lit(dy)).alias("y"))
    v = v.withColumn("inner", geo.covered(domain, F.col("x"), F.col("y")))
    c = spark.range((nx - 1) * (ny - 1)).select("id", (F.floor(F.col("id") / (nx - 1)) * nx + F.col("id") % (nx - 1)).alias("a"))
    lower = F.struct((2 * F.col("id")).alias("e"), F.col("a").alias("v1"), (F.col("a") + 1).alias("v2"), (F.col("a") + nx + 1).alias("v3"))
    upper = F.struct((2 * F.col("id") + 1).alias("e"), F.col("a").alias("v1"), (F.col("a") + nx + 1).alias("v2"), (F.col("a") + nx).alias("v3"))
    t = c.select(F.explode(F.array(lower, upper)).alias("t")).select(*[F.col(f"t.{k}").cast("int").alias(k) for k in ("e", "v1", "v2", "v3")])
    return v, t


def corners(vertex: DataFrame, triangle: DataFrame) -> DataFrame:
    """Triangles with their corner coordinates and area (e, v1.., x1, y1, .., area). The vertex table is joined three times;
    Spark broadcasts it while it is under its threshold."""
    out = triangle
    for k in (1, 2, 3):
        out = out.join(vertex.select(F.col("v").alias(f"v{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")), f"v{k}")
    area = 0.5 * ((F.col("x2") - F.col("x1")) * (F.col("y3") - F.col("y1")) - (F.col("x3") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    return out.withColumn("area", area)


def angles(vertex: DataFrame, triangle: DataFrame) -> DataFrame:
    """e, area and the three angles in degrees, by the law of cosines."""
    c = corners(vertex, triangle)
    side = {}
    for k, (i, j) in {1: (2, 3), 2: (1, 3), 3: (1, 2)}.items():
        dx, dy = F.col(f"x{i}") - F.col(f"x{j}"), F.col(f"y{i}") - F.col(f"y{j}")
        side[k] = dx * dx + dy * dy
    out = c.select("e", "area", *[side[k].alias(f"s{k}") for k in side])
    s1, s2, s3 = (F.col(f"s{k}") for k in (1, 2, 3))

    def angle(a, b, opposite):
        return F.degrees(F.acos((a + b - opposite) / (2 * F.sqrt(a * b))))

    return out.select("e", "area", angle(s2, s3, s1).alias("a1"), angle(s1, s3, s2).alias("a2"), angle(s1, s2, s3).alias("a3"))


def edge_table(triangle: DataFrame) -> DataFrame:
    """Distinct edges (u, w, n, boundary); n: triangles that share the edge."""
    pair = F.explode(F.array(*[F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("w")) for a, b in (("v1", "v2"), ("v2", "v3"), ("v3", "v1"))]))
    e = triangle.select(pair.alias("p")).groupBy("p.u", "p.w").agg(F.count("*").alias("n"))
    return e.withColumn("boundary", F.col("n") == 1)


def quality(vertex: DataFrame, triangle: DataFrame) -> DataFrame:
    """One row of mesh quality: counts, smallest angle and its quantiles, edge lengths, largest ratio of areas of
    neighbours, ratio of the largest to the smallest lumped mass."""
    a = angles(vertex, triangle)
    low = a.select(F.least("a1", "a2", "a3").alias("m"))
    ang = low.agg(F.min("m").alias("min_angle"), F.percentile("m", 0.05).alias("angle_q05"), F.percentile("m", 0.5).alias("angle_q50"))
    v1, v2 = (vertex.select(F.col("v").alias(k), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")) for k in ("u", "w"))
    length = edge_table(triangle).join(v1, "u").join(v2, "w").select(geo.euclid(F.col("xu"), F.col("yu"), F.col("xw"), F.col("yw")).alias("d"))
    edge = length.agg(F.count("*").alias("n_edges"), F.min("d").alias("edge_min"), F.avg("d").alias("edge_mean"), F.max("d").alias("edge_max"))
    sides = a.select("e", "area").join(triangle, "e").select("area", F.explode(F.array(*[F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("w")) for p, q in (("v1", "v2"), ("v2", "v3"), ("v3", "v1"))])).alias("s"))
    near = sides.groupBy("s.u", "s.w").agg(F.max("area").alias("hi"), F.min("area").alias("lo")).agg(F.max(F.col("hi") / F.col("lo")).alias("neighbour_ratio"))
    from geopanel.operators.fem import mass

    m = mass(vertex, triangle).agg((F.max("c") / F.min("c")).alias("mass_ratio"))
    n = vertex.agg(F.count("*").alias("n_vertices"), F.sum(F.col("inner").cast("int")).alias("n_inner"))
    t = triangle.agg(F.count("*").alias("n_triangles"))
    out = n
    for part in (t, ang, edge, near, m):
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out


# --- driver-side meshes ---------------------------------------------------------------------------------------------


def prune_low_degree(tri: np.ndarray, least: int) -> np.ndarray:
    """Drop triangles that touch a vertex of fewer than `least` triangles, until none is left."""
    while len(tri):
        n = np.bincount(tri.ravel())
        bad = (n[tri] < least).any(1)
        if not bad.any():
            break
        tri = tri[~bad]
    return tri


def _renumber(xy: np.ndarray, tri: np.ndarray, domain) -> Mesh:
    used = np.unique(tri)
    new = np.full(len(xy), -1)
    new[used] = np.arange(len(used))
    xy = xy[used]
    inner = _inside(xy, domain)
    return Mesh(xy, new[tri], inner, tuple(geo.as_polygons(domain)))


def _inside(xy: np.ndarray, domain, boundary: bool = True) -> np.ndarray:
    """Vectorised point in domain."""
    polys = geo.as_polygons(domain)
    if not polys:
        return np.ones(len(xy), bool)
    out = np.zeros(len(xy), bool)
    px, py = xy[:, 0], xy[:, 1]
    for p in polys:
        odd, edge = np.zeros(len(xy), bool), np.zeros(len(xy), bool)
        for x1, y1, x2, y2 in geo.edges(p):
            edge |= ((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1) == 0) & (px >= min(x1, x2)) & (px <= max(x1, x2)) & (py >= min(y1, y2)) & (py <= max(y1, y2))
            if y1 != y2:
                odd ^= ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)
        out |= (odd | edge) if boundary else (odd & ~edge)
    return out


def _dist_to_ring(xy: np.ndarray, ring) -> np.ndarray:
    """Distance to a closed ring's segments."""
    out = np.full(len(xy), np.inf)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
        d = np.array([x2 - x1, y2 - y1])
        len2 = float(d @ d) or 1.0
        t = np.clip(((xy - (x1, y1)) @ d) / len2, 0, 1)
        out = np.minimum(out, np.hypot(*(xy - ((x1, y1) + t[:, None] * d)).T))
    return out


def grid_mesh(domain, offset: float = 0.0, nx: int = 20, ny: int = 20, min_degree: int = 1) -> Mesh:
    """Lattice over the box of the domain's hull buffered by offset, without triangles whose centroid lies outside."""
    ring = geo.domain_hull(domain)
    r = np.array(ring)
    (x0, y0), (x1, y1) = r.min(0) - offset, r.max(0) + offset
    gx, gy = np.meshgrid(np.linspace(x0, x1, nx), np.linspace(y0, y1, ny))
    xy = np.stack([gx.ravel(), gy.ravel()], 1)
    a = (np.arange(ny - 1)[:, None] * nx + np.arange(nx - 1)).ravel()
    tri = np.concatenate([np.stack([a, a + 1, a + nx + 1], 1), np.stack([a, a + nx + 1, a + nx], 1)])
    mid = xy[tri].mean(1)
    keep = _inside(mid, [ring]) | (_dist_to_ring(mid, ring) <= offset)
    tri = prune_low_degree(tri[keep], min_degree)
    if not len(tri):
        raise ValueError("the lattice is too coarse for the domain")
    return _renumber(xy, tri, domain)


def grid_mesh_of_size(domain, n_inner: int, offset: float = 0.0, min_degree: int = 1, max_iter: int = 40, tol: float = 0.05) -> Mesh:
    """The lattice, by bisection of its spacing, whose inner vertices come nearest to n_inner."""
    r = np.array(geo.domain_hull(domain))
    w, h = r.max(0) - r.min(0) + 2 * offset
    lo, hi, best = 2, 4096, None
    for _ in range(max_iter):
        nx = (lo + hi) // 2
        ny = max(2, round(nx * h / w))
        try:
            m = grid_mesh(domain, offset, nx, ny, min_degree)
        except ValueError:
            lo = nx + 1
            continue
        if best is None or abs(m.n_inner - n_inner) < abs(best.n_inner - n_inner):
            best = m
        if m.n_inner == n_inner or lo >= hi:
            break
        lo, hi = (nx + 1, hi) if m.n_inner < n_inner else (lo, nx - 1)
        if lo > hi:
            break
    if best is None:
        raise ValueError("no lattice fits the domain")
    if abs(best.n_inner - n_inner) > tol * n_inner:
        warnings.warn(f"the nearest lattice has {best.n_inner} inner vertices, {n_inner} were asked for", stacklevel=2)
    return best


def delaunay(xy: np.ndarray) -> np.ndarray:
    """Delaunay triangles of points by insertion (Bowyer and Watson), counter-clockwise. Quadratic at worst: for meshes."""
    n = len(xy)
    mid, span = (xy.max(0) + xy.min(0)) / 2, float((xy.max(0) - xy.min(0)).max()) or 1.0
    far = mid + span * np.array([[-60.0, -35.0], [60.0, -35.0], [0.0, 70.0]])
    p = np.concatenate([xy, far])
    tri = np.array([[n, n + 1, n + 2]])

    def circle(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c = p[t[:, 0]], p[t[:, 1]], p[t[:, 2]]
        d = 2 * ((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0]))
        b2, c2 = ((b - a) ** 2).sum(1), ((c - a) ** 2).sum(1)
        ux = ((c[:, 1] - a[:, 1]) * b2 - (b[:, 1] - a[:, 1]) * c2) / d
        uy = ((b[:, 0] - a[:, 0]) * c2 - (c[:, 0] - a[:, 0]) * b2) / d
        return a + np.stack([ux, uy], 1), ux * ux + uy * uy

    centre, r2 = circle(tri)
    for i in np.random.default_rng(0).permutation(n):
        bad = ((p[i] - centre) ** 2).sum(1) < r2 * (1 + 1e-12)
        e = np.concatenate([tri[bad][:, [0, 1]], tri[bad][:, [1, 2]], tri[bad][:, [2, 0]]])
        key = np.sort(e, 1)
        _, at, count = np.unique(key, axis=0, return_index=True, return_counts=True)
        rim = e[at[count == 1]]
        new = np.column_stack([rim, np.full(len(rim), i)])
        a, b, c = p[new[:, 0]], p[new[:, 1]], p[new[:, 2]]
        new = new[(b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0]) > 1e-14 * span * span]
        nc, nr = circle(new)
        tri, centre, r2 = np.concatenate([tri[~bad], new]), np.concatenate([centre[~bad], nc]), np.concatenate([r2[~bad], nr])
    return tri[(tri < n).all(1)]


def density(points: np.ndarray, gx: np.ndarray, gy: np.ndarray, bandwidth: float | None = None, mask: np.ndarray | None = None) -> np.ndarray:
    """Gaussian kernel intensity on a grid, edge-corrected by the smoothed mask (Diggle); Scott bandwidth by default."""
    n = len(points)
    h = bandwidth or n ** (-1 / 6) * math.sqrt((points[:, 0].var() + points[:, 1].var()) / 2)
    count = np.zeros((len(gy), len(gx)))
    ix = np.clip(np.rint((points[:, 0] - gx[0]) / (gx[1] - gx[0])), 0, len(gx) - 1).astype(int)
    iy = np.clip(np.rint((points[:, 1] - gy[0]) / (gy[1] - gy[0])), 0, len(gy) - 1).astype(int)
    np.add.at(count, (iy, ix), 1)

    def smooth(z: np.ndarray) -> np.ndarray:
        for axis, g in ((0, gy), (1, gx)):
            k = np.exp(-0.5 * ((g[:, None] - g[None, :]) / h) ** 2)
            k /= k.sum(1).max()
            z = k @ z if axis == 0 else z @ k.T
        return z

    inside = np.ones_like(count) if mask is None else mask.astype(float)
    f = smooth(count) / np.maximum(smooth(inside), 0.05) * inside
    cell = (gx[1] - gx[0]) * (gy[1] - gy[0])
    total = f.sum() * cell
    return f / total if total else f


def gradient_limit(h: np.ndarray, dx: float, dy: float, slope: float) -> np.ndarray:
    """The largest field below h that changes by at most slope a unit of distance between the 8 neighbours: sweeps until
    nothing changes."""
    h = h.copy()
    moves = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    while True:
        old = h.copy()
        for i, j in moves:
            d = slope * math.hypot(i * dy, j * dx)
            src = h[max(0, -i) : h.shape[0] - max(0, i), max(0, -j) : h.shape[1] - max(0, j)]
            dst = h[max(0, i) : h.shape[0] - max(0, -i), max(0, j) : h.shape[1] - max(0, -j)]
            np.minimum(dst, src + d, out=dst)
        if np.array_equal(old, h, equal_nan=True):
            return h


def adaptive_mesh(points: np.ndarray, domain=None, n_inner: int = 100, eps: float = 0.3, gradation: float = 0.3, bandwidth: float | None = None, offset: float | None = None, grid: int = 96, tol: float = 0.1, max_iter: int = 12, seed: int = 0) -> Mesh:
    """Delaunay mesh whose vertices are denser where sites are, with about n_inner vertices inside the domain.

    The size field is (rho)^(-1/2) with rho = (1 - eps) intensity + eps / area, limited in slope; vertices are a greedy
    Poisson-disk sample of the field (densest first), and the field is rescaled until the count fits.
    """
    if not 0 < eps <= 1 or gradation <= 0 or n_inner < 3:
        raise ValueError("eps is in (0, 1], gradation positive, n_inner 3 or more")
    points = np.asarray(points, float)
    domain = domain if domain is not None else [geo.hull(map(tuple, points))]
    ring = geo.domain_hull(domain)
    r = np.array(ring)
    diag = float(np.hypot(*(r.max(0) - r.min(0))))
    offset = diag / 6 if offset is None else offset
    lo, hi = r.min(0) - offset, r.max(0) + offset
    gx, gy = np.linspace(lo[0], hi[0], grid), np.linspace(lo[1], hi[1], grid)
    xx, yy = np.meshgrid(gx, gy)
    cells = np.stack([xx.ravel(), yy.ravel()], 1)
    mask = _inside(cells, domain).reshape(xx.shape)
    dx, dy = gx[1] - gx[0], gy[1] - gy[0]
    area = mask.sum() * dx * dy
    rho = (1 - eps) * density(points, gx, gy, bandwidth, mask) + eps / area
    h0 = 1 / np.sqrt(rho)
    ring_d = _dist_to_ring(cells, ring).reshape(xx.shape)
    h0 = np.where(mask, h0, h0[mask].max() * (1 + ring_d / max(offset, 1e-9)))
    near = _inside(cells, [ring]).reshape(xx.shape) | (ring_d <= offset)
    rng = np.random.default_rng(seed)
    cand = rng.uniform(lo, hi, (min(60_000, 120 * n_inner + 4000), 2))
    jx = np.clip(np.rint((cand[:, 0] - gx[0]) / dx), 0, grid - 1).astype(int)
    jy = np.clip(np.rint((cand[:, 1] - gy[0]) / dy), 0, grid - 1).astype(int)
    ok = near[jy, jx]
    cand, jx, jy = cand[ok], jx[ok], jy[ok]
    kappa, best = 1.0 / math.sqrt(n_inner), None
    for _ in range(max_iter):
        size = gradient_limit(kappa * h0, dx, dy, gradation)[jy, jx]
        order = np.argsort(size, kind="stable")
        kept = _disk_sample(cand[order], size[order])
        xy = cand[order][kept]
        count = int(_inside(xy, domain).sum())
        if best is None or abs(count - n_inner) < abs(best[1] - n_inner):
            best = (xy, count)
        if abs(count - n_inner) <= tol * n_inner:
            break
        kappa *= math.sqrt(max(count, 1) / n_inner)
    xy, count = best
    if abs(count - n_inner) > tol * n_inner:
        warnings.warn(f"the mesh has {count} inner vertices, {n_inner} were asked for", stacklevel=2)
    frame = np.array([lo, (hi[0], lo[1]), hi, (lo[0], hi[1])])
    return _renumber(*_smooth(np.concatenate([xy, frame])), domain)


def _smooth(xy: np.ndarray, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Move inner points towards the mean of their neighbours and triangulate again: slivers go."""
    tri = delaunay(xy)
    for _ in range(rounds):
        e = np.sort(np.concatenate([tri[:, [0, 1]], tri[:, [1, 2]], tri[:, [2, 0]]]), axis=1)
        e, n = np.unique(e, axis=0, return_counts=True)
        rim = np.zeros(len(xy), bool)
        rim[e[n == 1].ravel()] = True
        total, degree = np.zeros_like(xy), np.zeros(len(xy))
        for a, b in ((0, 1), (1, 0)):
            np.add.at(total, e[:, a], xy[e[:, b]])
            np.add.at(degree, e[:, a], 1)
        xy = np.where(rim[:, None], xy, xy + 0.6 * (total / np.maximum(degree, 1)[:, None] - xy))
        tri = delaunay(xy)
    return xy, tri


def _disk_sample(xy: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Greedy: a point is kept if no kept point lies within 0.8 of its size."""
    kept: list[int] = []
    cell = float(size.min()) * 0.8 or 1.0
    buckets: dict[tuple[int, int], list[int]] = {}
    for i, (p, s) in enumerate(zip(xy, 0.8 * size, strict=True)):
        if kept:
            k = xy[kept] - p
            if len(kept) < 400:
                if (np.einsum("ij,ij->i", k, k) < s * s).any():
                    continue
            else:
                reach, c = int(s / cell) + 1, (int(p[0] // cell), int(p[1] // cell))
                near = [j for a in range(c[0] - reach, c[0] + reach + 1) for b in range(c[1] - reach, c[1] + reach + 1) for j in buckets.get((a, b), ())] if reach < 12 else kept
                if near and (((xy[near] - p) ** 2).sum(1) < s * s).any():
                    continue
        kept.append(i)
        buckets.setdefault((int(p[0] // cell), int(p[1] // cell)), []).append(i)
    return np.array(kept)


def search(spark: SparkSession, points: np.ndarray, domain, settings: list[dict]) -> DataFrame:
    """Build an adaptive mesh for every setting in parallel and report its quality; a failure is a row with a message."""
    import pandas as pd

    rows = [(i, float(s.get("n_inner", 100)), float(s.get("eps", 0.3)), float(s.get("gradation", 0.3))) for i, s in enumerate(settings)]
    table = spark.createDataFrame(rows, "setting int, n_inner double, eps double, gradation double").repartition(max(1, len(rows)))

    def run(frames):
        for f in frames:
            out = []
            for r in f.itertuples():
                base = (r.setting, r.n_inner, r.eps, r.gradation)
                try:
                    with warnings.catch_warnings():
                        warnings.simplefilter("ignore")
                        m = adaptive_mesh(points, domain, int(r.n_inner), r.eps, r.gradation)
                    a, b, c = (m.xy[m.tri[:, k]] for k in range(3))
                    sides = [np.hypot(*(p - q).T) for p, q in ((b, c), (a, c), (a, b))]
                    ang = [np.degrees(np.arccos(np.clip((q * q + s * s - p * p) / (2 * q * s), -1, 1))) for p, q, s in (sides, sides[1:] + sides[:1], sides[2:] + sides[:2])]
                    out.append((*base, "ok", "", len(m.xy), m.n_inner, float(np.min(ang)), float(np.quantile(np.min(ang, 0), 0.05))))
                except Exception as e:  # noqa: BLE001  the report is the point of the search
                    out.append((*base, "failed", str(e)[:200], 0, 0, float("nan"), float("nan")))
            yield pd.DataFrame(out, columns=["setting", "n_inner", "eps", "gradation", "status", "message", "n_vertices", "got_inner", "min_angle", "angle_q05"])

    return table.mapInPandas(run, "setting int, n_inner double, eps double, gradation double, status string, message string, n_vertices int, got_inner int, min_angle double, angle_q05 double")


def rank(found: DataFrame, least_angle: float = 10.0, tol: float = 0.15) -> DataFrame:
    """Suitable settings, best angles first."""
    fits = (F.col("status") == "ok") & (F.abs(F.col("got_inner") - F.col("n_inner")) <= tol * F.col("n_inner")) & (F.col("angle_q05") >= least_angle)
    return found.where(fits).orderBy(F.desc("angle_q05"), "setting")
