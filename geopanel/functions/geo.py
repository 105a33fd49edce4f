"""Planar and spherical geometry as column expressions and small driver-side helpers.

Polygons are given as lists of rings of (x, y) vertices, the first ring the shell, further rings holes. A polygon's
predicate is one expression over its edges, so that point filters stay inside code generation; tables of polygons are
joined by bounding box first (operators.areal).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Ring = Sequence[tuple[float, float]]
Polygon = Sequence[Ring]

EARTH_KM = 6371.0


def as_polygons(domain) -> list[Polygon]:
    """A flat list of polygons from a ring, a polygon (list of rings), or nested lists of them."""
    if domain is None:
        return []
    if _is_ring(domain):
        return [[_closed(domain)]]
    if isinstance(domain, (list, tuple)) and domain and all(_is_ring(r) for r in domain):
        return [[_closed(r) for r in domain]]
    if isinstance(domain, (list, tuple)) and domain:
        return [p for d in domain for p in as_polygons(d)]
    raise TypeError("a domain is a ring of (x, y) vertices, a list of rings, or a list of polygons")


def _is_ring(v) -> bool:
    return isinstance(v, (list, tuple)) and len(v) >= 3 and all(isinstance(p, (list, tuple)) and len(p) == 2 and all(isinstance(c, (int, float)) for c in p) for p in v)


def _closed(ring: Ring) -> list[tuple[float, float]]:
    out = [(float(x), float(y)) for x, y in ring]
    return out if out[0] == out[-1] else [*out, out[0]]


def edges(poly: Polygon) -> Iterable[tuple[float, float, float, float]]:
    for ring in poly:
        ring = _closed(ring)
        for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
            yield x1, y1, x2, y2


def crosses(px: Column, py: Column, x1, y1, x2, y2) -> Column:
    """1 where a ray to the right crosses the edge, else 0. Coordinates may be columns or numbers."""
    x1, y1, x2, y2 = (v if isinstance(v, Column) else F.lit(float(v)) for v in (x1, y1, x2, y2))
    span = F.when(y2 != y1, y2 - y1)
    hit = ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / span + x1)
    return F.when(hit, 1).otherwise(0)


def on_edge(px: Column, py: Column, x1, y1, x2, y2) -> Column:
    """True where the point lies on the closed edge."""
    x1, y1, x2, y2 = (v if isinstance(v, Column) else F.lit(float(v)) for v in (x1, y1, x2, y2))
    flat = (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1) == 0
    return flat & px.between(F.least(x1, x2), F.greatest(x1, x2)) & py.between(F.least(y1, y2), F.greatest(y1, y2))


def inside(poly: Polygon, px: Column, py: Column, boundary: bool = True) -> Column:
    """Whether a point is in a polygon; points on its boundary count as boundary says."""
    es = list(edges(poly))
    xs, ys = [e[0] for e in es], [e[1] for e in es]
    box = px.between(min(xs), max(xs)) & py.between(min(ys), max(ys))
    odd = reduce(lambda a, b: a + b, [crosses(px, py, *e) for e in es]) % 2 == 1
    edge = reduce(lambda a, b: a | b, [on_edge(px, py, *e) for e in es])
    return box & ((odd | edge) if boundary else (odd & ~edge))


def covered(domain, px: Column, py: Column, boundary: bool = True) -> Column:
    """Whether any single polygon of a domain holds the point; no domain holds every point."""
    polys = as_polygons(domain)
    return reduce(lambda a, b: a | b, [inside(p, px, py, boundary) for p in polys]) if polys else F.lit(True)


def hull(points: Iterable[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull, counter-clockwise and closed (Andrew's monotone chain)."""
    pts = sorted(set((float(x), float(y)) for x, y in points))
    if len(pts) < 3:
        return [*pts, *pts[:1]]

    def half(seq):
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(pts) + half(reversed(pts))
    return [*ring, ring[0]]


def domain_hull(domain) -> list[tuple[float, float]]:
    return hull(p for poly in as_polygons(domain) for ring in poly for p in ring)


def contains(ring: Ring, x: float, y: float, boundary: bool = True) -> bool:
    """The driver-side twin of inside() for one ring."""
    ring, odd = _closed(ring), False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
        if (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return boundary
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def area_centroid(poly: Polygon) -> tuple[float, float, float]:
    """(area, x, y) by the shoelace formula; holes subtract."""
    total = cx = cy = 0.0
    for k, ring in enumerate(poly):
        ring = _closed(ring)
        a = sx = sy = 0.0
        for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
            w = x1 * y2 - x2 * y1
            a, sx, sy = a + w / 2, sx + (x1 + x2) * w / 6, sy + (y1 + y2) * w / 6
        sign = (1 if a > 0 else -1) * (1 if k == 0 else -1)
        total, cx, cy = total + sign * a, cx + sign * sx, cy + sign * sy
    return (total, cx / total, cy / total) if total else (0.0, float("nan"), float("nan"))


def euclid(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_KM) -> Column:
    """Haversine distance of points in degrees."""
    a = F.sin(F.radians(lat2 - lat1) / 2)
    b = F.sin(F.radians(lon2 - lon1) / 2)
    s = a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), s)))


#: Fixed values of WGS84.
_A, _FLAT, _K0 = 6378137.0, 1 / 298.257223563, 0.9996


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:4326 degrees to EPSG:3857 metres."""
    return F.radians(lon) * _A, _A * F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def from_web_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / _A), F.degrees(2 * F.atan(F.exp(y / _A)) - F.lit(math.pi / 2))


def utm(lon: Column, lat: Column, zone: int, north: bool = True) -> tuple[Column, Column]:
    """WGS84 degrees to UTM metres by the Krueger series to the third order (below a millimetre within a zone)."""
    n = _FLAT / (2 - _FLAT)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north_ = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north_ = north_ + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + _K0 * radius * east, (0 if north else 10000000) + _K0 * radius * north_


def from_utm(x: Column, y: Column, zone: int, north: bool = True) -> tuple[Column, Column]:
    """UTM metres to WGS84 degrees, the inverse of utm() by series to the third order."""
    n = _FLAT / (2 - _FLAT)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi = (y - (0 if north else 10000000)) / (_K0 * radius)
    eta = (x - 500000) / (_K0 * radius)
    a, b = xi, eta
    for j, c in enumerate(beta, 1):
        a = a - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    lat = chi
    for j, c in enumerate(delta, 1):
        lat = lat + c * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(b), F.cos(a))) + (zone * 6 - 183), F.degrees(lat)


def _epsg(crs: str) -> int:
    code = str(crs).upper().removeprefix("EPSG:")
    known = code.isdigit() and (int(code) in (4326, 3857) or int(code) // 100 in (326, 327) and 1 <= int(code) % 100 <= 60)
    if not known:
        raise ValueError(f"cannot reproject {crs!r}; known are EPSG:4326, EPSG:3857 and the UTM zones EPSG:326zz and EPSG:327zz")
    return int(code)


def reproject(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column]:
    """Coordinates of one system as those of another, by way of degrees."""
    a, b = _epsg(source), _epsg(target)
    if a == b:
        return x, y
    lon, lat = (x, y) if a == 4326 else from_web_mercator(x, y) if a == 3857 else from_utm(x, y, a % 100, a // 100 == 326)
    return (lon, lat) if b == 4326 else web_mercator(lon, lat) if b == 3857 else utm(lon, lat, b % 100, b // 100 == 326)


def centroid(rings: Column) -> tuple[Column, Column]:
    """Planar centroid of a column of polygons, array<array<struct<x, y>>>: the outer ring, then holes, which subtract."""

    def sums(ring: Column) -> Column:
        """(area, x moment, y moment) of one ring, with the sign of its orientation."""
        pairs = F.zip_with(ring, F.concat(F.slice(ring, 2, 1 << 30), F.slice(ring, 1, 1)), lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))
        zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

        def add(s: Column, e: Column) -> Column:
            w = e["x1"] * e["y2"] - e["x2"] * e["y1"]
            return F.struct((s["a"] + w / 2).alias("a"), (s["x"] + (e["x1"] + e["x2"]) * w / 6).alias("x"), (s["y"] + (e["y1"] + e["y2"]) * w / 6).alias("y"))

        return F.aggregate(pairs, zero, add)

    signed = F.transform(rings, lambda r, k: F.struct(sums(r).alias("s"), F.when(k == 0, 1.0).otherwise(-1.0).alias("k")))
    each = F.transform(signed, lambda v: F.struct((F.signum(v["s"]["a"]) * v["k"] * v["s"]["a"]).alias("a"), (F.signum(v["s"]["a"]) * v["k"] * v["s"]["x"]).alias("x"), (F.signum(v["s"]["a"]) * v["k"] * v["s"]["y"]).alias("y")))

    def total(part: str) -> Column:
        return F.aggregate(each, F.lit(0.0), lambda t, v: t + v[part])

    return F.try_divide(total("x"), total("a")), F.try_divide(total("y"), total("a"))
