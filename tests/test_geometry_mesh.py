import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geopanel.functions import geo, special
from geopanel.operators import areal, fem, mesh, spde

SQUARE = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]]
HOLED = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0)]]


def points(spark, pts):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "site_id long, x double, y double")


def test_boundary_rules(spark):
    df = points(spark, [(5, 1), (0, 5), (10, 10), (5, 5), (4, 5), (11, 5)])
    x, y = F.col("x"), F.col("y")
    assert [r[0] for r in df.orderBy("site_id").select(geo.covered([HOLED], x, y)).collect()] == [True, True, True, False, True, False]
    assert [r[0] for r in df.orderBy("site_id").select(geo.covered([HOLED], x, y, False)).collect()] == [True, False, False, False, False, False]
    two = areal.points_in_polygons(df, [SQUARE, [[(10.0, 0.0), (20.0, 0.0), (20.0, 10.0), (10.0, 10.0)]]])
    assert sorted((r.site_id, r.poly_id) for r in two.collect()) == [(0, 0), (1, 0), (2, 0), (2, 1), (3, 0), (4, 0), (5, 1)]


def test_domains_and_hulls():
    assert len(geo.as_polygons([SQUARE, [HOLED]])) == 2
    with pytest.raises(TypeError):
        geo.as_polygons("square")
    ring = geo.hull([(0, 0), (1, 0), (1, 1), (0, 1), (0.5, 0.5)])
    assert len(ring) == 5 and geo.contains(ring, 0.5, 0.5) and not geo.contains(ring, 2, 0)
    a, x, y = geo.area_centroid(HOLED)
    assert (a, x, y) == pytest.approx((96.0, 5.0, 5.0))


def test_projections(spark):
    df = spark.createDataFrame([(9.19, 45.4642), (12.5, 41.9)], "lon double, lat double")
    x, y = geo.web_mercator(F.col("lon"), F.col("lat"))
    lon, lat = geo.from_web_mercator(x, y)
    e, n = geo.utm(F.col("lon"), F.col("lat"), 32)
    r = df.select(lon.alias("lon"), lat.alias("lat"), e.alias("e"), n.alias("n"), F.col("lon").alias("a"), F.col("lat").alias("b")).first()
    assert r.lon == pytest.approx(r.a, abs=1e-9) and r.lat == pytest.approx(r.b, abs=1e-9)
    assert 514_000 < r.e < 516_000 and 5_034_000 < r.n < 5_036_000
    mid = spark.createDataFrame([(9.0, 0.0)], "lon double, lat double").select(*geo.utm(F.col("lon"), F.col("lat"), 32)).first()
    assert mid[0] == pytest.approx(500000, abs=1e-6) and mid[1] == pytest.approx(0, abs=1e-6)


def test_special_functions():
    assert special.bessel_k1(1.0) == pytest.approx(0.6019072302, abs=1e-7)
    assert special.bessel_k1(5.0) == pytest.approx(0.0040446134, abs=1e-8)
    assert special.t_quantile(0.975, 10) == pytest.approx(2.2281388520, abs=1e-8)
    assert special.t_tail(2.0, 5) == pytest.approx(0.1019394834, abs=1e-8)
    assert special.t_quantile(0.025, 1e7) == pytest.approx(-1.959964, abs=1e-5)


@pytest.fixture(scope="module")
def lattice(spark):
    v, t = mesh.lattice(spark, (-3.0, -3.0, 13.0, 13.0), 9, 7, SQUARE)
    return v.cache(), t.cache()


def test_element_identities(spark, lattice):
    v, t = lattice
    assert fem.mass(v, t).agg(F.sum("c")).first()[0] == pytest.approx(256)
    g = fem.stiffness(v, t)
    assert g.groupBy("i").agg(F.sum("g").alias("s")).agg(F.max(F.abs("s"))).first()[0] < 1e-10
    assert fem.energy(v.withColumn("u", 2 * F.col("x") - 3 * F.col("y")), t, "u").first()[0] == pytest.approx(13 * 256)


def test_basis_reproduces_linear_functions(spark, lattice):
    v, t = lattice
    pts = points(spark, [(0.3, 0.7), (5, 5), (-3, -3), (13, 13), (1, 1), (20, 0)])
    b = fem.basis(pts, v, t)
    s = b.join(v, "v").groupBy("site_id").agg(F.sum("h").alias("one"), F.sum(F.col("h") * F.col("x")).alias("px"), F.sum(F.col("h") * F.col("y")).alias("py")).join(pts, "site_id").collect()
    assert len(s) == 5 and all(r.one == pytest.approx(1) and r.px == pytest.approx(r.x) and r.py == pytest.approx(r.y) for r in s)
    lat = fem.latent_basis(b, v).groupBy("site_id").agg(F.sum("h").alias("one")).collect()
    assert all(r.one == pytest.approx(1) for r in lat) and {r.site_id for r in lat} == {0, 1, 4}


def test_precision_and_schur(spark):
    m = mesh.grid_mesh([SQUARE], 2.0, 7, 7)
    s = spde.Spde.of(m)
    v, t, c, g = s.tables(spark)
    q = s.precision(0.7)
    for r in spde.precision(c, g, 0.7).collect():
        assert r.q == pytest.approx(q[r.i, r.j], abs=1e-10)
    low, d = s.marginal(0.7, gradient=True)
    i = np.flatnonzero(m.inner)
    assert np.allclose(np.linalg.inv(low), np.linalg.inv(q)[np.ix_(i, i)])
    e = 1e-6
    assert np.allclose(d, (s.marginal(0.7 + e) - s.marginal(0.7 - e)) / (2 * e), rtol=1e-5, atol=1e-6)
    with pytest.raises(ValueError):
        spde.Spde.of(m, nu=0.5)


def test_matern(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (4.0,)], "d double").select(spde.correlation(F.col("d"), 0.9).alias("r"))
    want = [1.0, 0.9 * special.bessel_k1(0.9), 3.6 * special.bessel_k1(3.6)]
    assert [r.r for r in df.collect()] == pytest.approx(want)


def test_grid_meshes():
    m = mesh.grid_mesh([SQUARE], 1.0, 10, 10)
    a, b, c = (m.xy[m.tri[:, k]] for k in range(3))
    area = 0.5 * ((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (c[:, 0] - a[:, 0]) * (b[:, 1] - a[:, 1]))
    assert (area > 0).all() and area.sum() == pytest.approx(144)
    assert m.covers_domain() and m.box == (-1.0, -1.0, 11.0, 11.0)
    e, rim = m.edges()
    assert rim.sum() == 36 and len(e) - len(m.tri) - len(m.xy) == -1
    n = mesh.grid_mesh_of_size([SQUARE], 64)
    assert n.n_inner == 64
    assert not mesh.prune_low_degree(np.array([[0, 1, 2]]), 2).size


def test_adaptive_mesh_is_denser_where_sites_are():
    rng = np.random.default_rng(0)
    pts = np.concatenate([rng.uniform(0.5, 4.5, (60, 2)), rng.uniform(0.5, 9.5, (40, 2))])
    m = mesh.adaptive_mesh(pts, [SQUARE], 80)
    assert abs(m.n_inner - 80) <= 12 and m.covers_domain()
    a, b, c = (m.xy[m.tri[:, k]] for k in range(3))
    area = 0.5 * ((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (c[:, 0] - a[:, 0]) * (b[:, 1] - a[:, 1]))
    assert (area > 0).all()
    dense = ((m.inner_points < 5).all(1)).mean()
    assert dense > 0.3
    hull = np.array(geo.hull(map(tuple, m.xy)))
    x, y = hull[:, 0], hull[:, 1]
    assert area.sum() == pytest.approx(abs((x[:-1] * y[1:] - x[1:] * y[:-1]).sum()) / 2, rel=1e-6)


def test_gradient_limit():
    h = np.full((20, 20), 10.0)
    h[5, 5] = 1.0
    out = mesh.gradient_limit(h, 1.0, 1.0, 0.5)
    assert out[5, 6] == pytest.approx(1.5) and out[6, 6] == pytest.approx(1 + 0.5 * math.sqrt(2)) and (out <= h).all()


def test_quality_and_search(spark, lattice):
    q = mesh.quality(*lattice).first()
    assert q.n_vertices == 63 and q.n_triangles == 96 and q.n_edges == 158 and q.min_angle == pytest.approx(math.degrees(math.atan(2 / (16 / 6))))
    found = mesh.search(spark, np.random.default_rng(0).uniform(0, 10, (40, 2)), [SQUARE], [{"n_inner": 30}, {"n_inner": 30, "eps": float("nan")}])
    rows = {r.setting: r for r in found.collect()}
    assert rows[0].status == "ok" and rows[1].status in ("ok", "failed")
    assert mesh.rank(found, 5.0).count() >= 1


def test_areal_means_and_delta(spark):
    df = points(spark, [(1, 1), (2, 2), (15, 15)]).withColumn("mean", F.col("x") * 1.0)
    r = areal.areal_mean(df, [SQUARE], ["s"]).first()
    assert (r.n_points, r["mean"], r.name) == (2, 1.5, "s")
    m = F.lit(0.3)
    for g, (h, h1, h2) in areal.BACK.items():
        e = 1e-4
        row = df.limit(1).select(h(m - e).alias("a"), h(m).alias("b"), h(m + e).alias("c"), h1(m).alias("d1"), h2(m).alias("d2")).first()
        assert row.d1 == pytest.approx((row.c - row.a) / (2 * e), abs=1e-6), g
        assert row.d2 == pytest.approx((row.c - 2 * row.b + row.a) / e**2, abs=1e-5), g
