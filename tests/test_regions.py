import json
import math
import random

import pytest
from pyspark.sql import functions as F

from geopanel.functions import geo
from geopanel.operators import areal
from geopanel.operators.regions import Regions
from geopanel.sources import geotext

SQUARE = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (1.0, 3.0), (3.0, 3.0), (3.0, 1.0)]]


def star(rnd, n, cx, cy, r):
    turns = sorted(rnd.uniform(0, 2 * math.pi) for _ in range(n))
    return [[(cx + r * rnd.uniform(0.4, 1) * math.cos(t), cy + r * rnd.uniform(0.4, 1) * math.sin(t)) for t in turns]]


def wkt(*polys):
    body = ", ".join("(" + ", ".join("(" + ", ".join(f"{x!r} {y!r}" for x, y in [*ring, ring[0]]) + ")" for ring in poly) + ")" for poly in polys)
    return f"MULTIPOLYGON ({body})"


def table(spark, polys):
    """polys: lists of polygons, by poly_id."""
    df = spark.createDataFrame([(k, f"p{k}", wkt(*p)) for k, p in enumerate(polys)], "poly_id int, name string, wkt string")
    return geotext.parse_polygons(df, "wkt").drop("wkt")


def inside(poly, x, y, boundary):
    odd = False
    for x1, y1, x2, y2 in geo.edges(poly):
        if (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return boundary
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def compare(spark, polys, points, boundary, edges):
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id int, x double, y double")
    got = sorted((r.id, r.poly_id) for r in Regions.of(table(spark, polys), edges).join(df, boundary).collect())
    want = sorted((i, k) for i, (x, y) in enumerate(points) for k, parts in enumerate(polys) if any(inside(p, x, y, boundary) for p in parts))
    assert got == want


@pytest.mark.parametrize("boundary", [True, False])
def test_both_boundary_rules_on_lattice_points(spark, boundary):
    polys = [[SQUARE], [SQUARE, [[(4.0, 4.0), (6.0, 4.0), (6.0, 6.0)]], [[(4.0, 0.0), (8.0, 0.0), (8.0, 4.0), (4.0, 4.0)]]], [[[(-2.0, 1.0), (9.0, 1.0), (3.0, 2.0)]]]]
    points = [(x / 2, y / 2) for x in range(-5, 20) for y in range(-2, 14)]
    for edges in (3, 16):
        compare(spark, polys, points, boundary, edges)


def test_many_edges_are_split(spark):
    rnd = random.Random(3)
    polys = [[star(rnd, 600, 500_000.0, 4_000_000.0, 100.0)], [star(rnd, 5, 500_050.0, 4_000_020.0, 300.0)], [star(rnd, 40, 500_000.0, 4_000_000.0, 0.5)]]
    points = [(500_000 + rnd.uniform(-200, 200), 4_000_000 + rnd.uniform(-200, 200)) for _ in range(1500)]
    points += [v for p in polys for poly in p for v in poly[0]][:300]
    compare(spark, polys, points, True, 16)
    cells = Regions.of(table(spark, polys)).cells
    assert cells.where("full").count() > 50  # accepted without edge tests
    assert cells.where("NOT full").select(F.max(F.expr("aggregate(parts, 0, (a, p) -> a + size(p.edges))"))).first()[0] <= 40


def test_a_row_of_many_polygons_and_points_that_share_places(spark):
    rnd = random.Random(6)

    def frame(x, y, h):
        return [[(x - k, y - k), (x + k, y - k), (x + k, y + k), (x - k, y + k)] for k in (h, h / 2)]

    row = [frame(rnd.randint(0, 80) / 8, rnd.randint(0, 80) / 8, rnd.choice([0.75, 1.0, 1.5])) for _ in range(120)]
    points = [(rnd.randint(-20, 100) / 8, rnd.randint(-20, 100) / 8) for _ in range(150)]
    df = spark.createDataFrame([(i, k, *p) for i, p in enumerate(points) for k in range(3)], "id int, k int, x double, y double")
    regions = Regions.of(table(spark, [row]), first=10, within=(-2.5, 12.5, -2.5, 12.5))
    for boundary in (True, False):
        want = sorted((i, k) for i, p in enumerate(points) if any(inside(q, *p, boundary) for q in row) for k in range(3))
        assert sorted((r.id, r.k) for r in regions.join(df, boundary).collect()) == want
    # Cells wholly inside stand for all the row's polygons there, not for one of them.
    assert regions.cells.where("full").groupBy("level", "cx", "cy").count().where("count > 2").isEmpty()
    tested = regions.cells.where("NOT full").agg(F.sum(F.expr("aggregate(parts, 0, (a, p) -> a + size(p.edges))"))).first()[0]
    assert tested < 16 * regions.rows


def test_thousands_of_polygons(spark):
    rnd = random.Random(4)
    polys = [[star(rnd, rnd.randint(3, 12), rnd.uniform(0, 100), rnd.uniform(0, 100), rnd.choice([0.2, 1, 8]))] for _ in range(3000)]
    compare(spark, polys, [(rnd.uniform(-5, 105), rnd.uniform(-5, 105)) for _ in range(200)], True, 16)


def test_tables_without_polygons(spark):
    empty = table(spark, []).where("false")
    points = spark.createDataFrame([(1.0, 1.0), (None, 1.0)], "x double, y double")
    assert Regions.of(empty) is None
    assert areal.points_in_polygons(points, empty).count() == 0
    assert areal.points_in_polygons(points, table(spark, [[[[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0)]]]])).count() == 1


GOOD = {
    "POLYGON ((0 0, 1 0, 1 1, 0 0))": 1,
    "polygon((0 0,1 0,1 1))": 1,
    "SRID=4326;MULTIPOLYGON Z (((0 0 5, +1 .5 5, 1. 1e1 5)), ((-2 -2 0, -3 -2 0, -3 -3.25E-1 0), (0 0 1, 1 0 1, 1 1 1)))": 2,
    " MultiPolygon  empty ": 0,
    "POLYGON EMPTY": 0,
}
BAD = [None, "", "POINT (1 1)", "POLYGON ((0 0, 1 0))", "POLYGON ((0 0, 1 1, x 2))", "POLYGON ((0 0, 1 0, 1 1)", "POLYGON (0 0, 1 0, 1 1)", "POLYGON ((0 0, 1, 1 1, 2 2))", "POLYGON ((0 0, 1 0, 1 1)) tail", "POLYGON [[[0,0],[1,0],[1,1]]]", "POLYGON ((0 0, 0 0, 0 0, 0 0))", "MULTIPOLYGON ((0 0, 1 0, 1 1))"]


def test_wkt(spark):
    df = spark.createDataFrame([(t,) for t in [*GOOD, *BAD]], "t string")
    got = {r.t: r.geom for r in geotext.parse_polygons(df, "t").collect()}
    assert {t: len(got[t]) for t in GOOD if got[t] is not None} == GOOD
    assert [t for t in BAD if got[t] is not None] == []
    third = got[list(GOOD)[2]]
    assert [tuple(p) for p in third[0][0]] == [(0.0, 0.0), (1.0, 0.5), (1.0, 10.0)] and tuple(third[1][0][2]) == (-3.0, -0.325)
    assert geotext.parse_report(df, "t").first().asDict() == {"n": 17, "n_null": 1, "n_bad": 11, "n_empty": 2, "n_polygons": 4}


def test_geojson(spark):
    ring = [[0, 0], [1.5, 0], [1, 1], [0, 0]]
    good = [{"type": "Polygon", "coordinates": [ring]}, {"type": "MultiPolygon", "coordinates": [[ring], [ring, ring]]}, {"type": "Feature", "properties": {"a": [1]}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"type": "Polygon", "coordinates": []}]
    bad = ['{"type": "Polygon"', '{"type": "Point", "coordinates": [1, 2]}', "[]", '{"type": "Polygon", "coordinates": [[[0, 0], [1, "x"], [1, 1]]]}', '{"type": "Feature", "geometry": null}', "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([json.dumps(g) for g in good] + bad)], "i int, t string")
    got = [r.geom for r in geotext.parse_polygons(df, "t", "geojson").orderBy("i").collect()]
    assert [len(g) for g in got[:4]] == [1, 2, 1, 0] and got[4:] == [None] * len(bad)


def test_round_trips(spark):
    rnd = random.Random(5)
    polys = [[star(rnd, 5_000, 0.0, 0.0, 1e7)], [SQUARE, star(rnd, 7, 1e-3, 1e9, 1e-4)], []]
    base = table(spark, polys[:2]).select("poly_id", "geom")
    for to, back in ((geotext.to_wkt, geotext.from_wkt), (geotext.to_geojson, geotext.from_geojson)):
        rows = base.withColumn("again", back(to(F.col("geom")))).collect()
        assert all(r.again == r.geom for r in rows)


def test_polygons_of_another_system(spark):
    lon_lat = spark.createDataFrame([("POLYGON ((9 45, 9.5 45, 9.5 45.5))",)], "t string").select(geotext.from_wkt(F.col("t")).alias("g"))
    there = lon_lat.select(geotext.reproject_polygons(F.col("g"), "EPSG:4326", "EPSG:32632").alias("g"))
    first = there.first().g[0][0][0]
    assert (first.x, first.y) == (pytest.approx(500_000, abs=1), pytest.approx(4_982_950, abs=2))
    back = there.select(geotext.reproject_polygons(F.col("g"), "EPSG:32632", "EPSG:4326").alias("g")).first().g
    assert [(pytest.approx(p.x, abs=1e-7), pytest.approx(p.y, abs=1e-7)) for p in back[0][0]] == [(9, 45), (9.5, 45), (9.5, 45.5)]


def test_means_of_points_that_share_places(spark):
    values = [(1.0, 1.0, 0, 2.0), (1.0, 1.0, 0, None), (1.0, 1.0, 0, 4.0), (2.0, 1.0, 0, 9.0), (1.0, 1.0, 1, None), (9.0, 9.0, 1, 1.0)]
    df = spark.createDataFrame(values, "x double, y double, t int, v double")
    got = areal.areal_mean(df, [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)]], ["a"], ["t"], "v")
    assert sorted(tuple(r) for r in got.collect()) == [(0, 0, "a", 4, 5.0), (1, 0, "a", 1, None)]
