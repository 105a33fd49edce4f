"""Queries of point searches, polygon tables and grids over the bundled tables, with DuckDB SQL of the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geopanel.operators import areal, eliminate, fem, field, near, spde
from geopanel.plans.ordering import numbered, with_previous
from geopanel.queries import _LATTICE_SQL, _lattice, r6
from geopanel.sources import geotext, sql
from geopanel.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(text: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = text
        return f

    return add


# --- nearest points and points within a radius -------------------------------------------------------------------------

_SHOPS_SQL = "shops AS (SELECT s_suppkey AS shop, s_nationkey AS nation, s_acctbal AS acctbal, ((37 * s_suppkey) % 101) / 10.0 AS x, ((53 * s_suppkey) % 97) / 10.0 AS y FROM supplier)"
_APART = "sqrt((s.x - v.x) * (s.x - v.x) + (s.y - v.y) * (s.y - v.y))"


def _sites(spark: SparkSession, d: str) -> DataFrame:
    return T.sites_events(spark, d).withColumnRenamed("site", "id")


def _shops(spark: SparkSession, d: str) -> DataFrame:
    x, y = T.place(F.col("s_suppkey"))
    return T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), "s_acctbal", x.alias("x"), y.alias("y"))


@query(f"WITH {T.SITES_SQL}, {_LATTICE_SQL} SELECT s.site, v.v::INT AS node, round({_APART}, 6) AS d FROM sites s CROSS JOIN v QUALIFY row_number() OVER (PARTITION BY s.site ORDER BY {_APART}, v.v) = 1")
def site_nearest_node(spark: SparkSession, d: str) -> DataFrame:
    got = near.nearest(_sites(spark, d), _lattice(spark)[0].withColumnRenamed("v", "id"))
    return got.select(F.col("left_id").alias("site"), F.col("right_id").alias("node"), r6(F.col("d"), "d"))


@query(f"WITH {T.SITES_SQL}, {_SHOPS_SQL} SELECT s.site, CAST(row_number() OVER (PARTITION BY s.site ORDER BY {_APART}, shop) AS INT) AS rank, shop, round({_APART}, 6) AS d FROM sites s CROSS JOIN shops v QUALIFY rank <= 5")
def site_nearest_suppliers(spark: SparkSession, d: str) -> DataFrame:
    got = near.nearest(_sites(spark, d), _shops(spark, d), 5)
    return got.select(F.col("left_id").alias("site"), "rank", F.col("right_id").alias("shop"), r6(F.col("d"), "d"))


@query(f"WITH {T.SITES_SQL}, {_SHOPS_SQL} SELECT s.site, shop, round({_APART}, 6) AS d FROM sites s JOIN shops v ON {_APART} <= 0.75")
def sites_within_radius(spark: SparkSession, d: str) -> DataFrame:
    got = near.within(_sites(spark, d), _shops(spark, d), 0.75)
    return got.select(F.col("left_id").alias("site"), F.col("right_id").alias("shop"), r6(F.col("d"), "d"))


@query(f"WITH {_SHOPS_SQL}, p AS (SELECT shop, x * 2 - 6 AS x, y * 2 - 6 AS y FROM shops) SELECT count(*) AS n, count(*) FILTER (x BETWEEN -3 AND 13 AND y BETWEEN -3 AND 13) AS found, count(*) FILTER (NOT (x BETWEEN -3 AND 13 AND y BETWEEN -3 AND 13)) AS not_found FROM p")
def basis_found(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers, spread beyond the lattice, that lie in one of its triangles."""
    points = _shops(spark, d).select("id", (F.col("x") * 2 - 6).alias("x"), (F.col("y") * 2 - 6).alias("y"))
    return fem.found(points, fem.basis(points, *_lattice(spark), site="id"), "id")


# --- polygons from text columns ----------------------------------------------------------------------------------------

#: A supplier's region is a square frame around it: half its width, and half that of its hole.
_HALF_SQL = "(0.75 + 0.25 * (shop % 4))"
_FRAME_SQL = f"(s.x BETWEEN v.x - {_HALF_SQL} AND v.x + {_HALF_SQL} AND s.y BETWEEN v.y - {_HALF_SQL} AND v.y + {_HALF_SQL} AND NOT (s.x > v.x - {_HALF_SQL} / 2 AND s.x < v.x + {_HALF_SQL} / 2 AND s.y > v.y - {_HALF_SQL} / 2 AND s.y < v.y + {_HALF_SQL} / 2))"
_OPEN_SQL = f"(s.x > v.x - {_HALF_SQL} AND s.x < v.x + {_HALF_SQL} AND s.y > v.y - {_HALF_SQL} AND s.y < v.y + {_HALF_SQL} AND NOT (s.x BETWEEN v.x - {_HALF_SQL} / 2 AND v.x + {_HALF_SQL} / 2 AND s.y BETWEEN v.y - {_HALF_SQL} / 2 AND v.y + {_HALF_SQL} / 2))"


def _frames(spark: SparkSession, d: str, fmt: str) -> DataFrame:
    """(nation, text): the frames of a nation's suppliers as one multipolygon."""
    half = 0.75 + 0.25 * (F.col("id") % 4)

    def ring(h):
        xs, ys = (F.col("x") - h, F.col("x") + h), (F.col("y") - h, F.col("y") + h)
        corners = [(xs[i], ys[j]) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]
        if fmt == "wkt":
            return F.concat(F.lit("("), F.concat_ws(", ", *[F.concat_ws(" ", a, b) for a, b in corners]), F.lit(")"))
        return F.concat(F.lit("["), F.concat_ws(",", *[F.concat(F.lit("["), a, F.lit(","), b, F.lit("]")) for a, b in corners]), F.lit("]"))

    shops = _shops(spark, d).select("nation", F.concat_ws(",", ring(half), ring(half / 2)).alias("rings"))
    if fmt == "wkt":
        return shops.groupBy("nation").agg(F.concat(F.lit("MULTIPOLYGON ("), F.array_join(F.transform(F.collect_list("rings"), lambda r: F.concat(F.lit("("), r, F.lit(")"))), ","), F.lit(")")).alias("text"))
    body = F.array_join(F.transform(F.collect_list("rings"), lambda r: F.concat(F.lit("["), r, F.lit("]"))), ",")
    return shops.groupBy("nation").agg(F.concat(F.lit('{"type":"Feature","properties":{},"geometry":{"type":"MultiPolygon","coordinates":['), body, F.lit("]}}")).alias("text"))


def _nations(spark: SparkSession, d: str, fmt: str) -> DataFrame:
    names = T.table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"))
    # A few long texts, which Spark would put into one task.
    texts = _frames(spark, d, fmt).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    polygons = geotext.parse_polygons(texts, "text", fmt).join(F.broadcast(names), "nation")
    return polygons.select(F.col("nation").alias("poly_id"), "name", "geom")


def _in_nations_sql(rule: str) -> str:
    return f"SELECT DISTINCT s.site, nation AS poly_id, n_name AS name FROM sites s JOIN shops v ON {rule} JOIN nation ON n_nationkey = nation"


@query(f"WITH {T.SITES_SQL}, {_SHOPS_SQL} {_in_nations_sql(_FRAME_SQL)}")
def sites_in_wkt_polygons(spark: SparkSession, d: str) -> DataFrame:
    return areal.points_in_polygons(T.sites_events(spark, d), _nations(spark, d, "wkt")).select("site", "poly_id", "name")


@query(f"WITH {T.SITES_SQL}, {_SHOPS_SQL} {_in_nations_sql(_OPEN_SQL)}")
def sites_in_geojson_polygons(spark: SparkSession, d: str) -> DataFrame:
    return areal.points_in_polygons(T.sites_events(spark, d), _nations(spark, d, "geojson"), boundary=False).select("site", "poly_id", "name")


@query(f"WITH {T.PANEL_SQL}, {_SHOPS_SQL}, hit AS ({_in_nations_sql(_FRAME_SQL)}) SELECT poly_id, name, t, count(*) AS n_points, round(avg(obs), 6) AS m FROM hit JOIN panel USING (site) WHERE obs IS NOT NULL GROUP BY 1, 2, 3")
def areal_mean_wkt(spark: SparkSession, d: str) -> DataFrame:
    p = T.panel_events(spark, d).where("obs is not null").withColumnsRenamed({"px": "x", "py": "y"})
    return areal.areal_mean(p, _nations(spark, d, "wkt"), None, ["t"], "obs").select("poly_id", "name", "t", "n_points", r6(F.col("obs"), "m"))


@query(f"WITH {_SHOPS_SQL} SELECT count(*) AS n, count(*) FILTER (shop % 7 = 0) AS n_null, count(*) FILTER (shop % 7 <> 0 AND acctbal < 0) AS n_bad, count(*) FILTER (shop % 7 <> 0 AND acctbal >= 0 AND shop % 5 = 0) AS n_empty, count(*) FILTER (shop % 7 <> 0 AND acctbal >= 0 AND shop % 5 <> 0) AS n_polygons FROM shops")
def wkt_parse_report(spark: SparkSession, d: str) -> DataFrame:
    """Texts of all suppliers: some are null, some lack a vertex, some are empty."""
    x, y = F.col("x"), F.col("y")
    text = F.concat(F.lit("POLYGON(("), F.concat_ws(",", F.concat_ws(" ", x, y), F.concat_ws(" ", x + 1, y), F.concat_ws(" ", x, y + 1)), F.lit("))"))
    text = F.when(F.col("id") % 7 == 0, None).when(F.col("s_acctbal") < 0, F.concat(F.lit("POLYGON(("), x, F.lit("))"))).when(F.col("id") % 5 == 0, "POLYGON EMPTY").otherwise(text)
    return geotext.parse_report(_shops(spark, d).select(text.alias("text")), "text")


# --- numbers in order --------------------------------------------------------------------------------------------------


@query("WITH first AS (SELECT user_id AS site, min(event_id) AS o FROM events GROUP BY 1) SELECT site, CAST(row_number() OVER (ORDER BY o, site) - 1 AS INT) AS site_id, lag(site) OVER (ORDER BY o, site) AS before FROM first")
def panel_site_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Sites numbered by first appearance, each with the site that appeared before it."""
    first = T.table(spark, d, "events").groupBy(F.col("user_id").alias("site")).agg(F.min("event_id").alias("o"))
    return with_previous(numbered(first, ["o", "site"], "site_id"), ["o", "site"], "site", "before").select("site", "site_id", "before")


# --- fields on a grid --------------------------------------------------------------------------------------------------

_GRID = field.Grid(-0.3, -0.4, 0.35, 32, 32)
_EPS, _SLOPE = 0.3, 0.4
_NODE_SQL = f"node AS (SELECT CAST(a AS INT) AS i, CAST(b AS INT) AS j FROM generate_series(0, {_GRID.nx - 1}) AS g(a) CROSS JOIN generate_series(0, {_GRID.ny - 1}) AS h(b))"
_FIELD_SQL = f"""{T.SITES_SQL}, {_NODE_SQL},
band AS (SELECT pow(count(*), -1.0 / 6) * sqrt((var_pop(x) + var_pop(y)) / 2) / {_GRID.delta} AS sigma FROM sites),
kernel AS (SELECT k, w / sum(w) OVER () AS w FROM (SELECT CAST(k AS INT) AS k, exp(-0.5 * (k / sigma) * (k / sigma)) AS w FROM band CROSS JOIN generate_series(-200, 200) AS g(k) WHERE abs(k) <= floor(4 * sigma + 0.5))),
mask AS (SELECT i, j FROM node WHERE {T.inside_sql(T.ELL, f"({_GRID.x0} + i * {_GRID.delta})", f"({_GRID.y0} + j * {_GRID.delta})")}),
seen AS (SELECT CAST(round_even((x - {_GRID.x0}) / {_GRID.delta}, 0) AS INT) AS i, CAST(round_even((y - {_GRID.y0}) / {_GRID.delta}, 0) AS INT) AS j, count(*) AS n FROM sites GROUP BY 1, 2),
n1 AS (SELECT i + k AS i, j, sum(n * w) AS n FROM seen CROSS JOIN kernel WHERE i BETWEEN 0 AND {_GRID.nx - 1} AND j BETWEEN 0 AND {_GRID.ny - 1} GROUP BY 1, 2), n2 AS (SELECT i, j + k AS j, sum(n * w) AS n FROM n1 CROSS JOIN kernel GROUP BY 1, 2),
m1 AS (SELECT i + k AS i, j, sum(w) AS m FROM mask CROSS JOIN kernel GROUP BY 1, 2), m2 AS (SELECT i, j + k AS j, sum(m * w) AS m FROM m1 CROSS JOIN kernel GROUP BY 1, 2),
raw AS (SELECT i, j, coalesce(n, 0) / greatest(m, 0.05) AS f FROM mask JOIN m2 USING (i, j) LEFT JOIN n2 USING (i, j)),
dens AS (SELECT i, j, f / (sum(f) OVER () * {_GRID.delta} * {_GRID.delta}) AS f FROM raw)"""
_SIZE_SQL = f"size AS (SELECT i, j, pow((1 - {_EPS}) * f + {_EPS} / (count(*) OVER () * {_GRID.delta} * {_GRID.delta}), -0.5) AS h FROM dens)"


def _density(spark: SparkSession, d: str) -> DataFrame:
    return field.intensity(T.sites_events(spark, d), _GRID, domain=T.ELL)


@query(f"WITH {_FIELD_SQL} SELECT i, j, round(f, 6) AS f FROM dens")
def site_intensity(spark: SparkSession, d: str) -> DataFrame:
    return _density(spark, d).select("i", "j", r6(F.col("f"), "f"))


@query(f"WITH {_FIELD_SQL}, {_SIZE_SQL} SELECT a.i, a.j, round(min(b.h + {_SLOPE} * {_GRID.delta} * (greatest(abs(a.i - b.i), abs(a.j - b.j)) + (sqrt(2) - 1) * least(abs(a.i - b.i), abs(a.j - b.j)))), 6) AS h FROM node a CROSS JOIN size b GROUP BY 1, 2")
def size_field_limited(spark: SparkSession, d: str) -> DataFrame:
    """Element sizes from the intensity, limited in slope, on all nodes; those outside the domain have none of their own."""
    f = _density(spark, d)
    area = f.count() * _GRID.delta**2
    size = f.select("i", "j", F.pow((1 - _EPS) * F.col("f") + _EPS / area, F.lit(-0.5)).alias("h"))
    return field.limit_slope(size, _GRID, _SLOPE).select("i", "j", r6(F.col("h"), "h"))


_TILE_SQL = "tile AS (SELECT DISTINCT CAST(floor(x / 1.3) AS INT) AS i, CAST(floor(y / 1.3) AS INT) AS j FROM sites), tri AS (SELECT 2 * (i + 8 * j) AS e, i + 9 * j AS v1, i + 1 + 9 * j AS v2, i + 1 + 9 * (j + 1) AS v3 FROM tile UNION ALL SELECT 2 * (i + 8 * j) + 1, i + 9 * j, i + 1 + 9 * (j + 1), i + 9 * (j + 1) FROM tile)"


def _tiles(spark: SparkSession, d: str) -> DataFrame:
    """(e, v1, v2, v3): two triangles for every tile with a site."""
    tile = T.sites_events(spark, d).select(*[F.floor(F.col(c) / 1.3).cast("int").alias(k) for c, k in (("x", "i"), ("y", "j"))]).distinct()
    a = F.col("i") + 9 * F.col("j")
    corners = [(a, a + 1, a + 10), (a, a + 10, a + 9)]
    both = F.array(*[F.struct((2 * (F.col("i") + 8 * F.col("j")) + k).alias("e"), *[v.alias(f"v{n}") for n, v in enumerate(c, 1)]) for k, c in enumerate(corners)])
    return tile.select(F.explode(both).alias("t")).select("t.*")


@query(
    f"""WITH RECURSIVE {T.SITES_SQL}, {_TILE_SQL}, left_over(round, e, v1, v2, v3) AS (
  SELECT 0, e, v1, v2, v3 FROM tri
  UNION ALL
  SELECT round + 1, e, v1, v2, v3 FROM left_over WHERE round < 80 AND NOT EXISTS (
    SELECT 1 FROM (SELECT v, count(DISTINCT other) AS degree FROM (
        SELECT v1 AS v, v2 AS other FROM left_over UNION ALL SELECT v2, v1 FROM left_over UNION ALL SELECT v2, v3 FROM left_over
        UNION ALL SELECT v3, v2 FROM left_over UNION ALL SELECT v3, v1 FROM left_over UNION ALL SELECT v1, v3 FROM left_over) GROUP BY v) d
    WHERE degree < 3 AND (v = v1 OR v = v2 OR v = v3))
)
SELECT e, v1, v2, v3 FROM left_over WHERE round = 80"""
)
def mesh_peeled(spark: SparkSession, d: str) -> DataFrame:
    """Two triangles for every tile with a site, less those at vertices of fewer than three edges."""
    return field.peel(_tiles(spark, d), 3)


_KAPPA = 0.8
#: The precision on all tiles; the cells of inner vertices hold an odd number of sites. Vertices go one a round.
_PRECISION_SQL = f"""{T.SITES_SQL}, {_TILE_SQL}, corner AS (SELECT e, k, v, (v % 9) * 1.3::DOUBLE AS x, (v // 9) * 1.3::DOUBLE AS y FROM (SELECT e, unnest([0, 1, 2]) AS k, unnest([v1, v2, v3]) AS v FROM tri)),
slope AS (SELECT a.e, a.v, b.y - c.y AS gy, c.x - b.x AS gx, abs((b.x - a.x) * (c.y - a.y) - (c.x - a.x) * (b.y - a.y)) / 2 AS area FROM corner a JOIN corner b ON b.e = a.e AND b.k = (a.k + 1) % 3 JOIN corner c ON c.e = a.e AND c.k = (a.k + 2) % 3),
mass AS (SELECT v, sum(area) / 3 AS c FROM slope GROUP BY 1),
stiff AS (SELECT a.v AS i, b.v AS j, sum((a.gx * b.gx + a.gy * b.gy) / (4 * a.area)) AS g FROM slope a JOIN slope b USING (e) GROUP BY 1, 2),
q AS (SELECT i, j, {1 / (4 * 3.141592653589793 * _KAPPA**2)!r} * sum(q) AS q FROM (SELECT v AS i, v AS j, {_KAPPA**4!r} * c AS q FROM mass UNION ALL SELECT i, j, {2 * _KAPPA**2!r} * g FROM stiff UNION ALL SELECT a.i, b.j, a.g * b.g / c FROM stiff a JOIN mass ON mass.v = a.j JOIN stiff b ON b.i = a.j) GROUP BY 1, 2),
inn AS (SELECT CAST(round(x / 1.3) AS INT) + 9 * CAST(round(y / 1.3) AS INT) AS v FROM sites GROUP BY 1 HAVING count(*) % 2 = 1),
o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS n FROM mass WHERE v NOT IN (SELECT v FROM inn)),
full_q AS (SELECT a.v AS i, b.v AS j, coalesce(q.q, 0.0) AS q FROM mass a CROSS JOIN mass b LEFT JOIN q ON q.i = a.v AND q.j = b.v)"""


@query(
    f"""WITH RECURSIVE {_PRECISION_SQL}, step(k, i, j, q) AS (
  SELECT 0, i, j, q FROM full_q
  UNION ALL
  SELECT s.k + 1, s.i, s.j, s.q - r.q * c.q / p.q FROM step s JOIN o ON o.n = s.k JOIN step r ON r.i = s.i AND r.j = o.v JOIN step c ON c.i = o.v AND c.j = s.j JOIN step p ON p.i = o.v AND p.j = o.v
  WHERE s.i <> o.v AND s.j <> o.v
)
SELECT i::INT AS i, j::INT AS j, round(q, 6) AS q FROM step WHERE k = (SELECT count(*) FROM o) AND abs(q) >= 0.00001"""
)
def mesh_marginal_precision(spark: SparkSession, d: str) -> DataFrame:
    """The precision of a field on the tiles with sites, for the vertices around which an odd number of sites lies."""
    sites = T.sites_events(spark, d)
    tri = _tiles(spark, d)
    vertex = tri.select(F.explode(F.array("v1", "v2", "v3")).alias("v")).distinct().select("v", (F.col("v") % 9 * 1.3).alias("x"), (F.floor(F.col("v") / 9) * 1.3).alias("y"))
    near_v = (F.round(F.col("x") / 1.3) + 9 * F.round(F.col("y") / 1.3)).cast("int").alias("v")
    inner = sites.groupBy(near_v).count().where("count % 2 = 1").select("v")
    q = spde.precision(fem.mass(vertex, tri), fem.stiffness(vertex, tri), _KAPPA)
    got = eliminate.marginal(q, inner).where(F.abs("q") >= 0.00001)
    return got.select("i", "j", r6(F.col("q"), "q"))


# --- SQL text alone ----------------------------------------------------------------------------------------------------

_NODES_TEXT = """
SELECT n.v, n.x, n.y, count(s.site) AS n_sites, round(min(gp_euclid(s.x, s.y, n.x, n.y)), 6) AS nearest
FROM range(9) AS r JOIN LATERAL gp_lattice_row(r.id, double(-3), double(-3), double(2), 9) AS n
LEFT JOIN gp_sites AS s ON round((s.x + 3) / 2) = n.i AND round((s.y + 3) / 2) = n.j
GROUP BY n.v, n.x, n.y
"""


@query(
    f"WITH {T.SITES_SQL}, node AS (SELECT CAST(k AS BIGINT) AS v, k % 9 AS i, k // 9 AS j, -3.0::DOUBLE + 2 * (k % 9) AS x, -3.0::DOUBLE + 2 * (k // 9) AS y FROM generate_series(0, 80) AS g(k)) "
    "SELECT v, n.x, n.y, count(site) AS n_sites, round(min(sqrt((s.x - n.x) * (s.x - n.x) + (s.y - n.y) * (s.y - n.y))), 6) AS nearest FROM node n LEFT JOIN sites s ON round((s.x + 3) / 2) = n.i AND round((s.y + 3) / 2) = n.j GROUP BY 1, 2, 3"
)
def sql_lattice_counts(spark: SparkSession, d: str) -> DataFrame:
    """Sites by the lattice node whose cell they are in, in SQL text with a table function."""
    sql.register(spark, {"gp_sites": T.sites_events(spark, d)})
    return spark.sql(_NODES_TEXT)


_SUPPLIERS_TEXT = """
SELECT gp_season(month) AS season, count(*) AS n, round(avg(y1), 6) AS log_revenue, round(max(gp_great_circle(double(site % 180), double(site % 80), 9.0D, 45.0D)), 4) AS farthest
FROM gp_panel GROUP BY 1
"""


@query(
    f"WITH {T.LINE_SQL} SELECT CASE WHEN month(month) IN (12, 1, 2) THEN 'Winter' WHEN month(month) IN (3, 4, 5) THEN 'Spring' WHEN month(month) IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END AS season, count(*) AS n, round(avg(y1), 6) AS log_revenue, "
    "round(max(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(45.0 - site % 80) / 2), 2) + cos(radians(site % 80)) * cos(radians(45.0)) * pow(sin(radians(9.0 - site % 180) / 2), 2))))), 4) AS farthest FROM line GROUP BY 1"
)
def sql_panel_seasons(spark: SparkSession, d: str) -> DataFrame:
    """A panel by season, in SQL text with scalar functions."""
    sql.register(spark, {"gp_panel": T.panel_lineitem(spark, d)})
    return spark.sql(_SUPPLIERS_TEXT)
