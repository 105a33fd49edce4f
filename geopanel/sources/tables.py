"""Panels on the bundled tables, and the SQL text of the same panels for value checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geopanel.functions.semantics import safe_ln

DAYS = 30
START = "2024-01-01"

SQUARE = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]]
LEFT = [[(0.0, 0.0), (5.0, 0.0), (5.0, 10.0), (0.0, 10.0)]]
ELL = [[(0.0, 0.0), (8.0, 0.0), (8.0, 3.0), (3.0, 3.0), (3.0, 9.0), (0.0, 9.0)]]
TRIANGLE = [[(1.0, 1.0), (9.0, 2.0), (4.0, 8.0)]]
POLYGONS = {"square": SQUARE, "left": LEFT, "ell": ELL, "triangle": TRIANGLE}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def place(key):
    """Coordinates of a site from its number."""
    return ((37 * key) % 101) / 10.0, ((53 * key) % 97) / 10.0


def sites_events(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").select(F.col("user_id").alias("site")).distinct()
    x, y = place(F.col("site"))
    return s.select("site", x.alias("x"), y.alias("y"))


def panel_events(spark: SparkSession, d: str) -> DataFrame:
    """(site, px, py, t, obs, x1, x2): log mean value of a user's events a day; every user has every day.

    The days are generated per site, so no join makes the grid."""
    e = table(spark, d, "events")
    day = F.datediff(F.to_date("ts"), F.lit(START).cast("date"))
    seen = e.groupBy(F.col("user_id").alias("site"), day.alias("t")).agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    grid = sites_events(spark, d).select("site", F.col("x").alias("px"), F.col("y").alias("py"), F.explode(F.sequence(F.lit(0), F.lit(DAYS - 1))).alias("t"))
    j = grid.join(seen.hint("merge"), ["site", "t"], "left")
    return j.select("site", "px", "py", "t", safe_ln(F.col("m")).alias("obs"), F.ln(1.0 + F.coalesce("n", F.lit(0))).alias("x1"), F.col("t").cast("double").alias("x2"))


def panel_lineitem(spark: SparkSession, d: str) -> DataFrame:
    """(site, month, y1, y2): log revenue and mean discount of a supplier a month."""
    li = table(spark, d, "lineitem")
    g = li.groupBy(F.col("l_suppkey").alias("site"), F.date_trunc("month", "l_shipdate").alias("month"))
    return g.agg(safe_ln(F.sum("l_extendedprice")).alias("y1"), F.avg("l_discount").alias("y2"))


SITES_SQL = """sites AS (SELECT user_id AS site, ((37 * user_id) % 101) / 10.0 AS x, ((53 * user_id) % 97) / 10.0 AS y FROM (SELECT DISTINCT user_id FROM events))"""
PANEL_SQL = f"""{SITES_SQL},
seen AS (SELECT user_id AS site, date_diff('day', DATE '{START}', CAST(ts AS DATE)) AS t, avg(value) AS m, count(*) AS n FROM events GROUP BY 1, 2),
panel AS (SELECT s.site, s.x AS px, s.y AS py, CAST(g.t AS INT) AS t, CASE WHEN m > 0 THEN ln(m) END AS obs, ln(1.0 + coalesce(n, 0)) AS x1, CAST(g.t AS DOUBLE) AS x2
  FROM sites s CROSS JOIN generate_series(0, {DAYS - 1}) AS g(t) LEFT JOIN seen ON seen.site = s.site AND seen.t = g.t)"""
LINE_SQL = """line AS (SELECT l_suppkey AS site, date_trunc('month', l_shipdate) AS month, CASE WHEN sum(l_extendedprice) > 0 THEN ln(sum(l_extendedprice)) END AS y1, avg(l_discount) AS y2 FROM lineitem GROUP BY 1, 2)"""


def inside_sql(poly, px: str, py: str, boundary: bool = True) -> str:
    """The polygon predicate as SQL text."""
    from geopanel.functions.geo import edges

    cross, edge = [], []
    for x1, y1, x2, y2 in edges(poly):
        edge.append(f"(({x2 - x1}) * ({py} - {y1}) - ({y2 - y1}) * ({px} - {x1}) = 0 AND {px} BETWEEN {min(x1, x2)} AND {max(x1, x2)} AND {py} BETWEEN {min(y1, y2)} AND {max(y1, y2)})")
        if y1 != y2:
            cross.append(f"CASE WHEN (({y1} > {py}) <> ({y2} > {py})) AND {px} < ({x2 - x1}) * ({py} - {y1}) / ({y2 - y1}) + {x1} THEN 1 ELSE 0 END")
    odd, on = f"(({' + '.join(cross)}) % 2 = 1)", f"({' OR '.join(edge)})"
    return f"({odd} OR {on})" if boundary else f"({odd} AND NOT {on})"
