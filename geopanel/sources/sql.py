"""A SQL surface: scalar functions, table functions and panels by name, for queries written in SQL text alone.

Scalar functions are SQL functions, which Catalyst inlines. Table functions are Python ones that a query calls for each row
of a table, so that their work is dealt as its rows are.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from geopanel.functions.geo import EARTH_KM

#: Scalar functions by name: arguments, result and expression.
SCALARS: dict[str, tuple[str, str, str]] = {
    "gp_safe_ln": ("v DOUBLE", "DOUBLE", "CASE WHEN v > 0 AND v < double('infinity') THEN ln(v) END"),
    "gp_euclid": ("x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE", "DOUBLE", "sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))"),
    "gp_great_circle": (
        "lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE",
        "DOUBLE",
        f"2 * {EARTH_KM} * asin(sqrt(least(1.0D, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))",
    ),
    "gp_season": ("ts TIMESTAMP", "STRING", "CASE WHEN month(ts) IN (12, 1, 2) THEN 'Winter' WHEN month(ts) IN (3, 4, 5) THEN 'Spring' WHEN month(ts) IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END"),
}


class _LatticeRow:
    def eval(self, j: int, x0: float, y0: float, step: float, nx: int) -> Iterator[tuple]:
        for i in range(nx):
            yield i + j * nx, i, j, x0 + i * step, y0 + j * step


class _LatticeTriangles:
    def eval(self, j: int, nx: int) -> Iterator[tuple]:
        for i in range(nx - 1):
            a, e = i + j * nx, 2 * (i + j * (nx - 1))
            yield e, a, a + 1, a + nx + 1
            yield e + 1, a, a + nx + 1, a + nx


#: Table functions by name: a row of a lattice, and the triangles above it.
TABLES = {
    "gp_lattice_row": (_LatticeRow, "v: bigint, i: bigint, j: bigint, x: double, y: double"),
    "gp_lattice_triangles": (_LatticeTriangles, "e: bigint, v1: bigint, v2: bigint, v3: bigint"),
}


def register(spark: SparkSession, views: dict[str, DataFrame] | None = None) -> None:
    """Define the functions in a session, and tables or panels as views of it; what has a name is replaced."""
    for name, (args, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    for name, (maker, schema) in TABLES.items():
        spark.udtf.register(name, udtf(maker, returnType=schema))
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
