"""Polygons from and to WKT and GeoJSON columns.

A polygon column is an array of polygons, each an array of rings (the shell, then holes), each an array of (x, y); a ring need
not repeat its first vertex. Both texts become nested JSON arrays by replacements of bounded patterns, which Spark parses; all
of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopanel.functions import geo

_NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
_NESTED = "array<array<array<array<double>>>>"
TYPE = "array<array<array<struct<x:double,y:double>>>>"


def _polygons(nested: Column) -> Column:
    """Nested number arrays as a polygon column; NULL unless every ring has three different vertices of finite numbers."""

    def finite(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    def fine_ring(ring: Column) -> Column:
        points = F.forall(ring, lambda p: F.coalesce((F.size(p) >= 2) & finite(F.get(p, F.lit(0))) & finite(F.get(p, F.lit(1))), F.lit(False)))
        return ring.isNotNull() & points & (F.size(F.array_distinct(F.transform(ring, lambda p: F.slice(p, 1, 2)))) >= 3)

    fine = F.forall(nested, lambda poly: poly.isNotNull() & (F.size(poly) > 0) & F.forall(poly, lambda r: F.coalesce(fine_ring(r), F.lit(False))))
    out = F.transform(nested, lambda poly: F.transform(poly, lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))))
    return F.when(F.coalesce(fine, F.lit(False)), out)


def _nested(json: Column) -> Column:
    return F.from_json(json, _NESTED, {"mode": "PERMISSIVE", "allowNumericLeadingZeros": "true"})


def _wrapped(kind: Column, body: Column) -> Column:
    """The JSON arrays of a POLYGON or MULTIPOLYGON as those of a multipolygon."""
    return F.when(kind == "polygon", F.concat(F.lit("["), body, F.lit("]"))).when(kind == "multipolygon", body)


def _wkt_json(text: Column) -> Column:
    head = r"^\s*(?:(?i)SRID=[0-9]+;)?\s*((?i)MULTIPOLYGON|POLYGON)\s*(?:(?i)ZM|Z|M)?\s*"
    kind, body = F.lower(F.regexp_extract(text, head, 1)), F.regexp_replace(text, head, "")
    empty = F.upper(F.trim(body)) == "EMPTY"
    # Text that has brackets of its own is no WKT.
    odd = body.rlike(r"[\[\]\"]")
    # x y [z [m]] becomes [x,y]; JSON wants digits on both sides of a point, and no plus.
    body = F.regexp_replace(body, rf"({_NUMBER})\s+({_NUMBER})(?:\s+{_NUMBER}){{0,2}}(?=\s*[,)])", "[$1,$2]")
    for pattern, to in ((r"(?<=[\[,])\+", ""), (r"(?<![0-9])\.(?=[0-9])", "0."), (r"(?<=[0-9])\.(?![0-9])", ".0")):
        body = F.regexp_replace(body, pattern, to)
    return F.when(empty & kind.isin("polygon", "multipolygon"), "[]").when(~odd, _wrapped(kind, F.translate(body, "()", "[]")))


def _geojson_json(text: Column) -> Column:
    shape = "type string, coordinates string"
    top = F.from_json(text, f"{shape}, geometry struct<{shape.replace(' ', ':')}>".replace("type:string,:", "type:string,"))
    feature = top["type"] == "Feature"
    kind = F.when(feature, top["geometry"]["type"]).otherwise(top["type"])
    body = F.when(feature, top["geometry"]["coordinates"]).otherwise(top["coordinates"])
    empty = F.regexp_replace(body, r"\s+", "") == "[]"
    known = kind.isin("Polygon", "MultiPolygon")
    return F.when(known & empty, "[]").when(known, _wrapped(F.lower(kind), body))


def from_wkt(text: Column) -> Column:
    """The polygon column of POLYGON and MULTIPOLYGON texts, in any case, with or without SRID=n; and Z, M values, which
    are left out. EMPTY ones are empty arrays; null texts, other geometries and texts that do not parse are NULL."""
    return _polygons(_nested(_wkt_json(text)))


def from_geojson(text: Column) -> Column:
    """The polygon column of GeoJSON geometries or features of type Polygon and MultiPolygon; others and texts that do not
    parse are NULL, empty coordinates an empty array."""
    return _polygons(_nested(_geojson_json(text)))


def _rings(polygons: Column, open_, point, close: str, between: str) -> Column:
    def ring(r: Column) -> Column:
        closed = F.when(F.element_at(r, 1) == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1)))
        return F.concat(F.lit(open_), F.array_join(F.transform(closed, point), between), F.lit(close))

    return F.transform(polygons, lambda poly: F.concat(F.lit(open_), F.array_join(F.transform(poly, ring), between), F.lit(close)))


def to_wkt(polygons: Column) -> Column:
    """WKT of a polygon column, with closed rings: POLYGON for one polygon, otherwise MULTIPOLYGON."""
    parts = _rings(polygons, "(", lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")), ")", ", ")
    one = F.concat(F.lit("POLYGON "), F.get(parts, F.lit(0)))
    many = F.concat(F.lit("MULTIPOLYGON ("), F.array_join(parts, ", "), F.lit(")"))
    return F.when(F.size(polygons) == 0, F.lit("MULTIPOLYGON EMPTY")).when(F.size(polygons) == 1, one).when(polygons.isNotNull(), many)


def to_geojson(polygons: Column) -> Column:
    """GeoJSON geometry of a polygon column, always a MultiPolygon."""
    parts = _rings(polygons, "[", lambda p: F.concat(F.lit("["), p["x"].cast("string"), F.lit(","), p["y"].cast("string"), F.lit("]")), "]", ",")
    return F.concat(F.lit('{"type":"MultiPolygon","coordinates":['), F.array_join(parts, ","), F.lit("]}"))


def reproject_polygons(polygons: Column, source: str, target: str) -> Column:
    """A polygon column with the vertices of one coordinate system as those of another."""

    def moved(p: Column) -> Column:
        x, y = geo.reproject(p["x"], p["y"], source, target)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(polygons, lambda poly: F.transform(poly, lambda ring: F.transform(ring, moved)))


def parse_polygons(df: DataFrame, column: str, fmt: str = "wkt", into: str = "geom") -> DataFrame:
    """df with the polygons of a text column.

    Each step is an array of one, exploded: otherwise the whole parse is written out, and run, wherever it is referred to."""
    json = {"wkt": _wkt_json, "geojson": _geojson_json}[fmt](F.col(column))
    for step in (lambda c: json, _nested, _polygons):
        df = df.withColumn("__parsed", F.explode(F.array(step(F.col("__parsed") if "__parsed" in df.columns else None))))
    return df.withColumn(into, F.col("__parsed")).drop("__parsed")


def parse_report(df: DataFrame, column: str, fmt: str = "wkt") -> DataFrame:
    """One row: n, n_null, n_bad (texts that gave no polygons), n_empty and n_polygons (parts)."""
    p = parse_polygons(df.select(column), column, fmt, "geom")
    text, geom = F.col(column), F.col("geom")
    return p.agg(
        F.count("*").alias("n"),
        F.count_if(text.isNull()).alias("n_null"),
        F.count_if(text.isNotNull() & geom.isNull()).alias("n_bad"),
        F.count_if(F.size(geom) == 0).alias("n_empty"),
        F.coalesce(F.sum(F.when(geom.isNotNull(), F.size(geom))), F.lit(0)).alias("n_polygons"),
    )
