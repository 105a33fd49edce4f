"""Change of support: points to polygons, and delta-method back-transformation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopanel.functions import geo
from geopanel.operators.regions import Regions
from geopanel.operators.work import cut

#: Back-transformations with their first and second derivatives.
BACK: dict[str, tuple[Callable, Callable, Callable]] = {
    "identity": (lambda v: v, lambda v: F.lit(1.0), lambda v: F.lit(0.0)),
    "exp": (F.exp, F.exp, F.exp),
    "square": (lambda v: v * v, lambda v: 2 * v, lambda v: F.lit(2.0)),
    "expm1": (F.expm1, F.exp, F.exp),
    "logistic": (
        lambda v: 1 / (1 + F.exp(-v)),
        lambda v: F.exp(-v) / ((1 + F.exp(-v)) * (1 + F.exp(-v))),
        lambda v: F.exp(-v) * (F.exp(-v) - 1) / ((1 + F.exp(-v)) * (1 + F.exp(-v)) * (1 + F.exp(-v))),
    ),
}


def delta_method(g: str | tuple[Callable, Callable, Callable], mean: Column, var: Column) -> tuple[Column, Column]:
    """(h + h'' v / 2, h'^2 v) at the mean."""
    h, h1, h2 = BACK[g] if isinstance(g, str) else g
    return h(mean) + h2(mean) * var / 2, h1(mean) * h1(mean) * var


def direct_transform(g: str, c: Column) -> Column:
    return BACK[g][0](c)


def polygon_table(df: DataFrame, polygons: list, names: list[str] | None = None) -> DataFrame:
    """(poly_id, name, geom) of a list of polygons, numbered in its order."""
    rows = [(k, names[k] if names else str(k), geo.as_polygons(p)) for k, p in enumerate(polygons)]
    return df.sparkSession.createDataFrame(rows, "poly_id int, name string, geom array<array<array<struct<x:double,y:double>>>>")


def points_in_polygons(points: DataFrame, polygons: DataFrame | list, names: list[str] | None = None, boundary: bool = True) -> DataFrame:
    """Every (point, polygon) with the point inside; a point on a shared border is in both when the boundary counts.

    polygons is a table (poly_id, name, geom), such as one read by sources.geotext, or a short list of polygons.
    """
    table = polygons if isinstance(polygons, DataFrame) else polygon_table(points, polygons, names)
    box = points.agg(*[f(F.nanvl(F.col(c).cast("double"), F.lit(None))) for c in ("x", "y") for f in (F.min, F.max)]).first()
    regions = Regions.of(table, within=tuple(box)) if box[0] is not None and box[2] is not None else None
    if regions is None:
        return points.withColumns({f.name: F.lit(None).cast(f.dataType) for f in table.schema if f.name != "geom"}).where("false")
    return regions.join(points, boundary)


def areal_mean(points: DataFrame, polygons: DataFrame | list, names: list[str] | None = None, by: list[str] | None = None, value: str = "mean") -> DataFrame:
    """(by.., poly_id, name, n_points, value): means over the points of each polygon; polygons without points are absent."""
    by = by or []
    v = F.col(value).cast("double")
    # Sums of each place and group first: a polygon is then met by places, not by all points there.
    place = points.groupBy(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *by).agg(F.count("*").alias("__n"), F.count(v).alias("__seen"), F.sum(v).alias("__sum"))
    hit = points_in_polygons(cut(place), polygons, names)
    return hit.groupBy(*by, "poly_id", "name").agg(F.sum("__n").alias("n_points"), F.try_divide(F.sum("__sum"), F.sum("__seen")).alias(value))
