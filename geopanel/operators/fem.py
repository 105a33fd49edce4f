"""P1 finite elements as coordinate tables: lumped mass (v, c), stiffness (i, j, g), basis (site, v, h)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geopanel.operators.mesh import corners


def mass(vertex: DataFrame, triangle: DataFrame) -> DataFrame:
    """(v, c): a third of the area of the triangles around each vertex."""
    c = corners(vertex, triangle).select(F.explode(F.array("v1", "v2", "v3")).alias("v"), (F.col("area") / 3).alias("a"))
    return c.groupBy("v").agg(F.sum("a").alias("c"))


def stiffness(vertex: DataFrame, triangle: DataFrame) -> DataFrame:
    """(i, j, g): integrals of products of basis gradients."""
    c = corners(vertex, triangle)
    x, y = [F.col(f"x{k}") for k in (1, 2, 3)], [F.col(f"y{k}") for k in (1, 2, 3)]
    b = [y[1] - y[2], y[2] - y[0], y[0] - y[1]]
    d = [x[2] - x[1], x[0] - x[2], x[1] - x[0]]
    cells = [F.struct(F.col(f"v{i + 1}").alias("i"), F.col(f"v{j + 1}").alias("j"), ((b[i] * b[j] + d[i] * d[j]) / (4 * F.col("area"))).alias("g")) for i in range(3) for j in range(3)]
    return c.select(F.explode(F.array(*cells)).alias("s")).groupBy("s.i", "s.j").agg(F.sum("s.g").alias("g"))


def energy(vertex: DataFrame, triangle: DataFrame, value: str) -> DataFrame:
    """One row: u'Gu, the Dirichlet energy of the vertex column `value`."""
    u = vertex.select(F.col("v").alias("i"), F.col(value).alias("ui"))
    w = vertex.select(F.col("v").alias("j"), F.col(value).alias("uj"))
    return stiffness(vertex, triangle).join(u, "i").join(w, "j").agg(F.sum(F.col("ui") * F.col("g") * F.col("uj")).alias("energy"))


def basis(points: DataFrame, vertex: DataFrame, triangle: DataFrame, site: str = "site_id", bins: int | None = None, tiny: float = 1e-8) -> DataFrame:
    """(site, v, h): barycentric weights of each point in its triangle.

    Points and triangles meet in the cells of a bins x bins grid over the mesh, one for every two triangles unless bins says
    otherwise, so the join is an equi-join; a point on several triangles takes the least one (the weights are the same).
    Points outside the mesh have no rows.
    """
    bins = bins or max(1, math.ceil(math.sqrt(triangle.count() / 2)))
    c = corners(vertex, triangle)
    box = vertex.agg(F.min("x").alias("bx"), F.min("y").alias("by"), ((F.max("x") - F.min("x")) / bins).alias("sx"), ((F.max("y") - F.min("y")) / bins).alias("sy"))

    def cell(v, lo, step):
        return F.least(F.lit(bins - 1), F.floor((v - F.col(lo)) / F.col(step)).cast("int"))

    t = c.crossJoin(F.broadcast(box))  # one row
    span = [F.sequence(cell(F.least(*[f"{a}{k}" for k in (1, 2, 3)]), f"b{a}", f"s{a}"), cell(F.greatest(*[f"{a}{k}" for k in (1, 2, 3)]), f"b{a}", f"s{a}")) for a in ("x", "y")]
    t = t.withColumn("cx", F.explode(span[0])).withColumn("cy", F.explode(span[1])).drop("bx", "by", "sx", "sy")
    p = points.select(F.col(site).alias("site"), F.col("x").alias("px"), F.col("y").alias("py")).crossJoin(F.broadcast(box))
    p = p.select("site", "px", "py", cell(F.col("px"), "bx", "sx").alias("cx"), cell(F.col("py"), "by", "sy").alias("cy"))
    j = p.join(t, ["cx", "cy"])

    def sub(a, b):
        return (F.col(f"x{a}") - F.col("px")) * (F.col(f"y{b}") - F.col("py")) - (F.col(f"x{b}") - F.col("px")) * (F.col(f"y{a}") - F.col("py"))

    j = j.select("site", "e", "v1", "v2", "v3", *[(sub(a, b) / (2 * F.col("area"))).alias(n) for n, a, b in (("l1", 2, 3), ("l2", 3, 1), ("l3", 1, 2))])
    j = j.where((F.col("l1") >= -1e-12) & (F.col("l2") >= -1e-12) & (F.col("l3") >= -1e-12))
    one = j.groupBy("site").agg(F.min_by(F.struct("v1", "v2", "v3", "l1", "l2", "l3"), "e").alias("b"))
    rows = F.explode(F.array(*[F.struct(F.col(f"b.v{k}").alias("v"), F.col(f"b.l{k}").alias("h")) for k in (1, 2, 3)]))
    return one.select(F.col("site").alias(site), rows.alias("r")).select(site, "r.v", "r.h").where(F.col("h") > tiny)


def found(points: DataFrame, basis_rows: DataFrame, site: str = "site_id") -> DataFrame:
    """One row: n points, those in a triangle, and those outside the mesh (not_found)."""
    hit = basis_rows.select(site).distinct().withColumn("hit", F.lit(1))
    every = points.select(site).join(hit, site, "left")
    return every.agg(F.count("*").alias("n"), F.count("hit").alias("found"), (F.count("*") - F.count("hit")).alias("not_found"))


def latent_basis(basis_rows: DataFrame, vertex: DataFrame, site: str = "site_id") -> DataFrame:
    """Basis restricted to inner vertices with rows that sum to one; sites with outer vertices alone have no rows."""
    b = basis_rows.join(vertex.where("inner").select("v"), "v", "left_semi")
    return b.select(site, "v", (F.col("h") / F.sum("h").over(Window.partitionBy(site))).alias("h"))
