"""Fields on a regular grid as tables (i, j, value): intensity of points, the steepest field allowed below one, and the
peeling of meshes by degree. Points and nodes never pass through the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geopanel.functions import geo
from geopanel.operators.work import cut, small

#: Least share of the kernel's mass that must lie in the domain for the edge correction: a fixed value.
FLOOR = 0.05
#: Standard deviations at which the kernel ends: a fixed value.
TRUNCATE = 4.0
#: A step of the relaxation counts if it lowers a value by more than this part.
STILL = 1e-12


@dataclass(frozen=True)
class Grid:
    """nx x ny nodes (i, j) at (x0 + i delta, y0 + j delta)."""

    x0: float
    y0: float
    delta: float
    nx: int
    ny: int

    @property
    def x(self) -> Column:
        return self.x0 + F.col("i") * self.delta

    @property
    def y(self) -> Column:
        return self.y0 + F.col("j") * self.delta

    def nodes(self, spark: SparkSession, domain=None) -> DataFrame:
        """(i, j) of the nodes in the domain, all without one."""
        n = spark.range(self.nx * self.ny).select(F.pmod("id", F.lit(self.nx)).cast("int").alias("i"), F.floor(F.col("id") / self.nx).cast("int").alias("j"))
        return n.where(geo.covered(domain, self.x, self.y)) if domain is not None else n

    def counts(self, points: DataFrame) -> DataFrame:
        """(i, j, n): points (x, y) by their nearest node; points off the grid are left out."""
        at = [F.rint((F.col(c) - o) / self.delta).cast("int").alias(k) for c, o, k in (("x", self.x0, "i"), ("y", self.y0, "j"))]
        return points.select(*at).where(F.col("i").between(0, self.nx - 1) & F.col("j").between(0, self.ny - 1)).groupBy("i", "j").agg(F.count("*").alias("n"))


def scott(points: DataFrame) -> float:
    """Scott's bandwidth: n^(-1/6) times the root of the mean variance of the coordinates (divisor n)."""
    r = points.agg(F.count("*").alias("n"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy")).first()
    if not r.n or not r.vx + r.vy:
        raise ValueError("no spread of points to take a bandwidth from")
    return r.n ** (-1 / 6) * math.sqrt((r.vx + r.vy) / 2)


def smooth(field: DataFrame, grid: Grid, sigma: float, value: str = "n") -> DataFrame:
    """(i, j, value): the field, zero where it has no row, under a Gaussian kernel of sigma grid steps, cut at TRUNCATE
    sigma and scaled to sum to one. One axis after the other: a node hands its weighted value to the nodes in reach."""
    reach = int(TRUNCATE * sigma + 0.5)
    kernel = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    weights = F.array(*[F.struct(F.lit(k - reach).alias("k"), F.lit(v / sum(kernel)).alias("w")) for k, v in enumerate(kernel)])
    out = field.select("i", "j", F.col(value).cast("double").alias(value))
    for c, other, size in (("i", "j", grid.nx), ("j", "i", grid.ny)):
        to = out.withColumn("s", F.explode(weights)).select((F.col(c) + F.col("s.k")).alias(c), other, (F.col(value) * F.col("s.w")).alias(value))
        out = to.where(F.col(c).between(0, size - 1)).groupBy("i", "j").agg(F.sum(value).alias(value))
    return out


def intensity(points: DataFrame, grid: Grid, bandwidth: float | None = None, domain=None) -> DataFrame:
    """(i, j, f): density of points (x, y) on the nodes of the domain, which sums to one over their area.

    Counts by nearest node are smoothed and divided by the domain's indicator smoothed alike (Diggle's edge correction, at
    least FLOOR). Without a point on the grid f is 0.
    """
    sigma = (scott(points) if bandwidth is None else bandwidth) / grid.delta
    mask = grid.nodes(points.sparkSession, domain)
    edge = smooth(mask.withColumn("m", F.lit(1.0)), grid, sigma, "m")
    raw = mask.join(edge, ["i", "j"], "left").join(smooth(grid.counts(points), grid, sigma), ["i", "j"], "left")
    raw = cut(raw.select("i", "j", (F.coalesce("n", F.lit(0.0)) / F.greatest(F.coalesce("m", F.lit(0.0)), F.lit(FLOOR))).alias("f")))
    total = (raw.agg(F.sum("f")).first()[0] or 0.0) * grid.delta**2
    return raw.withColumn("f", F.col("f") / total if total else F.lit(0.0))


def limit_slope(field: DataFrame, grid: Grid, slope: float, value: str = "h") -> DataFrame:
    """(i, j, value): the largest field on all nodes of the grid that lies below the given one, where it has a row with a
    value, and changes by at most slope a unit of length between the 8 neighbours of a node.

    Values flow from changed nodes to their neighbours and stay where they are lower than what is there. The first rounds
    take strides of falling powers of two, which are paths of the grid as well; the last ones, of single steps, end when
    nothing falls any more, so that strides only save rounds. A field without values gives nulls.
    """
    all_nodes = grid.nodes(field.sparkSession)
    now = cut(all_nodes.join(field.select("i", "j", F.col(value).cast("double").alias("h")), ["i", "j"], "left").withColumn("moved", F.col("h").isNotNull()))
    stride = 1 << max(0, (max(grid.nx, grid.ny) - 1).bit_length() - 1)
    while True:
        moves = F.array(*[F.struct(F.lit(i * stride).alias("i"), F.lit(j * stride).alias("j"), F.lit(slope * grid.delta * stride * math.hypot(i, j)).alias("w")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
        sent = now.where("moved" if stride == 1 else "h IS NOT NULL").withColumn("m", F.explode(moves))
        sent = sent.select((F.col("i") + F.col("m.i")).alias("i"), (F.col("j") + F.col("m.j")).alias("j"), (F.col("h") + F.col("m.w")).alias("got"))
        sent = sent.where(F.col("i").between(0, grid.nx - 1) & F.col("j").between(0, grid.ny - 1)).groupBy("i", "j").agg(F.min("got").alias("got"))
        falls = F.coalesce(F.col("h").isNull() & F.col("got").isNotNull() | (F.col("got") < F.col("h") - STILL * F.abs("h")), F.lit(False))
        last = stride == 1
        # All nodes send in the first round of single steps; later ones only where a value fell.
        begins = F.lit(stride == 2) & F.col("h").isNotNull()
        now = now.drop("moved").join(sent, ["i", "j"], "left").withColumn("moved", falls)
        now = cut(now.select("i", "j", F.when(F.col("moved"), F.col("got")).otherwise(F.col("h")).alias("h"), (F.col("moved") | begins).alias("moved")))
        if last and now.where("moved").isEmpty():
            return now.select("i", "j", F.col("h").alias(value))
        stride = max(1, stride // 2)


def peel(triangle: DataFrame, least: int) -> DataFrame:
    """The triangles (v1, v2, v3, ..) left when those that touch a vertex of fewer than `least` different edges go, again and
    again until no vertex of a triangle has fewer. Only vertices that lost an edge are looked at again; all may go.

    Vertices are not null; repeated triangles stay or go together.
    """
    tri = cut(triangle)
    sides = F.explode(F.array(*[F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("w")) for a, b in (("v1", "v2"), ("v2", "v3"), ("v3", "v1"))])).alias("s")

    def edges(t: DataFrame) -> DataFrame:
        return t.select(sides).groupBy(F.col("s.u").alias("u"), F.col("s.w").alias("w")).agg(F.count("*").alias("n"))

    def degrees(e: DataFrame) -> DataFrame:
        return e.select(F.explode(F.array("u", "w")).alias("v")).groupBy("v").agg(F.count("*").alias("d"))

    held = cut(edges(tri))
    degree = cut(degrees(held))
    # A round for every layer that goes; each writes what is left.
    low = degree.where(F.col("d") < least).select("v")
    while n := low.count():
        mark = small(low.withColumn("low", F.lit(True)), n)
        # A triangle goes if any of its corners is low.
        for k in (1, 2, 3):
            tri = tri.join(mark.withColumnsRenamed({"v": f"v{k}", "low": f"low{k}"}), f"v{k}", "left")
        tri = cut(tri.withColumn("gone", F.coalesce(*[F.col(f"low{k}") for k in (1, 2, 3)], F.lit(False))).drop("low1", "low2", "low3"))
        lost = edges(tri.where("gone")).withColumnRenamed("n", "lost")
        tri = tri.where("NOT gone").drop("gone")
        left = cut(held.join(lost, ["u", "w"], "left").withColumn("n", F.col("n") - F.coalesce("lost", F.lit(0))))
        fell = degrees(left.where("n = 0")).withColumnRenamed("d", "fell")
        held = left.where("n > 0").drop("lost")
        degree = cut(degree.join(fell, "v", "left").select("v", (F.col("d") - F.coalesce("fell", F.lit(0))).alias("d"), F.col("fell").isNotNull().alias("seen")))
        low = degree.where((F.col("d") < least) & (F.col("d") > 0) & F.col("seen")).select("v")
        degree = degree.drop("seen")
    return tri.select(triangle.columns)
