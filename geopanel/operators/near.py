"""Nearest neighbours and radius joins of two point tables, exact, by joins on cells.

The nearest: a quadtree is fitted to the right table, whose crowded cells are split, four by four, until each holds few
points. Left points start at the root and descend a step a round. The counts and bounding boxes of a point's cells bound the
distance of its k-th neighbour; cells beyond that bound are dropped, so that every point is left with the few leaves around
it, however dense or sparse the place. Bounds and distances are computed by the same monotone steps: ties are never lost.

Within a radius: cells as wide as the radius, each left point in the three by three around its own; cells with many right
points are dealt in parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geopanel.operators.work import cut, small

#: Points of a leaf, unless more lie in a cell of the last level, which divides the frame 2^LEVELS times.
LEAF, LEVELS = 32, 30
#: Levels of a step.
STEP = 2
#: Right points of a cell that are compared in one part.
PART = 4096
_CELL = ["level", "cx", "cy"]
_BOX = ["xlo", "xhi", "ylo", "yhi"]


def _placed(df: DataFrame, id_col: str) -> DataFrame:
    """id, x, y of the points with finite coordinates; negative zeros are zeros."""
    rows = df.select(F.col(id_col).alias("id"), *[(F.col(c).cast("double") + F.lit(0.0)).alias(c) for c in ("x", "y")])
    return rows.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('infinity')" for c in ("x", "y")))


def _up(c: str, levels) -> Column:
    return F.shiftright(F.col(c), levels) if isinstance(levels, int) else F.expr(f"shiftright({c}, {levels})")


def _boxes() -> list[Column]:
    return [f(lo).alias(n) for n, f, lo in (("xlo", F.min, "xlo"), ("xhi", F.max, "xhi"), ("ylo", F.min, "ylo"), ("yhi", F.max, "yhi"))]


def quadtree(points: DataFrame, leaf: int = LEAF) -> tuple[DataFrame, DataFrame, dict[int, int]] | None:
    """(nodes, points, levels) of the cells over points (id, x, y), or None without points.

    nodes: level, cx, cy, n, the box of its points, and whether it is a leaf. points: with the cell of their leaf. levels:
    the number of nodes by level. Counting starts at the level where a leaf is full on average; crowded cells go on, one
    level step and one aggregation of their points at a time, and coarser levels add up finer ones.
    """
    box = points.agg(F.count("*").alias("n"), F.min("x").alias("x"), F.max("x").alias("xhi"), F.min("y").alias("y"), F.max("y").alias("yhi")).first()
    if not box.n:
        return None
    size = max(box.xhi - box.x, box.yhi - box.y) or 1.0
    last = (1 << LEVELS) - 1

    def at(c: str, lo: float) -> Column:
        return F.least(F.lit(last), F.floor((F.col(c) - lo) / size * (last + 1))).cast("int")

    rest = cut(points.withColumns({"fx": at("x", box.x), "fy": at("y", box.y)}))
    level, n = 0, box.n
    while n > leaf and level + STEP <= LEVELS:
        n, level = n / 4**STEP, level + STEP
    first, nodes, leaves, levels = level, [], [], {}
    while True:
        here = rest.withColumns({"level": F.lit(level), "cx": _up("fx", LEVELS - level), "cy": _up("fy", LEVELS - level)})
        cells = here.groupBy(*_CELL).agg(F.count("*").alias("n"), F.min("x").alias("xlo"), F.max("x").alias("xhi"), F.min("y").alias("ylo"), F.max("y").alias("yhi"))
        cells = cut(cells.withColumn("leaf", (F.col("n") <= leaf) | F.lit(level + STEP > LEVELS)))
        counts = cells.agg(F.count("*").alias("n"), F.count_if(~F.col("leaf")).alias("more")).first()
        nodes.append(cells)
        levels[level] = counts.n
        if not counts.more:
            leaves.append(here)
            break
        crowded = small(cells.where("NOT leaf").select(*_CELL), counts.more)
        leaves.append(here.join(crowded, _CELL, "left_anti"))
        rest = cut(here.join(crowded, _CELL, "left_semi").drop(*_CELL))
        level += STEP
    if first:
        up = nodes[0].withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(first - STEP), F.lit(STEP))))
        up = up.select(F.col("to").alias("level"), *[F.expr(f"shiftright({c}, {first} - to)").alias(c) for c in ("cx", "cy")], "n", *_BOX)
        up = cut(up.groupBy(*_CELL).agg(F.sum("n").alias("n"), *_boxes()).withColumn("leaf", F.lit(False)))
        levels |= {r.level: r["count"] for r in up.groupBy("level").count().collect()}
        nodes.append(up)
    table, held = nodes[0], leaves[0]
    for more in nodes[1:]:
        table = table.unionByName(more)
    for more in leaves[1:]:
        held = held.unionByName(more)
    return table, held.drop("fx", "fy"), levels


def nearest(left: DataFrame, right: DataFrame, k: int = 1, left_id: str = "id", right_id: str = "id", leaf: int = LEAF) -> DataFrame:
    """(left_id, rank, right_id, d): the k nearest right points of each left point by Euclidean distance, ties to the
    smaller id; all of them where there are fewer.

    Both tables have columns x and y. Points without finite coordinates take no part. Left rows at one place are searched
    once, and each has its rows in the result, repeated rows once; of right points at one place only the k smallest ids can
    be among the nearest and are kept. Ids keep their types.
    """
    a, b = _placed(left, left_id), _placed(right, right_id).where("id IS NOT NULL").distinct()
    at_place = Window.partitionBy("x", "y").orderBy("id")
    b = b.withColumn("r", F.row_number().over(at_place)).where(F.col("r") <= k).drop("r")
    tree = quadtree(b, max(leaf, k))
    out = a.sparkSession.createDataFrame([], f"left_id {a.schema['id'].dataType.simpleString()}, rank int, right_id {b.schema['id'].dataType.simpleString()}, d double")
    if tree is None:
        return out
    nodes, points, levels = tree
    x, y = F.col("px"), F.col("py")
    low = [F.greatest(F.col(f"{c}lo") - p, p - F.col(f"{c}hi"), F.lit(0.0)) for c, p in (("x", x), ("y", y))]
    high = [F.greatest(F.abs(p - F.col(f"{c}lo")), F.abs(p - F.col(f"{c}hi"))) for c, p in (("x", x), ("y", y))]
    by_reach = Window.partitionBy("px", "py").orderBy("reach", *_CELL).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("px", "py")

    def pruned(pairs: DataFrame) -> DataFrame:
        """Without the cells beyond the distance within which the cells of a point surely hold k points."""
        bound = F.min(F.when(F.col("held") >= k, F.col("reach"))).over(whole)
        pairs = pairs.withColumn("held", F.sum("n").over(by_reach)).withColumn("bound", bound)
        return pairs.where("bound IS NULL OR near <= bound").drop("held", "bound")

    seen = ["px", "py", *_CELL, "n", "leaf", "near", "reach"]
    root = nodes.where("level = 0")
    places = a.select(F.col("x").alias("px"), F.col("y").alias("py")).distinct()
    pairs = places.withColumns({"level": F.lit(0), "cx": F.lit(0), "cy": F.lit(0)}).join(F.broadcast(root), _CELL)  # one node
    pairs = pairs.withColumns({"near": F.lit(0.0), "reach": F.lit(float("inf"))}).select(*seen)
    for rounds, level in enumerate(sorted(levels)[1:], 1):
        kids = nodes.where(F.col("level") == level).withColumnsRenamed({"cx": "kx", "cy": "ky", "n": "kn", "leaf": "kleaf"}).drop("level")
        kids = small(kids.withColumns({"cx": _up("kx", STEP), "cy": _up("ky", STEP)}), levels[level])
        open_ones = pairs.where(f"NOT leaf AND level = {level - STEP}").select("px", "py", "cx", "cy").join(kids, ["cx", "cy"])
        near, reach = low[0] * low[0] + low[1] * low[1], high[0] * high[0] + high[1] * high[1]
        found = open_ones.select("px", "py", F.lit(level).alias("level"), F.col("kx").alias("cx"), F.col("ky").alias("cy"), F.col("kn").alias("n"), F.col("kleaf").alias("leaf"), near.alias("near"), reach.alias("reach"))
        pairs = pruned(pairs.where("leaf").unionByName(found))
        if rounds % 3 == 0 or level == max(levels):
            pairs = cut(pairs)
    met = pairs.select("px", "py", *_CELL).join(points.select(*_CELL, "id", "x", "y"), _CELL)
    met = met.select("px", "py", F.col("id").alias("right_id"), F.sqrt((x - F.col("x")) * (x - F.col("x")) + (y - F.col("y")) * (y - F.col("y"))).alias("d"))
    best = met.withColumn("rank", F.row_number().over(whole.orderBy("d", "right_id"))).where(F.col("rank") <= k)
    rows = a.select(F.col("id").alias("left_id"), F.col("x").alias("px"), F.col("y").alias("py")).distinct()
    return rows.join(best, ["px", "py"]).select("left_id", F.col("rank").cast("int").alias("rank"), "right_id", "d")


def within(left: DataFrame, right: DataFrame, radius: float, left_id: str = "id", right_id: str = "id") -> DataFrame:
    """(left_id, right_id, d): all pairs of a left and a right point at most the radius apart.

    Both tables have columns x and y. Points without finite coordinates take no part; repeated rows give repeated pairs.
    Coordinates may reach a thousand million radii.
    """
    if radius < 0:
        raise ValueError("a radius is not negative")
    # A little wider than the radius, so that rounding cannot put two near points two cells apart.
    side = radius * (1 + 1e-6) or 1.0
    a, b = _placed(left, left_id), _placed(right, right_id)
    cell = {"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)}
    b = b.select(F.col("id").alias("right_id"), F.col("x").alias("qx"), F.col("y").alias("qy"), *[v.alias(c) for c, v in cell.items()])
    crowded = cut(b.groupBy("cx", "cy").count().where(F.col("count") > PART).select("cx", "cy", F.ceil(F.col("count") / PART).cast("int").alias("parts")))
    n = crowded.count()
    a = a.withColumns(cell)
    for c in ("cx", "cy"):
        a = a.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    if n:
        b = b.join(small(crowded, n), ["cx", "cy"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("right_id", "qx", "qy"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
        a = a.join(small(crowded, n), ["cx", "cy"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    d = F.sqrt((F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy")))
    met = a.join(b, ["cx", "cy", "part"] if n else ["cx", "cy"]).withColumn("d", d).where(F.col("d") <= radius)
    return met.select(F.col("id").alias("left_id"), "right_id", "d")
