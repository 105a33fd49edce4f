"""Points in the polygons of a table, by a quadtree of cells fitted to it.

A row of the table may hold many polygons; each goes its own way, so that the work spreads over tasks. A polygon starts in the
cells, as wide as it is, that its box touches. Cells with many edges of a row are split, a step of levels a round, and keep
only the edges that can matter to points inside: those that meet the cell, and those to its right that end between its lower
and upper side. Edges that pass on its right from below to above are counted. A cell that no edge of a polygon meets is wholly
inside, and its points are accepted without an edge test and whatever the row's other polygons, or outside, and dropped. Of rows
with very many polygons some come first, and the others are fitted only where the cells of those are not wholly inside. Places
meet cells by equality at each level that the table has, once however many points share them; the polygons never pass through the
driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopanel.functions import geo
from geopanel.operators.work import cut, small

#: Edges of a cell that is not split, levels of a step, and steps at most below a polygon's first cells.
EDGES, STEP, STEPS = 16, 2, 6
LEVELS = 28
#: Polygons of a row that come first, about, and cells wholly inside that may be broadcast to leave out the others.
FIRST, NARROW = 256, 500_000
_KEY = ["level", "cx", "cy"]
_ROW, _PART = "__row", "__part"


def _edges(polygon: Column) -> Column:
    """The edges of all rings of a polygon."""

    def edges(ring: Column) -> Column:
        return F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))

    return F.flatten(F.transform(polygon, edges))


def _sides(e: Column) -> Column:
    """The edge with the least and greatest of its cross products with the corners of the cell xl, xh, yl, yh: where their
    signs agree, the line of the edge passes the cell."""
    corners = [(e["x2"] - e["x1"]) * (F.col(py) - e["y1"]) - (e["y2"] - e["y1"]) * (F.col(px) - e["x1"]) for px in ("xl", "xh") for py in ("yl", "yh")]
    return F.struct(e.alias("e"), F.least(*corners).alias("lo"), F.greatest(*corners).alias("hi"))


def _kind(s: Column, slack: float) -> Column:
    """The edge of _sides and what it is to the cell: 0 nothing, 1 counted, 2 kept for its end, 3 met."""
    e, xl, xh, yl, yh = s["e"], *(F.col(c) for c in ("xl", "xh", "yl", "yh"))
    tiny = slack * (F.abs(e["x2"] - e["x1"]) + F.abs(e["y2"] - e["y1"]))
    bottom, top, right = F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]), F.greatest(e["x1"], e["x2"])
    up, flat, beside = e["y2"] > e["y1"], bottom == top, F.least(e["x1"], e["x2"]) > xh
    below, above = s["hi"] < -tiny, s["lo"] > tiny
    # The cell is left of an upward edge, or of a downward one, whose products have the other sign.
    cell_left = beside | F.when(up, above).otherwise(below)
    kind = F.when((top < yl) | (bottom > yh) | (right < xl), 0).when(flat, F.when(beside, 0).otherwise(3)).when(cell_left, F.when((bottom < yl) & (top > yh), 1).otherwise(2))
    return F.struct(e.alias("e"), kind.when(F.when(up, below).otherwise(above), 0).otherwise(3).alias("k"))


def _crossings(edges: Column, px: Column, py: Column) -> Column:
    return F.aggregate(edges, F.lit(0), lambda a, e: a + geo.crosses(px, py, e["x1"], e["y1"], e["x2"], e["y2"]))


def _box_cells(part: DataFrame, level: Column, frame: tuple[float, float, float], slack: float) -> DataFrame:
    """part with level and a row for each cell of that level that its box touches."""
    part = part.withColumn("level", level.cast("int"))
    scale = F.pow(F.lit(2.0), F.col("level"))
    for c, o in (("x", frame[0]), ("y", frame[1])):
        lo, hi = (F.least(scale - 1, F.floor((F.col(f"b{c}{k}") + s * slack - o) / frame[2] * scale)).cast("int") for k, s in ((0, -1), (1, 1)))
        part = part.withColumn(f"c{c}", F.explode(F.sequence(F.greatest(F.lit(0), lo), F.greatest(F.lit(0), hi))))
    return part


def _fit(todo: DataFrame, frame: tuple[float, float, float], slack: float, edges: int, within: tuple | None, spread: int) -> tuple[list[DataFrame], list[DataFrame], dict[int, int], int]:
    """Of (row, level, cx, cy, base, edges), a row a polygon and cell: tables of cells wholly inside, tables of other cells with
    their parts, cells a level, and the number of the former."""
    full, met, rows, n_full = [], [], {}, 0
    for step in range(STEPS + 1):
        side = F.lit(frame[2]) / F.pow(F.lit(2.0), F.col("level"))
        sides = {f"{c}{n}": o + (F.col(f"c{c}") + k) * side + s * slack for c, o in (("x", frame[0]), ("y", frame[1])) for n, k, s in (("l", 0, -1), ("h", 1, 1))}
        kinds = F.transform(F.transform("edges", _sides), lambda e: _kind(e, slack))
        # An array of one, exploded, so that filters below do not evaluate it again.
        here = todo.withColumns(sides)
        if within:
            here = here.where((F.col("xh") >= within[0]) & (F.col("xl") <= within[1]) & (F.col("yh") >= within[2]) & (F.col("yl") <= within[3]))
        here = here.withColumn("kinds", F.explode(F.array(kinds))).drop("edges")
        near = F.transform(F.filter("kinds", lambda e: e["k"] >= 2), lambda e: e["e"])
        here = here.withColumns({"base": F.col("base") + F.size(F.filter("kinds", lambda e: e["k"] == 1)), "met": F.exists("kinds", lambda e: e["k"] == 3), "edges": near})
        mx, my = (F.col("xl") + F.col("xh")) / 2, (F.col("yl") + F.col("yh")) / 2
        inside = ~F.col("met") & ((F.col("base") + _crossings(F.col("edges"), mx, my)) % 2 == 1)
        here = cut(here.select(_ROW, *_KEY, "base", "edges", "met", inside.alias("full")).where("full OR met"))
        cells = here.groupBy(_ROW, *_KEY).agg(F.max("full").alias("full"), F.sum(F.size("edges")).alias("n"))
        more = ~F.col("full") & (F.col("n") > edges) & F.lit(step < STEPS)
        cells = cut(cells.withColumn("more", more))
        counts = {(r.level, r.full, r.more): r["count"] for r in cells.groupBy("level", "full", "more").count().collect()}
        for (at, inside_, more_), n in counts.items():
            rows[at] = rows.get(at, 0) + (0 if more_ else n)
            n_full += n if inside_ else 0
        full.append(cells.where("full").select(_ROW, *_KEY))
        open_ = here.where("NOT full").drop("full", "met")
        leaf, n_leaf = cells.where("NOT full AND NOT more").select(_ROW, *_KEY), sum(n for (_, f, m), n in counts.items() if not f and not m)
        met.append(open_.join(small(leaf, n_leaf), [_ROW, *_KEY]).groupBy(_ROW, *_KEY).agg(F.collect_list(F.struct("base", "edges")).alias("parts")))
        n_more = sum(n for (_, _, m), n in counts.items() if m)
        if not n_more:
            break
        todo = open_.join(small(cells.where("more").select(_ROW, *_KEY), n_more), [_ROW, *_KEY]).repartition(spread)
        grid = F.sequence(F.lit(0), F.lit((1 << STEP) - 1))
        for c in ("cx", "cy"):
            todo = todo.withColumn("k", F.explode(grid)).withColumn(c, (F.col(c) * (1 << STEP) + F.col("k")).cast("int")).drop("k")
        todo = todo.withColumn("level", F.col("level") + STEP)
    return full, met, rows, n_full


class Regions:
    """The cells of a polygon table: (row, level, cx, cy, full, parts), the other columns of its rows, and the frame in which
    places find their cells. Cells of a row may lie in each other."""

    def __init__(self, cells: DataFrame, levels: list[int], rows: int, frame: tuple[float, float, float], table: DataFrame, n: int):
        self.cells, self.levels, self.rows, self.frame, self.table, self.n = cells, levels, rows, frame, table, n

    @staticmethod
    def of(polygons: DataFrame, edges: int = EDGES, first: int = FIRST, within: tuple | None = None) -> Regions | None:
        """Fit to a table (poly_id, name, geom), geom a polygon column; rows without polygons hold no point. None if none do.
        within, the least and greatest x, then y, of the places to come, leaves out cells beyond them."""
        table = cut(polygons.where(F.size("geom") > 0).withColumn(_ROW, F.monotonically_increasing_id()))
        flat = F.flatten(F.flatten("geom"))
        xs, ys = F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"])
        ends = [f(F.array_min(v) if f is F.min else F.array_max(v)).alias(n) for f, v, n in ((F.min, xs, "x0"), (F.max, xs, "x1"), (F.min, ys, "y0"), (F.max, ys, "y1"))]
        got = table.agg(*ends, F.count("*").alias("n"), F.max(F.size("geom")).alias("most"), F.sum(F.size(flat)).alias("corners")).first()
        if got.x0 is None:
            return None
        box = tuple(got)[:4]
        size = max(got.x1 - got.x0, got.y1 - got.y0) or 1.0
        frame = (got.x0, got.y0, size)
        # Wider than the rounding of a coordinate's cell.
        slack = 1e-13 * max(abs(v) for v in (*box, size))
        spread = min(int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + got.corners // 2_000)
        part = table.select(_ROW, F.size("geom").alias("n"), F.explode("geom").alias("polygon")).repartition(spread)
        at = F.flatten("polygon")
        xs, ys = F.transform(at, lambda p: p["x"]), F.transform(at, lambda p: p["y"])
        part = part.select(_ROW, "n", _edges(F.col("polygon")).alias("edges"), F.array_min(xs).alias("bx0"), F.array_max(xs).alias("bx1"), F.array_min(ys).alias("by0"), F.array_max(ys).alias("by1"))
        part = cut(part.withColumn(_PART, F.monotonically_increasing_id())).where("bx0 IS NOT NULL")
        wide = F.greatest(F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0"))
        top = LEVELS - STEP * STEPS
        level = F.when(wide > 0, F.greatest(F.lit(0), F.least(F.lit(top), F.floor(F.lit(math.log2(size)) - F.log2(wide))))).otherwise(top)
        ahead = (F.col("n") <= first) | (F.pmod(F.xxhash64("edges"), F.ceil(F.col("n") / first)) == 0)
        start = [_ROW, *_KEY, F.lit(0).alias("base"), "edges"]
        full, met, rows, n_full = _fit(_box_cells(part.where(ahead), level, frame, slack).select(*start), frame, slack, edges, within, spread)
        if got.most > first:
            held = full[0]
            for f in full[1:]:
                held = held.unionByName(f)
            rest = _box_cells(part.where(~ahead).drop("edges"), level + 2 * STEP, frame, slack).select(_ROW, _PART, *_KEY)
            if within:
                for c, o, k in (("cx", frame[0], 0), ("cy", frame[1], 2)):
                    side = F.lit(size) / F.pow(F.lit(2.0), F.col("level"))
                    rest = rest.where((o + (F.col(c) + 1) * side + slack >= within[k]) & (o + F.col(c) * side - slack <= within[k + 1]))
            for lv in sorted(rows):
                up = {c: F.when(F.col("level") >= lv, F.expr(f"shiftright({c}, level - {lv})")) for c in ("cx", "cy")}
                there = held.where(F.col("level") == lv).select(_ROW, F.col("cx").alias("ux"), F.col("cy").alias("uy"))
                rest = rest.withColumns({"ux": up["cx"], "uy": up["cy"]}).join(F.broadcast(there) if n_full <= NARROW else there, [_ROW, "ux", "uy"], "left_anti").drop("ux", "uy")
            rest = cut(rest).drop(_ROW).join(part.select(_ROW, _PART, "edges"), _PART).select(*start).repartition(spread)
            later = _fit(rest, frame, slack, edges, within, spread)
            full, met = full + later[0], met + later[1]
            for lv, n in later[2].items():
                rows[lv] = rows.get(lv, 0) + n
        cells = None
        for f in full:
            f = f.select(_ROW, *_KEY, F.lit(True).alias("full"))
            cells = f if cells is None else cells.unionByName(f)
        for m in met:
            cells = cells.unionByName(m.withColumn("full", F.lit(False)), allowMissingColumns=True)
        return Regions(cut(cells), sorted(k for k, v in rows.items() if v), sum(rows.values()), frame, table.drop("geom"), got.n)

    def join(self, points: DataFrame, boundary: bool = True) -> DataFrame:
        """points (x, y, ..) with the other columns of the polygons that hold them, one row a point and polygon.

        A point on the boundary of a polygon, holes included, is in it if the boundary counts, and in none of those it is on
        otherwise. Points without coordinates are in none.
        """
        x0, y0, size = self.frame
        points = points.withColumns({"__x": F.col("x").cast("double"), "__y": F.col("y").cast("double")})
        x, y = F.col("__x"), F.col("__y")
        slack = 1e-13 * max(abs(v) for v in (x0, y0, x0 + size, y0 + size, size))
        inner = points.where(x.between(x0 - slack, x0 + size + slack) & y.between(y0 - slack, y0 + size + slack))
        at = inner.select("__x", "__y").distinct()
        at = at.withColumn("level", F.explode(F.array(*[F.lit(v) for v in self.levels])))
        scale = F.pow(F.lit(2.0), F.col("level"))
        for c, v, o in (("cx", x, x0), ("cy", y, y0)):
            at = at.withColumn(c, F.greatest(F.lit(0), F.least(scale - 1, F.floor((v - o) / size * scale))).cast("int"))
        met = at.join(small(self.cells, self.rows), _KEY)

        def holds(p: Column) -> Column:
            odd = (p["base"] + _crossings(p["edges"], x, y)) % 2 == 1
            edge = F.exists(p["edges"], lambda e: geo.on_edge(x, y, e["x1"], e["y1"], e["x2"], e["y2"]))
            return (odd | edge) if boundary else (odd & ~edge)

        hits = met.where(F.col("full") | F.exists("parts", holds)).select("__x", "__y", _ROW).distinct()
        return inner.join(hits.join(small(self.table, self.n), _ROW).drop(_ROW).hint("merge"), ["__x", "__y"]).drop("__x", "__y")
