"""Variables integrated out of a sparse precision, as joins on its coordinate form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopanel.operators.work import small, written


def marginal(precision: DataFrame, inner: DataFrame) -> DataFrame:
    """(i, j, q): the precision of the vertices of inner (v) with all others integrated out, Q_ii - Q_io Q_oo^-1 Q_oi, without
    a dense matrix. precision (i, j, q) is symmetric, holds both (i, j) and (j, i), and is positive definite; a pivot that
    is not positive is an error. Vertices of inner without an entry have none in the result; repeated entries add up.

    Each round eliminates a set of outer vertices of which no two are neighbours, so that their pivots do not depend on each
    other: those with fewer neighbours than any outer neighbour, ties by a hash. Low degrees first keep the fill small. An
    eliminated vertex of degree k sends k^2 updates; what is left of it is the fill of the result itself.
    """
    mark = inner.select(F.col("v")).distinct().withColumn("in", F.lit(True))
    e = precision.groupBy("i", "j").agg(F.sum("q").alias("q"))
    for c in ("i", "j"):
        e = e.join(mark.withColumnsRenamed({"v": c, "in": f"{c}_in"}), c, "left").withColumn(f"{c}_in", F.coalesce(f"{c}_in", F.lit(False)))
    e = written(e.select("i", "j", "q", "i_in", "j_in"))
    while True:
        outer = e.where("NOT i_in")
        # First come low degrees; the hash spreads ties, which would otherwise follow the numbers of a lattice.
        degree = outer.groupBy("i").agg(F.count(F.when(F.col("i") != F.col("j"), 1)).alias("k"))
        turn = degree.select("i", F.struct("k", F.xxhash64("i").alias("h"), "i").alias("turn"))
        beside = outer.where("NOT j_in AND i <> j").select("i", "j").join(turn.withColumnsRenamed({"i": "j", "turn": "other"}), "j")
        first = beside.groupBy("i").agg(F.min("other").alias("other"))
        chosen = written(turn.join(first, "i", "left").where("other IS NULL OR turn < other").select(F.col("i").alias("v")))
        n = chosen.count()
        if not n:
            return e.select("i", "j", "q")
        row = e.withColumnRenamed("i", "v").join(small(chosen, n), "v").select("v", "j", "q", "j_in")
        pivot = row.where("v = j").select("v", F.when(F.col("q") > 0, F.col("q")).otherwise(F.raise_error(F.lit("the precision is not positive definite"))).alias("d"))
        side = row.where("v <> j")
        a = side.select("v", F.col("j").alias("i"), F.col("q").alias("qa"), F.col("j_in").alias("i_in"))
        sent = a.join(side.join(pivot, "v"), "v").select("i", "j", (-F.col("qa") * F.col("q") / F.col("d")).alias("q"), "i_in", "j_in")
        for c in ("i", "j"):
            e = e.join(small(chosen.withColumnRenamed("v", c), n), c, "left_anti")
        e = e.select("i", "j", "q", "i_in", "j_in").unionByName(sent)
        e = written(e.groupBy("i", "j").agg(F.sum("q").alias("q"), F.first("i_in").alias("i_in"), F.first("j_in").alias("j_in")))
