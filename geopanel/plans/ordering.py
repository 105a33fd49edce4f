"""Numbers and neighbours in one order over a whole table, without a task that holds it all.

The table is dealt to ranges of its order and written, so that ranges stay as they are; a window orders each range, and
one row a range, of which there are as many as shuffle partitions, says what lies before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geopanel.operators.work import cut

_PART = "__range"


def _ranged(df: DataFrame, by: list[str]) -> DataFrame:
    return cut(df.repartitionByRange(*by).withColumn(_PART, F.spark_partition_id()))


def _with_ranges(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.join(F.broadcast(df.sparkSession.createDataFrame(rows, schema)), _PART, "left")


def numbered(df: DataFrame, by: list[str], out: str) -> DataFrame:
    """df with the place of each row, from 0 and without gaps, in the order of the columns, which are to differ between
    rows; nulls come first."""
    r = _ranged(df, by)
    before, rows = 0, []
    for part, n in sorted(tuple(c) for c in r.groupBy(_PART).count().collect()):
        rows.append((part, before))
        before += n
    r = _with_ranges(r, rows, f"{_PART} int, __before long")
    place = F.row_number().over(Window.partitionBy(_PART).orderBy(*by)) - 1 + F.col("__before")
    return r.withColumn(out, place.cast("int")).drop(_PART, "__before")


def with_previous(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """df with the value of the row before each one in the order of the columns; the first row has null."""
    r = _ranged(df, by)
    ends = r.groupBy(_PART).agg(F.max_by(F.struct(value), F.struct(*by)).alias("last"))
    last, rows = None, []
    for part, end in sorted((c[_PART], c["last"][0]) for c in ends.collect()):
        rows.append((part, last))
        last = end
    kind = dict(df.dtypes)[value]
    r = _with_ranges(r, rows, f"{_PART} int, __last {kind}")
    w = Window.partitionBy(_PART).orderBy(*by)
    inside = F.when(F.row_number().over(w) == 1, F.col("__last")).otherwise(F.lag(value).over(w))
    return r.withColumn(out, inside).drop(_PART, "__last")
