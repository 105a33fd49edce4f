"""Missing values are NULL inside the engine; NaN and infinities become NULL on the way in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NULL for NaN and infinities."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def safe_ln(c: Column) -> Column:
    return F.when(c > 0, F.ln(c))


def safe_sqrt(c: Column) -> Column:
    return F.when(c >= 0, F.sqrt(c))


def std_of_variance(v: Column) -> Column:
    """Square root of a variance; rounding noise down to -1e-8 counts as zero, anything below is missing."""
    return F.when(v >= -1e-8, F.sqrt(F.greatest(v, F.lit(0.0))))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return F.when(b != 0, a / b)


def missing(*cols: Column) -> Column:
    """True where any of the columns is NULL, NaN or infinite."""
    out = F.lit(False)
    for c in cols:
        out = out | finite(c).isNull()
    return out
