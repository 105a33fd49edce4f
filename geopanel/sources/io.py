"""Dataset registry, readers with missing-value tokens, and run logs."""

from __future__ import annotations

import datetime as dt
import os
import platform
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name -> path of a parquet table; fill with register().
_KNOWN: dict[str, str] = {}


def register(name: str, path: str) -> None:
    _KNOWN[name] = path


def load_dataset(spark: SparkSession, name: str) -> DataFrame:
    if name not in _KNOWN:
        raise ValueError(f"unknown dataset {name!r}; known: {', '.join(sorted(_KNOWN)) or 'none'}")
    return spark.read.parquet(_KNOWN[name])


def list_datasets(spark: SparkSession) -> DataFrame:
    """(name, path, columns) of the registered tables."""
    rows = [(n, p, ", ".join(spark.read.parquet(p).columns)) for n, p in sorted(_KNOWN.items())]
    return spark.createDataFrame(rows, "name string, path string, columns string")


def read_csv(spark: SparkSession, path: str, na_values: Sequence[str] = ("", "NA", "NaN", "null"), ts: str | None = None, fmt: str | None = None, schema: str | None = None) -> DataFrame:
    """A CSV with a header; any of the tokens, trimmed, is missing. Without a schema, text is cast where all values allow
    it as numbers when used. ts is parsed by fmt, unreadable times are NULL."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    tokens = list(na_values)
    out = raw.select(*[F.when(F.trim(F.col(f"`{c}`")).isin(tokens), None).otherwise(F.col(f"`{c}`")).alias(c) for c in raw.columns])
    if ts:
        out = out.withColumn(ts, F.try_to_timestamp(F.col(ts), F.lit(fmt)) if fmt else F.try_to_timestamp(F.col(ts)))
    if schema:
        for part in schema.split(","):
            name, kind = part.split()
            out = out.withColumn(name, F.col(name).try_cast(kind))
    return out


def points_from_columns(df: DataFrame, lon: str, lat: str) -> DataFrame:
    return df.withColumns({"x": F.col(lon).cast("double"), "y": F.col(lat).cast("double")})


def write_table(df: DataFrame, path: str, fmt: str = "parquet", by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite").format(fmt)
    (w.partitionBy(*by) if by else w).option("header", True).save(path)


def hardware(spark: SparkSession) -> dict[str, str]:
    sc = spark.sparkContext
    return {"system": platform.platform(), "python": platform.python_version(), "spark": spark.version, "master": sc.master, "parallelism": str(sc.defaultParallelism), "driver_cpus": str(os.cpu_count())}


def append_log(path: str, summary: str, mode: str = "a") -> None:
    with open(path, mode) as f:
        f.write(f"{dt.datetime.now(dt.timezone.utc):%Y-%m-%d %H:%M:%S} UTC\n{summary}\n\n")
