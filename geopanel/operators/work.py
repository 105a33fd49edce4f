"""Work tables between the rounds of an operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table that may be broadcast, after they have been counted.
SMALL = 50_000


def shared(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, for tables that driver and executors share.

    A local session without one gets a folder of its own; on a cluster, whose executors would not share it, that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None)
        if own is None and not str(sc.master).startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(own or os.path.join(tempfile.gettempdir(), "geopanel-checkpoints"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, for loops whose rounds join a table with itself: with
    checkpoints such rounds got slower and slower, probably because a checkpoint keeps what its plan estimates."""
    path = f"{shared(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, which has so many rows, marked for a broadcast if they are few."""
    return F.broadcast(df) if rows <= SMALL else df
