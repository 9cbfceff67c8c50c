"""Cutting the lineage of loop variables and sizing broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a counted side is broadcast.
BROADCAST_ROWS = 1_000_000


def shared(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. On one machine alone it may be unset; then it is temporary."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a count shows that it is small enough; else Spark shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
