"""Reading tables, cutting lineage and naming columns, shared by the operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a side is broadcast after it has been measured; beyond, Spark shuffles both sides.
BROADCAST_BYTES = 32 << 20


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of the folder; whatever file system the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. On one machine alone it may be unset; then it is temporary."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as files in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path inside the shared folder."""
    import uuid

    base = shared_dir(spark)
    return f"{base}/{name}-{uuid.uuid4().hex}" if urlparse(base).scheme else f"file://{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: ``cut`` for wide or many rows, in less room."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its values have ``most`` bytes at most; one aggregate measures them."""
    sizes = {"string": lambda c: F.octet_length(c), "binary": lambda c: F.octet_length(c), "array": lambda c: 8 * F.greatest(F.size(c), F.lit(0))}
    width = sum((F.coalesce(sizes.get(f.dataType.typeName(), lambda c: F.lit(0))(F.col(f.name)), F.lit(0)) + 8 for f in df.schema), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(width.cast("bigint")).alias("n")).first()["n"] or 0) <= most else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for the row, however often ``body`` mentions it."""
    return F.transform(F.array(value), lambda x: body(x))[0]
