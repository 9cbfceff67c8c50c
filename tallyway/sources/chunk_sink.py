"""A sink of thinned point chunks that a later run takes up where an earlier one was lost, its index, and its place in the manifest.

Chunks are written in waves. A wave replaces its own chunks' folders alone, then adds a line for each of them to the finished ones; only that
line makes a chunk finished. A run that is lost between both leaves folders that the next run replaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tallyway.operators import feeds

DATA, FINISHED = "chunks", "finished"
LINE = "chunk bigint, points bigint, ground_min double, hash string"
#: Waves of a run; what is lost with a run is one of them.
WAVES = 8
GROUND = 2


def finished(spark: SparkSession, path: str) -> DataFrame:
    """The chunks that are finished; the last line of a chunk holds. None where nothing was written yet."""
    try:
        lines = spark.read.schema(LINE + ", wave bigint").json(f"{path}/{FINISHED}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LINE)
    return lines.groupBy("chunk").agg(F.max_by(F.struct("points", "ground_min", "hash"), "wave").alias("l")).select("chunk", "l.*")


def told(rows: DataFrame) -> DataFrame:
    """What a chunk's line tells: points, the lowest ground, and a hash of its rows in any order."""
    columns = sorted(c for c in rows.columns if c != "chunk")
    low = F.round(F.min(F.when(F.col("cls") == GROUND, F.col("z"))), 3)
    return rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("points"), low.alias("ground_min"), F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).cast("string").alias("hash"))


def build(points: DataFrame, path: str, waves: int = WAVES, force: bool = False, after_data: Callable[[int], None] | None = None) -> DataFrame:
    """Writes the chunks of ``points(chunk, x, y, z, cls, ...)`` that aren't finished (all, with ``force``) and returns the finished ones.

    Rows of a large chunk are dealt to many tasks. ``after_data`` is called when a wave's folders are there and before it counts.
    """
    spark = points.sparkSession
    done = finished(spark, path)
    todo = points.filter("chunk IS NOT NULL") if force else points.join(done.select("chunk"), "chunk", "left_anti").filter("chunk IS NOT NULL")
    number = F.pmod(F.xxhash64("chunk"), F.lit(waves))
    at = spark.range(1).select(F.unix_micros(F.current_timestamp())).first()[0]
    for wave in range(waves):
        part = todo.filter(number == wave)
        chunks = [r["chunk"] for r in part.select("chunk").distinct().limit(1).collect()]
        if not chunks:
            continue
        part.hint("rebalance", "chunk").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(f"{path}/{DATA}")
        if after_data is not None:
            after_data(wave)
        own = spark.read.parquet(f"{path}/{DATA}").withColumn("chunk", F.col("chunk").cast("bigint")).filter(F.pmod(F.xxhash64("chunk"), F.lit(waves)) == wave)
        lines = told(own) if force else told(own.join(done.select("chunk"), "chunk", "left_anti"))
        lines.withColumn("wave", F.lit(at + wave)).write.mode("append").json(f"{path}/{FINISHED}")
    return finished(spark, path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, chunk and bytes of the files of finished chunks."""
    rows = spark.read.parquet(f"{path}/{DATA}").select(F.col("chunk").cast("bigint").alias("chunk"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
    return rows.distinct().join(finished(spark, path).select("chunk"), "chunk", "left_semi")


def index(spark: SparkSession, path: str) -> DataFrame:
    """A row per finished chunk with its bytes, and of all of them: how many chunks, points and bytes."""
    sizes = files(spark, path).groupBy("chunk").agg(F.sum("bytes").alias("bytes"))
    each = finished(spark, path).join(sizes, "chunk")
    total = each.agg(F.count(F.lit(1)).alias("all_chunks"), F.sum("points").alias("all_points"), F.sum("bytes").alias("all_bytes"))
    return each.crossJoin(F.broadcast(total))  # one row


def attached(manifest: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """``manifest(path, stage, rows, hash)`` with a line per finished chunk, which replaces what it said of it, and one for the index."""
    done = finished(spark, path)
    lines = done.select(F.format_string("lidar/chunk_%d", "chunk").alias("path"), F.lit("lidar").alias("stage"), F.col("points").alias("rows"), "hash")
    whole = done.agg(F.sum("points").alias("rows"), F.sum(F.xxhash64("chunk", "hash").cast("decimal(20,0)")).cast("string").alias("hash"))
    top = whole.select(F.lit("lidar/index").alias("path"), F.lit("lidar").alias("stage"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("hash", F.lit("0")).alias("hash"))
    return feeds.upserted(manifest, lines.unionByName(top), "path")
