"""The feeds' mergeable aggregates on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyway.functions import geo
from tallyway.model import Grid
from tallyway.operators import feeds


def files(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def hourly_cells(crashes: DataFrame, grid: Grid, late: str = "1 hour") -> DataFrame:
    """Crashes per hour of event time and cell. ``late``: how long an hour stays open. Works on batches alike."""
    x, y = geo.cell_x(F.col("lon"), grid), geo.cell_y(F.col("lat"), grid)
    timed = crashes.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 hour").alias("w"), x.alias("cx"), y.alias("cy")).agg(F.count(F.lit(1)).alias("n"), F.sum("severity").cast("bigint").alias("severity_sum")).select(F.col("w.start").alias("hour"), "cx", "cy", "n", "severity_sum")


def keep_cells(crashes: DataFrame, grid: Grid, table: str, checkpoint: str) -> StreamingQuery:
    """Keeps the table of cells up to date: each batch is summed and merged into it, then the stream ends with its input.

    A batch writes a folder of its number, replaced if it runs twice, so sums never count it twice.
    """

    def merge(batch: DataFrame, number: int) -> None:
        feeds.crash_cells(batch, grid).select("cx", "cy", "n", "severity_sum").write.mode("overwrite").parquet(f"{table}/batch={number}")

    return crashes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cells(spark: SparkSession, table: str) -> DataFrame:
    """The table that ``keep_cells`` keeps."""
    return spark.read.parquet(table).groupBy("cx", "cy").agg(F.sum("n").alias("n"), F.sum("severity_sum").alias("severity_sum"))


def thinned(points: DataFrame, cell: float) -> DataFrame:
    """Surface thinning as a running aggregate (update mode)."""
    return feeds.thinned(points, cell)
