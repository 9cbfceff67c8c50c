"""Sinks: chunked networks, feature lines, audit tables and the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyway.operators import feeds


def chunked(edges: DataFrame, path: str) -> None:
    """One folder per chunk, so that a study area reads its own chunks only."""
    edges.repartition("chunk").sortWithinPartitions("chunk", "edge").write.mode("overwrite").partitionBy("chunk").parquet(path)


def feature_lines(points: DataFrame, path: str) -> None:
    """Point features, a JSON document per line; all columns but lon and lat are properties."""
    rest = [c for c in points.columns if c not in ("lon", "lat")]
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    points.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*rest).alias("properties"))).alias("value")).write.mode("overwrite").text(path)


def feature_shapes(rows: DataFrame, shape: str, path: str, closed: bool = False) -> None:
    """Lines, or with ``closed`` polygons of one ring, of ``shape`` (array of structs lon, lat), a JSON document per line; the other columns are properties.

    A ring ends where it begins, whether or not its last corner says so.
    """
    rest = [c for c in rows.columns if c != shape]
    corners = F.transform(shape, lambda p: F.array(p["lon"], p["lat"]))
    ring = F.when(F.element_at(corners, 1) == F.element_at(corners, -1), corners).otherwise(F.concat(corners, F.slice(corners, 1, 1)))
    geometry = F.struct(F.lit("Polygon" if closed else "LineString").alias("type"), (F.array(ring) if closed else corners).alias("coordinates"))
    kept = rows.filter(F.size(shape) >= (3 if closed else 2))
    kept.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*rest).alias("properties"))).alias("value")).write.mode("overwrite").text(path)


def zones_csv(zones: DataFrame, path: str) -> None:
    six = lambda c: F.format_string("%.6f", c).alias(c)
    zones.select("zone", six("lon"), six("lat")).write.mode("overwrite").option("header", True).csv(path)


def manifest(spark_files: DataFrame, old: DataFrame | None, path: str) -> DataFrame:
    """Merges the listed files (path, stage, rows, hash) into the manifest and writes it; returns what it holds now."""
    merged = spark_files if old is None else feeds.upserted(old, spark_files, "path")
    merged.write.mode("overwrite").json(path)
    return merged


def content_hash(rows: DataFrame) -> DataFrame:
    """Rows and an order-free hash of a table, by which a stage sees whether its input changed."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*rows.columns).cast("decimal(20,0)")).cast("string").alias("hash"))
