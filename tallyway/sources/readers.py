"""Readers of the input formats; all through Spark's own sources, so any file system that Spark knows will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyway.functions import geo, roads
from tallyway.operators import network

FEATURES = "features array<struct<properties: map<string,string>, geometry: string>>"


def features(spark: SparkSession, folder: str, *layers: str) -> DataFrame:
    """Features of paged GeoJSON layers: properties (map) and geometry (JSON text). A layer may be sharded as name and name_*.

    Pages are whole documents, each parsed in one task; a broken page yields nothing.
    """
    paths = [f"{folder}/{{{name},{name}_*}}/*" for name in layers]
    schema = T.StructType([T.StructField("features", T.ArrayType(T.StructType([T.StructField("properties", T.MapType(T.StringType(), T.StringType())), T.StructField("geometry", T.StringType())])))])
    pages = spark.read.schema(schema).option("multiLine", True).json(paths)
    return pages.select(F.explode("features").alias("f")).select("f.properties", "f.geometry")


def number(properties: Column, name: str) -> Column:
    """A numeric property, whether or not it is quoted."""
    return F.trim(F.try_element_at(properties, F.lit(name))).try_cast("double")


def text(properties: Column, name: str) -> Column:
    """A text property, trimmed; empty is null."""
    return F.nullif(F.trim(F.try_element_at(properties, F.lit(name))), F.lit(""))


def first_point(geometry: Column) -> Column:
    """The first position in a geometry of any nesting, as struct lon, lat."""
    pair = F.regexp_extract(geometry, r"\[\s*(-?[0-9.eE+-]+\s*,\s*-?[0-9.eE+-]+)", 1)
    lon, lat = (F.trim(F.try_element_at(F.split(pair, ","), F.lit(i))).try_cast("double") for i in (1, 2))
    return F.when(lon.isNotNull() & lat.isNotNull(), F.struct(lon.alias("lon"), lat.alias("lat")))


def points(geometry: Column) -> Column:
    """All positions of a geometry of any nesting, in the order of the document, as an array of structs lon, lat; empty without coordinates."""
    pair = r"\[\s*(-?[0-9.]+(?:[eE][+-]?[0-9]+)?)\s*,\s*(-?[0-9.]+(?:[eE][+-]?[0-9]+)?)"
    told = F.coalesce(F.get_json_object(geometry, "$.coordinates"), F.lit(""))
    lon, lat = (F.regexp_extract_all(told, F.lit(pair), F.lit(k)) for k in (1, 2))
    return F.zip_with(lon, lat, lambda x, y: F.struct(x.try_cast("double").alias("lon"), y.try_cast("double").alias("lat")))


def census_csv(spark: SparkSession, path: str, **columns: str) -> DataFrame:
    """Gzipped or plain CSV: ``name=type`` columns found by header, whatever its case. Rows in which one doesn't parse are skipped."""
    raw = spark.read.option("header", True).csv(path)
    by = {c.lower(): c for c in raw.columns}
    if missing := [c for c in columns if c.lower() not in by]:
        raise ValueError(f"columns {missing} are not in {path}")
    return raw.select(*[F.col(f"`{by[c.lower()]}`").try_cast(t).alias(c) for c, t in columns.items()]).dropna()


def timetables(spark: SparkSession, folders: dict[str, str]) -> dict[str, DataFrame]:
    """trips, stop_times, stops and calendar of unpacked timetable feeds, ids prefixed by agency. Absent files are skipped."""
    found: dict[str, DataFrame] = {}
    for agency, folder in folders.items():
        for table in ("trips", "stop_times", "stops", "calendar", "routes"):
            try:
                rows = spark.read.option("header", True).csv(f"{folder}/{table}.txt")
            except Exception as error:  # noqa: BLE001
                if "PATH_NOT_FOUND" not in str(error):
                    raise
                continue
            ids = {c: F.concat(F.lit(f"{agency}:"), F.col(c)) for c in rows.columns if c.endswith("_id")}
            rows = rows.withColumns(ids)
            found[table] = found[table].unionByName(rows, allowMissingColumns=True) if table in found else rows
    return found


def runs_on_weekdays(trips: DataFrame, calendar: DataFrame) -> DataFrame:
    """Trips whose service runs on Monday, Tuesday or Wednesday; a service without a calendar runs."""
    days = calendar.select("service_id", ((F.col("monday") == 1) | (F.col("tuesday") == 1) | (F.col("wednesday") == 1)).alias("runs"))
    return trips.join(days, "service_id", "left").filter(F.coalesce("runs", F.lit(True))).drop("runs")


def seconds_of(clock: Column) -> Column:
    """Seconds of a h:mm:ss clock that may pass 24 hours."""
    part = lambda i: F.try_element_at(F.split(clock, ":"), F.lit(i)).try_cast("int")
    return part(1) * 3600 + part(2) * 60 + part(3)


def roads_of(nodes: DataFrame, ways: DataFrame, box: tuple[float, float, float, float], keep_service: bool = False) -> tuple[DataFrame, DataFrame]:
    """Edges and lost segments of extracted ``nodes(node, lon, lat)`` and ``ways(way, refs, tags)`` inside the box."""
    inside = nodes.filter(geo.in_box(F.col("lon"), F.col("lat"), box))
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    name = roads.highway_name(tag("highway"))
    open_ = ~F.coalesce(tag("access").isin("no", "private"), F.lit(False))
    kept = ways.filter(name.isNotNull() & open_ & (F.lit(keep_service) | (name != "service")))
    known = kept.select("way", "refs", name.alias("class_name"), tag("lanes").try_cast("int").alias("lanes"), roads.max_speed_kph(tag("maxspeed")).alias("speed_kph"), roads.one_way(tag("oneway")).alias("way_direction"))
    return network.ways_to_edges(known, inside, F.col("way_direction"))


def in_file_order(raw: DataFrame) -> DataFrame:
    """``raw``, as a text source reads it, with place: file, split and row within it, in the order in which the files have the rows.

    Rows of a split are read one after the other by one task, so the number that grows within the task orders them; files are ordered by path.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    return raw.select("*", place.alias("place"))


def block_positions(spark: SparkSession, path: str) -> DataFrame:
    """block, lon and lat from a census crosswalk (columns tabblk2020, blklatdd, blklondd in any case and place); the last row of a block holds.

    Rows of which one doesn't parse are skipped, and don't replace an earlier one. A file without one of the columns is an error.
    """
    raw = in_file_order(spark.read.option("header", True).csv(path))
    by = {c.strip().lower(): c for c in raw.columns}
    wanted = {"block": ("tabblk2020", "bigint"), "lat": ("blklatdd", "double"), "lon": ("blklondd", "double")}
    if missing := [c for c, _ in wanted.values() if c not in by]:
        raise ValueError(f"columns {missing} are not in {path}")
    rows = raw.select("place", *[F.trim(F.col(f"`{by[c]}`")).try_cast(t).alias(n) for n, (c, t) in wanted.items()]).dropna()
    return rows.groupBy("block").agg(F.max_by(F.struct("lon", "lat"), "place").alias("at")).select("block", "at.lon", "at.lat")


def manifest(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """The manifest's lines and its hash, which names what was made from it; lines in another order are the same manifest."""
    lines = spark.read.json(path)
    row = lines.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(F.to_json(F.struct(*sorted(lines.columns)))).cast("decimal(20,0)")).alias("h")).first()
    return lines, f"{int(row['h'] or 0) % 2**64:016x}-{row['n']}"


def chunked_network(spark: SparkSession, path: str, index: DataFrame, chunks: list[int] | None = None) -> DataFrame:
    """The edges of all chunks of a network that ``writers.chunked`` wrote, or of some, whose folders alone are read.

    ``index(chunk, edge_count)`` says what must be there: a chunk with more or fewer edges is an error, found when the rows are.
    """
    rows = spark.read.parquet(path).withColumn("chunk", F.col("chunk").cast("bigint"))
    asked = index if chunks is None else index.filter(F.col("chunk").isin(chunks))
    rows = rows if chunks is None else rows.filter(F.col("chunk").isin(chunks))
    counted = rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).join(asked.select("chunk", "edge_count"), "chunk", "full")
    bad = counted.filter("coalesce(n, 0) <> coalesce(edge_count, 0)").orderBy("chunk").limit(1).collect()
    if bad:
        raise ValueError(f"chunk {bad[0]['chunk']} has {bad[0]['n'] or 0} edges and not {bad[0]['edge_count'] or 0}")
    return rows


def cloud_index(texts: DataFrame) -> DataFrame:
    """cx, cy, bytes, points and ground_min of each chunk that the index in ``texts(value)`` names, one document a row.

    Lenient, as others write it: chunks are under ``chunks`` or at the top; keys are ``x_y``, with or without folder, ``chunk_`` and ``.bin``; keys of
    another form and entries that are no objects are passed over; numbers that are none are 0. Keys that name the same chunk: the last in the order of keys holds.
    """
    value = F.try_parse_json("value")
    table = F.coalesce(F.try_variant_get(value, "$.chunks", "map<string,variant>"), F.try_variant_get(value, "$", "map<string,variant>"))
    each = texts.select(F.explode(table).alias("key", "entry"))
    place = r"(?:^|/)(?:chunk_)?(\d+)_(\d+)(?:\.bin)?$"
    number = lambda name: F.when(F.schema_of_variant(F.try_variant_get("entry", f"$.{name}", "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL.*)$"), F.try_variant_get("entry", f"$.{name}", "double"))
    rows = each.filter(F.col("key").rlike(place) & F.schema_of_variant("entry").startswith("OBJECT")).select(
        "key", *[F.regexp_extract("key", place, g).try_cast("bigint").alias(c) for g, c in ((1, "cx"), (2, "cy"))],
        F.coalesce(number("bytes"), F.lit(0)).cast("bigint").alias("bytes"), F.coalesce(number("points"), F.lit(0)).cast("bigint").alias("points"),
        F.coalesce(number("ground_min"), number("groundMin"), F.lit(0.0)).alias("ground_min"),
    )
    return rows.groupBy("cx", "cy").agg(F.max_by(F.struct("bytes", "points", "ground_min"), "key").alias("e")).select("cx", "cy", "e.*")
