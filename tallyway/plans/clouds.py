"""Queries over point clouds, octree, chunk sink and its index, and over the grid of chunks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyway.functions import geo
from tallyway.operators import feeds, network, octree
from tallyway.operators.iterate import shared
from tallyway.plans.derive import CHUNKS, Town
from tallyway.plans.register import query, rounded
from tallyway.sources import chunk_sink

#: The returns lie within it; a small span, so that some hundred points make several levels.
ROOT, DEPTH = octree.Root(-1.0, -1.0, -1.0, 2.0, span=4), 6
BOX = octree.Box(-0.1, -0.2, 0.2, 0.05)
DENSITY = 60.0
CLASSES = (1, 2, 3, 4, 5)

_AT = lambda c, most: f"CAST(least(greatest(floor(({c}+1)*({most})/2),0),({most})-1) AS BIGINT)"
_CELL = lambda d: ", ".join(_AT(c, f"4*(1<<({d}))") for c in "xyz")
_STEP = "(2.0::DOUBLE/(1<<{0}.depth))"


def _overlap(t: str) -> str:
    step = _STEP.format(t)
    return f"-1+{step}*{t}.kx<{BOX.x1} AND -1+{step}*({t}.kx+1)>{BOX.x0} AND -1+{step}*{t}.ky<{BOX.y1} AND -1+{step}*({t}.ky+1)>{BOX.y0}"


#: All points placed level by level, then the walk down from the root.
_WALK = f""", store AS (SELECT *, 0 AS depth, row_number() OVER (PARTITION BY {_CELL(0)} ORDER BY vec_id)=1 AS placed FROM returns
    UNION ALL SELECT vec_id, x, y, z, cls, depth+1, row_number() OVER (PARTITION BY {_CELL('depth+1')} ORDER BY vec_id)=1 OR depth+1={DEPTH} FROM store WHERE NOT placed),
    held AS (SELECT *, {', '.join(f"{_AT(c, '1<<depth')} AS k{c}" for c in 'xyz')} FROM store WHERE placed),
    tree AS (SELECT depth, kx, ky, kz, count(*) AS n FROM held GROUP BY ALL),
    walk AS (SELECT * FROM tree WHERE depth=0 UNION ALL SELECT t.* FROM walk w JOIN tree t ON t.depth=w.depth+1 AND t.kx//2=w.kx AND t.ky//2=w.ky AND t.kz//2=w.kz WHERE {_overlap('t')})"""


def _store(t: Town) -> DataFrame:
    return octree.built(t.returns, ROOT, DEPTH, "vec_id")


@query(f"{_WALK} SELECT CAST(depth AS INT) AS depth, kx, ky, kz, n FROM walk", "returns")
def octree_descent(t: Town) -> DataFrame:
    """Nodes over a box of the map, down to the deepest level."""
    return octree.descended(octree.hierarchy(_store(t)), ROOT, BOX, DEPTH)


@query(
    f"""{_WALK} SELECT vec_id, round(x,6) AS x, round(y,6) AS y, round(z,6) AS z, CAST(cls AS INT) AS cls, CAST(h.depth AS INT) AS depth FROM held h JOIN walk w USING (depth, kx, ky, kz)
    WHERE h.depth<={ROOT.depth_for(DENSITY)} AND x>={BOX.x0} AND x<{BOX.x1} AND y>={BOX.y0} AND y<{BOX.y1} AND cls IN {CLASSES}""",
    "returns",
)
def octree_points(t: Town) -> DataFrame:
    """Points of the box at a density, read from a store through the nodes that the descent found."""
    path = f"{shared(t.spark)}/octree-{uuid.uuid4().hex}"
    octree.written(_store(t), f"{path}/store")
    store = t.spark.read.parquet(f"{path}/store")
    keys = octree.descended(octree.hierarchy(store), ROOT, BOX, ROOT.depth_for(DENSITY))
    points = octree.read_nodes(store, octree.keys_written(keys, f"{path}/keys"), BOX, CLASSES)
    return rounded(points.select("vec_id", "x", "y", "z", "cls", "depth"))


def _sunk(t: Town) -> str:
    path = f"{shared(t.spark)}/cloud-{uuid.uuid4().hex}"
    chunk_sink.build(t.returns.withColumn("chunk", F.col("vec_id") % 16), path)
    return path


@query("SELECT vec_id%16 AS chunk, count(*) AS points, round(min(CASE WHEN cls=2 THEN z END),3) AS ground_min, (SELECT count(DISTINCT vec_id%16) FROM returns) AS all_chunks, (SELECT count(*) FROM returns) AS all_points FROM returns GROUP BY 1", "returns")
def cloud_index(t: Town) -> DataFrame:
    """The index of chunks that were written to the shared folder."""
    return chunk_sink.index(t.spark, _sunk(t)).select("chunk", "points", "ground_min", "all_chunks", "all_points")


@query(
    """SELECT path, stage, rows FROM (SELECT 'lidar/chunk_'||vec_id%16 AS path, 'lidar' AS stage, count(*) AS rows FROM returns GROUP BY 1 UNION ALL SELECT 'lidar/index', 'lidar', count(*) FROM returns
    UNION ALL SELECT 'graph/'||n_nationkey, 'graph', n_nationkey FROM nation)""",
    "returns",
)
def cloud_attached(t: Town) -> DataFrame:
    """A manifest of the graph's files and an outdated chunk, after the chunks were attached."""
    k = F.col("n_nationkey").cast("bigint")
    line = lambda path, stage, rows: [path.alias("path"), F.lit(stage).alias("stage"), rows.alias("rows"), F.lit("0").alias("hash")]
    old = t.table("nation").select(*line(F.concat(F.lit("graph/"), k.cast("string")), "graph", k))
    stale = t.table("nation").filter("n_nationkey = 3").select(*line(F.concat(F.lit("lidar/chunk_"), k.cast("string")), "lidar", F.lit(-1).cast("bigint")))
    return chunk_sink.attached(old.unionByName(stale), t.spark, _sunk(t)).select("path", "stage", "rows")


_SIDES = (("c0", "west", "lon", 0), ("r0", "south", "lat", 0), ("c1", "west", "lon", 1), ("r1", "south", "lat", 1))


def _corner_sql(name: str, low: str, axis: str, upper: int) -> str:
    size, most = (CHUNKS.lon_deg, CHUNKS.cols) if axis == "lon" else (CHUNKS.lat_deg, CHUNKS.rows)
    raw = f"((({axis}{upper})-({getattr(CHUNKS, low)!r}::DOUBLE))/{size!r}::DOUBLE)"
    return f"CAST(least(greatest(CASE WHEN abs({raw}-floor({raw}+0.5))<1e-9 THEN floor({raw}+0.5)-{upper} ELSE floor({raw}) END,0),{most - 1}) AS BIGINT) AS {name}"


@query(
    f"""SELECT part, {', '.join(_corner_sql(*s) for s in _SIDES)} FROM (SELECT p_partkey AS part, {CHUNKS.west!r}::DOUBLE+(p_partkey%23)*{CHUNKS.lon_deg!r}::DOUBLE AS lon0, {CHUNKS.south!r}::DOUBLE+(p_partkey%19-1)*{CHUNKS.lat_deg!r}::DOUBLE/2 AS lat0,
    {CHUNKS.west!r}::DOUBLE+(p_partkey%23+p_size%4+1)*{CHUNKS.lon_deg!r}::DOUBLE AS lon1, {CHUNKS.south!r}::DOUBLE+(p_partkey%19+p_size%5)*{CHUNKS.lat_deg!r}::DOUBLE/2 AS lat1 FROM part)"""
)
def window_cells(t: Town) -> DataFrame:
    """The cells that a window of each part takes; many corners lie on a boundary, some beyond the grid."""
    k, size = F.col("p_partkey"), F.col("p_size")
    lon, lat = (lambda i: F.lit(CHUNKS.west) + i * F.lit(CHUNKS.lon_deg)), (lambda i: F.lit(CHUNKS.south) + i * F.lit(CHUNKS.lat_deg) / 2)
    c0, r0, c1, r1 = geo.window_cells(lon(k % 23), lat(k % 19 - 1), lon(k % 23 + size % 4 + 1), lat(k % 19 + size % 5), CHUNKS)
    return t.table("part").select(k.alias("part"), c0.alias("c0"), r0.alias("r0"), c1.alias("c1"), r1.alias("r1"))


@query("SELECT edge, min(chunk) AS chunk, count(*) AS files FROM (SELECT edge, src_chunk AS chunk FROM placed UNION ALL SELECT edge, dst_chunk FROM placed WHERE src_chunk<>dst_chunk) GROUP BY edge", "placed")
def edges_once(t: Town) -> DataFrame:
    """Each edge once, from the first of the files that hold it, and how many do."""
    placed = network.with_chunks(t.edges, t.nodes, CHUNKS)
    held = placed.select("edge", F.explode(F.array_distinct(F.array("src_chunk", "dst_chunk"))).alias("chunk"))
    files = held.groupBy("edge").agg(F.count(F.lit(1)).alias("files"))
    return network.first_wins(held, "edge", "chunk").join(files, "edge").select("edge", "chunk", "files")


@query("SELECT min(yr) AS first_year, max(yr) AS last_year FROM crashes", "crashes")
def crash_years(t: Town) -> DataFrame:
    return feeds.year_range(t.crashes)
