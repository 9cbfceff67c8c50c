"""What maps and panels ask of results: areas, boxes, colours, joins with geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyway import model
from tallyway.functions import geo
from tallyway.model import Grid


def major_in_view(edges: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Roads of the major classes whose first point lies in the box (west, south, east, north)."""
    west, south, east, north = box
    return edges.filter(F.col("class").isin(*model.MAJOR_CLASSES) & F.col("a_lon").between(west, east) & F.col("a_lat").between(south, north))


def with_geometry(results: DataFrame, edges: DataFrame) -> DataFrame:
    """Results by edge next to the ends of their road; results without a road go."""
    return results.join(edges.select("edge", "a_lon", "a_lat", "b_lon", "b_lat"), "edge")


def interpolated(value: Column, stops: tuple[tuple[float, tuple[int, int, int]], ...]) -> Column:
    """A colour (r, g, b) between those of the stops beside ``value``, each part rounded half up; beyond the ends, theirs."""
    colour = lambda parts: F.struct(*[p.cast("int").alias(c) for p, c in zip(parts, "rgb", strict=True)])
    plain = lambda rgb: colour([F.lit(p) for p in rgb])
    out = F.when(value <= stops[0][0], plain(stops[0][1]))
    for (low, one), (high, two) in zip(stops, stops[1:]):
        t = (value - low) / (high - low)
        out = out.when(value <= high, colour([F.floor(a + (b - a) * t + 0.5) for a, b in zip(one, two, strict=True)]))
    return out.when(value.isNotNull(), plain(stops[-1][1]))


def chunks_in_view(views: DataFrame, chunks: DataFrame, grid: Grid) -> DataFrame:
    """view and chunk for each of ``chunks(chunk)`` whose cell overlaps the box of ``views(view, west, south, east, north)``.

    A box is cut into the cells that it touches, so the overlap is an equi-join.
    """
    span = lambda low, high: F.explode(F.sequence(low, high))
    cells = views.withColumn("cx", span(geo.cell_x(F.col("west"), grid), geo.cell_x(F.col("east"), grid)))
    cells = cells.withColumn("cy", span(geo.cell_y(F.col("south"), grid), geo.cell_y(F.col("north"), grid)))
    inside = (F.col("east") >= grid.west) & (F.col("west") <= grid.west + grid.cols * grid.lon_deg) & (F.col("north") >= grid.south) & (F.col("south") <= grid.south + grid.rows * grid.lat_deg)
    return cells.filter(inside).withColumn("chunk", F.col("cy") * grid.cols + F.col("cx")).join(chunks.select("chunk"), "chunk").select("view", "chunk")


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """What a new area has to load and what it can free: ``key`` and action."""
    load = new.select(key).distinct().join(old.select(key), key, "left_anti").withColumn("action", F.lit("load"))
    free = old.select(key).distinct().join(new.select(key), key, "left_anti").withColumn("action", F.lit("free"))
    return load.union(free)


def file_counts(mirrored: DataFrame) -> DataFrame:
    """Per chunk's file of ``network.mirrored`` edges: ghost nodes (ends of another chunk) and border edges (ends in two chunks)."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("src_chunk").alias("home")), F.struct(F.col("dst").alias("node"), F.col("dst_chunk").alias("home"))))
    nodes = mirrored.select("chunk", ends.alias("e")).select("chunk", "e.node", "e.home").distinct()
    ghosts = nodes.groupBy("chunk").agg(F.count_if(F.col("home") != F.col("chunk")).alias("ghost_nodes"))
    border = mirrored.groupBy("chunk").agg(F.count_if(F.col("src_chunk") != F.col("dst_chunk")).alias("border_edges"))
    return ghosts.join(border, "chunk").select("chunk", "ghost_nodes", "border_edges")


def contiguous_ids(nodes: DataFrame) -> DataFrame:
    """``nodes(chunk, node)`` numbered from 0 by chunk and node; a total over chunks gives where each begins, so no task sees all nodes."""
    sizes = nodes.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("chunk", (F.sum("n").over(Window.orderBy("chunk")) - F.col("n")).alias("first"))
    within = F.row_number().over(Window.partitionBy("chunk").orderBy("node")) - 1
    return nodes.join(F.broadcast(starts), "chunk").select("chunk", "node", (F.col("first") + within).alias("id"))


def above_ground(points: DataFrame, grounds: DataFrame) -> DataFrame:
    """Heights of points over the lowest ground of their chunk; null where it has none."""
    return points.join(F.broadcast(grounds.select("chunk", "ground_min")), "chunk", "left").withColumn("height", F.col("z") - F.col("ground_min")).drop("ground_min")
