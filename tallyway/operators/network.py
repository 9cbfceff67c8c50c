"""Building and reshaping the road network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyway.functions import geo
from tallyway.model import Grid
from tallyway.operators.iterate import cut


def ways_to_edges(ways: DataFrame, nodes: DataFrame, direction: Column) -> tuple[DataFrame, DataFrame]:
    """Directed edges between neighbouring refs of ``ways(way, refs, ...)`` whose ends are both in ``nodes(node, lon, lat)``.

    direction: 1 forward, -1 backward, 0 both. Returns edges (with src, dst, len_m and the ways' other columns) and the
    segments that lost an end. Segments of no length are dropped.
    """
    attributes = [c for c in ways.columns if c != "refs"]
    steps = F.transform(F.sequence(F.lit(1), F.size("refs") - 1), lambda i: F.struct(F.element_at("refs", i).alias("a"), F.element_at("refs", i + 1).alias("b")))
    kept = ways.filter(F.size("refs") >= 2)
    touching = kept.select("way", F.explode("refs").alias("node")).join(nodes.select("node"), "node", "left_semi").select("way").distinct()
    segments = kept.join(touching, "way", "left_semi").select(*attributes, direction.alias("direction"), F.posexplode(steps).alias("piece", "s"))
    ends = segments.select("*", F.col("s.a").alias("a"), F.col("s.b").alias("b")).drop("s")
    at = lambda c: nodes.select(F.col("node").alias(c), F.col("lon").alias(f"{c}_lon"), F.col("lat").alias(f"{c}_lat"))
    placed = ends.join(at("a"), "a", "left").join(at("b"), "b", "left")
    lost = placed.filter("a_lon IS NULL OR b_lon IS NULL").select("way", "piece", "a", "b")
    whole = placed.filter("a_lon IS NOT NULL AND b_lon IS NOT NULL").withColumn("len_m", geo.equirect_m(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"))).filter("len_m > 0")
    there, back = F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))
    arcs = F.when(F.col("direction") == 1, F.array(there)).when(F.col("direction") == -1, F.array(back)).otherwise(F.array(there, back))
    edges = whole.withColumn("arc", F.explode(arcs)).select(*attributes, "piece", "arc.src", "arc.dst", "len_m")
    return edges, lost


def with_chunks(edges: DataFrame, nodes: DataFrame, grid: Grid) -> DataFrame:
    """Adds src_chunk and dst_chunk."""
    chunk = nodes.select("node", geo.chunk_of(F.col("lon"), F.col("lat"), grid).alias("chunk"))
    a, b = (chunk.select(F.col("node").alias(c), F.col("chunk").alias(f"{c}_chunk")) for c in ("src", "dst"))
    return edges.join(a, "src").join(b, "dst")


def mirrored(edges: DataFrame) -> DataFrame:
    """Each edge once in its owner's chunk, that of its tail, and once more in its head's where that is another."""
    both = F.when(F.col("src_chunk") == F.col("dst_chunk"), F.array("src_chunk")).otherwise(F.array("src_chunk", "dst_chunk"))
    return edges.withColumn("chunk", F.explode(both)).withColumn("owned", F.col("chunk") == F.col("src_chunk"))


def chunk_index(edges: DataFrame, nodes: DataFrame, grid: Grid) -> DataFrame:
    """Per chunk its nodes, owned edges and where its contiguous ids begin.

    The running totals go over chunks, of which the grid has a fixed number, not over nodes.
    """
    at = geo.chunk_of(F.col("lon"), F.col("lat"), grid)
    n = nodes.groupBy(at.alias("chunk")).agg(F.count(F.lit(1)).alias("node_count"))
    e = edges.groupBy(F.col("src_chunk").alias("chunk")).agg(F.count(F.lit(1)).alias("edge_count"))
    both = n.join(e, "chunk", "left").select("chunk", "node_count", F.coalesce("edge_count", F.lit(0)).cast("bigint").alias("edge_count"))
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return both.select(
        "chunk", (F.col("chunk") % grid.cols).alias("cx"), F.floor(F.col("chunk") / grid.cols).alias("cy"), "node_count", "edge_count",
        F.coalesce(F.sum("node_count").over(before), F.lit(0)).alias("node_offset"), F.coalesce(F.sum("edge_count").over(before), F.lit(0)).alias("edge_offset"),
    )


def offsets(edges: DataFrame, nodes: DataFrame, grid: Grid, end: str = "src") -> DataFrame:
    """Compressed rows: for each node its chunk, edges leaving it (or, with ``end`` dst, entering) and how many come before.

    Order is by (chunk, node). Totals run within a chunk and over chunks, so no task sees all nodes.
    """
    at = nodes.select("node", geo.chunk_of(F.col("lon"), F.col("lat"), grid).alias("chunk"))
    degree = edges.groupBy(F.col(end).alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.sort_array(F.collect_list("edge")).alias("edges"))
    rows = at.join(degree, "node", "left").select("chunk", "node", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"), F.coalesce("edges", F.array().cast("array<bigint>")).alias("edges"))
    total = rows.groupBy("chunk").agg(F.sum("degree").alias("total"))
    starts = total.select("chunk", (F.sum("total").over(Window.orderBy("chunk")) - F.col("total")).alias("first"))
    within = Window.partitionBy("chunk").orderBy("node")
    return rows.join(F.broadcast(starts), "chunk").select("chunk", "node", "degree", "edges", (F.col("first") + F.sum("degree").over(within) - F.col("degree")).alias("offset"))


def block_window(lon: float, lat: float, radius: int, grid: Grid) -> tuple[int, int, int, int]:
    x = min(grid.cols - 1, max(0, int((lon - grid.west) // grid.lon_deg)))
    y = min(grid.rows - 1, max(0, int((lat - grid.south) // grid.lat_deg)))
    return max(0, x - radius), max(0, y - radius), min(grid.cols - 1, x + radius), min(grid.rows - 1, y + radius)


def in_window(chunk: Column, window: tuple[int, int, int, int], grid: Grid) -> Column:
    """Study area as a predicate on the chunk number, so that a partitioned scan is pruned by it."""
    x, y = chunk % grid.cols, F.floor(chunk / grid.cols)
    return x.between(window[0], window[2]) & y.between(window[1], window[3])


def first_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per ``key``, the first in ``order``: an edge that its own file and a neighbour's hold counts once. Combined before it is shuffled."""
    rest = [c for c in rows.columns if c != key and c not in order]
    return rows.groupBy(key).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("row")).select(*[F.col(key) if c == key else F.col(f"row.{c}").alias(c) for c in rows.columns])


def loaded(edges: DataFrame, resident: Column, other: Column) -> DataFrame:
    """Edges with an end in the area; ``boundary`` where the other end lies outside."""
    return edges.withColumns({"a_in": resident, "b_in": other}).filter("a_in OR b_in").withColumn("boundary", ~(F.col("a_in") & F.col("b_in"))).drop("a_in", "b_in")


def without_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    used = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.join(used, "node", "left_semi")


#: Attributes in which the roads of a chain are alike; those that an edge table has. Speeds may differ by less than SPEED_KPH from road to road.
ALIKE = ("class", "lanes", "speed_kph")
SPEED_KPH = 0.5


def degree_two(edges: DataFrame) -> DataFrame:
    """Per node: neighbours, whether all its roads are alike in class, lanes and speed, and whether it can be taken out of a chain.

    Speeds are alike if each road's, in the order of edge, is within SPEED_KPH of the one's before. Chains of mixed direction stay: where a node has a
    road to a neighbour, it has one back, or all its roads run one way.
    """
    same = F.struct(*[c for c in ALIKE[:2] if c in edges.columns]).alias("kind")
    speed = F.col("speed_kph") if "speed_kph" in edges.columns else F.lit(0.0)
    about = [same, speed.alias("speed"), "edge" if "edge" in edges.columns else F.lit(0).alias("edge")]
    ends = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(1).alias("out"), *about)
    ends = ends.union(edges.select(F.col("dst"), F.col("src"), F.lit(0), *about))
    per = ends.groupBy("node", "other").agg(
        F.sum("out").alias("outs"), F.count(F.lit(1)).alias("n"), F.min("kind").alias("lo"), F.max("kind").alias("hi"), F.min("speed").alias("slow"), F.max("speed").alias("fast")
    )
    seen = per.groupBy("node").agg(
        F.count(F.lit(1)).alias("neighbours"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("slow").alias("slow"), F.max("fast").alias("fast"),
        F.min("outs").alias("o1"), F.max("outs").alias("o2"), F.min("n").alias("n1"), F.max("n").alias("n2"),
        F.max((F.col("node") == F.col("other")).cast("int")).alias("loops"),
    )
    two_way = (F.col("n1") == 2) & (F.col("n2") == 2) & (F.col("o1") == 1) & (F.col("o2") == 1)
    one_way = (F.col("n1") == 1) & (F.col("n2") == 1) & (F.col("o1") == 0) & (F.col("o2") == 1)
    shape = (F.col("neighbours") == 2) & (F.col("loops") == 0) & (two_way | one_way)
    kinds, close = F.col("lo") == F.col("hi"), F.col("fast") - F.col("slow") < SPEED_KPH
    told = seen.select("node", "neighbours", kinds.alias("kinds"), close.alias("close"), shape.alias("shape"))
    if "speed_kph" in edges.columns:  # a chain's node has four roads at most, so they fit in one row
        doubtful = told.filter("kinds AND shape AND NOT close").select("node")
        in_order = ends.join(doubtful, "node", "left_semi").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("edge", "speed"))).alias("all"))
        steps = F.zip_with(F.slice("all", 2, 4), F.slice("all", 1, 4), lambda b, a: F.abs(b["speed"] - a["speed"]) < SPEED_KPH)
        stepwise = in_order.select("node", (~F.exists(steps, lambda x: F.coalesce(~x, F.lit(False)))).alias("stepwise"))
        told = told.join(stepwise, "node", "left").withColumn("close", F.col("close") | F.coalesce("stepwise", F.lit(False)))
    alike = F.col("kinds") & F.col("close")
    return told.select("node", "neighbours", alike.alias("alike"), (alike & F.col("shape")).alias("collapsible"))


def simplified(edges: DataFrame) -> DataFrame:
    """Edges with chains of collapsible nodes merged: edge (the chain's first), src, dst, the attributes, len_m, parts and shape.

    shape is the chain's nodes in order. Pointer doubling: an edge points at the edge that continues it through a collapsible
    head; each round doubles what an edge spans, so a chain of n edges takes log2 n joins. In every round some edge of a chain
    comes to its end, so when none does, what is still open are rings of collapsible nodes alone: those edges stay as they are.
    A chain that leads back to where it began would be a loop and goes.
    """
    names = [c for c in ALIKE if c in edges.columns]
    flags = degree_two(edges).filter("collapsible").select("node")
    inner = cut(edges.select("edge", "src", "dst", *names, "len_m"))
    heads = inner.join(flags.withColumnRenamed("node", "dst"), "dst", "left_semi").select("edge", "src", "dst")
    nexts = inner.join(flags.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("src").alias("dst"), F.col("edge").alias("next"), F.col("dst").alias("beyond"))
    step = heads.join(nexts, "dst").filter("beyond <> src").select("edge", "next")
    own = [F.col("dst").alias("last"), "len_m", F.lit(1).cast("bigint").alias("parts"), F.array("src", "dst").alias("shape")]
    span = cut(inner.join(step, "edge", "left").select("edge", "src", *own, "next"))
    left, before = span.filter("next IS NOT NULL").count(), -1
    while left and left != before:
        far = span.select(F.col("edge").alias("next"), *[F.col(c).alias(f"f_{c}") for c in ("last", "len_m", "parts", "shape", "next")])
        span = cut(
            span.join(far, "next", "left").select(
                "edge", "src", F.coalesce("f_last", "last").alias("last"), (F.col("len_m") + F.coalesce("f_len_m", F.lit(0.0))).alias("len_m"),
                (F.col("parts") + F.coalesce("f_parts", F.lit(0))).alias("parts"),
                F.when(F.col("f_shape").isNull(), F.col("shape")).otherwise(F.concat("shape", F.slice("f_shape", 2, F.size("f_shape")))).alias("shape"), F.col("f_next").alias("next"),
            )
        )
        left, before = span.filter("next IS NOT NULL").count(), left
    starts = inner.join(flags.withColumnRenamed("node", "src"), "src", "left_anti").select("edge")
    chains = span.join(starts, "edge", "left_semi").filter("next IS NULL AND last <> src").select("edge", "src", F.col("last").alias("dst"), "len_m", "parts", "shape")
    rings = inner.join(span.filter("next IS NOT NULL").select("edge"), "edge", "left_semi").select("edge", "src", "dst", "len_m", F.lit(1).cast("bigint").alias("parts"), F.array("src", "dst").alias("shape"))
    return chains.union(rings).join(inner.select("edge", *names), "edge").select("edge", "src", "dst", *names, "len_m", "parts", "shape")
