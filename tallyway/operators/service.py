"""What-if edits of transit service: routes taken out and patterns added, folded into calls and headways."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyway.functions import geo

#: Metres a second of a vehicle of an added pattern, between stops in a straight line.
RIDE_MPS = 5.5
ADD, REMOVE = "AddPattern", "RemoveRoute"


def folded(edits: DataFrame) -> DataFrame:
    """The last of ``edits(seq, op, route, stops, headway_s)`` of each route, wherever rows lie; an edit replaces any earlier one of its route."""
    return edits.filter("route IS NOT NULL").groupBy("route").agg(F.max_by(F.struct("seq", "op", "stops", "headway_s"), "seq").alias("e")).select("route", "e.*")


def faults(edits: DataFrame, nodes: DataFrame, routes: DataFrame) -> DataFrame:
    """seq and reason of folded edits that can't be done: an unknown route to remove, no headway, fewer than two stops, or stops that aren't nodes."""
    last = folded(edits)
    gone = last.filter(F.col("op") == REMOVE).join(routes.select("route").distinct(), "route", "left_anti").select("seq", F.lit("no such route").alias("reason"))
    added = last.filter(F.col("op") == ADD)
    idle = added.filter("headway_s IS NULL OR headway_s <= 0").select("seq", F.lit("no headway").alias("reason"))
    short = added.filter(F.coalesce(F.size("stops"), F.lit(0)) < 2).select("seq", F.lit("fewer than two stops").alias("reason"))
    stops = added.select("seq", F.explode("stops").alias("node"))
    unknown = stops.join(nodes.select("node"), "node", "left_anti").select("seq").distinct().select("seq", F.lit("a stop is missing").alias("reason"))
    return gone.unionByName(idle).unionByName(short).unionByName(unknown)


def added(edits: DataFrame, nodes: DataFrame, speed_mps: float = RIDE_MPS) -> DataFrame:
    """Calls of the patterns that edits add: pattern (the edit's seq), route, seq, node, along_s and headway_s.

    Stops are in the edit's order, which posexplode keeps with each; the way between neighbours is a straight line. Where a stop isn't a node, the ride is
    broken there: node is null, and time goes on after it as if nothing lay between.
    """
    last = folded(edits).filter((F.col("op") == ADD) & (F.col("headway_s") > 0) & (F.size("stops") >= 2))
    each = last.select("seq", "route", "headway_s", F.posexplode("stops").alias("place", "stop"))
    at = each.join(nodes.select(F.col("node").alias("stop"), "node", "lon", "lat"), "stop", "left")
    way = Window.partitionBy("seq").orderBy("place")
    metres = geo.equirect_m(F.lag("lon").over(way), F.lag("lat").over(way), F.col("lon"), F.col("lat"))
    run = at.withColumn("hop_s", F.coalesce(metres / speed_mps, F.lit(0.0)))
    return run.select(F.col("seq").alias("pattern"), "route", F.col("place").alias("seq"), "node", F.sum("hop_s").over(way).alias("along_s"), "headway_s")


def edited(calls: DataFrame, edits: DataFrame, nodes: DataFrame, first: int, speed_mps: float = RIDE_MPS) -> DataFrame:
    """``calls(pattern, route, seq, node, along_s, headway_s)`` under ``edits``: removed routes go, added patterns follow from number ``first`` on.

    A route that is added to keeps its own patterns; one that was removed after it was added to loses both.
    """
    gone = folded(edits).filter(F.col("op") == REMOVE).select("route")
    new = added(edits, nodes, speed_mps).withColumn("pattern", F.col("pattern") + first)
    names = ["pattern", "route", "seq", "node", "along_s", "headway_s"]
    return calls.join(gone, "route", "left_anti").select(*names).unionByName(new.select(*names))


def boardable(calls: DataFrame) -> DataFrame:
    """Calls as ``transit.ridden`` takes them: a boarding waits half a headway."""
    return calls.select("pattern", "seq", "node", (F.col("headway_s") / 2).alias("wait_s"), "along_s")
