"""One object over a study area: network, trips, timetable and counts are given once, hours are run and asked about after."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tallyway import model
from tallyway.operators import assign, feeds, scenario, transit
from tallyway.operators.iterate import shared
from tallyway.settings import Settings

log = logging.getLogger("tallyway")

SOLVED = ["edge", "src", "dst", "len_m", "free_s", "capacity_vph", "open"]


@contextmanager
def timed(spark: SparkSession, stage: str) -> Iterator[None]:
    """Logs how long the block took, also where it fails; Spark shows its jobs under the name of the stage."""
    context, began = spark.sparkContext, time.monotonic()
    before = context.getLocalProperty("spark.job.description")
    context.setLocalProperty("spark.job.description", stage)
    try:
        yield
    except BaseException:
        log.error("%s failed after %.1f s", stage, time.monotonic() - began)
        raise
    finally:
        context.setLocalProperty("spark.job.description", before)
    log.info("%s took %.1f s", stage, time.monotonic() - began)


@dataclass
class Engine:
    """``edges`` of a network with src, dst and attributes, ``nodes(node, lon, lat)``, ``trips(hour, origin, dest, trips)`` between nodes.

    For reach: ``walks(src, dst, cost)``, ``calls(pattern, seq, node, wait_s, along_s)`` and ``homes(node, trips)``. For calibration:
    ``stations(station_id, edge, aadt)``. What isn't given raises where it is asked for. Hours that were run are files in the shared folder.
    """

    edges: DataFrame
    nodes: DataFrame
    trips: DataFrame
    walks: DataFrame | None = None
    calls: DataFrame | None = None
    homes: DataFrame | None = None
    stations: DataFrame | None = None
    settings: Settings = field(default_factory=Settings)
    recorded: dict[int, DataFrame] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    def run_hour(self, hour: int, edits: DataFrame | None = None, additions: DataFrame | None = None) -> DataFrame:
        """edge, len_m, free_s, capacity_vph, open, volume and hour at equilibrium. A run without edits is recorded; one with them starts from it."""
        if not 0 <= hour < 24:
            raise ValueError("an hour is 0 to 23")
        changed = edits is not None or additions is not None
        edges = self.edges
        if edits is not None:
            edges = scenario.changed(edges, edits, additions)
        elif additions is not None:
            edges = edges.select(*SOLVED).unionByName(additions.select(*SOLVED))
        with timed(self.spark, f"hour {hour}" + ", edited" * changed):
            trips = self.trips.filter(self.trips["hour"] == hour).drop("hour")
            found = assign.equilibrium(edges, trips, self.recorded.get(hour) if changed else None, self.settings.iterations, self.settings.gap)
            volumes = found.frame(self.nodes, hour)
            return volumes if changed else self.record(hour, volumes)

    def record(self, hour: int, volumes: DataFrame) -> DataFrame:
        """Keeps the volumes of an hour, instead of what was kept of it before."""
        path = f"{shared(self.spark)}/hour-{hour}-{uuid.uuid4().hex}"
        volumes.write.parquet(path)
        self.recorded[hour] = self.spark.read.parquet(path)
        return self.recorded[hour]

    def day(self) -> DataFrame:
        """Volumes of all hours that are recorded."""
        if not self.recorded:
            raise ValueError("no hour was run")
        return reduce(DataFrame.unionByName, self.recorded.values())

    def kpis(self) -> DataFrame:
        """Vehicle miles, vehicle hours and mean delay of each recorded hour."""
        return assign.kpis(self.day(), "hour")

    def calibration(self) -> tuple[DataFrame, DataFrame]:
        """Counts beside the recorded hours' daily volumes, a row per station, and how well they fit."""
        if self.stations is None:
            raise ValueError("no stations were given")
        rows = feeds.calibration(self.stations, feeds.modelled_daily(self.day(), model.hour_shares(self.spark)))
        return rows, feeds.fit(rows)

    def isochrone(self, starts: DataFrame, minutes: float, ride: bool = True) -> DataFrame:
        """origin, node and seconds within the minutes from ``starts(origin, node, cost)``; on foot alone without ``ride`` or without a timetable."""
        if self.walks is None:
            raise ValueError("no walks were given")
        with timed(self.spark, "isochrone"):
            return transit.isochrone(self.walks, self.calls if ride else None, starts, minutes * 60.0)

    def reach_summary(self, labels: DataFrame) -> DataFrame:
        """People and zones that each origin reaches."""
        if self.homes is None:
            raise ValueError("no homes were given")
        return transit.reached_people(labels, self.homes)
