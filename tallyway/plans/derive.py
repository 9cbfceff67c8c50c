"""Domain relations derived from the driver's tables; the only place that knows their names."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyway import model
from tallyway.functions import geo, roads
from tallyway.model import Grid

WEST, SOUTH, EAST, NORTH = model.STUDY_BBOX
CHUNKS = Grid.cover(model.STUDY_BBOX, model.CHUNK_CELL_M)
CRASHES = Grid.cover(model.STUDY_BBOX, model.CRASH_CELL_M)


@dataclass
class Town:
    """The relations of one data folder."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def side(self) -> int:
        """Nodes along a side of the lattice; it grows with the customers."""
        n = self.table("customer").agg(F.max("c_custkey")).first()[0] or 0
        return max(2, int(-(-((n + 1) ** 0.5) // 1)))

    @property
    def nodes(self) -> DataFrame:
        """A node per customer, in rows of a lattice over the study box."""
        k, s = F.col("c_custkey"), self.side
        ix, iy = k % s, F.floor(k / s)
        at = lambda low, span, i: F.lit(low) + F.lit(span) * i / (s - 1)
        return self.table("customer").select(k.alias("node"), ix.alias("ix"), iy.alias("iy"), at(WEST, 0.5, ix).alias("lon"), at(SOUTH, 0.46, iy).alias("lat"), F.col("c_nationkey").cast("bigint").alias("nation"), F.col("c_acctbal").alias("balance"))

    @property
    def edges(self) -> DataFrame:
        """Roads to the neighbours on the lattice that exist, both ways. edge = 4 * src + direction; lengths are jittered so that no two paths tie."""
        s = self.side
        steps = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(x).alias("x"), F.lit(y).alias("y")) for d, (x, y) in enumerate([(-1, 0), (1, 0), (0, -1), (0, 1)])])
        out = self.nodes.select(F.col("node").alias("src"), "ix", "iy", F.col("lon").alias("a_lon"), F.col("lat").alias("a_lat"), F.explode(steps).alias("s"))
        aimed = out.withColumns({"jx": F.col("ix") + F.col("s.x"), "jy": F.col("iy") + F.col("s.y")}).filter((F.col("jx") >= 0) & (F.col("jx") < s) & (F.col("jy") >= 0))
        aimed = aimed.withColumn("dst", F.col("jy") * s + F.col("jx"))
        heads = self.nodes.select(F.col("node").alias("dst"), F.col("lon").alias("b_lon"), F.col("lat").alias("b_lat"))
        line = F.when(F.col("s.y") == 0, F.col("iy")).otherwise(F.col("ix"))
        kind = F.when(line % 6 == 0, 0).when(line % 3 == 0, 2).when(line % 2 == 0, 3).otherwise(5)
        edge = (F.col("src") * 4 + F.col("s.d")).alias("edge")
        m = geo.equirect_m(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat")) + F.lit(0.1) * ((F.col("src") * 4 + F.col("s.d")) * 7919 % 97)
        return aimed.join(heads, "dst").select(edge, "src", "dst", kind.alias("class"), m.alias("len_m"), "a_lon", "a_lat", "b_lon", "b_lat")

    @property
    def network(self) -> DataFrame:
        """Edges with attributes and free-flow times."""
        full = roads.with_defaults(self.edges, model.road_classes(self.spark))
        return full.withColumn("free_s", roads.free_flow_s(F.col("len_m"), F.col("speed_kph"))).withColumn("open", F.lit(True))

    @property
    def zones(self) -> DataFrame:
        k = F.col("n_nationkey")
        return self.table("nation").select(k.cast("bigint").alias("zone"), (F.lit(WEST) + F.lit(0.5) * (k * 37 % 100) / 100.0).alias("lon"), (F.lit(SOUTH) + F.lit(0.46) * (k * 61 % 100) / 100.0).alias("lat"))

    @property
    def commutes(self) -> DataFrame:
        line, orders = self.table("lineitem"), self.table("orders")
        both = line.join(orders, line["l_orderkey"] == orders["o_orderkey"])
        homes = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("bigint").alias("origin"))
        works = self.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("bigint").alias("dest"))
        return both.join(homes, "o_custkey").join(works, "l_suppkey").select("origin", "dest", F.col("l_quantity").alias("trips"))

    @property
    def crashes(self) -> DataFrame:
        u, e = F.col("user_id"), F.col("event_id")
        kind = F.col("event_type")
        severity = F.when(kind == "error", 5).when(kind == "purchase", 4).when(kind == "signup", 3).when(kind == "click", 2).otherwise(1)
        return self.table("events").select(e.alias("crash_id"), "ts", (F.lit(WEST) + F.lit(0.5) * (u * 37 % 150) / 150.0 + F.lit(0.0012) * (e % 3)).alias("lon"), (F.lit(SOUTH) + F.lit(0.46) * (u * 61 % 150) / 150.0 + F.lit(0.0009) * (e % 2)).alias("lat"), F.year("ts").cast("bigint").alias("yr"), severity.alias("severity"))

    @property
    def stations(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.table("supplier").select(k.alias("station_id"), F.abs("s_acctbal").alias("aadt"), (F.lit(WEST) + F.lit(0.5) * (k * 4937 % 10000) / 10000.0).alias("lon"), (F.lit(SOUTH) + F.lit(0.46) * (k * 3571 % 10000) / 10000.0).alias("lat"))

    @property
    def stop_times(self) -> DataFrame:
        from pyspark.sql import Window

        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
        k = F.col("l_orderkey")
        arrive = (k * 137 % 93600 + 300 * F.col("l_linenumber") + F.col("l_quantity")).cast("double")
        return self.table("lineitem").select(k.alias("trip"), F.row_number().over(w).alias("seq"), (F.col("l_suppkey") % 4).alias("stop"), arrive.alias("arrive_s"))

    @property
    def told_times(self) -> DataFrame:
        """Stop times of which some arrivals and some departures aren't told."""
        arrival, departure = F.when(F.col("seq") % 3 != 0, F.col("arrive_s")), F.when(F.col("seq") % 4 != 1, F.col("arrive_s") + 20.0)
        return self.stop_times.select("trip", "seq", "stop", arrival.alias("arrival_s"), departure.alias("departure_s"))

    @property
    def departures(self) -> DataFrame:
        return self.table("orders").select((F.col("o_custkey") % 50).alias("pattern"), F.col("o_orderkey").alias("trip"), (F.col("o_orderkey") * 137 % 93600).cast("double").alias("depart_s"))

    @property
    def parcels(self) -> DataFrame:
        k = F.col("p_partkey")
        names = F.array(*[F.lit(c) for c in model.ZONE_CATEGORIES], F.lit("R-3"))
        return self.table("part").select(k.alias("parcel_id"), F.element_at(names, (k % 8).cast("int") + 1).alias("zone"), F.col("p_type").alias("land_use"), (F.lit(100.0) * F.col("p_size")).alias("area_m2"))

    @property
    def assessments(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_partkey").alias("parcel_id"), F.year("l_shipdate").cast("bigint").alias("yr"), F.col("l_extendedprice").alias("total"), "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")

    @property
    def returns(self) -> DataFrame:
        e = lambda k: F.element_at("embedding", k).cast("double")
        return self.table("embeddings").select("vec_id", e(1).alias("x"), e(2).alias("y"), e(3).alias("z"), F.col("label").alias("cls"))

    @property
    def edits(self) -> DataFrame:
        """A what-if edit per order, on an edge that may or may not exist."""
        k = F.col("o_orderkey")
        kind = F.when(k % 5 == 0, "close").otherwise("set")
        return self.table("orders").select(
            k.alias("seq"), kind.alias("type"), (k * 7919 % (4 * self.side * self.side + 40)).alias("edge"),
            F.when((k % 5 != 0) & (k % 2 == 0), (k % 4 + 1).cast("int")).alias("lanes"), F.when((k % 5 != 0) & (k % 3 == 0), (30 + k % 60).cast("double")).alias("speed_kph"),
            F.when((k % 5 != 0) & (k % 7 == 0), (500 + k % 3000).cast("double")).alias("capacity_vph"),
        )

    @property
    def additions(self) -> DataFrame:
        """A what-if road per order, between nodes that may or may not exist."""
        k, n = F.col("o_orderkey"), self.side * self.side + 5
        return self.table("orders").select(
            k.alias("seq"), (k * 31 % n).alias("src"), (k * 57 % n).alias("dst"), (k % 3 + 1).cast("int").alias("lanes"),
            (40 + k % 50).cast("double").alias("speed_kph"), (600 * (k % 3 + 1)).cast("double").alias("capacity_vph"),
        )

    @property
    def hourly(self) -> DataFrame:
        """Observed-like volumes by (hour, edge): quantities of lineitems on an edge of their supplier and part."""
        edge = (F.col("l_partkey") * 4 + F.col("l_linenumber") % 4).cast("bigint")
        hour = F.when(F.col("l_partkey") % 9 == 0, 8).otherwise((F.col("l_suppkey") % 24).cast("int"))
        return self.table("lineitem").groupBy(hour.alias("hour"), edge.alias("edge")).agg(F.sum("l_quantity").alias("volume"))
