"""Queries by name: each over the driver's tables, with the same question as DuckDB SQL where SQL can ask it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyway import model
from tallyway.functions import geo, roads
from tallyway.operators import assign, blocks, demand, feeds, network, paths, scenario, snap, transit, views
from tallyway.operators.iterate import cut
from tallyway.plans import oracle
from tallyway.plans.derive import CHUNKS, CRASHES, SOUTH, WEST, Town
from tallyway.plans.register import ORACLE_SQL, QUERIES, query, rounded  # noqa: F401
from tallyway.streaming import feeds as streams

BLOCK = network.block_window(-77.3, 38.85, 4, CHUNKS)
IN_BLOCK = lambda c: f"({c} % {CHUNKS.cols} BETWEEN {BLOCK[0]} AND {BLOCK[2]} AND {c} // {CHUNKS.cols} BETWEEN {BLOCK[1]} AND {BLOCK[3]})"
CX, CY = oracle.crash_cell()


# ------------------------------------------------------------------ network


@query("SELECT edge, src, dst, CAST(class AS INT) AS class, round(len_m,4) AS len_m FROM edges", "edges")
def lattice_network(t: Town) -> DataFrame:
    return rounded(t.edges.select("edge", "src", "dst", "class", "len_m"), 4)


@query("SELECT edge, speed_kph, CAST(lanes AS INT) AS lanes, capacity_vph, round(free_s,5) AS free_s FROM network", "network")
def edge_defaults(t: Town) -> DataFrame:
    return t.network.select("edge", "speed_kph", "lanes", "capacity_vph", F.round("free_s", 5).alias("free_s"))


@query("SELECT edge, CAST(greatest(CAST(trunc(least(greatest(free_s*100,0),1e8)) AS BIGINT),1) AS BIGINT) AS weight FROM network", "network")
def path_weights(t: Town) -> DataFrame:
    return t.network.select("edge", roads.weight(F.col("free_s")).alias("weight"))


@query("SELECT cx, cy, chunk, count(*) AS n FROM chunked GROUP BY ALL", "chunked")
def grid_cells(t: Town) -> DataFrame:
    x, y = geo.cell_x(F.col("lon"), CHUNKS), geo.cell_y(F.col("lat"), CHUNKS)
    return t.nodes.groupBy(x.alias("cx"), y.alias("cy"), geo.chunk_of(F.col("lon"), F.col("lat"), CHUNKS).alias("chunk")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT chunk, chunk % {CHUNKS.cols} AS cx, chunk // {CHUNKS.cols} AS cy, node_count, edge_count,
    CAST(coalesce(sum(node_count) OVER (ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS node_offset,
    CAST(coalesce(sum(edge_count) OVER (ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS edge_offset
    FROM (SELECT c.chunk, count(DISTINCT c.node) AS node_count, count(p.edge) AS edge_count FROM chunked c LEFT JOIN edges p ON p.src=c.node GROUP BY c.chunk)""",
    "chunked", "edges",
)
def chunk_index(t: Town) -> DataFrame:
    return network.chunk_index(network.with_chunks(t.edges, t.nodes, CHUNKS), t.nodes, CHUNKS)


@query("SELECT chunk, edge, chunk=src_chunk AS owned FROM (SELECT edge, src_chunk, src_chunk AS chunk FROM placed UNION ALL SELECT edge, src_chunk, dst_chunk FROM placed WHERE src_chunk<>dst_chunk)", "placed")
def border_mirror(t: Town) -> DataFrame:
    return network.mirrored(network.with_chunks(t.edges, t.nodes, CHUNKS)).select("chunk", "edge", "owned")


@query(f"SELECT edge, NOT ({IN_BLOCK('src_chunk')} AND {IN_BLOCK('dst_chunk')}) AS boundary FROM placed WHERE {IN_BLOCK('src_chunk')} OR {IN_BLOCK('dst_chunk')}", "placed")
def boundary_edges(t: Town) -> DataFrame:
    placed = network.with_chunks(t.edges, t.nodes, CHUNKS)
    inside = lambda c: network.in_window(F.col(c), BLOCK, CHUNKS)
    return network.loaded(placed, inside("src_chunk"), inside("dst_chunk")).select("edge", "boundary")


@query(f"SELECT chunk, count(*) AS nodes FROM chunked WHERE {IN_BLOCK('chunk')} GROUP BY chunk", "chunked")
def study_area_block(t: Town) -> DataFrame:
    at = t.nodes.select(geo.chunk_of(F.col("lon"), F.col("lat"), CHUNKS).alias("chunk"))
    return at.filter(network.in_window(F.col("chunk"), BLOCK, CHUNKS)).groupBy("chunk").agg(F.count(F.lit(1)).alias("nodes"))


@query(
    "SELECT c.chunk, c.node, count(e.edge) AS degree, CAST(sum(count(e.edge)) OVER (ORDER BY c.chunk, c.node)-count(e.edge) AS BIGINT) AS \"offset\", coalesce(string_agg(CAST(e.edge AS VARCHAR), ',' ORDER BY e.edge),'') AS edges FROM chunked c LEFT JOIN edges e ON e.src=c.node GROUP BY c.chunk, c.node",
    "chunked", "edges",
)
def csr_offsets(t: Town) -> DataFrame:
    return network.offsets(t.edges, t.nodes, CHUNKS).select("chunk", "node", "degree", "offset", F.array_join("edges", ",").alias("edges"))


@query("SELECT DISTINCT node FROM (SELECT src AS node FROM edges WHERE class<5 UNION ALL SELECT dst FROM edges WHERE class<5)", "edges")
def prune_isolated(t: Town) -> DataFrame:
    return network.without_isolated(t.nodes, t.edges.filter("class < 5")).select("node")


@query(
    """SELECT node, count(*) AS neighbours, min(lo)=max(hi) AS alike FROM (SELECT node, other, min(class) AS lo, max(class) AS hi FROM
    (SELECT src AS node, dst AS other, class FROM edges WHERE class<5 UNION ALL SELECT dst, src, class FROM edges WHERE class<5) GROUP BY node, other) GROUP BY node""",
    "edges",
)
def degree2_flags(t: Town) -> DataFrame:
    return network.degree_two(t.edges.filter("class < 5")).select("node", "neighbours", "alike")


@query(
    """, e AS (SELECT edge, src, dst, class, len_m FROM edges WHERE class<3),
    ends AS (SELECT src AS node, dst AS other, class, 1 AS o FROM e UNION ALL SELECT dst, src, class, 0 FROM e),
    per AS (SELECT node, other, sum(o) AS outs, count(*) AS n, min(class) AS lo, max(class) AS hi FROM ends GROUP BY node, other),
    flag AS (SELECT node FROM per GROUP BY node HAVING count(*)=2 AND min(lo)=max(hi) AND NOT bool_or(node=other) AND ((min(n)=2 AND max(n)=2 AND min(outs)=1 AND max(outs)=1) OR (min(n)=1 AND max(n)=1 AND min(outs)=0 AND max(outs)=1))),
    walk AS (SELECT edge AS piece, edge, src, src AS prev, dst AS last, class, len_m, 1 AS parts, src||'-'||dst AS shape FROM e WHERE src NOT IN (SELECT node FROM flag)
        UNION ALL SELECT n.edge, w.edge, w.src, w.last, n.dst, w.class, w.len_m+n.len_m, parts+1, shape||'-'||n.dst FROM walk w JOIN flag f ON f.node=w.last JOIN e n ON n.src=w.last AND n.dst<>w.prev)
    SELECT edge, src, last AS dst, CAST(class AS INT) AS class, round(len_m,4) AS len_m, CAST(parts AS BIGINT) AS parts, shape FROM walk WHERE last NOT IN (SELECT node FROM flag) AND last<>src
    UNION ALL SELECT edge, src, dst, CAST(class AS INT), round(len_m,4), 1, src||'-'||dst FROM e WHERE edge NOT IN (SELECT piece FROM walk)""",
    "edges",
)
def simplify_degree2(t: Town) -> DataFrame:
    return rounded(network.simplified(t.edges.filter("class < 3")), 4).withColumn("shape", F.array_join("shape", "-"))


@query(
    """, e AS (SELECT edge, src, dst, class, lanes, speed_kph+0.3::DOUBLE*(edge%3) AS kph, len_m FROM network WHERE class<5),
    ends AS (SELECT src AS node, dst AS other, edge, class, lanes, kph, 1 AS o FROM e UNION ALL SELECT dst, src, edge, class, lanes, kph, 0 FROM e),
    steps AS (SELECT *, abs(kph-lag(kph) OVER (PARTITION BY node ORDER BY edge))>=0.5 AS apart FROM ends),
    per AS (SELECT node, other, sum(o) AS outs, count(*) AS n, min(class*100+lanes) AS lo, max(class*100+lanes) AS hi, bool_or(coalesce(apart,false)) AS apart FROM steps GROUP BY node, other),
    flag AS (SELECT node FROM per GROUP BY node HAVING count(*)=2 AND min(lo)=max(hi) AND NOT bool_or(apart) AND NOT bool_or(node=other) AND ((min(n)=2 AND max(n)=2 AND min(outs)=1 AND max(outs)=1) OR (min(n)=1 AND max(n)=1 AND min(outs)=0 AND max(outs)=1))),
    walk AS (SELECT edge AS piece, edge, src, src AS prev, dst AS last, kph, len_m, 1 AS parts FROM e WHERE src NOT IN (SELECT node FROM flag)
        UNION ALL SELECT n.edge, w.edge, w.src, w.last, n.dst, w.kph, w.len_m+n.len_m, parts+1 FROM walk w JOIN flag f ON f.node=w.last JOIN e n ON n.src=w.last AND n.dst<>w.prev)
    SELECT edge, src, last AS dst, round(kph,4) AS speed_kph, round(len_m,4) AS len_m, CAST(parts AS BIGINT) AS parts FROM walk WHERE last NOT IN (SELECT node FROM flag) AND last<>src
    UNION ALL SELECT edge, src, dst, round(kph,4), round(len_m,4), 1 FROM e WHERE edge NOT IN (SELECT piece FROM walk)""",
    "network",
)
def simplify_network(t: Town) -> DataFrame:
    """The network without its residential roads, whose speeds were measured and differ a little from road to road."""
    measured = t.network.withColumn("speed_kph", F.col("speed_kph") + F.lit(0.3) * (F.col("edge") % 3)).filter("class < 5")
    return rounded(network.simplified(measured).select("edge", "src", "dst", "speed_kph", "len_m", "parts"), 4)


@query(f"SELECT cx, cy, round(avg(lon),8) AS lon, round(avg(lat),8) AS lat, count(*) AS members FROM chunked WHERE lon BETWEEN -77.54 AND -77.04 AND lat BETWEEN 38.60 AND 39.06 GROUP BY cx, cy", "chunked")
def zones_centroids(t: Town) -> DataFrame:
    key = F.struct(geo.cell_x(F.col("lon"), CHUNKS).alias("cx"), geo.cell_y(F.col("lat"), CHUNKS).alias("cy"))
    made = demand.centroids(t.nodes, key, model.STUDY_BBOX)
    return made.select("zone.cx", "zone.cy", F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"), "members")


# ------------------------------------------------------------------- demand


def _ring_sql() -> str:
    west, south, east, north = model.STUDY_BBOX
    rows, n = [], model.EXTERNAL_ZONES
    wide, high = east - west, north - south
    for k in range(n):
        d = 2.0 * (wide + high) * k / n
        if d < wide:
            at = (west + d, south)
        elif d < wide + high:
            at = (east, south + (d - wide))
        elif d < 2 * wide + high:
            at = (east - (d - wide - high), north)
        else:
            at = (west, north - (d - 2 * wide - high))
        rows.append(f"({k}, {at[0]!r}::DOUBLE, {at[1]!r}::DOUBLE)")
    return ", ".join(rows)


_STATES = ", ".join(f"({s}, {a}::DOUBLE, {b}::DOUBLE)" for s, a, b in model.STATE_CENTRES)
_BLOCKS = "SELECT c_custkey AS block, CASE WHEN c_custkey%3=0 THEN -78.5::DOUBLE+c_custkey%17*0.1::DOUBLE END AS lon, CASE WHEN c_custkey%3=0 THEN 38.2::DOUBLE+c_custkey%13*0.1::DOUBLE END AS lat, CASE WHEN c_custkey%5=0 THEN 99 ELSE 10+c_nationkey END AS state FROM customer"


@query(
    f"""SELECT block, zone, how FROM (SELECT b.block, coalesce(own, external) AS zone, CASE WHEN own IS NOT NULL THEN 'zone' WHEN external IS NOT NULL THEN 'external' ELSE 'dropped' END AS how,
    row_number() OVER (PARTITION BY b.block ORDER BY m, external) AS rn FROM (
    SELECT b.*, z.zone AS own, coalesce(b.lon, s.lon) AS at_lon, coalesce(b.lat, s.lat) AS at_lat FROM ({_BLOCKS}) b LEFT JOIN (SELECT 0 AS zone) z ON b.block // 1000 = z.zone LEFT JOIN (VALUES {_STATES}) s(state, lon, lat) ON b.state=s.state) b
    LEFT JOIN LATERAL (SELECT k AS external, {oracle.distance('b.at_lon', 'b.at_lat', 'r.lon', 'r.lat')} AS m FROM (VALUES {_ring_sql()}) r(k, lon, lat) WHERE b.at_lon IS NOT NULL) x ON true) WHERE rn=1"""
)
def place_cascade(t: Town) -> DataFrame:
    k = F.col("c_custkey")
    at = lambda low, n: F.when(k % 3 == 0, F.lit(low) + k % n * F.lit(0.1))
    blocks = t.table("customer").select(k.alias("block"), at(-78.5, 17).alias("lon"), at(38.2, 13).alias("lat"), F.when(k % 5 == 0, 99).otherwise(F.lit(10) + F.col("c_nationkey")).cast("bigint").alias("state"))
    zones = t.spark.range(1).select(F.col("id").alias("zone"))
    return demand.placed(blocks, zones, demand.external_ring(t.spark, model.STUDY_BBOX), model.STUDY_BBOX)


@query("SELECT origin, dest, round(trips,6) AS trips FROM od", "od")
def od_matrix(t: Town) -> DataFrame:
    return rounded(demand.trips(t.commutes))


@query(
    f"""SELECT a.origin, a.dest, round(pull*1500000.0::DOUBLE/whole,4) AS trips FROM pulls a, (SELECT sum(pull) AS whole FROM pulls) w WHERE pull*1500000.0::DOUBLE/whole>=0.5::DOUBLE""",
    "pulls",
)
def gravity_demand(t: Town) -> DataFrame:
    mass = t.table("customer").groupBy(F.col("c_nationkey").cast("bigint").alias("zone")).agg(F.count(F.lit(1)).cast("double").alias("mass"))
    return rounded(demand.gravity(t.zones.join(mass, "zone")), 4)


@query(
    "SELECT hour, origin, dest, round(sum(trips),6) AS trips FROM (SELECT hour, origin, dest, trips*share*(1-back) AS trips FROM od, hours UNION ALL SELECT hour, dest, origin, trips*share*back FROM od, hours) GROUP BY hour, origin, dest",
    "od", "hours",
)
def hour_trips(t: Town) -> DataFrame:
    return rounded(demand.hourly(demand.trips(t.commutes), model.hour_shares(t.spark)))


@query("SELECT zone, round(sum(trips),5) AS weight FROM (SELECT origin AS zone, trips FROM od UNION ALL SELECT dest, trips FROM od) GROUP BY zone", "od")
def zone_weights(t: Town) -> DataFrame:
    return rounded(demand.zone_weights(demand.trips(t.commutes)), 5)


@query()
def coarse_zones(t: Town) -> DataFrame:
    return demand.coarse(t.zones, demand.trips(t.commutes), target=8)


# ----------------------------------------------------------------- snapping


@query(
    f"""SELECT s.station_id, b.node, round(b.m,3) AS snap_m FROM stations s LEFT JOIN (SELECT station_id, node, m FROM (SELECT station_id, node, m, row_number() OVER (PARTITION BY station_id ORDER BY m, node) AS rn
    FROM (SELECT station_id, node, {oracle.distance('s.lon', 's.lat', 'n.lon', 'n.lat')} AS m FROM stations s, nodes n) WHERE m<=400.0::DOUBLE) WHERE rn=1) b ON s.station_id=b.station_id""",
    "stations", "nodes",
)
def snap_nodes(t: Town) -> DataFrame:
    points = t.stations.withColumnRenamed("station_id", "point")
    return snap.to_nodes(points, t.nodes, model.SNAP_STOP_M).select(F.col("point").alias("station_id"), "node", F.round("snap_m", 3).alias("snap_m"))


@query("SELECT s.station_id, b.edge, round(b.m,3) AS snap_m FROM stations s LEFT JOIN snapped b ON s.station_id=b.station_id", "snapped")
def snap_edges(t: Town) -> DataFrame:
    points = t.stations.withColumnRenamed("station_id", "point")
    return snap.to_edges(points, t.edges, model.SNAP_STATION_M).select(F.col("point").alias("station_id"), "edge", F.round("snap_m", 3).alias("snap_m"))


@query(
    f"SELECT node, zone, round(m,3) AS snap_m FROM (SELECT node, zone, m, row_number() OVER (PARTITION BY node ORDER BY m, zone) AS rn FROM (SELECT n.node, z.zone, {oracle.distance('n.lon', 'n.lat', 'z.lon', 'z.lat')} AS m FROM nodes n, zones z)) WHERE rn=1",
    "nodes", "zones",
)
def nearest_zone(t: Town) -> DataFrame:
    near = snap.to_few(t.nodes.withColumnRenamed("node", "point"), t.zones.withColumnRenamed("zone", "target"))
    return near.select(F.col("point").alias("node"), F.col("target").alias("zone"), F.round("snap_m", 3).alias("snap_m"))


# ------------------------------------------------------------ scenario, flow


@query("SELECT edge, lanes, speed_kph, round(capacity_vph,6) AS capacity_vph, open FROM overlay", "overlay")
def scenario_overlay(t: Town) -> DataFrame:
    return scenario.applied(t.network.select("edge", "len_m", "lanes", "speed_kph", "capacity_vph"), t.edits).select("edge", "lanes", "speed_kph", F.round("capacity_vph", 6).alias("capacity_vph"), "open")


@query("SELECT seq, type, edge FROM edits WHERE edge NOT IN (SELECT edge FROM edges)", "edits", "edges")
def scenario_warnings(t: Town) -> DataFrame:
    return scenario.warnings(t.edges, t.edits)


@query("SELECT edge, type, lanes, speed_kph, capacity_vph FROM (SELECT *, row_number() OVER (PARTITION BY edge, type ORDER BY seq DESC) AS rn FROM edits) WHERE rn=1", "edits")
def canonical_edits(t: Town) -> DataFrame:
    return scenario.canonical(t.edits)


@query(
    "SELECT h.edge, hour, round(volume/capacity_vph,10) AS vc, round(free_s*(1+0.15::DOUBLE*pow(volume/greatest(capacity_vph,1.0::DOUBLE),4)),5) AS cost_s FROM hourly h JOIN network n ON h.edge=n.edge", "hourly", "network"
)
def bpr_curve(t: Town) -> DataFrame:
    made = assign.measured(t.hourly.join(t.network, "edge"))
    return made.select("edge", "hour", F.round("vc", 10).alias("vc"), F.round("cost_s", 5).alias("cost_s"))


@query(
    """SELECT hour, round(sum(volume*len_m/1609.344::DOUBLE),4) AS vmt, round(sum(volume*c/3600.0::DOUBLE),4) AS vht, round(sum(volume*greatest(c-free_s,0))/sum(volume),6) AS mean_delay_s_per_traversal
    FROM (SELECT h.hour, volume, len_m, free_s, free_s*(1+0.15::DOUBLE*pow(volume/greatest(capacity_vph,1.0::DOUBLE),4)) AS c FROM hourly h JOIN network n ON h.edge=n.edge) GROUP BY hour""",
    "hourly", "network",
)
def kpis(t: Town) -> DataFrame:
    k = assign.kpis(t.hourly.join(t.network, "edge"), "hour")
    return k.select("hour", F.round("vmt", 4).alias("vmt"), F.round("vht", 4).alias("vht"), F.round("mean_delay_s_per_traversal", 6).alias("mean_delay_s_per_traversal"))


@query("SELECT edge, round(vc,8) AS vc FROM (SELECT h.edge, sum(volume)/max(capacity_vph) AS vc FROM hourly h JOIN network n ON h.edge=n.edge GROUP BY h.edge) WHERE vc>0 ORDER BY vc DESC, edge LIMIT 20", "hourly", "network")
def busiest_edges(t: Town) -> DataFrame:
    day = t.hourly.groupBy("edge").agg(F.sum("volume").alias("volume"))
    return assign.busiest(day.join(t.network, "edge")).select("edge", F.round("vc", 8).alias("vc"))


@query(
    """SELECT round(sum(vmt),3) AS vmt, round(sum(vht),3) AS vht, round(avg(d),6) AS mean_delay_s, round(sum(d*vmt)/sum(vmt),6) AS weighted_delay_s, CAST(arg_max(hour, (vmt, -hour)) AS INT) AS peak_hour FROM
    (SELECT hour, sum(volume*len_m/1609.344::DOUBLE) AS vmt, sum(volume*c/3600.0::DOUBLE) AS vht, sum(volume*greatest(c-free_s,0))/sum(volume) AS d FROM
    (SELECT h.hour, volume, len_m, free_s, free_s*(1+0.15::DOUBLE*pow(volume/greatest(capacity_vph,1.0::DOUBLE),4)) AS c FROM hourly h JOIN network n ON h.edge=n.edge) GROUP BY hour)""",
    "hourly", "network",
)
def daily_kpis(t: Town) -> DataFrame:
    k = assign.kpis(t.hourly.join(t.network, "edge"), "hour").withColumnRenamed("mean_delay_s_per_traversal", "mean_delay_s")
    return feeds.daily_kpis(k).select(F.round("vmt", 3).alias("vmt"), F.round("vht", 3).alias("vht"), F.round("mean_delay_s", 6).alias("mean_delay_s"), F.round("weighted_delay_s", 6).alias("weighted_delay_s"), F.col("peak_hour").cast("int").alias("peak_hour"))


@query("SELECT a.hour, a.edge, round(a.volume*0.5::DOUBLE-a.volume,6) AS delta FROM hourly a WHERE a.edge%3<>0", "hourly")
def scenario_diff(t: Town) -> DataFrame:
    changed = t.hourly.filter("edge % 3 <> 0").withColumn("volume", F.col("volume") * 0.5)
    return rounded(scenario.difference(t.hourly, changed, "volume"))


@query("SELECT origin, dest, round((lo+hi)/2,4) AS first_route FROM halved WHERE k=40", "halved")
def wardrop_split(t: Town) -> DataFrame:
    first = assign.wardrop(F.col("trips"), F.lit(60.0), F.lit(1200.0), F.lit(110.0), F.lit(3000.0))
    return demand.trips(t.commutes).select("origin", "dest", F.round(first, 4).alias("first_route"))


def _zone_trips(t: Town, hour: int | None) -> DataFrame:
    """Trips of an hour (None: of all, with hour) between the nodes nearest the zones."""
    shares = model.hour_shares(t.spark)
    rows = demand.hourly(demand.trips(t.commutes), shares if hour is None else shares.filter(F.col("hour") == hour))
    near = snap.to_few(t.zones.withColumnRenamed("zone", "point"), t.nodes.withColumnRenamed("node", "target")).select(F.col("point").alias("zone"), F.col("target").alias("node"))
    a, b = (near.select(F.col("zone").alias(c), F.col("node").alias(f"{c}_node")) for c in ("origin", "dest"))
    return rows.join(F.broadcast(a), "origin").join(F.broadcast(b), "dest").select(F.col("origin_node").alias("origin"), F.col("dest_node").alias("dest"), "trips", *(["hour"] if hour is None else []))


def _solver_edges(t: Town) -> DataFrame:
    return t.network.select("edge", "src", "dst", "len_m", "free_s", "capacity_vph", "open")


@query()
def aon_free_flow(t: Town) -> DataFrame:
    return rounded(assign.loads(_solver_edges(t), _zone_trips(t, 8), t.nodes), 4)


@query()
def hour_assignment(t: Town) -> DataFrame:
    result = assign.equilibrium(_solver_edges(t), _zone_trips(t, 8), nodes=t.nodes)
    volumes = result.frame(t.nodes, 8)
    return assign.kpis(volumes, "hour").withColumns({"iterations": F.lit(result.iterations), "gap": F.lit(result.gap)})


@query()
def sweep_daily(t: Town) -> DataFrame:
    """Every edge's day under assigned traffic: all 24 hours, in jobs that they share."""
    hours = assign.sweep_together(_solver_edges(t), _zone_trips(t, None), list(range(24)), tag="sweep_daily")
    return rounded(assign.daily(hours), 3)


@query()
def hour_under_edits(t: Town) -> DataFrame:
    """Hour 8 with every edit and every added road, starting from the flows without them: measures of both, and what changed."""
    trips = _zone_trips(t, 8).cache()
    base = assign.equilibrium(_solver_edges(t), trips, nodes=t.nodes)
    more = scenario.added(t.additions, t.nodes, 4 * t.side * t.side + 40)
    after = assign.equilibrium(scenario.changed(t.network, t.edits, more), trips, base.frame(t.nodes, 8), nodes=t.nodes)
    one, two = (cut(assign.kpis(r.frame(t.nodes, 8), "hour")) for r in (base, after))
    rows = [one.withColumn("which", F.lit("base")), two.withColumn("which", F.lit("edited")), scenario.kpi_delta(one, two, "hour").withColumn("which", F.lit("change"))]
    return rounded(rows[0].unionByName(rows[1]).unionByName(rows[2]), 3)


@query(
    f"""SELECT seq+4*side*side+40 AS edge, src, dst, round(m,4) AS len_m, round(m/greatest(speed_kph/3.6::DOUBLE,0.001::DOUBLE),5) AS free_s, CAST(lanes AS INT) AS lanes, capacity_vph FROM
    (SELECT x.*, greatest({oracle.distance('a.lon', 'a.lat', 'b.lon', 'b.lat')},1.0::DOUBLE) AS m FROM additions x JOIN nodes a ON a.node=x.src JOIN nodes b ON b.node=x.dst WHERE x.src<>x.dst), side""",
    "additions", "nodes",
)
def added_edges(t: Town) -> DataFrame:
    made = scenario.added(t.additions, t.nodes, 4 * t.side * t.side + 40)
    return made.select("edge", "src", "dst", F.round("len_m", 4).alias("len_m"), F.round("free_s", 5).alias("free_s"), "lanes", "capacity_vph")


@query(
    """SELECT seq, CASE WHEN src IN (SELECT node FROM nodes) AND dst IN (SELECT node FROM nodes) THEN 'both ends are one' ELSE 'an end is missing' END AS reason FROM additions
    WHERE src=dst OR src NOT IN (SELECT node FROM nodes) OR dst NOT IN (SELECT node FROM nodes)""",
    "additions", "nodes",
)
def added_warnings(t: Town) -> DataFrame:
    return scenario.added_warnings(t.additions, t.nodes)


@query(
    """, flows AS (SELECT h.hour, volume, len_m, free_s, free_s*(1+0.15::DOUBLE*pow(volume/greatest(capacity_vph,1.0::DOUBLE),4)) AS c FROM hourly h JOIN network n ON h.edge=n.edge),
    new_flows AS (SELECT hour, volume, len_m, free_s, CASE WHEN open THEN free_s*(1+0.15::DOUBLE*pow(volume/greatest(capacity_vph,1.0::DOUBLE),4)) ELSE 1e7::DOUBLE END AS c FROM
        (SELECT h.hour, volume, len_m, len_m/greatest(speed_kph/3.6::DOUBLE,0.001::DOUBLE) AS free_s, capacity_vph, open FROM hourly h JOIN overlay o ON h.edge=o.edge)),
    sums AS (SELECT hour, sum(volume*len_m/1609.344::DOUBLE) AS vmt, sum(volume*c/3600.0::DOUBLE) AS vht, sum(volume*greatest(c-free_s,0))/sum(volume) AS d FROM flows GROUP BY hour),
    new_sums AS (SELECT hour, sum(volume*len_m/1609.344::DOUBLE) AS vmt, sum(volume*c/3600.0::DOUBLE) AS vht, sum(volume*greatest(c-free_s,0))/sum(volume) AS d FROM new_flows GROUP BY hour)
    SELECT a.hour, round(b.vmt-a.vmt,3) AS vmt, round(b.vht-a.vht,1) AS vht, round(b.d-a.d,2) AS mean_delay_s_per_traversal FROM sums a JOIN new_sums b ON a.hour=b.hour""",
    "hourly", "network", "overlay",
)
def kpi_delta(t: Town) -> DataFrame:
    base = assign.kpis(t.hourly.join(t.network, "edge"), "hour")
    after = assign.kpis(t.hourly.join(scenario.changed(t.network, t.edits), "edge"), "hour")
    d = scenario.kpi_delta(base, after, "hour")
    vmt = F.round(F.round("vmt", 3) + 0.0, 3)  # no negative zero
    return d.select("hour", vmt.alias("vmt"), F.round("vht", 1).alias("vht"), F.round("mean_delay_s_per_traversal", 2).alias("mean_delay_s_per_traversal"))


@query(oracle.relaxed("gates", "(SELECT src, dst, free_s AS c FROM network)") + " SELECT origin, node, round(cost,4) AS cost FROM reach", "gates", "network")
def shortest_path_skim(t: Town) -> DataFrame:
    near = snap.to_few(t.zones.withColumnRenamed("zone", "point"), t.nodes.withColumnRenamed("node", "target")).select(F.col("point").alias("origin"), F.col("target").alias("node"), F.lit(0.0).alias("cost"))
    far = blocks.relaxed(_solver_edges(t).select("src", "dst", F.col("free_s").alias("cost")), t.nodes, near)
    return rounded(far, 4)


# ------------------------------------------------------------------ transit


@query("SELECT array_to_string(pattern, ',') AS pattern, count(*) AS trips, min(trip) AS first_trip FROM patterns GROUP BY pattern", "patterns")
def gtfs_patterns(t: Town) -> DataFrame:
    return transit.patterns(t.stop_times).select(F.array_join("pattern", ",").alias("pattern"), "trips", "first_trip")


@query("SELECT array_to_string(pattern, ',') AS pattern, CAST(seq AS INT) AS seq, list_extract(list(hop_s ORDER BY hop_s), CAST(count(*)//2+1 AS INT)) AS hop_s FROM hops JOIN patterns USING (trip) GROUP BY pattern, seq", "hops", "patterns")
def hop_medians(t: Town) -> DataFrame:
    return transit.hop_medians(t.stop_times).select(F.array_join("pattern", ",").alias("pattern"), "seq", "hop_s")


@query(
    "SELECT trip, CAST(leg AS BIGINT) AS leg, sum(hop_s) AS hop_s FROM (SELECT s.trip, sum(CASE WHEN stop<>3 THEN 1 ELSE 0 END) OVER (PARTITION BY s.trip ORDER BY s.seq) AS leg, coalesce(hop_s,0) AS hop_s FROM stop_times s LEFT JOIN hops h ON s.trip=h.trip AND s.seq=h.seq) WHERE leg>0 GROUP BY trip, leg",
    "stop_times", "hops",
)
def folded_hops(t: Town) -> DataFrame:
    return transit.folded_hops(t.stop_times, F.col("stop") != 3)


@query(
    "SELECT p.pattern, CAST(h.hour AS INT) AS hour, 3600.0::DOUBLE/n AS headway_s FROM (SELECT DISTINCT pattern FROM departures) p CROSS JOIN hours h LEFT JOIN (SELECT pattern, CAST(floor(depart_s/3600) AS BIGINT)%24 AS hour, count(*) AS n FROM departures GROUP BY 1,2) d ON d.pattern=p.pattern AND d.hour=h.hour",
    "departures", "hours",
)
def headways(t: Town) -> DataFrame:
    return transit.headways(t.departures, model.hour_shares(t.spark))


@query("SELECT pattern AS route, arg_min(trip, (-n, trip)) AS trip, max(n) AS length FROM (SELECT d.pattern, d.trip, count(*) AS n FROM departures d JOIN stop_times s ON s.trip=d.trip GROUP BY 1,2) GROUP BY pattern", "departures", "stop_times")
def longest_trip(t: Town) -> DataFrame:
    sizes = t.stop_times.groupBy("trip").agg(F.count(F.lit(1)).alias("length"))
    return transit.longest_trips(t.departures.join(sizes, "trip").select(F.col("pattern").alias("route"), "trip", "length"))


def _walks(t: Town) -> DataFrame:
    return t.edges.select("src", "dst", (F.col("len_m") / model.WALK_MPS).alias("cost"))


def _starts(t: Town) -> DataFrame:
    """Reach from every supplier whose id is divisible by 50; where its place on the lattice has no node, from the nearest node."""
    side = t.side
    own = t.table("supplier").filter("s_suppkey % 50 = 0").select(F.col("s_suppkey").alias("origin"), (F.col("s_suppkey") * 37 % (side * side)).alias("node"))
    at = lambda low, span, k: F.lit(low) + F.lit(span) * k / (side - 1)
    gone = own.join(t.nodes.select("node"), "node", "left_anti").select(F.col("origin").alias("point"), at(WEST, 0.5, F.col("node") % side).alias("lon"), at(SOUTH, 0.46, F.floor(F.col("node") / side)).alias("lat"))
    moved = snap.to_few(gone, t.nodes.withColumnRenamed("node", "target")).select(F.col("point").alias("origin"), F.col("target").alias("node"))
    return own.join(t.nodes.select("node"), "node", "left_semi").select("origin", "node").unionByName(moved).withColumn("cost", F.lit(0.0))


def _calls(t: Town) -> DataFrame:
    """Patterns along every sixth row of the lattice: a stop at every third node, 60 seconds a hop, a headway from departures."""
    way = t.departures.groupBy("pattern").agg((3600.0 * 24 / F.count(F.lit(1))).alias("headway"))
    stops = t.nodes.filter("iy % 6 = 0 AND ix % 3 = 0").select(F.floor(F.col("iy") / 6).alias("pattern"), (F.col("ix") / 3).cast("int").alias("seq"), "node")
    return stops.join(way, "pattern").select("pattern", "seq", "node", (F.least("headway", F.lit(1800.0)) / 2).alias("wait_s"), (F.col("seq") * 60.0).alias("along_s"))


@query(oracle.relaxed("starts", "walks", "x.c<=3600") + " SELECT origin, node, round(cost,3) AS cost FROM reach", "starts", "walks")
def isochrone_walk(t: Town) -> DataFrame:
    return rounded(transit.isochrone(_walks(t), None, _starts(t), 3600.0, nodes=t.nodes), 3)


@query(oracle.ridden(3600.0) + " SELECT origin, node, round(cost,3) AS cost FROM reach", "starts", "walks", "calls")
def isochrone_transit(t: Town) -> DataFrame:
    return rounded(transit.isochrone(_walks(t), _calls(t), _starts(t), 3600.0, nodes=t.nodes), 3)


@query()
def reach_bands(t: Town) -> DataFrame:
    return transit.bands(transit.isochrone(_walks(t), _calls(t), _starts(t), 3600.0, nodes=t.nodes), t.nodes)


@query(oracle.ridden(3600.0) + f" SELECT origin, round(sum(trips)/{model.TRIPS_PER_CAPITA}::DOUBLE,4) AS people, count(*) AS zones FROM reach r JOIN homes h ON h.node=r.node GROUP BY origin", "starts", "walks", "calls", "homes")
def reach_population(t: Town) -> DataFrame:
    homes = t.table("customer").join(t.table("orders"), F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_custkey").alias("node")).agg(F.count(F.lit(1)).cast("double").alias("trips"))
    return rounded(transit.reached_people(transit.isochrone(_walks(t), _calls(t), _starts(t), 3600.0, nodes=t.nodes), homes), 4)


# -------------------------------------------------------------------- feeds


@query(
    f"SELECT cx, cy, count(*) AS n, CAST(sum(severity) AS BIGINT) AS severity_sum, round(sum(severity)/count(*),6) AS mean_severity, round({CRASHES.west!r}::DOUBLE+(cx+0.5::DOUBLE)*{CRASHES.lon_deg!r}::DOUBLE,8) AS lon, round({CRASHES.south!r}::DOUBLE+(cy+0.5::DOUBLE)*{CRASHES.lat_deg!r}::DOUBLE,8) AS lat FROM (SELECT {CX} AS cx, {CY} AS cy, severity FROM crashes) GROUP BY cx, cy",
    "crashes",
)
def crash_grid(t: Town) -> DataFrame:
    return feeds.crash_cells(t.crashes, CRASHES).select("cx", "cy", "n", "severity_sum", F.round("mean_severity", 6).alias("mean_severity"), F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"))


def _crashed(t: Town) -> DataFrame:
    return snap.to_edges(t.crashes.withColumnRenamed("crash_id", "point"), t.edges, model.SNAP_CRASH_M)


@query("SELECT edge, count(*) AS n, CAST(sum(severity) AS BIGINT) AS severity_sum, count(*) FILTER (WHERE severity=5) AS fatal FROM crashed GROUP BY edge", "crashed")
def crash_edges(t: Town) -> DataFrame:
    return feeds.crash_edges(_crashed(t))


@query("SELECT edge, count(*) AS crashes FROM crashed GROUP BY edge ORDER BY crashes DESC, edge LIMIT 5", "crashed")
def crash_top_edges(t: Town) -> DataFrame:
    return feeds.top_edges(_crashed(t))


@query(
    "SELECT CASE WHEN event_id%8 BETWEEN 1 AND 5 THEN CAST(event_id%8 AS INT) ELSE 1 END AS severity, CAST(sum(greatest(floor(user_id%40/10.0::DOUBLE+0.5::DOUBLE),1)) AS BIGINT) AS crashes FROM events GROUP BY 1"
)
def tile_severities(t: Town) -> DataFrame:
    cells = t.table("events").select((F.col("event_id") % 8).alias("severity"), (F.col("user_id") % 40 / 10.0).alias("count"))
    return feeds.tile_severities(cells)


@query("SELECT s AS severity, count(crash_id) AS n FROM (VALUES (1),(2),(3),(4),(5)) v(s) LEFT JOIN crashes c ON c.severity=s GROUP BY s", "crashes")
def crash_severity_summary(t: Town) -> DataFrame:
    return feeds.by_severity(t.crashes)


@query("SELECT event_id, CAST(CASE event_id%6 WHEN 0 THEN CASE WHEN event_id%7 BETWEEN 1 AND 5 THEN event_id%7 END WHEN 1 THEN 5 WHEN 2 THEN 3 WHEN 3 THEN NULL WHEN 4 THEN 4 ELSE 1 END AS INT) AS severity FROM events")
def kabco_parse(t: Town) -> DataFrame:
    e = F.col("event_id")
    text = F.when(e % 6 == 0, (e % 7).cast("string")).when(e % 6 == 1, " k ").when(e % 6 == 2, "3: visible injury").when(e % 6 == 3, "unknown").when(e % 6 == 4, "a").otherwise("O")
    return t.table("events").select("event_id", roads.severity(text).alias("severity"))


@query("SELECT edge, hours_present, round(modelled_daily,4) AS modelled_daily FROM daily", "daily")
def modeled_daily(t: Town) -> DataFrame:
    return feeds.modelled_daily(t.hourly, model.hour_shares(t.spark)).select("edge", "hours_present", F.round("modelled_daily", 4).alias("modelled_daily"))


def _calibrated(t: Town) -> DataFrame:
    snapped = snap.to_edges(t.stations.withColumnRenamed("station_id", "point"), t.edges, model.SNAP_STATION_M).withColumnRenamed("point", "station_id")
    return feeds.calibration(snapped, feeds.modelled_daily(t.hourly, model.hour_shares(t.spark)))


@query("SELECT station_id, s.edge, aadt, round(modelled_daily,4) AS modelled_daily, hours_present FROM snapped s JOIN daily d ON s.edge=d.edge", "snapped", "daily")
def calibration_rows(t: Town) -> DataFrame:
    return _calibrated(t).select("station_id", "edge", "aadt", F.round("modelled_daily", 4).alias("modelled_daily"), "hours_present")


@query(
    "SELECT count(*) AS n, round(1-sum(pow(modelled_daily-aadt,2))/nullif(var_pop(aadt)*count(*),0),6) AS r2, round(sqrt(sum(pow(modelled_daily-aadt,2))/count(*)),4) AS rmse, round(avg(modelled_daily-aadt),4) AS bias, round(max(aadt),4) AS max_observed, round(max(modelled_daily),4) AS max_modelled FROM snapped s JOIN daily d ON s.edge=d.edge WHERE modelled_daily>0",
    "snapped", "daily",
)
def calibration_stats(t: Town) -> DataFrame:
    return feeds.fit(_calibrated(t)).select("n", F.round("r2", 6).alias("r2"), *[F.round(c, 4).alias(c) for c in ("rmse", "bias", "max_observed", "max_modelled")])


# ---------------------------------------------------------------- land, gis


@query("SELECT p_partkey, round(CASE WHEN h BETWEEN 1 AND 200 THEN h END,6) AS height_m FROM (SELECT p_partkey, coalesce(CASE WHEN p_partkey%3=0 THEN p_size*7.0::DOUBLE END, p_retailprice-900.0::DOUBLE)*0.3048::DOUBLE AS h FROM part)")
def building_heights(t: Town) -> DataFrame:
    h = roads.height_m(F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") * 7.0), F.col("p_retailprice"), F.lit(900.0))
    return t.table("part").select("p_partkey", F.round(h, 6).alias("height_m"))


def _latest(t: Town) -> DataFrame:
    order = [F.col(c) for c in ("yr", "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")]
    return feeds.latest(t.assessments, "parcel_id", *order, F.col("total")).select("parcel_id", "yr", "total")


@query("SELECT p.parcel_id, zone, land_use, yr, total FROM parcels p LEFT JOIN latest l ON p.parcel_id=l.parcel_id", "parcels", "latest")
def parcel_join(t: Town) -> DataFrame:
    rows = t.parcels
    return feeds.parcels(rows.select("parcel_id"), rows.select("parcel_id", "zone", "land_use"), _latest(t)).select("parcel_id", "zone", "land_use", "yr", "total")


@query("SELECT p_partkey AS parcel_id, round(abs(p_size*0.0001::DOUBLE*cos(radians(38.8::DOUBLE))*111320.0::DOUBLE*0.0002::DOUBLE*111320.0::DOUBLE),3) AS area_m2 FROM part")
def polygon_area(t: Town) -> DataFrame:
    wide = F.col("p_size") * 0.0001
    corner = lambda x, y: F.struct((F.lit(-77.3) + x).alias("lon"), (F.lit(38.8) + y).alias("lat"))
    ring = F.array(corner(F.lit(0.0), F.lit(0.0)), corner(wide, F.lit(0.0)), corner(wide, F.lit(0.0002)), corner(F.lit(0.0), F.lit(0.0002)))
    return t.table("part").select(F.col("p_partkey").alias("parcel_id"), F.round(geo.ring_area_m2(ring), 3).alias("area_m2"))


@query(
    "SELECT CASE WHEN zone='R-3' THEN 'other' ELSE zone END AS category, count(*) AS parcels, round(sum(area_m2),2) AS area_m2, round(sum(coalesce(total,0)),2) AS assessed_value FROM parcels p LEFT JOIN latest l ON p.parcel_id=l.parcel_id GROUP BY ROLLUP (CASE WHEN zone='R-3' THEN 'other' ELSE zone END)",
    "parcels", "latest",
)
def land_use_rollup(t: Town) -> DataFrame:
    tiles = t.parcels.join(_latest(t), "parcel_id", "left").select("parcel_id", "zone", "area_m2", F.col("total").alias("value"), F.explode(F.sequence(F.lit(0), (F.col("parcel_id") % 2).cast("int"))).alias("tile"))
    return rounded(feeds.land_use(tiles), 2)


@query(
    """, rows AS (SELECT CASE WHEN zone='R-3' THEN 'other' ELSE zone END AS category, count(*) AS parcels, round(sum(coalesce(total,0)),2) AS assessed_value FROM parcels p LEFT JOIN latest l ON p.parcel_id=l.parcel_id GROUP BY 1)
    SELECT category, parcels, assessed_value, row_number() OVER (ORDER BY assessed_value DESC, parcels DESC, category) AS place FROM rows""",
    "parcels", "latest",
)
def land_use_order(t: Town) -> DataFrame:
    """Categories by falling value, then parcels; there are as many rows as categories."""
    tiles = t.parcels.join(_latest(t), "parcel_id", "left").select("parcel_id", "zone", "area_m2", F.col("total").alias("value"), F.lit(0).alias("tile"))
    rows = rounded(feeds.land_use(tiles), 2).filter("category IS NOT NULL")
    place = F.row_number().over(Window.orderBy(F.desc("assessed_value"), F.desc("parcels"), "category"))
    return rows.select("category", "parcels", "assessed_value", place.cast("bigint").alias("place"))


@query("SELECT CAST(floor(x/0.05::DOUBLE) AS BIGINT) AS ix, CAST(floor(y/0.05::DOUBLE) AS BIGINT) AS iy, round(max(z),6) AS z, count(*) AS n FROM returns GROUP BY 1,2", "returns")
def surface_thin(t: Town) -> DataFrame:
    cell = lambda c: F.floor(F.col(c) / 0.05).cast("bigint")
    n = t.returns.groupBy(cell("x").alias("ix"), cell("y").alias("iy")).agg(F.count(F.lit(1)).alias("n"))
    return feeds.thinned(t.returns, 0.05).join(n, ["ix", "iy"]).select("ix", "iy", F.round("z", 6).alias("z"), "n")


@query("SELECT vec_id%16 AS chunk, count(*) AS points, round(min(CASE WHEN cls=2 THEN z END),3) AS ground_min FROM returns GROUP BY 1", "returns")
def ground_min(t: Town) -> DataFrame:
    return feeds.ground(t.returns, F.col("vec_id") % 16)


@query(
    f""", c AS (SELECT chunk, count(*)*2000000 AS bytes, pow(avg(lon)-(-77.3::DOUBLE),2)+pow(avg(lat)-38.85::DOUBLE,2) AS d FROM chunked GROUP BY chunk),
    o AS (SELECT *, row_number() OVER (ORDER BY d, chunk, bytes) AS k FROM c),
    f AS (SELECT 0::BIGINT AS k, 0::BIGINT AS used, 0::BIGINT AS chunk, 0::BIGINT AS hits UNION ALL
        SELECT o.k, CASE WHEN used+bytes<={model.LIDAR_BUDGET} THEN CAST(used+bytes AS BIGINT) ELSE used END, CASE WHEN used+bytes<={model.LIDAR_BUDGET} THEN o.chunk END, hits+CASE WHEN used+bytes<={model.LIDAR_BUDGET} THEN 1 ELSE 0 END FROM f JOIN o ON o.k=f.k+1)
    SELECT CAST(hits-1 AS INT) AS place, chunk FROM f WHERE k>0 AND chunk IS NOT NULL""",
    "chunked",
)
def chunk_budget(t: Town) -> DataFrame:
    at = geo.chunk_of(F.col("lon"), F.col("lat"), CHUNKS)
    chunks = t.nodes.groupBy(at.alias("chunk")).agg(F.count(F.lit(1)).alias("points"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat")).withColumn("bytes", F.col("points") * 2_000_000)
    return feeds.within_budget(chunks, -77.3, 38.85, model.LIDAR_BUDGET)


@query(
    "SELECT o_orderkey, round(CASE WHEN o_orderkey<=0 THEN 0 ELSE pow(o_orderkey/36000.0::DOUBLE,2.9::DOUBLE) END*CASE WHEN o_orderkey%2=0 THEN 0.145::DOUBLE ELSE 1.0::DOUBLE END/CASE WHEN o_orderkey%8+1<=1 THEN 1.0::DOUBLE ELSE 1+(o_orderkey%8)*0.883::DOUBLE END,8) AS seconds FROM orders"
)
def cost_model(t: Town) -> DataFrame:
    k = F.col("o_orderkey")
    return t.table("orders").select("o_orderkey", F.round(roads.hour_cost_s(k, k % 2 == 0, k % 8 + 1), 8).alias("seconds"))


@query("SELECT coalesce(n.k,o.k) AS path, coalesce(n.r,o.r) AS rows FROM (SELECT o_orderkey AS k, o_totalprice AS r FROM orders WHERE o_orderkey%2=0) o FULL JOIN (SELECT o_orderkey AS k, -o_totalprice AS r FROM orders WHERE o_orderkey%3=0) n ON o.k=n.k")
def manifest_upsert(t: Town) -> DataFrame:
    k = F.col("o_orderkey")
    rows = lambda keep, r: t.table("orders").filter(keep).select(k.alias("path"), r.alias("rows"))
    return feeds.upserted(rows(k % 2 == 0, F.col("o_totalprice")), rows(k % 3 == 0, -F.col("o_totalprice")), "path")


@query("SELECT p_partkey, CASE p_partkey%6 WHEN 0 THEN 'motorway' WHEN 1 THEN 'primary' WHEN 2 THEN 'unclassified' WHEN 3 THEN NULL WHEN 4 THEN 'living_street' ELSE 'residential' END AS class_name, round(CASE p_partkey%4 WHEN 0 THEN p_size*1.609344::DOUBLE WHEN 1 THEN p_size WHEN 2 THEN p_size ELSE NULL END,6) AS speed_kph FROM part")
def osm_tag_parse(t: Town) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    tag = F.element_at(F.array(*map(F.lit, ("motorway_link", "primary", "road", "footway", "living_street", "residential"))), (k % 6).cast("int") + 1)
    speed = F.when(k % 4 == 0, F.concat(s, F.lit(" mph"))).when(k % 4 == 1, s).when(k % 4 == 2, F.concat(s, F.lit(" km/h"))).otherwise("walk")
    return t.table("part").select("p_partkey", roads.highway_name(tag).alias("class_name"), F.round(roads.max_speed_kph(speed), 6).alias("speed_kph"))


@query(f"SELECT date_trunc('hour', ts) AS hour, {CX} AS cx, {CY} AS cy, count(*) AS n, CAST(sum(severity) AS BIGINT) AS severity_sum FROM crashes GROUP BY ALL", "crashes")
def crash_hours(t: Town) -> DataFrame:
    return streams.hourly_cells(t.crashes, CRASHES)


# -------------------------------------------------------------------- views


@query("SELECT b AS block, b//1000 AS block_group, b//10000000000000 AS state FROM (SELECT (10+c_nationkey)*10000000000000+c_custkey*1000+7 AS b FROM customer)")
def census_blocks(t: Town) -> DataFrame:
    block = (F.lit(10) + F.col("c_nationkey")).cast("bigint") * 10**13 + F.col("c_custkey") * 1000 + 7
    return t.table("customer").select(block.alias("block")).select("block", demand.block_group(F.col("block")).alias("block_group"), demand.block_state(F.col("block")).alias("state"))


@query("SELECT origin, dest, trips FROM od WHERE NOT (origin>=18 AND dest>=18)", "od")
def without_through_trips(t: Town) -> DataFrame:
    """Zones from 18 on lie outside."""
    return demand.without_through(demand.trips(t.commutes), t.zones.filter("zone >= 18"))


@query(
    "SELECT crash_id, CASE WHEN crash_id%3<>0 THEN lon WHEN crash_id%5<>0 THEN lon+1e-4::DOUBLE END AS lon, CASE WHEN crash_id%3<>0 THEN lat WHEN crash_id%5<>0 THEN lat+1e-4::DOUBLE END AS lat FROM crashes", "crashes"
)
def crash_positions(t: Town) -> DataFrame:
    k = F.col("crash_id")
    told = lambda c: F.when(k % 5 == 0, F.lit(0.0)).otherwise(F.col(c) + 1e-4)
    lon, lat = feeds.position(F.when(k % 3 != 0, F.col("lon")), F.when(k % 3 != 0, F.col("lat")), told("lon"), told("lat"))
    return t.crashes.select("crash_id", lon.alias("lon"), lat.alias("lat"))


@query("SELECT p_partkey, CASE WHEN p_partkey%2=0 THEN p_size+0.0::DOUBLE WHEN p_partkey%3=0 THEN p_size*2.0::DOUBLE WHEN p_partkey%5=0 THEN p_size*3.5::DOUBLE ELSE 6.0::DOUBLE END AS height_m FROM part")
def shown_heights(t: Town) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    height, render, levels = F.when(k % 2 == 0, s.cast("string")).otherwise("tall"), F.when(k % 3 == 0, s * 2.0), F.when(k % 5 == 0, s)
    return t.table("part").select("p_partkey", roads.shown_height_m(height, render, levels).alias("height_m"))


@query(f"SELECT CAST(sum(n) AS BIGINT) AS edges FROM (SELECT src_chunk AS chunk, count(*) AS n FROM placed GROUP BY 1) WHERE {IN_BLOCK('chunk')}", "placed")
def area_edges(t: Town) -> DataFrame:
    index = network.chunk_index(network.with_chunks(t.edges, t.nodes, CHUNKS), t.nodes, CHUNKS)
    return index.filter(network.in_window(F.col("chunk"), BLOCK, CHUNKS)).agg(F.sum("edge_count").alias("edges"))


@query(
    """, files AS (SELECT src_chunk AS chunk, * FROM placed UNION ALL SELECT dst_chunk, * FROM placed WHERE src_chunk<>dst_chunk),
    held AS (SELECT chunk, src AS node, src_chunk AS home FROM files UNION SELECT chunk, dst, dst_chunk FROM files)
    SELECT h.chunk, h.ghost_nodes, f.border_edges FROM (SELECT chunk, count(*) FILTER (WHERE home<>chunk) AS ghost_nodes FROM held GROUP BY chunk) h JOIN (SELECT chunk, count(*) FILTER (WHERE src_chunk<>dst_chunk) AS border_edges FROM files GROUP BY chunk) f ON h.chunk=f.chunk""",
    "placed",
)
def file_counts(t: Town) -> DataFrame:
    return views.file_counts(network.mirrored(network.with_chunks(t.edges, t.nodes, CHUNKS)))


@query("SELECT chunk, node, row_number() OVER (ORDER BY chunk, node)-1 AS id FROM chunked", "chunked")
def contiguous_ids(t: Town) -> DataFrame:
    return views.contiguous_ids(t.nodes.select(geo.chunk_of(F.col("lon"), F.col("lat"), CHUNKS).alias("chunk"), "node"))


def _ramp_sql(value: str) -> str:
    """Nested CASE over the colours' stops, as one text of three numbers."""
    stops = model.VC_COLOURS
    mixed = lambda k, p: f"CAST(floor({stops[k][1][p]}+({stops[k + 1][1][p] - stops[k][1][p]})*(({value})-({stops[k][0]}::DOUBLE))/{stops[k + 1][0] - stops[k][0]!r}::DOUBLE+0.5::DOUBLE) AS BIGINT)"
    cases = [f"WHEN {value}<={stops[k + 1][0]}::DOUBLE THEN {mixed(k, 0)}||','||{mixed(k, 1)}||','||{mixed(k, 2)}" for k in range(len(stops) - 1)]
    first, last = (",".join(map(str, s[1])) for s in (stops[0], stops[-1]))
    return f"CASE WHEN {value}<={stops[0][0]}::DOUBLE THEN '{first}' {' '.join(cases)} ELSE '{last}' END"


@query(f"SELECT h.hour, h.edge, {_ramp_sql('(volume/capacity_vph)')} AS colour FROM hourly h JOIN network n ON h.edge=n.edge", "hourly", "network")
def vc_colours(t: Town) -> DataFrame:
    rgb = views.interpolated(F.col("volume") / F.col("capacity_vph"), model.VC_COLOURS)
    return t.hourly.join(t.network, "edge").select("hour", "edge", rgb.alias("c")).select("hour", "edge", F.concat_ws(",", "c.r", "c.g", "c.b").alias("colour"))


@query("SELECT DISTINCT e.edge, e.edge IN (SELECT edge FROM edges) AS known FROM edits e", "edits", "edges")
def edited_edges(t: Town) -> DataFrame:
    there = t.edges.select("edge", F.lit(True).alias("there"))
    return t.edits.select("edge").distinct().join(there, "edge", "left").select("edge", F.coalesce("there", F.lit(False)).alias("known"))


SHIFTED = (BLOCK[0] + 2, BLOCK[1] + 1, BLOCK[2] + 2, BLOCK[3] + 1)
IN_SHIFTED = lambda c: f"({c} % {CHUNKS.cols} BETWEEN {SHIFTED[0]} AND {SHIFTED[2]} AND {c} // {CHUNKS.cols} BETWEEN {SHIFTED[1]} AND {SHIFTED[3]})"


@query(f"SELECT chunk, CASE WHEN {IN_BLOCK('chunk')} THEN 'free' ELSE 'load' END AS action FROM (SELECT DISTINCT chunk FROM chunked) WHERE {IN_BLOCK('chunk')}<>{IN_SHIFTED('chunk')}", "chunked")
def area_changes(t: Town) -> DataFrame:
    chunks = t.nodes.select(geo.chunk_of(F.col("lon"), F.col("lat"), CHUNKS).alias("chunk")).distinct()
    old, new = (chunks.filter(network.in_window(F.col("chunk"), w, CHUNKS)) for w in (BLOCK, SHIFTED))
    return views.changes(old, new, "chunk")


@query("SELECT trip, arg_min(leave_s, seq) AS depart_s FROM (SELECT trip, seq, leave_s FROM told WHERE seq=1) WHERE leave_s IS NOT NULL GROUP BY trip", "told")
def first_departures(t: Town) -> DataFrame:
    return transit.first_departures(t.told_times)


@query("SELECT trip, seq, greatest(n-leave_s,0.0::DOUBLE) AS hop_s FROM (SELECT *, lead(reach_s) OVER (PARTITION BY trip ORDER BY seq) AS n FROM told) WHERE n IS NOT NULL AND leave_s IS NOT NULL", "told")
def told_hops(t: Town) -> DataFrame:
    return transit.told_hops(t.told_times)


@query("SELECT edge FROM edges WHERE class<=3 AND a_lon BETWEEN -77.4::DOUBLE AND -77.2::DOUBLE AND a_lat BETWEEN 38.7::DOUBLE AND 38.9::DOUBLE", "edges")
def major_in_view(t: Town) -> DataFrame:
    return views.major_in_view(t.edges, (-77.4, 38.7, -77.2, 38.9)).select("edge")


@query("SELECT hour, h.edge, volume, round(a_lon,8) AS a_lon, round(a_lat,8) AS a_lat, round(b_lon,8) AS b_lon, round(b_lat,8) AS b_lat FROM hourly h JOIN edges e ON e.edge=h.edge", "hourly", "edges")
def hour_geometry(t: Town) -> DataFrame:
    return rounded(views.with_geometry(t.hourly, t.edges), 8)


@query(
    "SELECT vec_id, round(z-g,6) AS height FROM returns r LEFT JOIN (SELECT vec_id%16 AS chunk, round(min(CASE WHEN cls=2 THEN z END),3) AS g FROM returns GROUP BY 1) x ON x.chunk=r.vec_id%16", "returns"
)
def above_ground(t: Town) -> DataFrame:
    points = t.returns.withColumn("chunk", F.col("vec_id") % 16)
    return views.above_ground(points, feeds.ground(points, F.col("chunk"))).select("vec_id", F.round("height", 6).alias("height"))


@query(
    f"""SELECT z.zone AS view, c.chunk FROM zones z JOIN (SELECT DISTINCT cx, cy, chunk FROM chunked) c ON {CHUNKS.west!r}::DOUBLE+c.cx*{CHUNKS.lon_deg!r}::DOUBLE<=z.lon+0.0401::DOUBLE AND {CHUNKS.west!r}::DOUBLE+(c.cx+1)*{CHUNKS.lon_deg!r}::DOUBLE>z.lon-0.0401::DOUBLE
    AND {CHUNKS.south!r}::DOUBLE+c.cy*{CHUNKS.lat_deg!r}::DOUBLE<=z.lat+0.0401::DOUBLE AND {CHUNKS.south!r}::DOUBLE+(c.cy+1)*{CHUNKS.lat_deg!r}::DOUBLE>z.lat-0.0401::DOUBLE""",
    "zones", "chunked",
)
def chunks_in_view(t: Town) -> DataFrame:
    side = lambda c, d: (F.col(c) + d)
    boxes = t.zones.select(F.col("zone").alias("view"), side("lon", -0.0401).alias("west"), side("lat", -0.0401).alias("south"), side("lon", 0.0401).alias("east"), side("lat", 0.0401).alias("north"))
    chunks = t.nodes.select(geo.chunk_of(F.col("lon"), F.col("lat"), CHUNKS).alias("chunk")).distinct()
    return views.chunks_in_view(boxes, chunks, CHUNKS)


@query("SELECT count(*) AS features, count(total) AS attributed FROM parcels p LEFT JOIN latest l ON p.parcel_id=l.parcel_id", "parcels", "latest")
def attributed_counts(t: Town) -> DataFrame:
    return feeds.attributed(t.parcels.join(_latest(t), "parcel_id", "left"), "total")


@query(
    """, flows AS (SELECT h.hour, h.edge, volume, volume/capacity_vph AS vc, volume*len_m/1609.344::DOUBLE AS vmt FROM hourly h JOIN network n ON h.edge=n.edge),
    peak AS (SELECT arg_max(hour, (vmt, -hour)) AS hour FROM (SELECT hour, sum(vmt) AS vmt FROM flows GROUP BY hour))
    SELECT edge, round(vc,8) AS vc FROM flows WHERE hour=(SELECT hour FROM peak) AND vc>0 ORDER BY vc DESC, edge LIMIT 20""",
    "hourly", "network",
)
def peak_corridors(t: Town) -> DataFrame:
    """The busiest roads of the hour with the most vehicle miles."""
    rows = t.hourly.join(t.network, "edge")
    peak = feeds.daily_kpis(assign.kpis(rows, "hour").withColumnRenamed("mean_delay_s_per_traversal", "mean_delay_s")).select(F.col("peak_hour").cast("int").alias("hour"))
    return assign.busiest(rows.join(F.broadcast(peak), "hour")).select("edge", F.round("vc", 8).alias("vc"))


from tallyway.plans import clouds, what_if  # noqa: E402, F401  they register their queries
