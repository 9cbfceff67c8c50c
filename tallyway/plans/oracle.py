"""The derived relations as DuckDB SQL, for checking queries against another engine."""

from __future__ import annotations

from tallyway import model
from tallyway.plans.derive import CHUNKS, CRASHES

_CLASSES = ", ".join(f"({c}, {v}::DOUBLE, {n}, {p}::DOUBLE)" for c, _, v, n, p in model.ROAD_CLASSES)
_HOURS = ", ".join(f"({h}, {s}::DOUBLE, {model.return_share(h)}::DOUBLE)" for h, s in enumerate(model.HOUR_SHARE))
_CATEGORIES = ", ".join(f"'{c}'" for c in model.ZONE_CATEGORIES)


def distance(a: str, b: str, c: str, d: str) -> str:
    return f"sqrt(pow(({c}-({a}))*111320.0::DOUBLE*cos(radians(0.5::DOUBLE*(({b})+({d})))),2)+pow((({d})-({b}))*111320.0::DOUBLE,2))"


def cell(lon: str, lat: str, grid=CHUNKS) -> tuple[str, str]:
    clamp = lambda v, most: f"CAST(least(greatest(floor({v}),0),{most}) AS BIGINT)"
    return clamp(f"(({lon})-({grid.west!r}::DOUBLE))/{grid.lon_deg!r}::DOUBLE", grid.cols - 1), clamp(f"(({lat})-({grid.south!r}::DOUBLE))/{grid.lat_deg!r}::DOUBLE", grid.rows - 1)


_X, _Y = cell("lon", "lat")

#: In order: later ones use earlier ones.
RELATIONS = {
    "side": "SELECT greatest(2, CAST(ceil(sqrt(max(c_custkey)+1)) AS BIGINT)) AS side FROM customer",
    "nodes": "SELECT c_custkey AS node, c_custkey % side AS ix, c_custkey // side AS iy, -77.54::DOUBLE+0.5::DOUBLE*(c_custkey % side)/(side-1) AS lon, 38.6::DOUBLE+0.46::DOUBLE*(c_custkey // side)/(side-1) AS lat, CAST(c_nationkey AS BIGINT) AS nation, c_acctbal AS balance FROM customer, side",
    "edges": f"""SELECT a.node*4+d AS edge, a.node AS src, b.node AS dst,
        CASE WHEN (CASE WHEN d<2 THEN a.iy ELSE a.ix END)%6=0 THEN 0 WHEN (CASE WHEN d<2 THEN a.iy ELSE a.ix END)%3=0 THEN 2 WHEN (CASE WHEN d<2 THEN a.iy ELSE a.ix END)%2=0 THEN 3 ELSE 5 END AS class,
        {distance('a.lon', 'a.lat', 'b.lon', 'b.lat')}+0.1::DOUBLE*((a.node*4+d)*7919%97) AS len_m, a.lon AS a_lon, a.lat AS a_lat, b.lon AS b_lon, b.lat AS b_lat
        FROM nodes a, (VALUES (0,-1,0),(1,1,0),(2,0,-1),(3,0,1)) s(d,dx,dy), side, nodes b
        WHERE a.ix+dx BETWEEN 0 AND side-1 AND a.iy+dy>=0 AND b.node=(a.iy+dy)*side+a.ix+dx""",
    "classes": f"SELECT * FROM (VALUES {_CLASSES}) c(class, kph, lanes, lane_vph)",
    "network": "SELECT edge, src, dst, e.class, len_m, kph AS speed_kph, lanes, lanes*lane_vph AS capacity_vph, len_m/greatest(kph/3.6::DOUBLE,0.001::DOUBLE) AS free_s FROM edges e JOIN classes c ON e.class=c.class",
    "chunked": f"SELECT node, lon, lat, {_X} AS cx, {_Y} AS cy, {_Y}*{CHUNKS.cols}+{_X} AS chunk FROM nodes",
    "placed": "SELECT e.*, a.chunk AS src_chunk, b.chunk AS dst_chunk FROM edges e JOIN chunked a ON e.src=a.node JOIN chunked b ON e.dst=b.node",
    "zones": "SELECT CAST(n_nationkey AS BIGINT) AS zone, -77.54::DOUBLE+0.5::DOUBLE*((n_nationkey*37)%100)/100.0::DOUBLE AS lon, 38.6::DOUBLE+0.46::DOUBLE*((n_nationkey*61)%100)/100.0::DOUBLE AS lat FROM nation",
    "od": "SELECT * FROM (SELECT CAST(c_nationkey AS BIGINT) AS origin, CAST(s_nationkey AS BIGINT) AS dest, sum(l_quantity)*0.8::DOUBLE AS trips FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN supplier ON l_suppkey=s_suppkey WHERE c_nationkey<>s_nationkey GROUP BY 1,2) WHERE trips>=0.5::DOUBLE",
    "masses": "SELECT z.*, CAST(n AS DOUBLE) AS mass FROM zones z JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON z.zone=c.c_nationkey",
    "pulls": f"SELECT a.zone AS origin, b.zone AS dest, a.mass*b.mass/pow(greatest({distance('a.lon', 'a.lat', 'b.lon', 'b.lat')},500.0::DOUBLE)/1000.0::DOUBLE,2) AS pull FROM masses a JOIN masses b ON a.zone<>b.zone",
    "halved": """SELECT origin, dest, trips, 0 AS k, 0.0::DOUBLE AS lo, trips AS hi FROM od UNION ALL
        SELECT origin, dest, trips, k+1, CASE WHEN g>0 THEN lo ELSE (lo+hi)/2 END, CASE WHEN g>0 THEN (lo+hi)/2 ELSE hi END FROM
        (SELECT *, (60.0::DOUBLE*(1+0.15::DOUBLE*pow((lo+hi)/2/1200.0::DOUBLE,4)))-(110.0::DOUBLE*(1+0.15::DOUBLE*pow((trips-(lo+hi)/2)/3000.0::DOUBLE,4))) AS g FROM halved WHERE k<40)""",
    "hours": f"SELECT * FROM (VALUES {_HOURS}) h(hour, share, back)",
    "crashes": "SELECT event_id AS crash_id, ts, -77.54::DOUBLE+0.5::DOUBLE*((user_id*37)%150)/150.0::DOUBLE+0.0012::DOUBLE*(event_id%3) AS lon, 38.6::DOUBLE+0.46::DOUBLE*((user_id*61)%150)/150.0::DOUBLE+0.0009::DOUBLE*(event_id%2) AS lat, CAST(year(ts) AS BIGINT) AS yr, CASE event_type WHEN 'error' THEN 5 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 3 WHEN 'click' THEN 2 ELSE 1 END AS severity FROM events",
    "stations": "SELECT s_suppkey AS station_id, abs(s_acctbal) AS aadt, -77.54::DOUBLE+0.5::DOUBLE*((s_suppkey*4937)%10000)/10000.0::DOUBLE AS lon, 38.6::DOUBLE+0.46::DOUBLE*((s_suppkey*3571)%10000)/10000.0::DOUBLE AS lat FROM supplier",
    "stop_times": "SELECT l_orderkey AS trip, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_suppkey,l_partkey,l_extendedprice) AS seq, l_suppkey%4 AS stop, CAST((l_orderkey*137)%93600+300*l_linenumber+l_quantity AS DOUBLE) AS arrive_s FROM lineitem",
    "told": "SELECT trip, seq, CASE WHEN seq%4<>1 THEN arrive_s+20 ELSE CASE WHEN seq%3<>0 THEN arrive_s END END AS leave_s, CASE WHEN seq%3<>0 THEN arrive_s ELSE CASE WHEN seq%4<>1 THEN arrive_s+20 END END AS reach_s FROM stop_times",
    "patterns": "SELECT trip, list(stop ORDER BY seq) AS pattern FROM stop_times GROUP BY trip",
    "hops": "SELECT trip, seq, greatest(n-arrive_s,0.0::DOUBLE) AS hop_s FROM (SELECT *, lead(arrive_s) OVER (PARTITION BY trip ORDER BY seq) AS n FROM stop_times) WHERE n IS NOT NULL",
    "departures": "SELECT o_custkey%50 AS pattern, o_orderkey AS trip, CAST((o_orderkey*137)%93600 AS DOUBLE) AS depart_s FROM orders",
    "parcels": f"SELECT p_partkey AS parcel_id, CASE WHEN p_partkey%8=7 THEN 'R-3' ELSE list_extract([{_CATEGORIES}], CAST(p_partkey%8+1 AS INT)) END AS zone, p_type AS land_use, 100.0::DOUBLE*p_size AS area_m2 FROM part",
    "latest": "SELECT parcel_id, yr, total FROM (SELECT l_partkey AS parcel_id, CAST(year(l_shipdate) AS BIGINT) AS yr, l_extendedprice AS total, row_number() OVER (PARTITION BY l_partkey ORDER BY year(l_shipdate) DESC, l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM lineitem) WHERE rn=1",
    "returns": "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, label AS cls FROM embeddings",
    "edits": """SELECT o_orderkey AS seq, CASE WHEN o_orderkey%5=0 THEN 'close' ELSE 'set' END AS type, (o_orderkey*7919)%(4*side*side+40) AS edge,
        CASE WHEN o_orderkey%5<>0 AND o_orderkey%2=0 THEN CAST(o_orderkey%4+1 AS INT) END AS lanes, CASE WHEN o_orderkey%5<>0 AND o_orderkey%3=0 THEN CAST(30+o_orderkey%60 AS DOUBLE) END AS speed_kph,
        CASE WHEN o_orderkey%5<>0 AND o_orderkey%7=0 THEN CAST(500+o_orderkey%3000 AS DOUBLE) END AS capacity_vph FROM orders, side""",
    "additions": "SELECT o_orderkey AS seq, (o_orderkey*31)%(side*side+5) AS src, (o_orderkey*57)%(side*side+5) AS dst, o_orderkey%3+1 AS lanes, CAST(40+o_orderkey%50 AS DOUBLE) AS speed_kph, CAST(600*(o_orderkey%3+1) AS DOUBLE) AS capacity_vph FROM orders, side",
    "folded": "SELECT edge, bool_or(type='close') AS closed, arg_max(lanes,seq) FILTER (WHERE lanes IS NOT NULL) AS new_lanes, arg_max(speed_kph,seq) FILTER (WHERE speed_kph IS NOT NULL) AS new_speed, arg_max(capacity_vph,seq) FILTER (WHERE capacity_vph IS NOT NULL) AS new_capacity FROM edits GROUP BY edge",
    "overlay": "SELECT n.edge, len_m, coalesce(new_lanes,lanes) AS lanes, coalesce(new_speed,speed_kph) AS speed_kph, coalesce(new_capacity,capacity_vph/greatest(lanes,1)*greatest(coalesce(new_lanes,lanes),1)) AS capacity_vph, NOT coalesce(closed,false) AS open FROM network n LEFT JOIN folded f ON n.edge=f.edge",
    "hourly": "SELECT CAST(CASE WHEN l_partkey%9=0 THEN 8 ELSE l_suppkey%24 END AS INT) AS hour, l_partkey*4+l_linenumber%4 AS edge, sum(l_quantity) AS volume FROM lineitem GROUP BY 1,2",
    "daily": "SELECT edge, count(DISTINCT h.hour) AS hours_present, CASE WHEN count(DISTINCT h.hour)=1 THEN sum(volume)/max(share) ELSE sum(volume) END AS modelled_daily FROM hourly h JOIN hours s ON h.hour=s.hour GROUP BY edge",
    "places": "SELECT DISTINCT lon, lat FROM crashes",
    "past": "SELECT p.lon, p.lat, e.edge, (a_lon-lon)*cos(radians(lat))*111320.0::DOUBLE AS ax, (a_lat-lat)*111320.0::DOUBLE AS ay, (b_lon-a_lon)*cos(radians(lat))*111320.0::DOUBLE AS dx, (b_lat-a_lat)*111320.0::DOUBLE AS dy FROM places p, edges e",
    "walks": f"SELECT src, dst, len_m/{model.WALK_MPS}::DOUBLE AS c FROM edges",
    "asked": "SELECT s_suppkey AS origin, -77.54::DOUBLE+0.5::DOUBLE*(s_suppkey*37%(side*side)%side)/(side-1) AS lon, 38.6::DOUBLE+0.46::DOUBLE*(s_suppkey*37%(side*side)//side)/(side-1) AS lat FROM supplier, side WHERE s_suppkey%50=0",
    "starts": f"SELECT a.origin, arg_min(n.node, (round({distance('a.lon', 'a.lat', 'n.lon', 'n.lat')},6), n.node)) AS node, 0.0::DOUBLE AS cost FROM asked a, nodes n GROUP BY a.origin",
    "gates": f"SELECT z.zone AS origin, arg_min(n.node, (round({distance('z.lon', 'z.lat', 'n.lon', 'n.lat')},6), n.node)) AS node, 0.0::DOUBLE AS cost FROM zones z, nodes n GROUP BY z.zone",
    "calls": "SELECT n.iy//6 AS pattern, CAST(ix//3 AS INT) AS seq, node, least(h.headway,1800)/2 AS wait_s, (ix//3)*60.0::DOUBLE AS along_s FROM nodes n JOIN (SELECT pattern, 3600.0::DOUBLE*24/count(*) AS headway FROM departures GROUP BY pattern) h ON h.pattern=n.iy//6 WHERE iy%6=0 AND ix%3=0",
    "homes": "SELECT c_custkey AS node, count(*) AS trips FROM customer JOIN orders ON c_custkey=o_custkey GROUP BY 1",
    "beside": "SELECT *, CASE WHEN dx*dx+dy*dy>0 THEN least(greatest(-(ax*dx+ay*dy)/(dx*dx+dy*dy),0.0::DOUBLE),1.0::DOUBLE) ELSE 0.0::DOUBLE END AS t FROM past",
    "crashed": "SELECT c.crash_id, c.severity, s.edge FROM crashes c JOIN (SELECT lon, lat, arg_min(edge, (round(m,6), edge)) AS edge FROM (SELECT lon, lat, edge, sqrt(pow(ax+t*dx,2)+pow(ay+t*dy,2)) AS m FROM beside) WHERE m<=120.0::DOUBLE GROUP BY lon, lat) s ON s.lon=c.lon AND s.lat=c.lat",
    "apart": "SELECT s.station_id, s.aadt, e.edge, (a_lon-lon)*cos(radians(lat))*111320.0::DOUBLE AS ax, (a_lat-lat)*111320.0::DOUBLE AS ay, (b_lon-a_lon)*cos(radians(lat))*111320.0::DOUBLE AS dx, (b_lat-a_lat)*111320.0::DOUBLE AS dy FROM stations s, edges e",
    "along": "SELECT *, CASE WHEN dx*dx+dy*dy>0 THEN least(greatest(-(ax*dx+ay*dy)/(dx*dx+dy*dy),0.0::DOUBLE),1.0::DOUBLE) ELSE 0.0::DOUBLE END AS t FROM apart",
    "snapped": "SELECT station_id, aadt, edge, m FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY round(m,6), edge) AS rn FROM (SELECT *, sqrt(pow(ax+t*dx,2)+pow(ay+t*dy,2)) AS m FROM along) WHERE m<=250.0::DOUBLE) WHERE rn=1",
}

NEEDS = {
    "walks": ["edges"], "calls": ["nodes", "departures"], "asked": ["side"], "starts": ["asked", "nodes"], "gates": ["zones", "nodes"],
    "masses": ["zones"], "pulls": ["masses"], "halved": ["od"], "nodes": ["side"], "edges": ["nodes"], "network": ["edges", "classes"], "chunked": ["nodes"], "placed": ["edges", "chunked"],
    "told": ["stop_times"], "patterns": ["stop_times"], "hops": ["stop_times"], "edits": ["side"], "folded": ["edits"], "additions": ["side"], "places": ["crashes"], "past": ["places", "edges"], "beside": ["past"], "crashed": ["beside"], "overlay": ["network", "folded"], "daily": ["hourly", "hours"], "apart": ["stations", "edges"], "along": ["apart"], "snapped": ["along"],
}


def sql(body: str, *names: str) -> str:
    """``body`` after the relations it names and those that they need."""
    wanted: set[str] = set()

    def want(name: str) -> None:
        if name not in wanted:
            wanted.add(name)
            for other in NEEDS.get(name, []):
                want(other)

    for name in names:
        want(name)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({t})" for n, t in RELATIONS.items() if n in wanted) + "\n" + body if wanted else body


def crash_cell() -> tuple[str, str]:
    return cell("lon", "lat", CRASHES)


def relaxed(starts: str, arcs: str, within: str = "true", name: str = "reach") -> str:
    """Labels (origin, node, cost) relaxed from ``starts`` over ``arcs(src, dst, c)``, as a recursive relation that keeps a row per key."""
    return f""", {name}(origin, node, cost) USING KEY (origin, node) AS (SELECT origin, node, cost FROM {starts} UNION
        SELECT x.origin, x.dst, min(x.c) FROM (SELECT i.origin, w.dst, i.cost+w.c AS c FROM {name} i JOIN {arcs} w ON w.src=i.node) x
        LEFT JOIN recurring.{name} r ON r.origin=x.origin AND r.node=x.dst WHERE {within} AND (r.cost IS NULL OR x.c<r.cost) GROUP BY x.origin, x.dst)"""


def ridden(budget: float, rounds: int = model.BOARDINGS) -> str:
    """Labels by walking and rides over ``calls``, each round written out; the last is reach. For patterns that share no stop and call at none twice, so that
    rides don't chain within a round."""
    parts = [relaxed("starts", "walks", f"x.c<={budget}", "walk0")]
    for k in range(rounds):
        parts.append(f""", ride{k} AS (SELECT l.origin, b.node, min(l.cost+a.wait_s+b.along_s-a.along_s) AS cost FROM walk{k} l JOIN calls a ON a.node=l.node JOIN calls b ON b.pattern=a.pattern AND b.seq>a.seq
            WHERE l.cost+a.wait_s+b.along_s-a.along_s<={budget} GROUP BY 1, 2),
            both{k} AS (SELECT origin, node, min(cost) AS cost FROM (SELECT * FROM walk{k} UNION ALL SELECT * FROM ride{k}) GROUP BY 1, 2)""")
        parts.append(relaxed(f"both{k}", "walks", f"x.c<={budget}", f"walk{k + 1}" if k + 1 < rounds else "reach"))
    return "".join(parts)
