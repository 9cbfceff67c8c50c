"""Hand-computed and analytic cases, and two forms of the same operator against each other."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyway import model
from tallyway.functions import roads
from tallyway.operators import assign, demand, feeds, network, paths, scenario, snap, transit


def solver_edges(spark, rows):
    """rows: (edge, src, dst, free_s, capacity)."""
    return spark.createDataFrame([(e, a, b, t, t, c, True) for e, a, b, t, c in rows], "edge long, src long, dst long, len_m double, free_s double, capacity_vph double, open boolean")


def test_two_routes_share_trips_as_in_theory(spark):
    edges = solver_edges(spark, [(0, 0, 1, 60.0, 1200.0), (1, 1, 3, 0.001, 1e9), (2, 0, 2, 110.0, 3000.0), (3, 2, 3, 0.001, 1e9)])
    trips = spark.createDataFrame([(0, 3, 3000.0)], "origin long, dest long, trips double")
    result = assign.equilibrium(edges, trips)
    first = result.edges.set_index("edge")["volume"][0]
    exact = spark.range(1).select(assign.wardrop(F.lit(3000.0), F.lit(60.0), F.lit(1200.0), F.lit(110.0), F.lit(3000.0))).first()[0]
    assert first == pytest.approx(exact, rel=0.01)
    assert result.gap < model.GAP


def test_closing_the_braess_link_saves_time(spark):
    rows = [(0, 0, 1, 1.0, 1000.0), (1, 2, 3, 1.0, 1000.0), (2, 0, 2, 45.0, 1e9), (3, 1, 3, 45.0, 1e9)]
    trips = spark.createDataFrame([(0, 3, 4000.0)], "origin long, dest long, trips double")
    hours = []
    for links in (rows, [*rows, (4, 1, 2, 0.1, 1e9)]):
        result = assign.equilibrium(solver_edges(spark, links), trips)
        hours.append(assign.kpis(result.frame(trips, 8), "hour").first()["vht"])
        assert result.gap >= 0
    assert hours[0] < hours[1]


def test_trees_agree_with_relaxation(spark):
    side = 7
    rng = np.random.default_rng(3)
    rows, e = [], 0
    for x in range(side):
        for y in range(side):
            for dx, dy in ((1, 0), (0, 1)):
                if x + dx < side and y + dy < side:
                    for a, b in (((x, y), (x + dx, y + dy)), ((x + dx, y + dy), (x, y))):
                        rows.append((e, a[0] * side + a[1], b[0] * side + b[1], float(rng.random() + 0.1)))
                        e += 1
    edges = pd.DataFrame(rows, columns=["edge", "src", "dst", "cost"])
    topology = paths.Topology(edges)
    topology.dst_list = topology.dst.tolist()
    distance, _, _ = paths.tree(topology, edges["cost"].to_numpy()[topology.order].tolist(), 0)
    frame = spark.createDataFrame(edges)
    labels = paths.relaxed(frame, spark.createDataFrame([(0, 0, 0.0)], "origin long, node long, cost double"))
    got = {r["node"]: r["cost"] for r in labels.collect()}
    assert got == pytest.approx(dict(zip(topology.nodes.tolist(), distance, strict=True)))
    trips = spark.createDataFrame([(0, side * side - 1, 5.0), (3, 10, 2.0)], "origin long, dest long, trips double")
    volume = {r["edge"]: r["volume"] for r in paths.all_or_nothing(paths.Shared(spark, edges), edges["cost"].to_numpy(), trips, 3).collect()}
    out = sum(volume.get(r.edge, 0) for r in edges.itertuples() if r.src == 0) - sum(volume.get(r.edge, 0) for r in edges.itertuples() if r.dst == 0)
    assert out == pytest.approx(5.0)


def test_loads_of_joins_agree_with_trees(spark):
    rng = np.random.default_rng(5)
    links = {(a, (a + 1) % 30) for a in range(30)} | {(int(a), int(b)) for a, b in rng.integers(0, 30, (60, 2)) if a != b}
    rows = [(k, a, b, float(rng.random() + 0.1) if k % 9 else 0.0) for k, (a, b) in enumerate(sorted(links))]
    rows.append((len(rows), 40, 41, 1.0))  # nobody gets there
    edges = pd.DataFrame(rows, columns=["edge", "src", "dst", "cost"])
    asked = [(int(a), int(b), float(n)) for a, b, n in rng.integers(0, 30, (50, 3)) if a != b and n] + [(3, 41, 7.0)]
    trips = spark.createDataFrame(asked, "origin long, dest long, trips double")
    want = {r["edge"]: r["volume"] for r in paths.all_or_nothing(paths.Shared(spark, edges), edges["cost"].to_numpy(), trips, 3).collect()}
    got = {r["edge"]: r["volume"] for r in paths.tree_loads(spark.createDataFrame(edges), trips).collect()}
    assert got == pytest.approx(want)
    assert paths.tree_loads(spark.createDataFrame(edges), trips.limit(0)).count() == 0


def test_free_roads_make_no_circle(spark):
    edges = spark.createDataFrame([(k, *e, 0.0) for k, e in enumerate([(0, 1), (1, 0), (1, 2), (2, 1), (2, 3), (3, 0)])], "edge long, src long, dst long, cost double")
    trips = spark.createDataFrame([(0, 3, 2.0), (2, 0, 1.0)], "origin long, dest long, trips double")
    got = {r["edge"]: r["volume"] for r in paths.tree_loads(edges, trips).collect()}
    assert got in ({0: 2.0, 2: 2.0, 4: 2.0, 3: 1.0, 1: 1.0}, {0: 2.0, 2: 2.0, 4: 3.0, 5: 1.0})


def test_equilibrium_beyond_the_bound_is_the_same(spark, monkeypatch):
    rng = np.random.default_rng(1)
    ends = [(x * 4 + y, (x + dx) * 4 + y + dy) for x in range(4) for y in range(4) for dx, dy in ((1, 0), (0, 1), (1, 1)) if x + dx < 4 and y + dy < 4]
    rows = [(e, a, b, float(rng.random() + 1), float(rng.integers(300, 900))) for e, (a, b) in enumerate(ends)]
    edges = solver_edges(spark, rows).withColumn("open", F.col("edge") != 7)
    trips = spark.createDataFrame([(0, 15, 2000.0), (1, 15, 700.0), (4, 11, 500.0), (0, 10, 900.0)], "origin long, dest long, trips double")
    near, one = assign.equilibrium(edges, trips, iterations=2), assign.loads(edges, trips).collect()
    monkeypatch.setattr(paths, "TOPOLOGY_EDGES", 0)
    far = assign.equilibrium(edges, trips, iterations=2)
    assert (far.iterations, far.gap) == (near.iterations, pytest.approx(near.gap))
    flows = {r["edge"]: r["volume"] for r in far.frame(trips, 8).collect()}
    assert flows == pytest.approx(near.edges.set_index("edge")["volume"].to_dict(), abs=1e-6)
    assert {r["edge"]: r["volume"] for r in assign.loads(edges, trips).collect()} == pytest.approx({r["edge"]: r["volume"] for r in one})
    assert assign.equilibrium(edges, trips.limit(0), far.frame(trips, 8)).gap == 0


def line(spark, n, metres=500.0):
    walks = [(i, j, metres / model.WALK_MPS) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n]
    return spark.createDataFrame(walks, "src long, dst long, cost double")


def test_walk_and_bus_on_a_line(spark):
    start = spark.createDataFrame([(0, 0, 0.0)], "origin long, node long, cost double")
    calls = spark.createDataFrame([(0, 0, 0, 300.0, 0.0), (0, 1, 8, 300.0, 120.0)], "pattern long, seq int, node long, wait_s double, along_s double")
    got = {r["node"]: r["cost"] for r in transit.isochrone(line(spark, 9), calls, start, 3600.0).collect()}
    assert got[8] == pytest.approx(420.0)
    assert got[7] == pytest.approx(420 + 500 / 1.35)
    walked = {r["node"] for r in transit.isochrone(line(spark, 9), None, start, 600.0).collect()}
    assert walked == {0, 1}
    assert {r["node"] for r in transit.isochrone(line(spark, 9), None, start, 0.0).collect()} == {0}


def test_a_chain_becomes_one_edge_each_way(spark):
    rows = [(2 * i + d, *((i, i + 1) if d == 0 else (i + 1, i)), 5, 100.0) for i in range(4) for d in (0, 1)]
    edges = spark.createDataFrame(rows, "edge long, src long, dst long, class int, len_m double")
    got = sorted((r["src"], r["dst"], r["len_m"], r["parts"]) for r in network.simplified(edges).collect())
    assert got == [(0, 4, 400.0, 4), (4, 0, 400.0, 4)]


def two_way(spark, links, extra="class int, lanes int", values=(5, 1)):
    rows = [(2 * k + d, *(link if d == 0 else link[::-1]), *values, 100.0) for k, link in enumerate(links) for d in (0, 1)]
    return spark.createDataFrame(rows, f"edge long, src long, dst long, {extra}, len_m double")


def test_rings_stay_and_loops_go(spark):
    ring = two_way(spark, [(0, 1), (1, 2), (2, 0)])
    assert sorted(r["edge"] for r in network.simplified(ring).collect()) == list(range(6))
    one_way = ring.filter("edge % 2 = 0")
    assert sorted(r["edge"] for r in network.simplified(one_way).collect()) == [0, 2, 4]
    # A chain 10-11-12-13 beside the ring, and a lollipop: a loop that leaves 20 and comes back to it.
    more = two_way(spark, [(0, 1), (1, 2), (2, 3), (3, 4), (4, 0), (10, 11), (11, 12), (12, 13), (20, 21), (21, 22), (22, 20), (20, 23), (20, 24)])
    got = network.simplified(more).collect()
    assert {(r["src"], r["dst"]) for r in got if r["src"] < 5} == {p for a in range(5) for p in ((a, (a + 1) % 5), ((a + 1) % 5, a))}
    assert sorted((r["src"], r["dst"], r["parts"], r["len_m"], r["shape"]) for r in got if 10 <= r["src"] < 20) == [(10, 13, 3, 300.0, [10, 11, 12, 13]), (13, 10, 3, 300.0, [13, 12, 11, 10])]
    assert {(r["src"], r["dst"]) for r in got if r["src"] >= 20} == {(20, 23), (23, 20), (20, 24), (24, 20)}


def test_a_change_of_lanes_ends_a_chain(spark):
    one, two = two_way(spark, [(0, 1), (1, 2)]), two_way(spark, [(2, 3), (3, 4)], values=(5, 2)).withColumn("edge", F.col("edge") + 10)
    got = sorted((r["src"], r["dst"], r["lanes"]) for r in network.simplified(one.union(two)).collect())
    assert got == [(0, 2, 1), (2, 0, 1), (2, 4, 2), (4, 2, 2)]


def test_directions_are_conjugate():
    rng = np.random.default_rng(3)
    weight, aim = rng.random(40), rng.standard_normal(40)
    past = [-0.2 * aim + 0.3 * rng.standard_normal(40) for _ in range(2)]
    d = assign.toward(aim, past, weight)
    solved = [k for k in (2, 1) if all(abs(float(d @ (weight * p))) < 1e-9 for p in past[:k])]
    assert solved
    assert assign.toward(aim, [], weight) is aim
    assert assign.toward(aim, [aim.copy()], weight) is aim  # only a negative share would be conjugate


def test_step_is_where_the_slope_vanishes():
    price = lambda x: 1 + x**4
    bend = lambda x: 4 * x**3
    x, d = np.array([3.0, 0.0]), np.array([-3.0, 3.0])
    assert assign.step_length(price, bend, x, d) == pytest.approx(0.5)
    assert assign.step_length(price, bend, x, np.array([-1.0, 0.0])) == 1.0


def test_many_targets_are_searched_in_rings(spark, monkeypatch):
    rng = np.random.default_rng(4)
    at = lambda n: [(k, -77.5 + float(a), 38.6 + float(b)) for k, (a, b) in enumerate(rng.random((n, 2)))]
    points, few = spark.createDataFrame(at(50), "point long, lon double, lat double"), spark.createDataFrame(at(60), "target long, lon double, lat double")
    want = sorted(tuple(r) for r in snap.to_few(points, few).collect())
    monkeypatch.setattr(snap, "FEW", 5)
    assert sorted(tuple(r) for r in snap.to_few(points, few).collect()) == want
    assert snap.to_few(points.limit(0), few).count() == 0


def test_hours_of_a_sweep_agree_with_single_hours(spark):
    edges = solver_edges(spark, [(0, 0, 1, 60.0, 1200.0), (1, 0, 1, 110.0, 3000.0)])
    trips = spark.createDataFrame([(7, 0, 1, 3000.0), (8, 0, 1, 100.0)], "hour int, origin long, dest long, trips double")
    got = {(r["hour"], r["edge"]): r["volume"] for r in assign.sweep(edges, trips, [7, 8]).collect()}
    exact = spark.range(1).select(assign.wardrop(F.lit(3000.0), F.lit(60.0), F.lit(1200.0), F.lit(110.0), F.lit(3000.0))).first()[0]
    assert got[(7, 0)] == pytest.approx(exact, rel=0.02) and got[(7, 0)] + got[(7, 1)] == pytest.approx(3000.0)
    assert got[(8, 0)] == pytest.approx(100.0)


def test_added_links_join_the_network(spark):
    nodes = spark.createDataFrame([(1, -77.5, 38.6), (2, -77.5, 38.61)], "node long, lon double, lat double")
    adds = spark.createDataFrame([(3, 1, 2, 2, 36.0, 1000.0), (4, 1, 9, 1, 36.0, 1.0), (5, 2, 2, 1, 36.0, 1.0)], "seq long, src long, dst long, lanes int, speed_kph double, capacity_vph double")
    row = scenario.added(adds, nodes, 100).collect()
    assert [(r["edge"], r["src"], r["dst"]) for r in row] == [(103, 1, 2)]
    assert row[0]["len_m"] == pytest.approx(1113.2) and row[0]["free_s"] == pytest.approx(111.32)
    assert sorted((r["seq"], r["reason"]) for r in scenario.added_warnings(adds, nodes).collect()) == [(4, "an end is missing"), (5, "both ends are one")]


def test_a_change_of_class_ends_a_chain(spark):
    rows = [(0, 0, 1, 2, 10.0), (1, 1, 0, 2, 10.0), (2, 1, 2, 5, 10.0), (3, 2, 1, 5, 10.0)]
    edges = spark.createDataFrame(rows, "edge long, src long, dst long, class int, len_m double")
    assert network.simplified(edges).count() == 4


def test_ways_become_directed_edges(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.01, 0.0), (3, 0.02, 0.0)], "node long, lon double, lat double")
    ways = spark.createDataFrame([(1, [1, 2, 3], 0), (2, [3, 2], 1), (3, [3, 9], 0), (4, [9, 8], 0), (5, [1], 0)], "way long, refs array<long>, dir int")
    edges, lost = network.ways_to_edges(ways, nodes, F.col("dir"))
    assert sorted((r["src"], r["dst"]) for r in edges.collect()) == [(1, 2), (2, 1), (2, 3), (3, 2), (3, 2)]
    assert [(r["a"], r["b"]) for r in lost.collect()] == [(3, 9)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.floats(0, 1), st.integers(0, 5)), min_size=1, max_size=40))
def test_thinning_twice_is_thinning_once(spark, points):
    rows = spark.createDataFrame([(x, y, float(z)) for x, y, z in points], "x double, y double, z double")
    once = feeds.thinned(rows, 0.25)
    twice = feeds.thinned(once.select("x", "y", "z"), 0.25)
    assert sorted(once.collect()) == sorted(twice.collect())


def test_last_edit_wins_and_lanes_rescale(spark):
    edges = spark.createDataFrame([(1, 2, 50.0, 1600.0), (2, 1, 50.0, 800.0), (3, 1, 40.0, 800.0)], "edge long, lanes int, speed_kph double, capacity_vph double")
    edits = spark.createDataFrame(
        [(1, "set", 1, 3, None, None), (2, "set", 1, 4, None, None), (3, "set", 2, 3, None, None), (4, "set", 2, None, None, 4000.0), (5, "close", 3, None, None, None), (6, "set", 9, 1, None, None)],
        "seq long, type string, edge long, lanes int, speed_kph double, capacity_vph double",
    )
    got = {r["edge"]: (r["lanes"], r["capacity_vph"], r["open"]) for r in scenario.applied(edges, edits).collect()}
    assert got == {1: (4, 3200.0, True), 2: (3, 4000.0, True), 3: (1, 800.0, False)}
    assert [r["edge"] for r in scenario.warnings(edges, edits).collect()] == [9]
    assert scenario.encoded(edits).count() == scenario.canonical(edits).count() == 4


def test_departures_after_midnight_wrap(spark):
    rows = spark.createDataFrame([(0, 8 * 3600.0 + m * 900) for m in range(4)] + [(0, 25.5 * 3600)], "pattern long, depart_s double")
    got = {r["hour"]: r["headway_s"] for r in transit.headways(rows, model.hour_shares(spark)).collect()}
    assert got[8] == 900 and got[1] == 3600 and got[3] is None


def test_upper_median(spark):
    rows = [(t, s, 0, float(s * (100 + t))) for t in range(4) for s in range(1, 3)]
    got = transit.hop_medians(spark.createDataFrame(rows, "trip long, seq int, stop long, arrive_s double")).collect()
    assert [r["hop_s"] for r in got] == [102.0]


def test_text_normalisation(spark):
    rows = spark.createDataFrame([("2",), (" k ",), ("4: serious",), ("no idea",), ("7",), ("fatal",), ("Nonvisible injury",), ("PDO",), (None,)], "s string")
    assert [r[0] for r in rows.select(roads.severity(F.col("s"))).collect()] == [2, 5, 4, None, None, 5, 2, 1, None]
    speeds = spark.createDataFrame([("50",), ("35 mph",), ("50 km/h",), ("walk",), (None,)], "s string")
    assert [r[0] for r in speeds.select(roads.max_speed_kph(F.col("s"))).collect()] == [50.0, pytest.approx(56.32704), 50.0, None, None]
    heights = spark.createDataFrame([(20.0, None, None), (None, 412.5, 400.0), (12000.0, None, None)], "h double, t double, g double")
    assert [r[0] for r in heights.select(roads.height_m(F.col("h"), F.col("t"), F.col("g"))).collect()] == [pytest.approx(6.096), pytest.approx(3.81), None]


def test_calibration_measures(spark):
    rows = lambda f: spark.createDataFrame([(float(a), a * f) for a in (100, 200, 400)] + [(50.0, 0.0)], "aadt double, modelled_daily double")
    perfect, thrice = feeds.fit(rows(1.0)).first(), feeds.fit(rows(3.0)).first()
    assert perfect["r2"] == 1 and perfect["n"] == 3
    assert thrice["bias"] > 0 and thrice["r2"] < 0


def test_daily_volume_of_one_hour_is_scaled(spark):
    rows = spark.createDataFrame([(1, 8, 78.0), (2, 8, 10.0), (2, 9, 30.0)], "edge long, hour int, volume double")
    got = {r["edge"]: (r["hours_present"], r["modelled_daily"]) for r in feeds.modelled_daily(rows, model.hour_shares(spark)).collect()}
    assert got == {1: (1, pytest.approx(1000.0)), 2: (2, 40.0)}


def test_budget_skips_what_does_not_fit(spark):
    chunks = spark.createDataFrame([(1, 6, 0.0, 0.0, 1), (2, 6, 0.1, 0.0, 1), (3, 4, 0.2, 0.0, 1), (4, 1, 0.0, 0.0, 0)], "chunk long, bytes long, lon double, lat double, points long")
    assert [r["chunk"] for r in feeds.within_budget(chunks, 0.0, 0.0, 10).collect()] == [1, 3]


def test_nothing_comes_of_nothing(spark):
    points = spark.createDataFrame([], "point long, lon double, lat double")
    nodes = spark.createDataFrame([], "node long, lon double, lat double")
    assert snap.to_nodes(points, nodes, 100.0).count() == 0
    assert demand.trips(spark.createDataFrame([], "origin long, dest long, trips double")).count() == 0
    assert paths.relaxed(spark.createDataFrame([], "src long, dst long, cost double"), spark.createDataFrame([], "origin long, node long, cost double")).count() == 0


def test_shares_of_the_day_sum_to_one():
    assert sum(model.HOUR_SHARE) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        model.Grid.cover((1.0, 0.0, 1.0, 2.0), 100.0)


def test_speeds_within_half_a_kph_are_one_road(spark):
    """A chain of 50.0 and 50.3 is one road each way; of 50.0 and 50.5 it isn't; from road to road counts, not from end to end."""
    def both_ways(*speeds):
        rows = [(2 * k + back, *((k, k + 1) if not back else (k + 1, k)), 5, 1, v, 100.0) for k, v in enumerate(speeds) for back in (0, 1)]
        return spark.createDataFrame(rows, "edge long, src long, dst long, class int, lanes int, speed_kph double, len_m double")

    chains = lambda *speeds: sorted((r["src"], r["dst"], r["speed_kph"], r["len_m"]) for r in network.simplified(both_ways(*speeds)).collect())
    assert chains(50.0, 50.3) == [(0, 2, 50.0, 200.0), (2, 0, 50.3, 200.0)]
    assert len(chains(50.0, 50.5)) == 4
    assert chains(50.0, 50.4, 50.8) == [(0, 3, 50.0, 300.0), (3, 0, 50.8, 300.0)]
    flags = {r["node"]: r["collapsible"] for r in network.degree_two(both_ways(50.0, 50.3, 51.0)).collect()}
    assert flags == {0: False, 1: True, 2: False, 3: False}


def test_hours_together_are_the_hours_alone(spark, monkeypatch):
    """All hours in shared jobs give what each gives by itself, an idle hour has no flows, and a day adds up."""
    edges = solver_edges(spark, [(0, 0, 1, 60.0, 1200.0), (1, 0, 2, 50.0, 900.0), (2, 1, 3, 50.0, 900.0), (3, 2, 3, 60.0, 1200.0), (4, 1, 2, 10.0, 700.0), (5, 3, 0, 30.0, 500.0)])
    trips = spark.createDataFrame([(h, 0, 3, 600.0 * h) for h in range(1, 5)] + [(2, 3, 1, 50.0), (2, 3, 1, 50.0)], "hour int, origin long, dest long, trips double")
    hours = [0, 1, 2, 3, 4]
    got = assign.sweep_together(edges, trips, hours, tag="day").cache()
    rows = {(r["hour"], r["edge"]): r for r in got.collect()}
    for h in hours:
        alone = assign.equilibrium(edges, trips.filter(f"hour = {h}").drop("hour"))
        assert all(rows[h, r.edge].volume == pytest.approx(r.volume, abs=1e-6) for r in alone.edges.itertuples())
        assert rows[h, 0]["iterations"] == alone.iterations and rows[h, 0]["gap"] == pytest.approx(alone.gap)
    assert all(rows[0, e]["volume"] == 0 for e in range(6))
    day = {r["edge"]: r for r in assign.daily(got).collect()}
    assert day[0]["daily"] == pytest.approx(sum(rows[h, 0]["volume"] for h in hours)) and day[0]["peak_hour"] == 4
    assert [r["edge"] for r in assign.busiest(got.groupBy("edge", "len_m", "free_s", "capacity_vph", "open").agg(F.sum("volume").alias("volume")), 2).collect()]
    monkeypatch.setattr(assign.paths, "TOPOLOGY_EDGES", 10)  # five hours of six edges are too many for one job
    apart = {(r["hour"], r["edge"]): r["volume"] for r in assign.sweep_together(edges, trips, [1, 3]).collect()}
    assert all(v == pytest.approx(rows[k]["volume"], rel=0.02, abs=1.0) for k, v in apart.items())


def test_a_sweep_can_be_cancelled(spark):
    """Cancelling its tag from another thread ends it."""
    import threading

    edges = solver_edges(spark, [(0, 0, 1, 60.0, 1200.0), (1, 0, 1, 110.0, 3000.0)])
    trips = spark.createDataFrame([(h, 0, 1, 3000.0) for h in range(24)], "hour int, origin long, dest long, trips double")
    stop = threading.Event()

    def cancel():
        while not stop.wait(0.2):
            spark.sparkContext.cancelJobsWithTag("to be cancelled")

    thread = threading.Thread(target=cancel)
    thread.start()
    try:
        with pytest.raises(Exception, match="(?i)cancel"):
            assign.sweep_together(edges, trips, list(range(24)), 1000, 0.0, tag="to be cancelled")
    finally:
        stop.set()
        thread.join()
    assert assign.sweep_together(edges, trips, [0], 2, tag="to be cancelled").count() == 2


def test_skim_in_both_forms(spark, monkeypatch):
    """Trees in tasks and labels by joins give the same costs; zones at one node, at an unknown one and out of reach are told apart."""
    edges = spark.createDataFrame([(0, 1, 2, 5.0), (1, 2, 3, 1.0), (2, 1, 3, 7.0), (3, 3, 1, 2.0), (4, 9, 1, 1.0)], "edge long, src long, dst long, cost double")
    gates = spark.createDataFrame([(10, 1), (11, 3), (12, 9), (13, 3), (14, 77)], "zone long, node long")
    key = lambda rows: {(r["from_zone"], r["to_zone"]): r["cost"] for r in rows.collect()}
    near = key(paths.skim(edges, gates))
    assert near[10, 11] == near[10, 13] == 6.0 and near[12, 10] == 1.0 and near[11, 13] == 0.0 and (10, 12) not in near and near[14, 14] == 0.0
    monkeypatch.setattr(paths, "TOPOLOGY_EDGES", 1)
    assert key(paths.skim(edges, gates)) == near
