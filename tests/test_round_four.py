"""Cases of the findings of the fourth round."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyway.operators import blocks, documents, feeds, paths, snap, transit
from tallyway.plans import catalog

SMALL = "/root/testdata/sf0.01"


def test_headways_of_edited_service_are_not_rounded(spark):
    """At sf0.01 headways have more than three decimals, which the SQL keeps."""
    con = duckdb.connect()
    for table in ("customer", "orders"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    want = con.execute(f"SELECT pattern, seq, headway_s FROM ({catalog.ORACLE_SQL['edited_service']})").fetchall()
    got = [tuple(r) for r in catalog.QUERIES["edited_service"](spark, SMALL).select("pattern", "seq", "headway_s").collect()]
    assert sorted(got) == sorted(want) and any(h != round(h, 3) for *_, h in got)


def scattered(spark, seed, n=120):
    """A random network with places, and starts of which one is at a node without any."""
    rng = random.Random(seed)
    nodes = [(k, rng.random(), rng.random()) for k in range(n)]
    edges = [(rng.randrange(n), rng.randrange(n), float(rng.randrange(0, 40))) for _ in range(3 * n)] + [(n + 5, 3, 1.0), (4, n + 5, 2.0)]
    starts = [(1, 0, 0.0), (2, 7, 3.0), (2, 9, 0.0), (3, n + 5, 0.0), (4, n + 900, 1.5)]
    return (
        spark.createDataFrame(nodes, "node long, lon double, lat double"), spark.createDataFrame(edges, "src long, dst long, cost double"),
        spark.createDataFrame(starts, "origin long, node long, cost double"),
    )


@pytest.mark.parametrize("budget", [None, 45.0])
def test_blocks_relax_as_edges_do(spark, monkeypatch, budget):
    monkeypatch.setattr(blocks, "BLOCK", 15)
    monkeypatch.setattr(blocks, "LABELS", 30)  # an origin or two at once
    nodes, edges, starts = scattered(spark, 5)
    assert blocks.dealt(nodes, 15).select("block").distinct().count() == 9
    want = sorted(tuple(r) for r in paths.relaxed(edges, starts, budget).select("origin", "node", "cost").collect())
    assert sorted(tuple(r) for r in blocks.relaxed(edges, nodes, starts, budget).collect()) == want and len(want) > 20


def test_a_network_takes_rounds_by_block_and_not_by_edge(spark, monkeypatch):
    """A line of 300 nodes in six blocks: edge by edge it took a job or more for each node."""
    rounds = []
    monkeypatch.setattr(blocks, "BLOCK", 9)
    kept = blocks.cut
    monkeypatch.setattr(blocks, "cut", lambda df: rounds.append(1) or kept(df))
    nodes = spark.range(300).selectExpr("id AS node", "id / 10.0D AS lon", "0.0D AS lat")
    edges = spark.range(299).selectExpr("id AS src", "id + 1 AS dst", "1.0D AS cost")
    labels = transit.isochrone(edges, None, spark.createDataFrame([(1, 0, 0.0)], "origin long, node long, cost double"), 1000.0, nodes=nodes)
    assert {r["node"]: r["cost"] for r in labels.collect()} == {k: float(k) for k in range(300)}
    assert len(rounds) < 15


def test_rides_go_on_from_block_to_block(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 15)
    nodes, edges, starts = scattered(spark, 11)
    calls = spark.createDataFrame([(p, k, (17 * p + 29 * k) % 120, 4.0, 3.0 * k) for p in range(4) for k in range(9)], "pattern long, seq int, node long, wait_s double, along_s double")
    want = sorted(tuple(r) for r in transit.isochrone(edges, calls, starts, 60.0).select("origin", "node", "cost").collect())
    assert sorted(tuple(r) for r in transit.isochrone(edges, calls, starts, 60.0, nodes=nodes).collect()) == want


@pytest.mark.parametrize("free", [False, True])
def test_trees_by_arrays_are_those_by_a_heap(free):
    """With ties, and with edges that take no time."""
    rng = np.random.default_rng(3)
    for _ in range(30):
        edges = pd.DataFrame({"edge": np.arange(120), "src": rng.integers(0, 40, 120), "dst": rng.integers(0, 40, 120)})
        topology, cost = paths.Topology(edges), rng.integers(0 if free else 1, 5, 120).astype(float)
        one, other = paths.tree(topology, cost, 0), paths.heap_tree(topology, cost, 0)
        for a, b in zip(one, other, strict=True):
            assert a.tolist() == b.tolist()


def test_trees_take_no_step_of_python_per_edge(monkeypatch):
    monkeypatch.setattr(paths, "heap_tree", None)
    k = np.arange(199)
    topology = paths.Topology(pd.DataFrame({"edge": k, "src": k, "dst": k + 1}))
    assert paths.loaded(topology, np.ones(199), pd.DataFrame({"origin": [0, 0], "dest": [199, 99], "trips": [2.0, 3.0]})).tolist() == [5.0] * 99 + [2.0] * 100


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_snapping_in_growing_radii_finds_the_nearest(spark):
    """Targets are crowded, so points look within a small radius first; some points find theirs in wider ones only, some none."""
    rng = random.Random(2)
    place = lambda: (-77.3 + rng.random() * 0.02, 38.8 + rng.random() * 0.02)
    nodes = spark.createDataFrame([(k, *place()) for k in range(900)], "node long, lon double, lat double")
    points = spark.createDataFrame([(k, *place()) for k in range(40)] + [(90, -77.3025, 38.81), (91, -77.305, 38.81), (92, -77.0, 38.0), (93, None, 38.81)], "point long, lon double, lat double")
    lon, lat = F.col("lon"), F.col("lat")
    assert len(snap.radii(nodes, 400.0, lon, lat, lon, lat)) > 2
    far = points.join(nodes.select("node", F.col("lon").alias("x"), F.col("lat").alias("y"))).withColumn("m", snap.geo.equirect_m(F.col("lon"), F.col("lat"), F.col("x"), F.col("y"))).filter("m <= 400")
    want = {r["point"]: r["b"]["node"] for r in far.groupBy("point").agg(F.min(F.struct("m", "node")).alias("b")).collect()}
    got = {r["point"]: r["node"] for r in snap.to_nodes(points, nodes, 400.0).collect()}
    assert got == {k: want.get(k) for k in [*range(40), 90, 91, 92, 93]} and got[90] is not None and got[92] is None


def test_points_that_look_at_few_targets_are_not_shuffled(spark):
    few = spark.createDataFrame([(2, 0.0, 0.0), (1, 0.0, 0.0)], "target long, lon double, lat double")
    near = snap.to_few(spark.createDataFrame([(7, 0.0, 1.0)], "point long, lon double, lat double"), few)
    assert [r["target"] for r in near.collect()] == [1] and "hashpartitioning" not in plan_of(near)


def test_folded_hops_join_nothing(spark):
    rows = spark.createDataFrame([(1, 1, 3, 0.0), (1, 2, 0, 10.0), (1, 3, 3, 25.0), (1, 4, 1, 20.0), (2, 1, 0, 5.0)], "trip long, seq int, stop int, arrive_s double")
    out = transit.folded_hops(rows, F.col("stop") != 3)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, 15.0), (1, 2, 0.0), (2, 1, 0.0)] and "Join" not in plan_of(out)


def test_documents_are_decoded_in_their_row(spark):
    codes = documents.encoded(spark.sql("SELECT 1L AS doc, 1L AS seq, named_struct('type', 'CloseEdge', 'edge', 5L) AS edit").select("doc", "seq", F.struct("edit.type", "edit.edge", F.lit(0).alias("from"), F.lit(0).alias("to"), F.lit("").alias("route_id")).alias("edit")))
    out = documents.decoded(codes.select("doc", "code"))
    assert [(r["doc"], r["edit"]["edge"]) for r in out.collect()] == [(1, 5)] and "Join" not in plan_of(documents.decoded(spark.createDataFrame([(1, "x")], "doc long, code string")))


def test_daily_volumes_take_one_aggregate_by_edge(spark):
    rows = spark.createDataFrame([(0, 1, 2.0), (23, 1, 3.0), (23, 1, 1.0), (5, 2, 4.0)], "hour int, edge long, volume double")
    hours = spark.createDataFrame([(h, 0.5) for h in range(24)], "hour int, share double")
    out = feeds.modelled_daily(rows, hours)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2, 6.0), (2, 1, 8.0)] and plan_of(feeds.modelled_daily(rows, hours)).count("hashpartitioning") == 1


@pytest.mark.xfail(reason="open: with small blocks the packing of this frame fails to bind a column; zone_skim itself runs at sf0.01 and 60 times sf0.1")
def test_a_skim_of_placed_nodes_keeps_the_network_from_the_driver(spark, monkeypatch):
    nodes, edges, _ = scattered(spark, 8)
    edges = spark.createDataFrame([(k, *r) for k, r in enumerate(edges.collect())], "edge long, src long, dst long, cost double")
    gates = spark.createDataFrame([(1, 0), (2, 7), (3, 500)], "zone long, node long")
    want = sorted(tuple(r) for r in paths.skim(edges, gates).collect())
    monkeypatch.setattr(blocks, "BLOCK", 15)
    monkeypatch.setattr(paths, "Shared", None)
    assert sorted(tuple(r) for r in paths.skim(edges, gates, nodes).collect()) == want and len(want) >= 5
