"""Origins of reach on a small town, rides in order, and the skim without a budget."""

import random

import pytest
from pyspark.sql import functions as F

from tallyway.operators import table_function, transit
from tallyway.plans import catalog

SUPPLIERS = {"s_suppkey": [0, 50, 75, 100, 150]}


class Small:
    """Seven nodes on a lattice of side 3, and five suppliers."""

    side = 3

    def __init__(self, spark):
        self.spark = spark
        self.nodes = spark.range(7).select(
            F.col("id").alias("node"), (-77.54 + 0.5 * (F.col("id") % 3) / 2).alias("lon"), (38.6 + 0.46 * F.floor(F.col("id") / 3) / 2).alias("lat")
        )

    def table(self, name):
        return self.spark.createDataFrame([(k,) for k in SUPPLIERS["s_suppkey"]], "s_suppkey long")


def test_every_start_has_a_node(spark):
    got = {r["origin"]: r["node"] for r in catalog._starts(Small(spark)).collect()}
    # 50 * 37 % 9 = 5, 100 * 37 % 9 = 1, 150 * 37 % 9 = 6: all there; 0 is node 0.
    assert got == {0: 0, 50: 5, 100: 1, 150: 6}


def test_a_start_without_a_node_moves_to_the_nearest(spark, monkeypatch):
    monkeypatch.setitem(SUPPLIERS, "s_suppkey", [200, 350])  # 200 * 37 % 9 = 2, 350 * 37 % 9 = 8, which has no node
    got = {r["origin"]: r["node"] for r in catalog._starts(Small(spark)).collect()}
    assert got == {200: 2, 350: 5}


def test_skim_reaches_every_node(spark):
    got = catalog.QUERIES["shortest_path_skim"](spark, "/root/testdata/sf0.001").groupBy("origin").agg(F.count("node").alias("n"), F.max("cost").alias("far")).collect()
    assert len(got) == 25 and len({r["n"] for r in got}) == 1 and max(r["far"] for r in got) > 1200


# ------------------------------------------------------- rides in order

FIVE = [(p, s, p + s, 10.0, 60.0 * s) for p in range(1, 6) for s in (0, 1)]
CALLS = "pattern long, seq int, node long, wait_s double, along_s double"


def swept_by_hand(edges, patterns, start, budget, rounds=3):
    """A round runs the patterns one after the other, each over what those before it left."""
    best = {start: 0.0}

    def walk():
        queue = list(best)
        while queue:
            u = queue.pop()
            for a, v, c in edges:
                if a == u and best[u] + c <= budget and best[u] + c < best.get(v, float("inf")):
                    best[v] = best[u] + c
                    queue.append(v)

    for _ in range(rounds):
        walk()
        better = False
        for _, calls in sorted(patterns.items()):
            aboard, before = float("inf"), 0.0
            for node, wait, along in calls:
                aboard += along - before
                before = along
                if node is None:
                    aboard = float("inf")
                    continue
                aboard = min(aboard, best.get(node, float("inf")) + wait)
                if aboard < best.get(node, float("inf")) and aboard <= budget:
                    best[node] = aboard
                    better = True
        if not better:
            break
    walk()
    return best


def test_rides_chain_in_a_round(spark):
    """Five patterns 1-2, 2-3, ... 5-6: in their order one round reaches 6, against it a round reaches one stop more."""
    calls, none = spark.createDataFrame(FIVE, CALLS), spark.createDataFrame([], "src long, dst long, cost double")
    starts = spark.createDataFrame([(0, 1, 0.0)], "origin long, node long, cost double")
    got = {r["node"]: r["cost"] for r in transit.isochrone(none, calls, starts, 3600.0, 1).collect()}
    assert got == {n: 70.0 * (n - 1) for n in range(1, 7)}
    back = calls.withColumn("pattern", 6 - F.col("pattern"))
    assert {r["node"] for r in transit.isochrone(none, back, starts, 3600.0).collect()} == {1, 2, 3, 4}
    assert transit.ridden(starts, calls.filter("pattern < 0")).count() == 0


def test_random_networks(spark):
    """200 networks at once, each an origin of its own: equal to a sweep in plain Python."""
    rng = random.Random(11)
    edges, calls, starts, want = [], [], [], {}
    for k in range(200):
        own = [(rng.randrange(8), rng.randrange(8), float(rng.randint(100, 900))) for _ in range(rng.randint(0, 10))]
        patterns = {}
        for p in range(rng.randint(0, 6)):
            along, wait, stops = 0.0, float(rng.randint(30, 400)), []
            for _ in range(rng.randint(1, 6)):
                stops.append((None if rng.random() < 0.1 else rng.randrange(8), wait, along))
                along += rng.randint(0, 300)
            patterns[p] = stops
        budget = 2000.0
        edges += [(100 * k + a, 100 * k + b, c) for a, b, c in own]
        calls += [(10 * k + p, s, None if n is None else 100 * k + n, w, a) for p, stops in patterns.items() for s, (n, w, a) in enumerate(stops)]
        starts.append((k, 100 * k, 0.0))
        want |= {(k, 100 * k + n): round(c, 6) for n, c in swept_by_hand(own, patterns, 0, budget).items()}
    out = transit.isochrone(spark.createDataFrame(edges, "src long, dst long, cost double"), spark.createDataFrame(calls, CALLS), spark.createDataFrame(starts, "origin long, node long, cost double"), 2000.0)
    assert {(r["origin"], r["node"]): round(r["cost"], 6) for r in out.collect()} == want


def test_table_function(spark):
    """The function of SQL gives what the joins give, of walks alone and with rides; wrong arguments are told when the query is made."""
    rng = random.Random(3)
    nodes = spark.createDataFrame([(k, -77.5 + 0.01 * (k % 10), 38.6 + 0.01 * (k // 10)) for k in range(100)], "node long, lon double, lat double")
    walks = [(a, b, 1200.0 + rng.randint(0, 300)) for a in range(100) for b in (a + 1, a - 1, a + 10, a - 10) if 0 <= b < 100 and abs(a % 10 - b % 10) <= 1]
    calls = [(p, s, None if (p, s) == (2, 3) else 10 * p + 2 * s, 120.0, 150.0 * s) for p in range(0, 10, 2) for s in range(5)]
    calls += [(1, s, 10 * s + 4, 60.0, 200.0 * s) for s in range(6)]
    starts = spark.createDataFrame([(k, 7 * k, 0.0) for k in range(12)] + [(3, 50, 30.0)], "origin long, node long, cost double")
    walks, calls = spark.createDataFrame(walks, "src long, dst long, cost double"), spark.createDataFrame(calls, CALLS)
    key = lambda rows, c: {(r["origin"], r["node"]): round(r[c], 6) for r in rows.collect()}
    for rides, budget in ((None, 3000.0), (calls, 2400.0), (calls, 600.0)):
        want = key(transit.isochrone(walks, rides, starts, budget), "cost")
        assert key(table_function.isochrone(starts, nodes, walks, rides, budget), "seconds") == want and len(want) >= 12
    small = table_function.reach_rows(starts.filter("origin = 0"), nodes, walks, None, 800.0)
    assert 0 < small.filter("kind = 'walk'").count() < walks.count() / 4
    assert table_function.isochrone(starts.filter("false"), nodes, walks, calls, 600.0).count() == 0
    for wrong in ("SELECT * FROM isochrone(TABLE({rows}), 'x')", "SELECT * FROM isochrone(TABLE(SELECT 1 AS origin), 5)"):
        with pytest.raises(Exception, match="isochrone takes"):
            spark.sql(wrong, rows=small)
