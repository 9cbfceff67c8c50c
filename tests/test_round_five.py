"""What the third round's findings asked for: reach, loads and packing that grow with the data."""

import random

import pytest
from pyspark.sql import functions as F

from tallyway.operators import assign, blocks, paths, table_function, transit


def town(spark, side, seed=5):
    """A lattice with jittered edges both ways: edges(edge, src, dst, cost) and nodes(node, lon, lat)."""
    rng = random.Random(seed)
    nodes = [(k, -77.5 + 0.01 * (k % side), 38.6 + 0.01 * (k // side)) for k in range(side * side)]
    ends = [(a, b) for a in range(side * side) for b in (a + 1, a - 1, a + side, a - side) if 0 <= b < side * side and abs(a % side - b % side) <= 1]
    edges = [(7 * k, a, b, 60.0 + rng.random() * 40) for k, (a, b) in enumerate(ends)]
    return spark.createDataFrame(edges, "edge long, src long, dst long, cost double"), spark.createDataFrame(nodes, "node long, lon double, lat double")


def test_placed_nodes_are_packed_in_small_blocks(spark, monkeypatch):
    edges, nodes = town(spark, 8)
    monkeypatch.setattr(blocks, "BLOCK", 10)
    gates = spark.createDataFrame([(1, 0), (2, 37), (3, 63)], "zone long, node long")
    want = {(r[0], r[1]): r[2] for r in paths.skim(edges, gates).collect()}
    assert {(r[0], r[1]): r[2] for r in paths.skim(edges, gates, nodes).collect()} == pytest.approx(want) and len(want) == 9


def test_the_table_function_copies_no_walk_per_origin(spark, monkeypatch):
    """Its input has each walk once, however many origins there are."""
    edges, nodes = town(spark, 8)
    monkeypatch.setattr(blocks, "BLOCK", 20)
    walks = edges.drop("edge")
    starts = spark.createDataFrame([(k, k, 0.0) for k in range(30)], "origin long, node long, cost double")
    seen, made = [], table_function.labels

    def told(network, entries, budget):
        seen.append(network.packed.agg(F.sum(F.size("arcs"))).first()[0])
        return made(network, entries, budget)

    monkeypatch.setattr(table_function, "labels", told)
    monkeypatch.setattr(table_function, "reach_rows", None)
    got = {(r[0], r[1]): r[2] for r in table_function.isochrone(starts, nodes, walks, None, 300.0).collect()}
    assert got == pytest.approx({(r[0], r[1]): r[2] for r in transit.isochrone(walks, None, starts, 300.0).collect()}) and seen == [walks.count()]


def test_words_get_numbers_as_they_are_met():
    """One lookup a word: new ones are numbered by it, and texts of Latin letters are cut by sets of characters."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from tallyway.llm import bpe

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng, plain = random.Random(2), Tokenizer.from_file(path)
    letters = [chr(c) for c in range(0x250)] + ["'s", "'ll", "'re", "  ", "　", "中", "<|endoftext|>"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(2000)] + ["it's  we'll 'tis 12 a1_b\t\n c", "", "'", " "]
    assert [x.tolist() for x in bpe.encoded(texts, path, 0)] == [[*plain.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    known = bpe.Numbers(a=0)
    assert [known[w] for w in ("b", "a", "b", "c")] == [1, 0, 1, 2]


def test_loads_go_block_by_block(spark, monkeypatch):
    """Beyond the driver's bound, neither the topology's vectors nor joins over all labels are used, and the flows are the same."""
    edges, nodes = town(spark, 8)
    roads = edges.select("edge", "src", "dst", F.lit(500.0).alias("len_m"), F.col("cost").alias("free_s"), F.lit(40.0).alias("capacity_vph"), F.lit(True).alias("open"))
    trips = spark.createDataFrame([(0, 63, 30.0), (0, 37, 20.0), (63, 5, 10.0), (28, 56, 5.0), (28, 999, 1.0)], "origin long, dest long, trips double")
    want, near = {r[0]: r[1] for r in assign.loads(roads, trips).collect()}, assign.equilibrium(roads, trips, iterations=1)
    monkeypatch.setattr(assign, "VECTOR_EDGES", 10)
    monkeypatch.setattr(assign, "BLOCK", 12)
    monkeypatch.setattr(paths, "Shared", None)
    monkeypatch.setattr(paths, "tree_loads", None)
    assert {r[0]: r[1] for r in assign.loads(roads, trips, nodes).collect()} == pytest.approx(want) and len(want) > 20
    assert assign.loads(roads, trips.limit(0), nodes).count() == 0
    far = assign.equilibrium(roads, trips, iterations=1, nodes=nodes)
    assert far.gap == pytest.approx(near.gap) and far.gap > 0
    assert {r["edge"]: r["volume"] for r in far.edges.collect()} == pytest.approx(dict(zip(near.edges["edge"], near.edges["volume"], strict=True)))


def test_islands_breed_while_it_helps(monkeypatch):
    """Breeding goes on after three children, finds fewer sequences than best fit did, and ends when it can't help."""
    import numpy as np

    from tallyway.llm import packing

    lengths = np.clip(np.random.default_rng(4).lognormal(5.5, 0.7, 12_000).astype(np.int64), 2, 1023)
    made, crossed = [], packing.crossed
    monkeypatch.setattr(packing, "crossed", lambda *a: made.append(1) or crossed(*a))
    begun = packing.founders(lengths, 1, 1024)
    bred = packing.evolved(lengths, begun, 7, 1024)
    assert 16 <= len(made) <= packing.GENERATIONS
    best = lambda group: max(packing.fitness(lengths, b, 1024) for b in group)
    assert best(bred) > best(begun) and all(packing.loads_of(lengths, b).max() <= 1024 and b.min() == 0 for b in bred)
    full = np.full(8, 512)
    made.clear()
    assert int(packing.evolved(full, packing.founders(full, 1, 1024), 7, 1024)[0].max()) == 3 and not made
