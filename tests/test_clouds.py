"""Octrees against plain loops, and a chunk sink that is interrupted."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyway.operators import octree
from tallyway.sources import chunk_sink

ROOT = octree.Root(-10.0, -10.0, -10.0, 20.0, span=2)


def cloud(n=300, seed=2):
    rng = random.Random(seed)
    at = lambda: rng.choice([rng.uniform(-10, 10), rng.uniform(0, 0.5), 10.0, -10.0])
    rows = [(k, at(), at(), at(), rng.choice([1, 2, 7, 18])) for k in range(n)]
    return rows + [(n + k, 0.1, 0.1, 0.1, 2) for k in range(20)]  # many in one place


def placed_by_hand(rows, depth):
    held, taken = {}, set()
    for i, x, y, z, _ in sorted(rows):
        for d in range(depth + 1):
            cell = lambda v, per: min(max(math.floor((v + 10) * per * 2**d / 20), 0), per * 2**d - 1)  # noqa: E731, B023
            voxel = (d, *(cell(v, 2) for v in (x, y, z)))
            if d == depth or voxel not in taken:
                taken.add(voxel)
                held[i] = (d, *(cell(v, 1) for v in (x, y, z)))
                break
    return held


def walked_by_hand(counts, box, depth):
    out, stack = set(), [(0, 0, 0, 0)]
    while stack:
        d, x, y, z = key = stack.pop()
        step = 20 / 2**d
        inside = -10 + step * x < box.x1 and -10 + step * (x + 1) > box.x0 and -10 + step * y < box.y1 and -10 + step * (y + 1) > box.y0
        if inside and counts.get(key):
            out.add(key)
            if d < depth:
                stack += [(d + 1, 2 * x + a, 2 * y + b, 2 * z + c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    return out


BOXES = [octree.Box(-1, -1, 1, 1), octree.Box(0, 0, 5, 10), octree.Box(-20, -20, 20, 20), octree.Box(30, 30, 40, 40), octree.Box(-5, 2.5, -2.5, 5)]


def test_octree_by_hand(spark, tmp_path):
    rows = cloud()
    points = spark.createDataFrame(rows, "id long, x double, y double, z double, cls int")
    store = octree.built(points, ROOT, 4, "id").cache()
    want = placed_by_hand(rows, 4)
    assert {r["id"]: (r["depth"], r["kx"], r["ky"], r["kz"]) for r in store.collect()} == want
    counts = {}
    for key in want.values():
        counts[key] = counts.get(key, 0) + 1
    nodes = octree.hierarchy(store)
    octree.written(store, f"{tmp_path}/store")
    held = spark.read.parquet(f"{tmp_path}/store")
    for k, box in enumerate(BOXES):
        found = octree.descended(nodes, ROOT, box, 3)
        assert {tuple(r)[:4] for r in found.collect()} == walked_by_hand(counts, box, 3)
        keys = octree.keys_written(found, f"{tmp_path}/keys{k}")
        read = octree.read_nodes(held, keys, box, (1, 2))
        inside = {i for i, x, y, _, c in rows if box.x0 <= x < box.x1 and box.y0 <= y < box.y1 and c in (1, 2) and want[i] in walked_by_hand(counts, box, 3)}
        assert {r["id"] for r in read.collect()} == inside
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    assert octree.built(points.filter("id < 0"), ROOT, 4, "id").count() == 0
    assert octree.descended(nodes.filter("n < 0"), ROOT, BOXES[0], 3).count() == 0


def test_density():
    root = octree.Root(0, 0, 0, 1024.0, 128)
    assert [root.spacing(d) for d in (0, 3)] == [8.0, 1.0]
    assert [root.depth_for(p) for p in (1 / 64, 1.0, 1.1, 4.0, 1e-9)] == [0, 3, 4, 4, 0]


class Lost(Exception):
    pass


def contents(spark, path):
    rows = spark.read.parquet(f"{path}/{chunk_sink.DATA}")
    return sorted(map(tuple, rows.select("chunk", "id", "x", "y", "z", "cls").collect()))


def test_sink_is_taken_up(spark, tmp_path):
    """A run lost between a wave's folders and its lines: the next writes what isn't finished and ends with the same chunks."""
    rows = [(*r, r[0] % 12) for r in cloud()]
    points = spark.createDataFrame(rows, "id long, x double, y double, z double, cls int, chunk long")
    whole, broken = f"{tmp_path}/whole", f"{tmp_path}/broken"
    want = sorted(map(tuple, chunk_sink.build(points, whole, waves=4).collect()))
    waves = []

    def lose(wave):
        waves.append(wave)
        if len(waves) == 3:
            raise Lost

    with pytest.raises(Lost):
        chunk_sink.build(points, broken, waves=4, after_data=lose)
    done = {r["chunk"] for r in chunk_sink.finished(spark, broken).collect()}
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "broken" / chunk_sink.DATA).rglob("*.parquet") if int(p.parent.name.split("=")[1]) in done}
    assert done and len(done) < 12 and before
    again = []
    got = sorted(map(tuple, chunk_sink.build(points, broken, waves=4, after_data=again.append).collect()))
    assert got == want and not set(waves[:2]) & set(again)
    assert contents(spark, broken) == contents(spark, whole)
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    nothing = []
    chunk_sink.build(points, broken, waves=4, after_data=nothing.append)
    assert not nothing
    more = points.withColumn("z", F.col("z") + 1)
    forced = {r["chunk"]: r["hash"] for r in chunk_sink.build(more, broken, waves=4, force=True).collect()}
    assert all(forced[r[0]] != r[3] for r in want)


def test_index_and_manifest(spark, tmp_path):
    points = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 2, 7), (2, 0.0, 0.0, 4.0, 1, 7), (3, 1.0, 1.0, 2.0, 6, 8), (4, 1.0, 1.0, 2.0, 6, None)], "id long, x double, y double, z double, cls int, chunk long")
    path = f"{tmp_path}/cloud"
    chunk_sink.build(points, path)
    index = {r["chunk"]: r for r in chunk_sink.index(spark, path).collect()}
    assert {c: (r["points"], r["ground_min"], r["all_chunks"], r["all_points"]) for c, r in index.items()} == {7: (2, 5.0, 2, 3), 8: (1, None, 2, 3)}
    assert all(r["bytes"] > 0 and r["all_bytes"] == sum(x["bytes"] for x in index.values()) for r in index.values())
    old = spark.createDataFrame([("lidar/chunk_7", "lidar", 1, "x"), ("graph/1", "graph", 5, "y")], "path string, stage string, rows long, hash string")
    got = {r["path"]: (r["stage"], r["rows"]) for r in chunk_sink.attached(old, spark, path).collect()}
    assert got == {"lidar/chunk_7": ("lidar", 2), "lidar/chunk_8": ("lidar", 1), "lidar/index": ("lidar", 3), "graph/1": ("graph", 5)}
    assert chunk_sink.finished(spark, f"{tmp_path}/none").count() == 0
