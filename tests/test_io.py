"""Readers, sinks and streams."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tallyway.functions import geo
from tallyway.model import STUDY_BBOX, Grid
from tallyway.operators import feeds
from tallyway.plans.derive import CRASHES, Town
from tallyway.sources import readers, writers
from tallyway.streaming import feeds as streams


def test_paged_features(spark, tmp_path):
    for shard, adt in (("counts", '"730"'), ("counts_2", "4211.25")):
        (tmp_path / shard).mkdir()
        (tmp_path / shard / "page-1.json").write_text('{"features":[{"properties":{"ADT":%s,"X":null,"N":" a "},"geometry":{"type":"LineString","coordinates":[[[-77.3,38.8],[1,2]]]}}]}' % adt)
    rows = readers.features(spark, str(tmp_path), "counts")
    got = rows.select(readers.number(F.col("properties"), "ADT").alias("adt"), readers.text(F.col("properties"), "N").alias("n"), readers.number(F.col("properties"), "X").alias("x"), readers.first_point(F.col("geometry")).alias("p")).orderBy("adt").collect()
    assert [r["adt"] for r in got] == [730.0, 4211.25]
    assert (got[0]["n"], got[0]["x"], tuple(got[0]["p"])) == ("a", None, (-77.3, 38.8))


def test_census_csv_skips_bad_rows(spark, tmp_path):
    (tmp_path / "od.csv").write_text("W_Geocode,h_geocode,S000\n1,2,3\nx,2,3\n")
    assert readers.census_csv(spark, str(tmp_path / "od.csv"), w_geocode="long", h_geocode="long", s000="int").count() == 1


def test_timetables(spark, tmp_path):
    (tmp_path / "trips.txt").write_text("trip_id,service_id\n1,a\n2,b\n3,c\n")
    (tmp_path / "calendar.txt").write_text("service_id,monday,tuesday,wednesday\na,1,0,0\nb,0,0,0\n")
    found = readers.timetables(spark, {"x": str(tmp_path), "gone": str(tmp_path / "none")})
    assert sorted(r["trip_id"] for r in readers.runs_on_weekdays(found["trips"], found["calendar"]).collect()) == ["x:1", "x:3"]
    assert spark.sql("SELECT '25:30:00' AS t").select(readers.seconds_of(F.col("t"))).first()[0] == 91800


def test_roads_from_extracted_ways(spark):
    nodes = spark.createDataFrame([(1, -77.3, 38.8), (2, -77.29, 38.8), (3, 0.0, 0.0)], "node long, lon double, lat double")
    ways = spark.createDataFrame([(1, [1, 2], {"highway": "primary_link", "oneway": "yes"}), (2, [2, 3], {"highway": "residential"}), (3, [1, 2], {"highway": "footway"}), (4, [1, 2], {"highway": "service"}), (5, [1, 2], {"highway": "trunk", "access": "private"})], "way long, refs array<long>, tags map<string,string>")
    edges, lost = readers.roads_of(nodes, ways, STUDY_BBOX)
    assert [(r["src"], r["dst"], r["class_name"]) for r in edges.collect()] == [(1, 2, "primary")]
    assert lost.count() == 1


def test_sinks(spark, tmp_path):
    points = spark.createDataFrame([(1, -77.3, 38.8)], "id long, lon double, lat double")
    writers.feature_lines(points, str(tmp_path / "f"))
    told = json.loads(spark.read.text(str(tmp_path / "f")).first()[0])
    assert told["geometry"]["coordinates"] == [-77.3, 38.8] and told["properties"] == {"id": 1}
    edges = spark.createDataFrame([(7, 1), (8, 2)], "edge long, chunk long")
    writers.chunked(edges, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g")).filter("chunk = 2").first()["edge"] == 8
    files = spark.createDataFrame([("a", 1), ("b", 2)], "path string, rows long")
    newer = spark.createDataFrame([("b", 5)], "path string, rows long")
    assert sorted(tuple(r) for r in writers.manifest(newer, files, str(tmp_path / "m")).collect()) == [("a", 1), ("b", 5)]
    assert writers.content_hash(points).first() == writers.content_hash(points.repartition(3)).first()


def test_a_stream_of_crashes_equals_the_batch(spark, tmp_path):
    crashes = Town(spark, "/root/testdata/sf0.001").crashes
    for k in range(3):
        crashes.filter(F.col("crash_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = streams.files(spark, str(tmp_path / "in"), crashes.schema)
    streams.keep_cells(rows, CRASHES, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    got = streams.cells(spark, str(tmp_path / "t")).select("cx", "cy", "n", "severity_sum")
    want = feeds.crash_cells(crashes, CRASHES).select("cx", "cy", "n", "severity_sum")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_grid_cells_cover_the_box():
    grid = Grid.cover(STUDY_BBOX, 2000.0)
    assert grid.cols * grid.lon_deg >= STUDY_BBOX[2] - STUDY_BBOX[0] and grid.rows * grid.lat_deg >= STUDY_BBOX[3] - STUDY_BBOX[1]


def test_last_duplicate_of_a_block_wins(spark, tmp_path):
    """Order is that of the files and of the rows in them; a row that doesn't parse replaces nothing."""
    head = "ST,BLKLONDD,TabBlk2020, blklatdd\n"
    rows = [f"51,{-77 - k / 1000},{510590000000000 + k % 40},{38 + k / 1000}\n" for k in range(2000)]
    (tmp_path / "a.csv").write_text(head + "".join(rows))
    (tmp_path / "b.csv").write_text(head + "51,-70.5,510590000000003,40.5\n51,x,510590000000004,40.5\n51,,510590000000005,1\n")
    got = {r["block"] - 510590000000000: (round(r["lon"], 6), round(r["lat"], 6)) for r in readers.block_positions(spark, str(tmp_path)).collect()}
    want = {k % 40: (round(-77 - k / 1000, 6), round(38 + k / 1000, 6)) for k in range(2000)} | {3: (-70.5, 40.5)}
    assert got == want
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "d.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="tabblk2020"):
        readers.block_positions(spark, str(tmp_path / "c"))


def test_manifest_and_its_hash(spark, tmp_path):
    files = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, rows long")
    for name, rows in (("one", files), ("two", files.orderBy(F.desc("path")).repartition(2)), ("other", files.withColumn("rows", F.col("rows") + 1))):
        writers.manifest(rows, None, str(tmp_path / name))
    lines, hash_ = readers.manifest(spark, str(tmp_path / "one"))
    assert sorted(map(tuple, lines.select("path", "rows").collect())) == [("a", 1), ("b", 2), ("c", 3)]
    assert readers.manifest(spark, str(tmp_path / "two"))[1] == hash_ != readers.manifest(spark, str(tmp_path / "other"))[1]


def test_whole_network_is_read_and_counted(spark, tmp_path):
    edges = spark.createDataFrame([(7, 1), (8, 2), (9, 2)], "edge long, chunk long")
    writers.chunked(edges, str(tmp_path / "g"))
    index = spark.createDataFrame([(1, 1), (2, 2)], "chunk long, edge_count long")
    assert sorted(r["edge"] for r in readers.chunked_network(spark, str(tmp_path / "g"), index).collect()) == [7, 8, 9]
    some = readers.chunked_network(spark, str(tmp_path / "g"), index, [2])
    assert sorted(r["edge"] for r in some.collect()) == [8, 9] and re.search(r"PartitionFilters: \[[^]]*chunk#\d+ = 2", some._jdf.queryExecution().executedPlan().toString())
    with pytest.raises(ValueError, match="chunk 3 has 0 edges and not 4"):
        readers.chunked_network(spark, str(tmp_path / "g"), index.union(spark.createDataFrame([(3, 4)], "chunk long, edge_count long")))


def test_lenient_cloud_index(spark):
    entries = {
        "3_4": {"bytes": 10, "points": 2, "ground_min": 1.5}, "lidar/chunk_05_6.bin": {"bytes": "x", "groundMin": -2}, "chunk_7_8": {}, "chunk_1": {"bytes": 1}, "a_b": {"bytes": 1},
        "9_9": 5, "8_8": None, "2_2": [1], "chunk_3_4.bin": {"bytes": 11},
    }
    for document in ({"chunks": entries, "grid": {"cols": 3}}, entries):
        got = {tuple(r)[:2]: tuple(r)[2:] for r in readers.cloud_index(spark.createDataFrame([(json.dumps(document),)], "value string")).collect()}
        assert got == {(3, 4): (11, 0, 0.0), (5, 6): (0, 0, -2.0), (7, 8): (0, 0, 0.0)}
    odd = spark.createDataFrame([("",), (None,), ("5",), ("{",), ('{"chunks": 4}',), ("[]",)], "value string")
    assert readers.cloud_index(odd).count() == 0


def test_positions_and_shapes(spark, tmp_path):
    shapes = {
        "Point": [1, 2.5], "LineString": [[1, 2], [-3.5, 4e1]], "Polygon": [[[0, 0], [1, 0], [1, 1]], [[5, 5], [6, 6]]], "MultiPolygon": [[[[1, 1, 9], [2, 2, 9]]]], "Empty": [], "Odd": "x",
    }
    rows = spark.createDataFrame([(k, json.dumps({"type": k, "coordinates": v})) for k, v in shapes.items()] + [("None", None), ("Bare", "{}")], "kind string, geometry string")
    got = {r["kind"]: [tuple(p) for p in r["p"]] for r in rows.select("kind", readers.points(F.col("geometry")).alias("p")).collect()}
    assert got == {
        "Point": [(1, 2.5)], "LineString": [(1, 2), (-3.5, 40)], "Polygon": [(0, 0), (1, 0), (1, 1), (5, 5), (6, 6)], "MultiPolygon": [(1, 1), (2, 2)], "Empty": [], "Odd": [], "None": [], "Bare": [],
    }
    lines = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]), (2, [(0.0, 0.0)]), (3, [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)])], "id long, shape array<struct<lon:double,lat:double>>")
    for closed, want in ((False, {1: [[0, 0], [1, 0], [1, 1]], 3: [[0, 0], [1, 0], [0, 0]]}), (True, {1: [[[0, 0], [1, 0], [1, 1], [0, 0]]], 3: [[[0, 0], [1, 0], [0, 0]]]})):
        writers.feature_shapes(lines, "shape", str(tmp_path / f"s{closed}"), closed)
        told = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / f"s{closed}")).collect()]
        assert {t["properties"]["id"]: t["geometry"]["coordinates"] for t in told} == want


def test_points_without_a_pixel_are_grey(spark):
    points = spark.createDataFrame([(1, -77.3, 38.8), (2, 10.0, 50.0)], "point long, lon double, lat double")
    tx, ty = geo.tile(F.col("lon"), F.col("lat"), 12)
    gx, gy = geo.tile(F.col("lon"), F.col("lat"), 20)
    pixels = points.filter("point = 1").select(tx.alias("tx"), ty.alias("ty"), (gx % 256).alias("px"), (gy % 256).alias("py"), F.lit("112233").alias("colour"))
    assert {tuple(r) for r in feeds.sampled(points, pixels, 12).collect()} == {(1, "112233"), (2, "8c8c8c")}
