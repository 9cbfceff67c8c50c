"""Settings in layers, and hours, reach and calibration through one object."""

import logging

import pytest
from pyspark.sql import functions as F

from tallyway import engine, settings
from tallyway.operators import assign, transit

EDGES = "edge long, src long, dst long, len_m double, free_s double, capacity_vph double, open boolean"


def test_layers(tmp_path):
    path = tmp_path / "area.toml"
    path.write_text('out_dir = "a"\n[roads]\ncell_m = 500\nsimplify = false\nbox = "0,1,2,3"\n[demand]\nauto_factor = 0.5\n')
    env = {"TALLYWAY_CELL_M": "750", "TALLYWAY_AUTO_FACTOR": "", "TALLYWAY_KEEP_SERVICE": "true", "OTHER": "x"}
    made = settings.layered(str(path), env, out_dir="b", gap=None, external_zones=3)
    assert made == settings.Settings(out_dir="b", cell_m=750.0, simplify=False, box=(0, 1, 2, 3), auto_factor=0.5, keep_service=True, external_zones=3)
    assert settings.layered(str(tmp_path / "none.toml")) == settings.Settings()


@pytest.mark.parametrize("given", [{"box": "1,2,3"}, {"box": (2, 0, 1, 1)}, {"simplify": "perhaps"}, {"cell_m": "wide"}, {"colour": 1}])
def test_bad_settings_are_named(given):
    with pytest.raises(ValueError, match=f"{next(iter(given))} in the call"):
        settings.layered(None, {}, **given)


@pytest.fixture
def area(spark):
    roads = [(1, 1, 2, 1000.0, 60.0, 500.0, True), (2, 1, 3, 1000.0, 50.0, 500.0, True), (3, 3, 2, 1000.0, 50.0, 500.0, True)]
    edges = spark.createDataFrame(roads, EDGES)
    nodes = spark.createDataFrame([(k, 0.1 * k, 0.0) for k in (1, 2, 3)], "node long, lon double, lat double")
    trips = spark.createDataFrame([(8, 1, 2, 100.0), (9, 1, 2, 40.0)], "hour int, origin long, dest long, trips double")
    stations = spark.createDataFrame([(7, 1, 150.0), (8, None, 1.0), (9, 3, 5.0)], "station_id long, edge long, aadt double")
    walks = edges.select("src", "dst", F.lit(600.0).alias("cost"))
    homes = spark.createDataFrame([(2, 30.0), (3, 60.0)], "node long, trips double")
    return engine.Engine(edges, nodes, trips, walks=walks, homes=homes, stations=stations)


def test_hours_and_calibration(area, caplog):
    with pytest.raises(ValueError, match="no hour"):
        area.kpis()
    with pytest.raises(ValueError, match="0 to 23"):
        area.run_hour(24)
    caplog.set_level(logging.INFO, "tallyway")
    for hour in (8, 9, 8):  # an hour that is run again is there once
        area.run_hour(hour)
    assert [r.message.split(" took")[0] for r in caplog.records] == ["hour 8", "hour 9", "hour 8"]
    assert {(r["hour"], r["edge"]): r["volume"] for r in area.day().collect()} == {(8, 1): 100.0, (8, 2): 0.0, (8, 3): 0.0, (9, 1): 40.0, (9, 2): 0.0, (9, 3): 0.0}
    alone = assign.kpis(area.recorded[9], "hour").collect()
    assert sorted(area.kpis().collect())[1:] == alone
    rows, fit = area.calibration()
    assert {(r["station_id"], r["modelled_daily"]) for r in rows.collect()} == {(7, 140.0), (9, 0.0)}
    assert fit.first()["n"] == 1 and fit.first()["bias"] == -10.0


def test_edits_leave_the_record_alone(area, spark):
    area.run_hour(8)
    edits = spark.createDataFrame([(1, "close", 1, None, None, None)], "seq long, type string, edge long, lanes int, speed_kph double, capacity_vph double")
    roads = area.edges.withColumns({"class": F.lit(5), "lanes": F.lit(1), "speed_kph": F.lit(40.0)})
    closed = engine.Engine(roads, area.nodes, area.trips, recorded=area.recorded).run_hour(8, edits)
    assert {r["edge"]: round(r["volume"], 1) for r in closed.collect()} == {1: 0.0, 2: 100.0, 3: 100.0}
    assert {r["edge"]: r["volume"] for r in area.recorded[8].collect()} == {1: 100.0, 2: 0.0, 3: 0.0}
    more = spark.createDataFrame([(9, 1, 2, 500.0, 5.0, 5000.0, True, 2)], EDGES + ", lanes int")
    assert {r["edge"]: r["volume"] for r in area.run_hour(8, additions=more).collect()}[9] > 99.0


def test_reach(area, spark):
    starts = spark.createDataFrame([(1, 1, 0.0)], "origin long, node long, cost double")
    labels = area.isochrone(starts, 10)
    assert sorted(labels.collect()) == sorted(transit.isochrone(area.walks, None, starts, 600.0).collect())
    assert area.reach_summary(labels).first().asDict() == {"origin": 1, "people": 30.0, "zones": 2}
    with pytest.raises(ValueError, match="no walks"):
        engine.Engine(area.edges, area.nodes, area.trips).isochrone(starts, 10)
