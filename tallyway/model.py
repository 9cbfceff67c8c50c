"""Constants and small dimension tables of the domain."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Fixed values.
M_PER_DEG_LAT = 111_320.0
STUDY_BBOX = (-77.54, 38.60, -77.04, 39.06)
CHUNK_CELL_M = 2_000.0
CRASH_CELL_M = 250.0
METRES_PER_MILE = 1609.344
BPR_ALPHA, BPR_BETA = 0.15, 4
MAX_ITERATIONS, GAP = 20, 1e-3
CLOSED_COST_S = 1e7
WALK_MPS, BOARDINGS = 1.35, 3
SNAP_STOP_M, SNAP_STATION_M, SNAP_CRASH_M = 400.0, 250.0, 120.0
FEET_M, LEAST_HEIGHT_M, MOST_HEIGHT_M = 0.3048, 1.0, 200.0
OD_FLOOR, AUTO_FACTOR, EXTERNAL_ZONES = 0.5, 0.8, 12
GRAVITY_TOTAL, GRAVITY_NEAREST_M = 1_500_000.0, 500.0
TRIPS_PER_CAPITA = 3.0
COARSE_ZONES, LLOYD_ROUNDS = 400, 12
REACH_BANDS_MIN = (15, 30, 45, 60)
LIDAR_CLASSES = (1, 2, 3, 4, 5, 6, 9)
LIDAR_BUDGET = 300 * 1024 * 1024
REF_EDGES, REF_SECONDS, COST_EXPONENT = 36_000, 1.0, 2.9
COARSE_FACTOR, THREAD_EFFICIENCY, COLD_FACTOR = 0.145, 0.883, 2

# Share of daily trips by hour.
HOUR_SHARE = (
    0.006, 0.004, 0.003, 0.003, 0.006, 0.017, 0.041, 0.070, 0.078, 0.055, 0.043, 0.043,
    0.048, 0.048, 0.051, 0.062, 0.082, 0.093, 0.078, 0.057, 0.041, 0.031, 0.023, 0.017,
)
# Fixed values: (first hour, last hour, share of trips on the way back); other hours 0.70.
RETURN_SHARE = ((0, 9, 0.10), (10, 13, 0.35), (14, 15, 0.55), (16, 19, 0.85))
# Class, name, free speed (kph), lanes and capacity per lane (vehicles an hour).
ROAD_CLASSES = (
    (0, "motorway", 105.0, 3, 2200.0),
    (1, "trunk", 90.0, 2, 1900.0),
    (2, "primary", 72.0, 2, 1600.0),
    (3, "secondary", 56.0, 1, 1400.0),
    (4, "tertiary", 48.0, 1, 1200.0),
    (5, "residential", 40.0, 1, 800.0),
    (6, "unclassified", 40.0, 1, 800.0),
    (7, "service", 24.0, 1, 400.0),
    (8, "living_street", 16.0, 1, 300.0),
    (9, "other", 32.0, 1, 600.0),
)
# State, longitude and latitude of its centre.
STATE_CENTRES = (
    (11, -77.02, 38.90), (24, -76.80, 39.05), (54, -80.60, 38.60), (42, -77.60, 40.90), (10, -75.50, 39.00),
    (34, -74.70, 40.20), (36, -75.50, 42.90), (37, -79.40, 35.50), (45, -80.90, 33.90), (47, -86.70, 35.80),
    (21, -84.30, 37.50), (39, -82.80, 40.30), (51, -78.80, 37.50),
)
ZONE_CATEGORIES = ("residential", "commercial", "industrial", "institutional", "mixed_use", "agricultural", "open_space")


def return_share(hour: int) -> float:
    return next((s for a, b, s in RETURN_SHARE if a <= hour <= b), 0.70)


@dataclass(frozen=True)
class Grid:
    """Near-square cells over a box; the last column and row may reach beyond it."""

    west: float
    south: float
    east: float
    north: float
    lon_deg: float
    lat_deg: float
    cols: int
    rows: int

    @staticmethod
    def cover(box: tuple[float, float, float, float], cell_m: float) -> Grid:
        west, south, east, north = box
        if not (-180 <= west < east <= 180 and -90 <= south < north <= 90):
            raise ValueError(f"not a box on the globe: {box}")
        lat = cell_m / M_PER_DEG_LAT
        lon = cell_m / (M_PER_DEG_LAT * abs(math.cos(math.radians((south + north) / 2))))
        return Grid(west, south, east, north, lon, lat, max(1, math.ceil((east - west) / lon)), max(1, math.ceil((north - south) / lat)))


def road_classes(spark: SparkSession) -> DataFrame:
    """Ten rows, so it can always be broadcast."""
    return spark.createDataFrame(list(ROAD_CLASSES), "class int, class_name string, class_kph double, class_lanes int, lane_vph double")


def hour_shares(spark: SparkSession) -> DataFrame:
    rows = [(h, s, return_share(h)) for h, s in enumerate(HOUR_SHARE)]
    return spark.createDataFrame(rows, "hour int, share double, back double")


#: Colour of a point under which no pixel lies.
NO_COLOUR = "8c8c8c"
# The classes that count as major, and the colours of volume over capacity.
MAJOR_CLASSES = (0, 1, 2, 3)
VC_COLOURS = (
    (0.0, (56, 142, 96)), (0.5, (140, 176, 70)), (0.75, (227, 186, 60)), (0.9, (232, 129, 47)), (1.05, (214, 62, 51)), (1.3, (140, 26, 60)),
)
#: Metres of a storey, and of a building of which nothing is known.
STOREY_M, UNKNOWN_HEIGHT_M = 3.5, 6.0
