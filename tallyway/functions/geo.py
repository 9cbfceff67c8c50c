"""Planar geometry as column expressions; distances are equirectangular, in metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyway.model import M_PER_DEG_LAT, Grid


def equirect_m(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    dx = (lon_b - lon_a) * M_PER_DEG_LAT * F.cos(F.radians((lat_a + lat_b) * 0.5))
    dy = (lat_b - lat_a) * M_PER_DEG_LAT
    return F.sqrt(dx * dx + dy * dy)


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def clamped(value: Column, most: int) -> Column:
    return F.least(F.greatest(F.floor(value), F.lit(0)), F.lit(most)).cast("bigint")


def cell_x(lon: Column, grid: Grid) -> Column:
    return clamped((lon - grid.west) / grid.lon_deg, grid.cols - 1)


def cell_y(lat: Column, grid: Grid) -> Column:
    return clamped((lat - grid.south) / grid.lat_deg, grid.rows - 1)


#: How near a boundary a corner counts as on it, in cells.
ON_BOUNDARY = 1e-9


def corner_cell(value: Column, low: float, size: float, cells: int, upper: bool) -> Column:
    """The cell of a window's corner along an axis: on a boundary the lower corner takes the cell that starts there, the upper the one that ends there.

    So a window that spans two cells exactly has two, and not three. Corners beyond the grid take its outermost cell.
    """
    raw = (value - low) / size
    nearest = F.floor(raw + 0.5)
    at = F.when(F.abs(raw - nearest) < ON_BOUNDARY, nearest - int(upper)).otherwise(F.floor(raw))
    return F.least(F.greatest(at, F.lit(0)), F.lit(cells - 1)).cast("bigint")


def window_cells(west: Column, south: Column, east: Column, north: Column, grid: Grid) -> tuple[Column, Column, Column, Column]:
    """First and last column and row of the cells that a window takes."""
    return (
        corner_cell(west, grid.west, grid.lon_deg, grid.cols, False), corner_cell(south, grid.south, grid.lat_deg, grid.rows, False),
        corner_cell(east, grid.west, grid.lon_deg, grid.cols, True), corner_cell(north, grid.south, grid.lat_deg, grid.rows, True),
    )


def chunk_of(lon: Column, lat: Column, grid: Grid) -> Column:
    return cell_y(lat, grid) * grid.cols + cell_x(lon, grid)


def segment_m(lon: Column, lat: Column, lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    """Distance of a point to the segment a-b, flat around the point."""
    k = F.cos(F.radians(lat)) * M_PER_DEG_LAT
    ax, ay = (lon_a - lon) * k, (lat_a - lat) * M_PER_DEG_LAT
    dx, dy = (lon_b - lon_a) * k, (lat_b - lat_a) * M_PER_DEG_LAT
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.least(F.greatest(-(ax * dx + ay * dy) / square, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    x, y = ax + t * dx, ay + t * dy
    return F.sqrt(x * x + y * y)


def ring_area_m2(ring: Column) -> Column:
    """Area of the first ring (array of structs lon, lat), closed or not."""
    n = F.size(ring)
    k = F.cos(F.radians(ring[0]["lat"])) * M_PER_DEG_LAT
    # From the first corner on: products of whole coordinates would eat up the digits.
    x = lambda i: (ring[i]["lon"] - ring[0]["lon"]) * k
    y = lambda i: (ring[i]["lat"] - ring[0]["lat"]) * M_PER_DEG_LAT
    cross = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: x(i) * y((i + 1) % n) - x((i + 1) % n) * y(i))
    return F.when(n >= 3, F.abs(F.aggregate(cross, F.lit(0.0), lambda a, c: a + c)) * 0.5).otherwise(0.0)


def middle_vertex(line: Column) -> Column:
    return F.element_at(line, (F.size(line) / 2).cast("int") + 1)


def mercator_x(lon: Column) -> Column:
    return lon * 20037508.342789244 / 180.0


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.radians(lat) / 2.0 + 0.7853981633974483)) * 6378137.0


def tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    n = float(2**zoom)
    y = (F.lit(1.0) - F.asinh(F.tan(F.radians(lat))) / 3.141592653589793) / 2.0 * n
    return F.floor((lon + 180.0) / 360.0 * n).cast("bigint"), F.floor(y).cast("bigint")
