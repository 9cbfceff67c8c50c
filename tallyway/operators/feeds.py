"""Point events, counts, calibration, land use and building features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyway import model
from tallyway.functions import geo, roads
from tallyway.model import Grid


def crash_cells(crashes: DataFrame, grid: Grid) -> DataFrame:
    """Per grid cell: crashes, severities, their mean and the cell's centre. Sums merge, so it also runs on streams."""
    x, y = geo.cell_x(F.col("lon"), grid), geo.cell_y(F.col("lat"), grid)
    per = crashes.groupBy(x.alias("cx"), y.alias("cy")).agg(F.count(F.lit(1)).alias("n"), F.sum("severity").cast("bigint").alias("severity_sum"))
    return per.withColumns({
        "mean_severity": F.col("severity_sum") / F.col("n"),
        "lon": grid.west + (F.col("cx") + 0.5) * grid.lon_deg, "lat": grid.south + (F.col("cy") + 0.5) * grid.lat_deg,
    })


def year_range(crashes: DataFrame) -> DataFrame:
    """first_year and last_year of ``crashes(yr)``, years that aren't told aside; both null without any."""
    told = F.when(F.col("yr") > 0, F.col("yr"))
    return crashes.agg(F.min(told).alias("first_year"), F.max(told).alias("last_year"))


def position(geom_lon: Column, geom_lat: Column, lon: Column, lat: Column) -> tuple[Column, Column]:
    """A crash's place: its geometry, else its coordinates where neither is zero."""
    has, told = geom_lon.isNotNull() & geom_lat.isNotNull(), (lon != 0) & (lat != 0)
    return F.when(has, geom_lon).when(told, lon), F.when(has, geom_lat).when(told, lat)


def crash_edges(snapped: DataFrame) -> DataFrame:
    fatal = F.sum((F.col("severity") == 5).cast("int")).cast("bigint")
    return snapped.filter("edge IS NOT NULL").groupBy("edge").agg(F.count(F.lit(1)).alias("n"), F.sum("severity").cast("bigint").alias("severity_sum"), fatal.alias("fatal"))


def of_edges(asked: DataFrame, crashed: DataFrame) -> DataFrame:
    """What ``crash_edges`` says of each edge of ``asked(edge)``; edges without crashes have zeros."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return asked.select("edge").distinct().join(crashed, "edge", "left").select("edge", zero("n"), zero("severity_sum"), zero("fatal"))


def parcel_cards(features: DataFrame) -> DataFrame:
    """What is shown of each parcel of ``features(parcel_id, zone, category, land_use, assessed_value, area_m2)``: blank texts are null, untold numbers 0."""
    told = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    number = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)).alias(c)
    return features.select(
        F.coalesce(told("parcel_id"), F.lit("(unknown)")).alias("parcel_id"), told("zone").alias("zone"), roads.zone_category(F.coalesce(told("category"), told("zone"))).alias("category"),
        told("land_use").alias("land_use"), number("assessed_value"), number("area_m2"),
    )


def top_edges(snapped: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` edges with the most crashes; ties: smaller edge."""
    return snapped.filter("edge IS NOT NULL").groupBy("edge").agg(F.count(F.lit(1)).alias("crashes")).orderBy(F.desc("crashes"), "edge").limit(n)


def tile_severities(features: DataFrame) -> DataFrame:
    """Crashes by clamped severity of ``features(severity, count)``: a cell stands for its count, a point for one."""
    rows = features.select(roads.clamped_severity(F.col("severity")).alias("severity"), roads.counted_weight(F.col("count")).alias("n"))
    return rows.groupBy("severity").agg(F.sum("n").alias("crashes"))


def by_severity(crashes: DataFrame) -> DataFrame:
    """Crashes of each severity from 1 to 5, zero where there is none."""
    all_ = crashes.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("severity"))
    per = crashes.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return all_.join(per, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def modelled_daily(hourly: DataFrame, hours: DataFrame) -> DataFrame:
    """Daily volume per edge of ``hourly(edge, hour, volume)``: the sum, or a single hour over its share of the day.

    The hours that are there are bits of a number, so an edge is one row of fixed width in one aggregate. Hours are 0 to 63.
    """
    rows = hourly.join(F.broadcast(hours.select("hour", "share")), "hour")
    bit = F.expr("shiftleft(1L, CAST(hour AS INT))")
    per = rows.groupBy("edge").agg(F.bit_count(F.bit_or(bit)).cast("bigint").alias("hours_present"), F.sum("volume").alias("v"), F.max("share").alias("share"))
    scaled = F.when(F.col("hours_present") == 1, F.col("v") / F.greatest(F.col("share"), F.lit(1.1920929e-07))).otherwise(F.col("v"))
    return per.select("edge", "hours_present", scaled.alias("modelled_daily"))


def calibration(stations: DataFrame, daily: DataFrame) -> DataFrame:
    return stations.filter("edge IS NOT NULL").join(daily, "edge").select("station_id", "edge", "aadt", "modelled_daily", "hours_present")


def fit(rows: DataFrame) -> DataFrame:
    """n, R squared about y = x, root mean square error, bias and maxima of the rows that the model can score.

    One pass: the total sum of squares comes from sums, centred on a value near the data to keep its digits.
    """
    o, m = F.col("aadt"), F.col("modelled_daily")
    sums = rows.filter(m > 0).agg(F.count(F.lit(1)).alias("n"), F.sum((m - o) ** 2).alias("res"), F.var_pop(o).alias("v"), F.avg(m - o).alias("bias"), F.max(o).alias("max_observed"), F.max(m).alias("max_modelled"))
    tot = F.col("v") * F.col("n")
    return sums.select("n", F.when(tot > 0, 1 - F.col("res") / tot).alias("r2"), F.sqrt(F.col("res") / F.col("n")).alias("rmse"), "bias", "max_observed", "max_modelled")


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The row of each key that is last in ``order``."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("row"))).alias("b")).select(key, "b.row.*")


def parcels(polygons: DataFrame, attributes: DataFrame, values: DataFrame) -> DataFrame:
    """Polygons with the attributes and the value of the same parcel, where there are any."""
    return polygons.join(attributes, "parcel_id", "left").join(values, "parcel_id", "left")


def land_use(features: DataFrame) -> DataFrame:
    """Parcels, area and value by category and, with a null category, in all. A parcel that occurs twice counts once."""
    once = features.groupBy("parcel_id").agg(F.min(F.struct("tile", "zone", "area_m2", "value")).alias("f")).select("parcel_id", "f.*")
    zoned = once.select(roads.zone_category(F.col("zone")).alias("category"), "area_m2", "value")
    return zoned.rollup("category").agg(F.count(F.lit(1)).alias("parcels"), F.sum(F.coalesce("area_m2", F.lit(0.0))).alias("area_m2"), F.sum(F.coalesce("value", F.lit(0.0))).alias("assessed_value"))


def attributed(features: DataFrame, attribute: str) -> DataFrame:
    return features.agg(F.count(F.lit(1)).alias("features"), F.count(attribute).alias("attributed"))


def daily_kpis(hourly: DataFrame) -> DataFrame:
    """Sums over hours, the plain and the weighted mean of delays, and the hour with the most vehicle miles."""
    return hourly.agg(
        F.sum("vmt").alias("vmt"), F.sum("vht").alias("vht"), F.avg("mean_delay_s").alias("mean_delay_s"),
        (F.sum(F.col("mean_delay_s") * F.col("vmt")) / F.sum("vmt")).alias("weighted_delay_s"), F.max(F.struct("vmt", (-F.col("hour")).alias("h"))).alias("p"),
    ).select("vmt", "vht", "mean_delay_s", "weighted_delay_s", (-F.col("p.h")).alias("peak_hour"))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key ``new`` doesn't have."""
    values = [c for c in old.columns if c != key]
    a, b = old.select(key, F.struct(*values).alias("o")), new.select(key, F.struct(*values).alias("n"))
    return a.join(b, key, "full").select(key, F.coalesce("n", "o").alias("r")).select(key, "r.*")


def thinned(points: DataFrame, cell: float) -> DataFrame:
    """The highest point of each square; thinning again changes nothing, so parts may be thinned first."""
    rest = [c for c in points.columns if c not in ("x", "y", "z")]
    ix, iy = F.floor(F.col("x") / cell).cast("bigint"), F.floor(F.col("y") / cell).cast("bigint")
    return points.groupBy(ix.alias("ix"), iy.alias("iy")).agg(F.max(F.struct("z", "x", "y", *rest)).alias("p")).select("ix", "iy", "p.*")


def ground(points: DataFrame, chunk: Column, ground_class: int = 2) -> DataFrame:
    low = F.round(F.min(F.when(F.col("cls") == ground_class, F.col("z"))), 3)
    return points.groupBy(chunk.alias("chunk")).agg(F.count(F.lit(1)).alias("points"), low.alias("ground_min"))


def within_budget(chunks: DataFrame, lon: float, lat: float, budget: int) -> DataFrame:
    """Chunks nearest the centre first, each taken if it still fits; later ones may fit where an earlier one didn't.

    The fold goes over the chunks of one view, of which a grid has a fixed number.
    """
    d = (F.col("lon") - lon) ** 2 + (F.col("lat") - lat) ** 2
    near = chunks.filter("points > 0").agg(F.array_sort(F.collect_list(F.struct(d.alias("d"), "chunk", "bytes"))).alias("all"))
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<bigint>").alias("taken"))
    fits = lambda a, c: a["used"] + c["bytes"] <= budget
    fold = F.aggregate("all", zero, lambda a, c: F.struct(F.when(fits(a, c), a["used"] + c["bytes"]).otherwise(a["used"]).alias("used"), F.when(fits(a, c), F.concat(a["taken"], F.array(c["chunk"]))).otherwise(a["taken"]).alias("taken")))
    return near.select(F.posexplode(fold["taken"]).alias("place", "chunk"))


def sampled(points: DataFrame, pixels: DataFrame, zoom: int, size: int = 256) -> DataFrame:
    """Colour of the nearest pixel of ``pixels(tx, ty, px, py, colour)`` for ``points(point, lon, lat)``; without one the middle grey, so that no hole looks black."""
    tx, ty = geo.tile(F.col("lon"), F.col("lat"), zoom)
    gx, gy = geo.tile(F.col("lon"), F.col("lat"), zoom + size.bit_length() - 1)
    at = points.withColumns({"tx": tx, "ty": ty, "px": gx % size, "py": gy % size})
    return at.join(pixels, ["tx", "ty", "px", "py"], "left").select("point", F.coalesce("colour", F.lit(model.NO_COLOUR)).alias("colour"))

