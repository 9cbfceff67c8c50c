"""Road attributes and text normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyway import model


def highway_name(tag: Column) -> Column:
    """The class name of a highway tag; links belong to their parent."""
    base = F.regexp_replace(tag, "_link$", "")
    known = [c[1] for c in model.ROAD_CLASSES if c[1] != "other"]
    return F.when(base == "road", "unclassified").when(base.isin(known), base)


def max_speed_kph(text: Column) -> Column:
    number = F.regexp_extract(F.trim(text), r"^([0-9]+(?:\.[0-9]+)?)\s*(mph|km/h)?$", 1)
    unit = F.regexp_extract(F.trim(text), r"^([0-9]+(?:\.[0-9]+)?)\s*(mph|km/h)?$", 2)
    value = number.try_cast("double")
    return F.when(value > 0, F.when(unit == "mph", value * 1.609344).otherwise(value))


def one_way(tag: Column) -> Column:
    """1 forward, -1 backward, 0 both."""
    return F.when(tag.isin("yes", "true", "1"), 1).when(tag.isin("-1", "reverse"), -1).otherwise(0)


def with_defaults(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds speed_kph, lanes and capacity_vph where the road itself doesn't tell them. ``classes`` has ten rows."""
    own = lambda c, t: F.col(c) if c in edges.columns else F.lit(None).cast(t)
    lanes = F.greatest(F.coalesce(own("lanes", "int"), F.col("class_lanes")), F.lit(1))
    made = {
        "speed_kph": F.coalesce(own("speed_kph", "double"), F.col("class_kph")),
        "lanes": lanes,
        "capacity_vph": F.coalesce(own("capacity_vph", "double"), lanes * F.col("lane_vph")),
    }
    return edges.join(F.broadcast(classes), "class").withColumns(made).drop("class_name", "class_kph", "class_lanes", "lane_vph")


def free_flow_s(len_m: Column, speed_kph: Column) -> Column:
    return len_m / F.greatest(speed_kph / 3.6, F.lit(1e-3))


def bpr_s(free_s: Column, volume: Column, capacity: Column, open_: Column | None = None) -> Column:
    """Travel time under a volume; a closed road costs a fixed prohibitive time."""
    r = volume / F.greatest(capacity, F.lit(1.0))
    cost = free_s * (F.lit(1.0) + model.BPR_ALPHA * (r * r * r * r))
    return cost if open_ is None else F.when(open_, cost).otherwise(model.CLOSED_COST_S)


# The spellings of each severity in open crash data.
KABCO = {5: ("K", "FATAL"), 4: ("A", "SEVERE INJURY"), 3: ("B", "VISIBLE INJURY"), 2: ("C", "NONVISIBLE INJURY"), 1: ("O", "PDO", "PROPERTY DAMAGE")}


def named_code(value: Column, names: dict[int, tuple[str, ...]]) -> Column:
    return F.coalesce(*[F.when(value.isin(*spellings), F.lit(code)) for code, spellings in names.items()])


def clamped_severity(value: Column) -> Column:
    """Rounded; 1 where that isn't 1 to 5."""
    whole = F.floor(F.coalesce(value.cast("double"), F.lit(0.0)) + 0.5).cast("int")
    return F.when(whole.between(1, 5), whole).otherwise(1)


def counted_weight(value: Column) -> Column:
    """What a feature stands for: its rounded count, one at least."""
    return F.greatest(F.floor(F.coalesce(value.cast("double"), F.lit(0.0)) + 0.5).cast("bigint"), F.lit(1).cast("bigint"))


def severity(text: Column) -> Column:
    """1 to 5 from a number, a coded text such as "3: injury", or a KABCO letter or word; null otherwise."""
    trimmed = F.upper(F.trim(text))
    code = F.coalesce(trimmed.try_cast("double"), F.trim(F.split_part(trimmed, F.lit(":"), F.lit(1))).try_cast("double")).cast("int")
    letters = named_code(trimmed, KABCO)
    return F.when(code.between(1, 5), code).otherwise(letters)


def height_m(lidar_ft: Column, top_ft: Column, ground_ft: Column) -> Column:
    metres = F.coalesce(lidar_ft, top_ft - ground_ft) * model.FEET_M
    return F.when(metres.between(model.LEAST_HEIGHT_M, model.MOST_HEIGHT_M), metres)


def shown_height_m(height: Column, render: Column, levels: Column) -> Column:
    """The first of a height, a rendered height and storeys that is a number; else a small building's."""
    number = lambda c: c.cast("string").try_cast("double")
    return F.coalesce(number(height), number(render), number(levels) * model.STOREY_M, F.lit(model.UNKNOWN_HEIGHT_M))


def mps(kph: Column) -> Column:
    return kph / 3.6


def kph(mps_: Column) -> Column:
    return mps_ * 3.6


def zone_category(name: Column) -> Column:
    return F.when(name.isin(*model.ZONE_CATEGORIES), name).otherwise("other")


def slug(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-")


def weight(seconds: Column) -> Column:
    """Whole hundredths of a second, at least one."""
    return F.greatest(F.least(F.greatest(seconds * 100, F.lit(0.0)), F.lit(1e8)).cast("bigint"), F.lit(1).cast("bigint"))


def hour_cost_s(edges: Column, coarse: Column, threads: Column) -> Column:
    full = F.when(edges <= 0, 0.0).otherwise(model.REF_SECONDS * F.pow(edges / float(model.REF_EDGES), F.lit(model.COST_EXPONENT)))
    speedup = F.when(threads <= 1, 1.0).otherwise(1.0 + (threads - 1) * model.THREAD_EFFICIENCY)
    return full * F.when(coarse, model.COARSE_FACTOR).otherwise(1.0) / speedup


def axis_max(value: Column) -> Column:
    half = F.pow(F.lit(10.0), F.floor(F.log10(value))) / 2
    return F.when(value > 0, F.ceil(value / half) * half).otherwise(1.0)
