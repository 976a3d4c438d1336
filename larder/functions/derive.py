"""Derived business columns (C22-C36) as pure Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.semantics import col, cut, minutes_between

# Delay buckets (minutes), right-closed: fixed edges and their display order.
DELAY_EDGES = [float("-inf"), -30.0, 0.0, 30.0, 60.0, float("inf")]
DELAY_LABELS = ["very_early", "early", "on_time", "late", "very_late"]


def dispatch_delay(expected="expected_arrival", actual="actual_arrival") -> Column:
    """Minutes late (negative = early), C23."""
    return minutes_between(expected, actual)


def on_time(delay) -> Column:
    """1 when -30 <= delay <= 30 (inclusive), else 0; NULL delay -> 0 like pandas."""
    return F.coalesce(col(delay).between(-30, 30).cast("int"), F.lit(0))


def delay_category(delay) -> Column:
    d = col(delay)
    return (F.when(d <= -30, "very_early").when(d <= 0, "early").when(d <= 30, "on_time")
             .when(d <= 60, "late").when(d > 60, "very_late"))


def revenue(qty="quantity_sold", price="price") -> Column:
    return col(qty) * col(price)


def location_type(plant="plant_id", store="store_id") -> Column:
    """Plant if a plant id is present, else store, else Unknown."""
    return (F.when(col(plant).isNotNull(), "Plant").when(col(store).isNotNull(), "Store")
             .otherwise("Unknown"))


def location_id(plant="plant_id", store="store_id") -> Column:
    return F.coalesce(col(plant), col(store))


def route_type(km) -> Column:
    """(0,30] Urban, (30,60] Suburban, (60,150] Rural, else NULL."""
    return cut(km, [0, 30, 60, 150], ["Urban", "Suburban", "Rural"])


def capacity_category(kg) -> Column:
    """(0,4000] Small, (4000,5500] Medium, (5500,10000] Large."""
    return cut(kg, [0, 4000, 5500, 10000], CAPACITY_LABELS)


# Capacity classes and trip-start classes: fixed values.
CAPACITY_LABELS = ["Small", "Medium", "Large"]
START_WINDOW_CLASSES = {"03:00-05:00": "Early", "04:00-06:00": "Mid", "05:00-07:00": "Late"}
ROUTE_TYPES = ["Urban", "Suburban", "Rural"]


def start_window_category(window) -> Column:
    """Map lookup; unknown windows -> NULL."""
    m = F.create_map(*[F.lit(x) for kv in START_WINDOW_CLASSES.items() for x in kv])
    return F.element_at(m, col(window))


def depot_region(depot) -> Column:
    """Text before the first '_', else DIRECT."""
    d = col(depot)
    return F.when(F.instr(d, "_") > 0, F.split_part(d, F.lit("_"), F.lit(1))).otherwise(F.lit("DIRECT"))


def stop_count(stops) -> Column:
    """Length of a comma list, 0 when NULL."""
    s = col(stops)
    return F.when(s.isNull(), F.lit(0)).otherwise(F.size(F.split(s, ",")))


def normalise_status(status) -> Column:
    """C14: strip + lower."""
    return F.lower(F.trim(col(status)))
