"""Services, patterns and footpaths of a static schedule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.columns import DAY_NAMES, gtfs_seconds
from ..operators.joins import grid_band_join


def calendar_on(calendar: DataFrame, day: str) -> DataFrame:
    """service_id of the calendar rows that run on a date (yyyy-MM-dd)."""
    d = F.lit(day).cast("date")
    runs = F.element_at(F.array(*(F.col(n.lower()) for n in DAY_NAMES)), F.dayofweek(d)) == "1"
    return calendar.where(runs & (F.to_date("start_date", "yyyyMMdd") <= d) & (F.to_date("end_date", "yyyyMMdd") >= d)).select("service_id")


def active_services(running: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Distinct services that run: the calendar's, with exceptions of type 1 added and of type 2 removed (a removal wins)."""
    added = exceptions.where("exception_type = '1'").select("service_id")
    removed = exceptions.where("exception_type = '2'").select("service_id")
    return running.select("service_id").unionAll(added).distinct().join(removed, "service_id", "left_anti")


def trip_patterns(stop_times: DataFrame, by: Sequence[str] = ("route_id", "direction_id")) -> DataFrame:
    """Trips with the same stops in the same order (and the same `by` columns): stops, trips (by first time, where there are times). Trips of one stop are left out."""
    timed = "arrival_time" in stop_times.columns
    cells = F.struct("stop_sequence", "stop_id", *([gtfs_seconds("arrival_time").alias("at")] if timed else []))
    trips = stop_times.groupBy(*by, "trip_id").agg(F.array_sort(F.collect_list(cells)).alias("_c")).where(F.size("_c") >= 2)  # one trip's stops
    trips = trips.withColumn("stops", F.transform("_c", lambda x: x["stop_id"]))
    order = F.struct(F.col("_c")[0]["at"].alias("at"), "trip_id") if timed else F.struct("trip_id")
    return trips.groupBy(*by, "stops").agg(F.array_sort(F.collect_list(order)).alias("_t")).select(*by, "stops", F.transform("_t", lambda x: x["trip_id"]).alias("trips"))


def footpaths(stops: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Unordered pairs of stops in walking distance, with the walk in seconds. stops: stop_id, stop_lat, stop_lon."""
    near = grid_band_join(stops, settings.footpath_m, lat="stop_lat", lon="stop_lon", pairs="once", settings=settings)
    return near.select(F.col("a_stop_id").alias("from_stop"), F.col("b_stop_id").alias("to_stop"), (F.floor(F.col("distance_m") / settings.footpath_speed_mps) + settings.footpath_extra_s).cast("bigint").alias("seconds"))
