"""What a map and a journey planner look up: route shapes, their bounds, delays by route and hour, transfer rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHAPE_KEYS = ("shape_id", "feed_name", "p_snapshot_date")


def shape_points(route_shapes: DataFrame, shapes: DataFrame) -> DataFrame:
    """Points of each route's shapes in order: route_id, shape_id, seq, lat, lon. Shapes are told by feed and date as well; points without a place are left out.

    shapes: GTFS columns as text. A route's shapes are few, so the route side is the one Spark may broadcast.
    """
    places = shapes.select(*SHAPE_KEYS, F.col("shape_pt_sequence").try_cast("int").alias("seq"), *(F.col(f"shape_pt_{c}").try_cast("double").alias(c) for c in ("lat", "lon")))
    named = route_shapes.select("route_id", *SHAPE_KEYS).distinct()
    return places.where("lat IS NOT NULL AND lon IS NOT NULL").join(named, list(SHAPE_KEYS)).select("route_id", "shape_id", "seq", "lat", "lon")


def bounds(points: DataFrame) -> DataFrame:
    """One row: the least and greatest latitude and longitude (nulls where there is no point)."""
    return points.agg(F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"))


def polylines(points: DataFrame, digits: int = 6) -> DataFrame:
    """A row for each shape of a route with its points as an array of [lat, lon] in order (one shape's points are a group)."""
    packed = F.array_sort(F.collect_list(F.struct("seq", F.round("lat", digits).alias("lat"), F.round("lon", digits).alias("lon"))))
    return points.groupBy("route_id", "shape_id").agg(F.transform(packed, lambda p: F.array(p["lat"], p["lon"])).alias("points"))


def route_hours(by_hour: DataFrame, least: int = 30) -> DataFrame:
    """Whole seconds of median and 90th percentile by route and hour with enough observations: route_id, hour_of_day, median_s, p90_s."""
    seen = by_hour.where(F.col("observations") >= least)
    return seen.select("route_id", "hour_of_day", F.rint("median_delay_seconds").cast("bigint").alias("median_s"), F.rint("p90_delay_seconds").cast("bigint").alias("p90_s"))


def transfer_rates(summary: DataFrame, least: int = 25) -> DataFrame:
    """Observed rates of transfers with enough attempts by their key, from_route|to_route|from_stop."""
    key = F.concat_ws("|", *(F.col(c).cast("string") for c in ("from_route_id", "to_route_id", "from_stop_id")))
    return summary.where(F.col("attempts") >= least).select(key.alias("transfer"), F.round("success_rate", 3).alias("success_rate"))


def lookups(hours: DataFrame, rates: DataFrame) -> DataFrame:
    """One row of JSON: route_hours as route to hour to [median, p90], and transfer_rates by key (bounded by routes, hours and transfer stops)."""
    hour = F.struct(F.col("hour_of_day").cast("string").alias("hour"), F.array("median_s", "p90_s").alias("delays"))
    by_route = hours.groupBy(F.col("route_id").cast("string").alias("route")).agg(F.array_sort(F.collect_list(hour)).alias("hours"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("route", "hours"))), lambda x: F.struct(x["route"], F.map_from_entries(x["hours"])))
    routes = by_route.agg(F.map_from_entries(entries).alias("route_hours"))
    observed = rates.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("transfer", "success_rate")))).alias("transfer_rates"))
    return routes.crossJoin(observed).select(F.to_json(F.struct("*")).alias("json"))  # one row each
