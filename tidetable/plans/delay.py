"""Scheduled against predicted arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.columns import scheduled_utc
from ..operators import quantiles
from ..operators.windows import final_observation


def sequence_key(feed: str = "feed_name", sequence: str = "stop_sequence"):
    """Realtime light-rail sequences count from one, the schedule's from zero."""
    return (F.col(sequence) - F.when(F.col(feed).like("lrt_%"), 1).otherwise(0)).cast("bigint")


def join_schedule(updates: DataFrame, stop_times: DataFrame, *, by_date: bool = True) -> DataFrame:
    """Stop-time updates with the schedule row of the same trip, stop and place in the trip; of the same day's schedule if by_date."""
    static = stop_times.select(
        "trip_id", "stop_id", F.col("stop_sequence").try_cast("bigint").alias("_seq"), "arrival_time", "feed_name", *([F.col("p_snapshot_date").cast("date").alias("_day")] if by_date else [])
    )
    left = updates.withColumn("_seq", sequence_key())
    keys = ["trip_id", "stop_id", "_seq", "feed_name"]
    if by_date:
        left, keys = left.withColumn("_day", F.col("snapshot_date").cast("date")), [*keys, "_day"]
    return left.join(static, keys).drop("_seq", "_day")


def delay_table(updates: DataFrame, stop_times: DataFrame, *, by_date: bool = True, keep_all: bool = False, dedup_by_sequence: bool = False, settings: Settings = DEFAULT) -> DataFrame:
    """Delay per prediction, or (by default) of the last prediction before each arrival.

    dedup_by_sequence keeps both visits of a loop trip to a stop; without it they count as one.
    """
    rows = join_schedule(updates.where("arrival_time_utc IS NOT NULL"), stop_times, by_date=by_date)
    scheduled = scheduled_utc("start_date", "arrival_time", "start_time", settings)
    seconds = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)).cast("double") / 1e6
    rows = rows.withColumns({"service_date": F.to_date("start_date", "yyyyMMdd"), "scheduled_arrival_utc": scheduled, "predicted_arrival_utc": F.col("arrival_time_utc"), "predicted_departure_utc": F.col("departure_time_utc")})
    rows = rows.withColumns(
        {
            "delay_seconds": seconds(F.col("predicted_arrival_utc"), F.col("scheduled_arrival_utc")),
            "prediction_lead_minutes": seconds(F.col("predicted_arrival_utc"), F.col("collected_at_utc")) / 60.0,
        }
    ).where("scheduled_arrival_utc IS NOT NULL")
    names = (
        "snapshot_date",
        "collected_at_utc",
        "feed_name",
        "trip_id",
        "route_id",
        "direction_id",
        "vehicle_id",
        "stop_id",
        "stop_sequence",
        "service_date",
        "arrival_time",
        "scheduled_arrival_utc",
        "predicted_arrival_utc",
        "predicted_departure_utc",
        "delay_seconds",
        "prediction_lead_minutes",
    )
    rows = rows.select(*names).withColumnRenamed("arrival_time", "scheduled_arrival_local_str")
    keys = ["snapshot_date", "trip_id", "stop_id", *(["stop_sequence"] if dedup_by_sequence else [])]
    return rows if keep_all else final_observation(rows, keys)


def delay_stats(delays: DataFrame) -> DataFrame:
    """One row: how many rows, trips, routes and stops there are, and the spread of their delays."""
    simple = delays.agg(F.count("*").alias("rows"), F.min("delay_seconds").alias("min_delay"), F.max("delay_seconds").alias("max_delay"), F.avg("delay_seconds").alias("mean_delay")).withColumn("_key", quantiles.key_of(()))
    spread = quantiles.percentiles(quantiles.value_counts(delays, (), "delay_seconds"), (), "delay_seconds", {"median_delay": 0.5, "p95_delay": 0.95})
    different = quantiles.distinct_counts(delays, (), {"trips": "trip_id", "routes": "route_id", "stops": "stop_id"})
    out = simple.join(spread, "_key", "left").join(different, "_key", "left").na.fill(0, ["trips", "routes", "stops"])
    return out.select("rows", "trips", "routes", "stops", "min_delay", "max_delay", "mean_delay", "median_delay", "p95_delay")
