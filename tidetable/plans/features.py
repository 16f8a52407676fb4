"""The feature table: prediction history, vehicle, schedule, weather and target of every prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.columns import haversine_m, local_parts, seq_normalized, transit_mode
from ..operators.windows import history_features, previous_stop, stride_thin

WEATHER = ("temperature_c", "weather_condition", "wind_speed_kmh", "wind_gust_kmh", "precip_probability_pct", "precip_category", "is_rain", "is_snow", "is_freezing_rain", "is_precip")
_WEATHER_KINDS = ("bigint", "string", "bigint", "bigint", "bigint", "string", "boolean", "boolean", "boolean", "boolean")
VEHICLE = (("latitude", "double"), ("longitude", "double"), ("bearing", "double"), ("speed", "double"), ("current_stop_sequence", "bigint"), ("current_status", "bigint"), ("vehicle_timestamp_utc", "timestamp"))


def final_targets(predictions: DataFrame, keys: tuple[str, ...] = ("snapshot_date", "trip_id", "stop_id"), value: str = "predicted_delay_seconds") -> DataFrame:
    """The value and arrival of each key's last prediction, by one aggregate (rows with a null value don't count)."""
    causal = predictions.where(f"prediction_lead_minutes >= 0 AND {value} IS NOT NULL")
    last = F.max(F.struct("collected_at_utc", value, "predicted_arrival_utc")).alias("_last")
    return causal.groupBy(*keys).agg(last).select(*keys, F.col(f"_last.{value}").alias("delay_seconds"), F.col("_last.collected_at_utc").alias("final_collected_at_utc"), F.col("_last.predicted_arrival_utc").alias("final_predicted_arrival_utc"))


def with_final_target(predictions: DataFrame, keys: tuple[str, ...] = ("snapshot_date", "trip_id", "stop_id"), value: str = "predicted_delay_seconds") -> DataFrame:
    """Each prediction with its key's final value: a window over the history's own partitioning, no self-join."""
    last = F.max(F.when((F.col("prediction_lead_minutes") >= 0) & F.col(value).isNotNull(), F.struct("collected_at_utc", value, "predicted_arrival_utc"))).over(Window.partitionBy(*keys))
    out = predictions.withColumn("_last", last).where("_last IS NOT NULL")
    return out.withColumns({"delay_seconds": F.col(f"_last.{value}"), "final_collected_at_utc": F.col("_last.collected_at_utc"), "final_predicted_arrival_utc": F.col("_last.predicted_arrival_utc")}).drop("_last")


def vehicle_dedup(positions: DataFrame, keys: tuple[str, ...] = ("snapshot_date", "collected_at_utc", "trip_id")) -> DataFrame:
    """One vehicle row a key: least of each attribute that isn't null, newest timestamp."""
    return positions.where("trip_id IS NOT NULL").groupBy(*keys).agg(*((F.max if n == "vehicle_timestamp_utc" else F.min)(n).alias(n) for n, _ in VEHICLE))


def dimensions(static: dict[str, DataFrame], *, by_date: bool = True) -> dict[str, DataFrame]:
    """routes, trips, stops and trip lengths of the schedule, one row a key."""
    day = [F.col("p_snapshot_date").cast("date").alias("_day")] if by_date else []
    keys = ["feed_name", *(["_day"] if by_date else [])]
    take = lambda t, *c: static[t].select("feed_name", *day, *c)
    longest = take("stop_times", "trip_id", F.col("stop_sequence").try_cast("bigint").alias("s")).groupBy(*keys, "trip_id").agg(F.max("s").alias("max_stop_sequence"))
    return {
        "routes": take("routes", "route_id", "route_short_name", F.col("route_type").try_cast("bigint").alias("route_type")).dropDuplicates([*keys, "route_id"]),
        "trips": take("trips", "trip_id", "trip_headsign", (F.col("direction_id").try_cast("bigint") if "direction_id" in static["trips"].columns else F.lit(None).cast("bigint")).alias("static_direction_id")).dropDuplicates([*keys, "trip_id"]),
        "stops": take("stops", "stop_id", "stop_name", F.col("stop_lat").try_cast("double").alias("stop_lat"), F.col("stop_lon").try_cast("double").alias("stop_lon")).dropDuplicates([*keys, "stop_id"]),
        "lengths": longest,
    }


def enrich(rows: DataFrame, dims: dict[str, DataFrame], *, by_date: bool = True) -> DataFrame:
    """Left joins to the schedule's dimensions; their sizes decide how Spark joins."""
    if by_date:
        rows = rows.withColumn("_day", F.col("snapshot_date").cast("date"))
    base = ["feed_name", *(["_day"] if by_date else [])]
    for name, key in (("routes", "route_id"), ("trips", "trip_id"), ("stops", "stop_id"), ("lengths", "trip_id")):
        rows = rows.join(dims[name], [*base, key], "left")
    return rows.drop("_day")


def with_weather(rows: DataFrame, weather: DataFrame | None, location: str = "kitchener-waterloo") -> DataFrame:
    """The forecast of the scheduled hour at one location; null columns where there is no weather table."""
    if weather is None:
        return rows.withColumns({n: F.lit(None).cast(k) for n, k in zip(WEATHER, _WEATHER_KINDS)})
    hourly = weather.where(F.col("location") == location)
    if "weather_condition" not in hourly.columns:
        hourly = hourly.withColumnRenamed("condition", "weather_condition")
    hourly = hourly.select(F.col("timestamp_utc_hour").alias("_hour"), *WEATHER)
    return rows.withColumn("_hour", F.date_trunc("hour", "scheduled_arrival_utc")).join(hourly, "_hour", "left").drop("_hour")


def with_vehicles(rows: DataFrame, positions: DataFrame | None, settings: Settings = DEFAULT) -> DataFrame:
    """The trip's vehicle in the same poll: place, distance to the stop, age of the fix. Null where there is none."""
    if positions is None:
        rows = rows.withColumns({n: F.lit(None).cast(k) for n, k in VEHICLE})
    else:
        rows = rows.join(vehicle_dedup(positions), ["snapshot_date", "collected_at_utc", "trip_id"], "left")
    age = F.unix_seconds("collected_at_utc") - F.unix_seconds("vehicle_timestamp_utc")
    sequence = F.col("stop_sequence") - F.col("current_stop_sequence")
    rows = rows.withColumns(
        {
            "vehicle_update_age_seconds": age,
            "is_vehicle_update_stale": age > settings.vehicle_stale_s,
            "vehicle_distance_to_stop_m": haversine_m("latitude", "longitude", "stop_lat", "stop_lon", settings),
            "vehicle_stop_sequence_delta": sequence.cast("bigint"),
        }
    )
    for old, new in (("latitude", "vehicle_lat"), ("longitude", "vehicle_lon"), ("bearing", "vehicle_bearing"), ("speed", "vehicle_speed"), ("current_stop_sequence", "vehicle_current_stop_sequence"), ("current_status", "vehicle_current_status")):
        rows = rows.withColumnRenamed(old, new)
    return rows.drop("vehicle_timestamp_utc")


def feature_table(predictions: DataFrame, static: dict[str, DataFrame], *, positions: DataFrame | None = None, weather: DataFrame | None = None, stride_minutes: int | None = None, by_date: bool = True, targets: bool = True, settings: Settings = DEFAULT) -> DataFrame:
    """Features of every prediction (of the last in each stride, if given); predictions is a delay table with all snapshots."""
    keys = ["snapshot_date", "trip_id", "stop_id"]
    rows = predictions.where("prediction_lead_minutes >= 0").withColumnRenamed("delay_seconds", "predicted_delay_seconds")
    if targets:
        rows = with_final_target(rows, tuple(keys))
    if stride_minutes:
        rows = stride_thin(rows, stride_minutes, keys, ("stop_sequence", "feed_name"))
    rows = history_features(rows, keys, ("collected_at_utc", "stop_sequence", "feed_name"))
    rows = previous_stop(rows, ["snapshot_date", "trip_id", "collected_at_utc"], ("stop_sequence", "stop_id"))
    rows = enrich(rows, dimensions(static, by_date=by_date), by_date=by_date)
    told = F.col("direction_id").cast("bigint") if "direction_id" in rows.columns else F.lit(None).cast("bigint")
    rows = rows.withColumn("direction_id", F.coalesce(told, "static_direction_id")).drop("static_direction_id")
    rows = with_vehicles(rows, positions, settings)
    rows = with_weather(rows, weather)
    rows = rows.withColumns({**local_parts("scheduled_arrival_utc", settings), "stop_sequence_normalized": seq_normalized("stop_sequence", "feed_name", "max_stop_sequence"), "transit_mode": transit_mode("feed_name")})
    if targets:
        rows = rows.withColumn("current_prediction_error_seconds", F.col("delay_seconds") - F.col("predicted_delay_seconds"))
    return rows.withColumnRenamed("predicted_delay_seconds", "current_predicted_delay_seconds")
