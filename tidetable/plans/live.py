"""Live scoring helpers: summaries of one cycle's predictions and feed freshness."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..operators.windows import latest_per_key


def route_summary(scored: DataFrame, settings: Settings = DEFAULT, feed: str = "feed_delay_seconds") -> DataFrame:
    p = F.col("predicted_delay_seconds")
    return scored.groupBy("route_id").agg(
        F.count("*").alias("arrivals"), F.countDistinct("trip_id").alias("trips"), F.avg(p).alias("mean_predicted"), F.max(p).alias("max_predicted"), F.avg(feed).alias("mean_feed"), F.count_if(p > settings.late_above_s).alias("late")
    )


def next_stops(scored: DataFrame, tie: str = "stop_sequence") -> DataFrame:
    """Each trip's arrival that comes first."""
    return latest_per_key(scored.where("prediction_lead_minutes >= 0"), ["trip_id"], [F.col("prediction_lead_minutes"), F.col(tie)])


def newest_snapshot(rows: DataFrame, ts: str = "collected_at_utc") -> DataFrame:
    """Only the rows of the newest poll."""
    newest = rows.agg(F.max(ts).alias("_newest"))  # one row
    return rows.join(F.broadcast(newest), rows[ts] == newest["_newest"]).drop("_newest")


def newest_of(rows: DataFrame, ts: str, keys: tuple[str, ...]) -> DataFrame:
    """The rows of each key's newest ts (a feed's newest schedule, say)."""
    newest = rows.groupBy(*keys).agg(F.max(ts).alias(ts))
    return rows.join(newest, [*keys, ts], "left_semi")


def freshness(updates: DataFrame, now: DataFrame, limit_minutes: Column) -> DataFrame:
    """Age of each feed's newest object against its limit. now: one row, `now`."""
    newest = updates.groupBy("feed").agg(F.max("updated").alias("newest")).crossJoin(F.broadcast(now))  # now: one row
    age = (F.unix_micros("now") - F.unix_micros("newest")).cast("double") / 60e6
    return newest.select("feed", age.alias("age_minutes"), (age <= limit_minutes).alias("is_fresh"))


def live_vehicles(positions: DataFrame, routes: DataFrame, trips: DataFrame) -> DataFrame:
    """The newest position of each vehicle (told by its id, or its entity's) that has a place and a route, with its route's short name
    and its trip's headsign and direction where they are known.

    routes: feed_name, route_id, route_short_name. trips: feed_name, trip_id, trip_headsign, direction_id. Both may repeat over dates.
    """
    placed = positions.where("latitude IS NOT NULL AND longitude IS NOT NULL AND route_id IS NOT NULL AND CAST(route_id AS string) <> ''")
    named = placed.withColumn("_vehicle", F.coalesce(F.col("vehicle_id").cast("string"), F.col("entity_id").cast("string")))
    last = latest_per_key(named, ["_vehicle"], [F.col("vehicle_timestamp_utc").desc_nulls_last(), F.col("collected_at_utc").desc(), F.col("entity_id")])
    short = routes.groupBy("feed_name", "route_id").agg(F.min("route_short_name").alias("_short"))
    sign = trips.groupBy("feed_name", "trip_id").agg(F.min(F.struct("trip_headsign", F.col("direction_id").try_cast("bigint").alias("direction_id"))).alias("_trip"))
    met = last.join(short, ["feed_name", "route_id"], "left").join(sign, ["feed_name", "trip_id"], "left")
    return met.select(
        "feed_name", "route_id", F.coalesce("_short", F.col("route_id").cast("string")).alias("route_short_name"), "trip_id", F.coalesce("direction_id", "_trip.direction_id").alias("direction_id"), F.col("_trip.trip_headsign").alias("trip_headsign"),
        F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "vehicle_timestamp_utc", F.col("_vehicle").alias("vehicle"),
    )


def markers(vehicles: DataFrame, scored: DataFrame, now: Column, digits: int = 6) -> DataFrame:
    """A row of JSON for each live vehicle, with its trip's next stop and prediction where that was scored."""
    ahead = next_stops(scored).select("trip_id", F.col("stop_id").alias("next_stop_id"), F.round("predicted_delay_seconds").alias("predicted_delay_seconds"))
    age = F.greatest(F.unix_seconds(now) - F.unix_seconds("vehicle_timestamp_utc"), F.lit(0))
    rows = vehicles.join(ahead, "trip_id", "left").select(
        "route_id", "route_short_name", "trip_headsign", "direction_id", F.round("lat", digits).alias("lat"), F.round("lon", digits).alias("lon"), F.when(F.col("vehicle_timestamp_utc").isNotNull(), age).alias("position_age_seconds"), "next_stop_id", "predicted_delay_seconds"
    )
    return rows.select("route_id", "trip_headsign", F.to_json(F.struct("*")).alias("json"))


def cycle(updates: DataFrame, score: Callable[[DataFrame], DataFrame], positions: DataFrame, routes: DataFrame, trips: DataFrame, now: Column, *, features: Callable[[DataFrame], DataFrame] | None = None, window_minutes: int = 60, settings: Settings = DEFAULT) -> dict[str, DataFrame]:
    """One live cycle: the updates of the rolling window, those of its newest poll scored, and what a client is told.

    features: from the window's rows to inputs (lags need the window); only the newest poll's rows of these go to score, which adds
    predicted_delay_seconds. Without features, score gets the window. Returns scored, summary (by route), vehicles, markers.
    """
    recent = updates.where(F.unix_seconds("collected_at_utc") > F.unix_seconds(now) - window_minutes * 60)
    scored = score(newest_snapshot(features(recent))) if features else newest_snapshot(score(recent))
    where = live_vehicles(newest_snapshot(positions), routes, trips)
    return {"scored": scored, "summary": route_summary(scored, settings) if "feed_delay_seconds" in scored.columns else route_summary(scored, settings, "current_predicted_delay_seconds"), "vehicles": where, "markers": markers(where, scored, now)}


def worst_arrivals(scored: DataFrame, n: int = 40, tie: str = "stop_id", predicted: str = "predicted_delay_seconds") -> DataFrame:
    """The n scored arrivals of greatest predicted delay."""
    return scored.orderBy(F.desc_nulls_last(predicted), tie).limit(n)


def document(found: dict[str, DataFrame], now: Column, *, most: int = 40, quantiles: tuple[float, float] | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """One row of JSON of a cycle: when, limits, totals, each route, each vehicle's marker, the worst arrivals. A client loads it whole, so it is one city's few hundred rows."""
    scored = found["scored"]
    totals = scored.agg(F.struct(F.count("*").alias("stopArrivals"), F.countDistinct("trip_id").alias("trips"), F.countDistinct("route_id").alias("routes")).alias("totals"))
    names = [c for c in ("trip_id", "route_id", "stop_id", "prediction_lead_minutes", "predicted_delay_seconds", "predicted_delay_lower_seconds", "predicted_delay_upper_seconds") if c in scored.columns]
    listed = lambda df, order, name: df.select(F.struct(*order, F.struct(*df.columns).alias("row")).alias("_x")).agg(F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["row"]).alias(name))
    routes = listed(found["summary"], ["route_id"], "routes")
    vehicles = found["markers"].agg(F.array_sort(F.collect_list("json")).alias("vehicles"))
    worst = listed(worst_arrivals(scored.select(*names), most), [(-F.col("predicted_delay_seconds")).alias("d"), "stop_id"], "worstArrivals")
    one = totals.crossJoin(routes).crossJoin(vehicles).crossJoin(worst)  # one row each
    head = [F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generatedAtUtc"), F.lit(settings.late_above_s).alias("lateThresholdSeconds"), *([F.array(*map(F.lit, quantiles)).alias("intervalQuantiles")] if quantiles else [])]
    whole = one.select(F.to_json(F.struct(*head, "totals", "routes", "worstArrivals")).alias("json"), F.array_join("vehicles", ",").alias("_v"))
    return whole.select(F.concat(F.expr("substring(json, 1, length(json) - 1)"), F.lit(',"vehicles":['), "_v", F.lit("]}")).alias("json"))


def health(updates: DataFrame, expected: DataFrame, now: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Each expected feed against the limit of its kind: feed, kind, age_minutes, is_fresh (false where it has no object).

    updates: feed, updated. expected: feed, kind (a key of freshness_minutes). now: one row, `now`.
    """
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in settings.freshness_minutes.items() for x in kv]), F.col("kind"))
    told = expected.join(updates.select("feed", "updated"), "feed", "left").groupBy("feed", "kind").agg(F.max("updated").alias("newest")).crossJoin(F.broadcast(now))  # now: one row
    age = (F.unix_micros("now") - F.unix_micros("newest")).cast("double") / 60e6
    return told.select("feed", "kind", age.alias("age_minutes"), F.coalesce(age <= limit, F.lit(False)).alias("is_fresh"))
