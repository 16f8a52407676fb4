"""Transfers: which connections a rider could make."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..operators import quantiles as Q
from ..operators.joins import grid_band_join, interval_join
from ..operators.windows import latest_per_key
from ..sources.shared import written


def stop_pairs(stops: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Stops (stop_id, feed_name, stop_lat, stop_lon) within walking distance, with the walk's length and time; a stop is its own pair."""
    near = grid_band_join(stops.select("stop_id", "feed_name", "stop_lat", "stop_lon").distinct(), settings.transfer_walk_m, lat="stop_lat", lon="stop_lon", settings=settings)
    walk = F.greatest(F.lit(settings.transfer_min_walk_s), F.col("distance_m") / settings.walk_speed_mps)
    return near.select(
        F.col("a_stop_id").alias("from_stop_id"), F.col("a_feed_name").alias("from_feed"), F.col("b_stop_id").alias("to_stop_id"), F.col("b_feed_name").alias("to_feed"), F.col("distance_m").alias("walk_distance_m"), walk.alias("walk_seconds")
    )


def candidates(observed: DataFrame, pairs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Arrivals with every departure of another route, from a stop in reach, that the schedule lets a rider catch within the longest wait.

    observed: snapshot_date, trip_id, route_id, direction_id, stop_id, feed_name, scheduled_s and actual_s (long epoch seconds).
    """
    side = lambda p: observed.select("snapshot_date", *(F.col(c).alias(f"{p}_{c}") for c in ("trip_id", "route_id", "direction_id", "stop_id", "feed_name", "scheduled_s", "actual_s")))
    arrivals = side("from").join(pairs.withColumnRenamed("from_feed", "from_feed_name").withColumnRenamed("to_feed", "to_feed_name"), ["from_stop_id", "from_feed_name"])
    low = F.ceil(F.col("from_scheduled_s") + F.col("walk_seconds")).cast("bigint")
    high = (F.col("from_scheduled_s") + F.lit(int(settings.transfer_wait_s))).cast("bigint")
    joined = interval_join(arrivals, side("to"), ["snapshot_date", "to_stop_id", "to_feed_name"], low, high, "to_scheduled_s", int(settings.transfer_wait_s))
    return joined.where("from_route_id <> to_route_id")


def proposed(rows: DataFrame) -> DataFrame:
    """The first connection to each route and direction after each arrival, with its outcome."""
    first = latest_per_key(rows, ["snapshot_date", "from_trip_id", "from_stop_id", "to_route_id", "to_direction_id"], [F.col("to_scheduled_s").asc_nulls_last(), F.col("walk_seconds").asc_nulls_last(), F.col("to_trip_id"), F.col("to_stop_id")])
    return _outcome(first)


def _outcome(rows: DataFrame) -> DataFrame:
    margin = F.col("to_actual_s") - F.col("from_actual_s") - F.col("walk_seconds")
    return rows.withColumns({"scheduled_wait_seconds": F.col("to_scheduled_s") - F.col("from_scheduled_s"), "actual_margin_seconds": margin, "made_transfer": margin >= 0})


def connections(observed: DataFrame, pairs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """What proposed(candidates(observed, pairs)) gives, without the candidates, whose number grows with the square of the arrivals.

    Arrivals of one stop and second ask once, and of the departures of a route, direction and second only the first counts. In slices of
    time as long as the longest wait, questions and departures are one sorted line each route and direction, on which a question finds
    the departure that follows. So there are as many rows as questions (two slices each) times routes, whatever departs meanwhile.
    """
    wait = int(settings.transfer_wait_s)
    side = lambda p: observed.select("snapshot_date", *(F.col(c).alias(f"{p}_{c}") for c in ("trip_id", "route_id", "direction_id", "stop_id", "feed_name", "scheduled_s", "actual_s")))
    place, line = ["snapshot_date", "to_stop_id", "to_feed_name", "_bucket"], ["to_route_id", "to_direction_id"]
    came = ["snapshot_date", "from_stop_id", "from_feed_name", "from_scheduled_s"]
    slice_of = lambda x: F.floor(x / F.lit(wait)).cast("bigint")
    departures = side("to").where("to_route_id IS NOT NULL AND to_scheduled_s IS NOT NULL").withColumn("_bucket", slice_of(F.col("to_scheduled_s")))
    departures = departures.groupBy(*place, *line, "to_scheduled_s").agg(F.min(F.struct("to_trip_id", "to_actual_s")).alias("_first"))
    asked = side("from").select(*came).distinct().join(pairs.withColumnRenamed("from_feed", "from_feed_name").withColumnRenamed("to_feed", "to_feed_name"), ["from_stop_id", "from_feed_name"])
    asked = asked.withColumns({"_low": F.ceil(F.col("from_scheduled_s") + F.col("walk_seconds")).cast("bigint"), "_high": (F.col("from_scheduled_s") + F.lit(wait)).cast("bigint")}).where("_low <= _high")
    asked = asked.withColumn("_bucket", F.explode(F.sequence(slice_of(F.col("_low")), slice_of(F.col("_high"))))).join(departures.select(*place, *line).distinct(), place)
    question = F.struct("from_stop_id", "from_feed_name", "from_scheduled_s", "walk_distance_m", "walk_seconds", "_high").alias("_asked")
    departs = F.struct("to_scheduled_s", "_first.to_trip_id", "_first.to_actual_s").alias("_departs")
    both = asked.select(*place, *line, F.col("_low").alias("_at"), question).unionByName(departures.select(*place, *line, F.col("to_scheduled_s").alias("_at"), departs), allowMissingColumns=True)
    backwards = Window.partitionBy(*place, *line).orderBy(F.desc("_at"), F.col("_asked").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_next", F.last("_departs", ignorenulls=True).over(backwards)).where("_asked IS NOT NULL AND _next.to_scheduled_s <= _asked._high")
    first = F.min(F.struct("_next.to_scheduled_s", "_asked.walk_seconds", "_next.to_trip_id", "to_stop_id", "to_feed_name", "_next.to_actual_s", "_asked.walk_distance_m")).alias("_to")
    answers = found.select("snapshot_date", "_asked.from_stop_id", "_asked.from_feed_name", "_asked.from_scheduled_s", *line, "to_stop_id", "to_feed_name", "_next", "_asked").repartition(*came).groupBy(*came, *line).agg(first)
    # a trip that comes to a stop once has one row a route and direction; only others must be compared
    arrivals = side("from").withColumn("_alone", F.count("*").over(Window.partitionBy("snapshot_date", "from_trip_id", "from_stop_id")) == 1)
    told = lambda mine: mine.drop("_alone").join(answers, came).where("from_route_id <> to_route_id").select("*", "_to.*").drop("_to")
    return proposed(told(arrivals.where("NOT _alone"))).unionByName(_outcome(told(arrivals.where("_alone"))))


def summary(events: DataFrame, by: tuple[str, ...], least: int = DEFAULT.transfer_min_rows) -> DataFrame:
    """The outcome of each group's connections. They are counted by day and margin once (written); the rest is from these counts, so no task holds a group's margins."""
    margin = "actual_margin_seconds"
    counts = written(events.groupBy(*by, "snapshot_date", margin).agg(F.count("*").alias("_n"), F.sum(F.when(F.col("made_transfer"), 1).otherwise(0)).alias("_made")), "transfer-counts")
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("attempts"), F.sum("_made").alias("made"), F.countDistinct("snapshot_date").alias("service_days")).where(F.col("attempts") >= least)
    found = Q.percentiles(Q.merge_counts(counts.where(F.col(margin).isNotNull()), by, margin, "_n"), by, margin, {"median_margin_seconds": 0.5, "p10_margin_seconds": 0.1}, n="_n")
    out = totals.withColumn("_key", Q.key_of(by)).join(found, "_key", "left")
    return out.select(*by, "attempts", "made", (F.col("made").cast("double") / F.col("attempts")).alias("success_rate"), "median_margin_seconds", "p10_margin_seconds", "service_days")
