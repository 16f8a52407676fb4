"""Journeys: how likely their transfers are, and which ones are worth showing.

plan() finds earliest arrivals by scanning patterns (raptor.py). earliest_arrivals() does the same over a table of rides, in rounds of
joins, for schedules where any ride is given by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.columns import make_rate_estimate
from ..operators.joins import nearest_k
from ..sources.shared import written
from . import raptor


def connections(stop_times: DataFrame) -> DataFrame:
    """Every ride from one stop of a trip to a later one: trip_id, route_id, from_stop, depart, to_stop, arrive (seconds).

    stop_times: trip_id, route_id, stop_id, stop_sequence, seconds. Rows grow with the square of a trip's stops, as any pair of them is a ride.
    """
    a = stop_times.select("trip_id", "route_id", F.col("stop_id").alias("from_stop"), F.col("seconds").alias("depart"), F.col("stop_sequence").alias("_i"))
    b = stop_times.select("trip_id", F.col("stop_id").alias("to_stop"), F.col("seconds").alias("arrive"), F.col("stop_sequence").alias("_j"))
    return a.join(b, "trip_id").where("_j > _i").drop("_i", "_j")


def earliest_arrivals(origins: DataFrame, rides: DataFrame, walks: DataFrame | None = None, *, rounds: int | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """query_id, stop_id, round, arrive, legs: the earliest arrival with at most that many rides, where another ride makes it earlier.

    origins: query_id, stop_id, ready (seconds; several stops a query are fine). walks: from_stop, to_stop, seconds (both ways are used).
    Legs are (trip_id or null for a walk, from_stop, to_stop, depart, arrive). After the first ride boarding needs settings.planner_slack_s;
    trips that overtake each other are all looked at.
    """
    leg = "struct<trip_id:string,from_stop:string,to_stop:string,depart:bigint,arrive:bigint>"
    best = origins.select("query_id", F.col("stop_id").cast("string").alias("stop_id"), F.lit(0).alias("round"), F.col("ready").cast("bigint").alias("arrive"), F.array().cast(f"array<{leg}>").alias("legs"))
    ride = rides.select(F.col("trip_id").cast("string").alias("trip_id"), F.col("from_stop").cast("string").alias("from_stop"), F.col("depart").cast("bigint").alias("depart"), F.col("to_stop").cast("string").alias("to_stop"), F.col("arrive").cast("bigint").alias("ride_arrive"))
    walk = None
    if walks is not None:
        once = walks.select(F.col("from_stop").cast("string").alias("from_stop"), F.col("to_stop").cast("string").alias("to_stop"), F.col("seconds").cast("bigint").alias("seconds"))
        walk = once.unionByName(once.select(F.col("to_stop").alias("from_stop"), F.col("from_stop").alias("to_stop"), "seconds"))
    first = Window.partitionBy("query_id", "stop_id").orderBy("arrive", F.size("legs"), F.to_json("legs"))
    earliest = lambda rows: rows.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    best = written(best)
    every, now = best, best
    for k in range(1, (rounds or settings.planner_rounds) + 1):
        slack = 0 if k == 1 else settings.planner_slack_s
        board = now.withColumnRenamed("stop_id", "from_stop").join(ride, "from_stop").where(F.col("depart") >= F.col("arrive") + slack)
        new = F.struct("trip_id", "from_stop", "to_stop", "depart", F.col("ride_arrive").alias("arrive")).cast(leg)
        step = earliest(board.select("query_id", F.col("to_stop").alias("stop_id"), F.lit(k).alias("round"), F.col("ride_arrive").alias("arrive"), F.concat("legs", F.array(new)).alias("legs")))
        if walk is not None:
            on_foot = step.withColumnRenamed("stop_id", "from_stop").join(walk, "from_stop")
            new = F.struct(F.lit(None).cast("string").alias("trip_id"), "from_stop", "to_stop", F.col("arrive").alias("depart"), (F.col("arrive") + F.col("seconds")).alias("arrive")).cast(leg)
            step = earliest(step.unionByName(on_foot.select("query_id", F.col("to_stop").alias("stop_id"), "round", (F.col("arrive") + F.col("seconds")).alias("arrive"), F.concat("legs", F.array(new)).alias("legs"))))
        known = every.groupBy("query_id", "stop_id").agg(F.min("arrive").alias("_best"))
        now = written(step.join(known, ["query_id", "stop_id"], "left").where("_best IS NULL OR arrive < _best").drop("_best"))
        every = every.unionByName(now)
    return every


def score(itineraries: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """success (product over transfers) and score (p90 arrival and the penalty of missing).

    itineraries: arrive_p90 and transfers, an array of (observed_rate or null, slack_s, median_delay_s). An observed rate comes before the estimate.
    """
    rate = lambda t: F.coalesce(t["observed_rate"], make_rate_estimate(t["slack_s"], t["median_delay_s"]))
    success = F.aggregate("transfers", F.lit(1.0), lambda acc, t: acc * rate(t))
    return itineraries.withColumn("success", success).withColumn("score", F.col("arrive_p90") + (1.0 - F.col("success")) * settings.planner_missed_penalty_s)


def choose(itineraries: DataFrame, *, most: int = 4, gain_s: int = 30) -> DataFrame:
    """Each query's best itineraries: every further ride must arrive gain_s earlier; alike ones (same leg_key) once; the best scores first."""
    fewer = Window.partitionBy("query_id").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    worth = itineraries.withColumn("_before", F.min("arrive").over(fewer)).where(F.col("_before").isNull() | (F.col("arrive") <= F.col("_before") - gain_s)).drop("_before")
    alike = Window.partitionBy("query_id", "leg_key").orderBy("score", "arrive")
    ranked = Window.partitionBy("query_id").orderBy("score", "arrive", "leg_key")
    once = worth.withColumn("_rn", F.row_number().over(alike)).where("_rn = 1").drop("_rn")
    return once.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= most)


def nearest_stops(points: DataFrame, stops: DataFrame, *, most: int = 6, settings: Settings = DEFAULT) -> DataFrame:
    """query_id, stop_id, walk_s: the `most` nearest stops in reach of each point (query_id, lat, lon). stops: stop_id, stop_lat, stop_lon."""
    places = stops.select("stop_id", F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon"))
    near = nearest_k(points, places, most, within_m=settings.planner_access_m, first_m=settings.planner_access_m, settings=settings)
    return near.select("query_id", "stop_id", F.rint(F.col("distance_m") / settings.footpath_speed_mps).cast("bigint").alias("walk_s"))


def improving(rounds: DataFrame, gain_s: int = 30) -> DataFrame:
    """Of each query's rows (query_id, round, arrive, ...; a row a round), those that arrive more than gain_s before the last one kept."""
    rest = [c for c in rounds.columns if c != "query_id"]
    packed = rounds.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("round", F.struct(*rest).alias("row")))).alias("_rows"))  # a row a round
    kind = packed.schema["_rows"].dataType.simpleString()
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast(kind).alias("kept"))

    def step(acc, x):
        better = acc["last"].isNull() | (x["row"]["arrive"] < acc["last"] - gain_s)
        return F.struct(F.when(better, x["row"]["arrive"]).otherwise(acc["last"]).alias("last"), F.when(better, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"))

    return packed.select("query_id", F.explode(F.aggregate("_rows", start, step)["kept"]).alias("_x")).select("query_id", "_x.row.*")


def itineraries(found: DataFrame, targets: DataFrame, routes: DataFrame, hours: DataFrame, rates: DataFrame, settings: Settings = DEFAULT, *, live: DataFrame | None = None, clock: DataFrame | None = None) -> DataFrame:
    """What earliest_arrivals found, as scored itineraries to the targets (query_id, stop_id, walk_s), one for each round that is worth it.

    routes: trip_id, route_id. hours: route_id, hour_of_day, median_s, p90_s (an hour that lacks has the route's mean; a route that
    lacks 60 and 240). rates: transfer (from_route|to_route|stop left at), success_rate. live: route_id, live_delay_s (a row a route) and clock:
    query_id, now (seconds); a ride that starts within settings.planner_live_s of now on a route that is later than is usual is taken to be as late.
    """
    ends = found.where("round > 0").join(targets, ["query_id", "stop_id"])
    total = F.col("arrive") + F.col("walk_s")
    best = ends.groupBy("query_id", "round").agg(F.min_by(F.struct(total.alias("arrive"), "stop_id", "walk_s", "legs"), F.struct(total, "stop_id")).alias("_e"))
    kept = improving(best.select("query_id", "round", "_e.*"))
    rides = kept.select("query_id", "round", F.posexplode(F.filter("legs", lambda x: x["trip_id"].isNotNull())).alias("_i", "_leg"))
    rides = rides.withColumn("trip_id", F.col("_leg.trip_id")).join(routes.select(F.col("trip_id").cast("string").alias("trip_id"), "route_id"), "trip_id")
    rides = rides.withColumn("hour_of_day", F.floor(F.col("_leg.depart") % 86400 / 3600).cast("int"))
    means = hours.groupBy("route_id").agg(F.rint(F.avg("median_s")).alias("_median"), F.rint(F.avg("p90_s")).alias("_p90"))
    rides = rides.join(hours.select("route_id", F.col("hour_of_day").cast("int").alias("hour_of_day"), "median_s", "p90_s"), ["route_id", "hour_of_day"], "left").join(means, "route_id", "left")
    rides = rides.withColumns({"median_s": F.coalesce(F.col("median_s").cast("double"), "_median", F.lit(60.0)), "p90_s": F.coalesce(F.col("p90_s").cast("double"), "_p90", F.lit(240.0))})
    if live is not None and clock is not None:
        now = live.select("route_id", F.rint(F.col("live_delay_s")).alias("_live"))
        rides = rides.join(now, "route_id", "left").join(clock.select("query_id", F.col("now").alias("_now")), "query_id", "left")
        rides = rides.withColumn("_live", F.when(F.col("_leg.depart") - F.col("_now") < settings.planner_live_s, F.col("_live"))).drop("_now")
    else:
        rides = rides.withColumn("_live", F.lit(None).cast("double"))
    rides = rides.withColumn("_late", F.greatest("median_s", "_live"))  # nulls don't count
    before = Window.partitionBy("query_id", "round").orderBy("_i")
    rides = rides.withColumns({c: F.lag(x).over(before) for c, x in (("_from", "route_id"), ("_left", "_leg.to_stop"), ("_at", "_leg.arrive"), ("_wait", "_late"))})
    rides = rides.withColumn("transfer", F.when(F.col("_from").isNotNull(), F.concat_ws("|", F.col("_from").cast("string"), F.col("route_id").cast("string"), "_left"))).join(rates, "transfer", "left")
    one = F.struct("_i", F.col("route_id").cast("string").alias("route_id"), F.col("_leg.depart").alias("depart"), "_late", "p90_s", F.struct(F.col("success_rate").alias("observed_rate"), (F.col("_leg.depart") - F.col("_at")).cast("double").alias("slack_s"), F.col("_wait").alias("median_delay_s")).alias("transfer"))
    taken = rides.groupBy("query_id", "round").agg(F.array_sort(F.collect_list(one)).alias("_rides"))  # a ride a round at most
    out = kept.join(taken, ["query_id", "round"])
    last = F.element_at("_rides", -1)
    return score(
        out.select(
            "query_id", "round", "arrive", "stop_id", "walk_s", "legs", F.col("_rides")[0]["depart"].alias("first_board"), (F.col("arrive") + last["_late"]).alias("arrive_expected"), (F.col("arrive") + last["p90_s"]).alias("arrive_p90"),
            F.transform(F.slice("_rides", 2, settings.planner_rounds), lambda x: x["transfer"]).alias("transfers"), F.array_join(F.transform("_rides", lambda x: F.concat_ws("@", x["route_id"], x["depart"].cast("string"))), ">").alias("leg_key"),
        ),
        settings,
    )


def plan(queries: DataFrame, stops: DataFrame, times: DataFrame, walks: DataFrame | None, hours: DataFrame, rates: DataFrame, *, live: DataFrame | None = None, most: int = 4, settings: Settings = DEFAULT) -> DataFrame:
    """Each query's best itineraries from place to place (query_id, place, score, ...): none for a query without stops in reach of both ends.

    queries: query_id, from_lat, from_lon, to_lat, to_lon, depart (seconds). times: see connections. live: see itineraries; it counts where queries have `now`. A second run starts a minute after
    the first one's first ride, for the departure after; itineraries of the same rides count once.
    """
    ends = {k: nearest_stops(queries.select("query_id", F.col(f"{k}_lat").alias("lat"), F.col(f"{k}_lon").alias("lon")), stops, settings=settings) for k in ("from", "to")}
    sources, targets = written(ends["from"]), written(ends["to"].withColumn("stop_id", F.col("stop_id").cast("string")))
    lines, routes = raptor.lines(times), times.select("trip_id", "route_id").distinct()
    goals = targets.select("query_id", "stop_id", "walk_s")
    clock = queries.select("query_id", "now") if "now" in queries.columns else None

    def run(departs: DataFrame, k: int) -> DataFrame:
        origins = sources.join(departs, "query_id").select("query_id", "stop_id", (F.col("depart") + F.col("walk_s")).alias("ready"))
        return written(itineraries(raptor.arrivals(origins, lines, walks, targets=goals, settings=settings), targets, routes, hours, rates, settings, live=live, clock=clock).withColumn("run", F.lit(k)))

    first = run(queries.select("query_id", "depart"), 1)
    second = run(first.groupBy("query_id").agg((F.min_by("first_board", "round") + 60).alias("depart")), 2)
    alike = Window.partitionBy("query_id", "leg_key").orderBy("run", "round")
    ranked = Window.partitionBy("query_id").orderBy("score", "run", "round")
    once = first.unionByName(second).withColumn("_n", F.row_number().over(alike)).where("_n = 1").drop("_n")
    return once.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= most)
