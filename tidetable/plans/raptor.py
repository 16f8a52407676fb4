"""Earliest arrivals by scanning patterns in rounds.

A line is a set of trips with the same stops in the same order that never overtake each other, so at each of its stops the earliest
trip that can still be boarded is found by binary search, and an earlier trip is never worse further on. A round looks only at lines
through stops that the round before improved, and scans each such line once, from the first of these stops on. All queries go
through the rounds together; a line's queries are dealt out by a hash, so that a busy line is no single task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..sources.shared import written

#: Queries a task has of a line at most, about.
QUERIES = 4096
LEG = "struct<trip_id:string,from_stop:string,to_stop:string,depart:bigint,arrive:bigint>"


def _fifo(group: pa.Table) -> pa.Table:
    """The trips of a pattern as lines without overtaking: each goes to the first line whose last trip is nowhere later."""
    times = np.array(group["times"].to_pylist(), np.int64)
    order = np.lexsort((np.array(group["trip_id"].to_pylist(), object).astype(str), *times.T[::-1]))
    lines: list[list[int]] = []
    for i in order.tolist():
        for line in lines:
            if (times[line[-1]] <= times[i]).all():
                line.append(i)
                break
        else:
            lines.append([i])
    trips = group["trip_id"].to_pylist()
    stops = group["stops"][0].as_py()
    return pa.table(
        {
            "stops": pa.array([stops] * len(lines), pa.list_(pa.string())),
            "trips": pa.array([[trips[i] for i in line] for line in lines], pa.list_(pa.string())),
            "times": pa.array([times[line].reshape(-1).tolist() for line in lines], pa.list_(pa.int64())),
        }
    )


def lines(times: DataFrame) -> DataFrame:
    """line, stops, trips (in order), times (trips x stops, flat) of a schedule day: trip_id, stop_id, stop_sequence, seconds.

    Trips with the same stops are a pattern; what a pattern holds is one day's trips of a route variant. Trips of one stop are left out.
    The lines are written, as every round reads them.
    """
    cell = F.struct(F.col("stop_sequence").alias("i"), F.col("stop_id").cast("string").alias("stop"), F.col("seconds").cast("bigint").alias("at"))
    trips = times.where("stop_id IS NOT NULL AND seconds IS NOT NULL").groupBy(F.col("trip_id").cast("string").alias("trip_id")).agg(F.array_sort(F.collect_list(cell)).alias("_c"))  # one trip's stops
    trips = trips.where(F.size("_c") >= 2).select("trip_id", F.transform("_c", lambda x: x["stop"]).alias("stops"), F.transform("_c", lambda x: x["at"]).alias("times"))
    found = trips.groupBy("stops").applyInArrow(_fifo, "stops array<string>, trips array<string>, times array<bigint>")
    return written(found.withColumn("line", F.xxhash64("stops", "trips")), "lines")


def scan(stops: int, times: np.ndarray, query: np.ndarray, position: np.ndarray, ready: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rides of a line (times: trips x stops): for rows (query, place in the line, ready) the query, place, trip and boarding place of each arrival.

    A query boards the earliest trip it can reach at any place before; among equal ones the first place.
    """
    queries, row = np.unique(query, return_inverse=True)
    trips = len(times)
    first = np.full((len(queries), stops), trips)
    for p in np.unique(position).tolist():
        mine = position == p
        np.minimum.at(first[:, p], row[mine], np.searchsorted(times[:, p], ready[mine], "left"))
    # the trip on board after each place, and where it was boarded
    aboard = np.minimum.accumulate(first, axis=1)
    new = np.ones_like(first, bool)
    new[:, 1:] = aboard[:, 1:] < aboard[:, :-1]
    boarded = np.maximum.accumulate(np.where(new, np.arange(stops), 0), axis=1)
    q, at = np.nonzero(aboard[:, :-1] < trips)
    return queries[q], at + 1, aboard[q, at], boarded[q, at]


def _rides(left: pa.Table, right: pa.Table) -> pa.Table:
    """left: query_id, position, ready of one line; right: the line (one row)."""
    names, stops = right["trips"][0].as_py() if right.num_rows else [], right["stops"][0].as_py() if right.num_rows else []
    if not left.num_rows or not names:
        return pa.table({"query_id": pa.array([], left.schema.field("query_id").type), **{c: pa.array([], t) for c, t in (("stop_id", pa.string()), ("arrive", pa.int64()), ("trip_id", pa.string()), ("from_stop", pa.string()), ("depart", pa.int64()))}})
    times = np.array(right["times"][0].as_py(), np.int64).reshape(len(names), len(stops))
    ids = left["query_id"].combine_chunks().dictionary_encode()
    query, place, trip, boarded = scan(len(stops), times, ids.indices.to_numpy(), left["position"].to_numpy(), left["ready"].to_numpy())
    stop = pa.array(stops, pa.string())
    return pa.table({"query_id": ids.dictionary.take(pa.array(query)), "stop_id": stop.take(pa.array(place)), "arrive": pa.array(times[trip, place]), "trip_id": pa.array(names, pa.string()).take(pa.array(trip)), "from_stop": stop.take(pa.array(boarded)), "depart": pa.array(times[trip, boarded])})


def arrivals(origins: DataFrame, day: DataFrame, walks: DataFrame | None = None, *, targets: DataFrame | None = None, rounds: int | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """query_id, stop_id, round, arrive, legs: the earliest arrival with at most that many rides, where another ride makes it earlier.

    origins: query_id, stop_id, ready (seconds; several stops a query are fine). day: from lines(). walks: from_stop, to_stop, seconds (both ways
    are used). After the first ride boarding needs settings.planner_slack_s. targets (query_id, stop_id, and walk_s if given): what is no
    earlier than the query's best arrival at its targets so far is given up. Legs are (trip_id or null for a walk, from_stop, to_stop, depart,
    arrive). Rounds are written; none is planned if the one before changed nothing. Empty inputs give the origins alone.
    """
    parts = max(1, math.ceil(origins.select("query_id").distinct().count() / QUERIES))
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part")  # as dealt has it: cogroup hashes an int and a long differently
    through = day.select("line", F.size("stops").alias("_n"), F.posexplode("stops").alias("position", "stop_id")).where("position < _n - 1").drop("_n")
    through = written(through, "stops-of-lines")
    dealt = day.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    walk = None
    if walks is not None:
        once = walks.select(F.col("from_stop").cast("string").alias("from_stop"), F.col("to_stop").cast("string").alias("to_stop"), F.col("seconds").cast("bigint").alias("seconds"))
        walk = once.unionByName(once.select(F.col("to_stop").alias("from_stop"), F.col("from_stop").alias("to_stop"), "seconds"))
    first = Window.partitionBy("query_id", "stop_id").orderBy("arrive", F.size("legs"), F.to_json("legs"))
    earliest = lambda rows: rows.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    start = origins.select("query_id", F.col("stop_id").cast("string").alias("stop_id"), F.lit(0).alias("round"), F.col("ready").cast("bigint").alias("arrive"), F.array().cast(f"array<{LEG}>").alias("legs"))
    kind = start.schema["query_id"].dataType.simpleString()
    every = now = written(earliest(start), "round")
    ends = None
    if targets is not None:
        on = F.col("walk_s").cast("bigint") if "walk_s" in targets.columns else F.lit(0).cast("bigint")
        ends = targets.select("query_id", F.col("stop_id").cast("string").alias("stop_id"), on.alias("_walk"))
    for k in range(1, (rounds or settings.planner_rounds) + 1):
        slack = 0 if k == 1 else settings.planner_slack_s
        touched = now.join(through, "stop_id").select("line", part, "query_id", "position", (F.col("arrive") + slack).alias("ready"))
        ridden = touched.groupBy("line", "part").cogroup(dealt.groupBy("line", "part")).applyInArrow(_rides, f"query_id {kind}, stop_id string, arrive bigint, trip_id string, from_stop string, depart bigint")
        known = every.groupBy("query_id", "stop_id").agg(F.min("arrive").alias("_best"))
        best = F.min(F.struct("arrive", "trip_id", "from_stop", "depart")).alias("_b")
        step = ridden.groupBy("query_id", "stop_id").agg(best).select("query_id", "stop_id", "_b.*")
        limit = None
        if ends is not None:
            limit = written(every.where("round > 0").join(ends, ["query_id", "stop_id"]).groupBy("query_id").agg(F.min(F.col("arrive") + F.col("_walk")).alias("_limit")), "limits")
        prune = (lambda rows: rows.join(limit, "query_id", "left").where("_limit IS NULL OR arrive < _limit").drop("_limit")) if limit is not None else (lambda rows: rows)
        step = prune(step.join(known, ["query_id", "stop_id"], "left"))
        before = now.select("query_id", F.col("stop_id").alias("from_stop"), F.col("legs").alias("_legs"))
        new = F.struct("trip_id", "from_stop", F.col("stop_id").alias("to_stop"), "depart", "arrive").cast(LEG)
        step = step.join(before, ["query_id", "from_stop"]).select("query_id", "stop_id", F.lit(k).alias("round"), "arrive", F.concat("_legs", F.array(new)).alias("legs"), "_best")
        if walk is not None:
            step = written(step, "ridden")
            on_foot = step.drop("_best").withColumnRenamed("stop_id", "from_stop").join(walk, "from_stop")
            new = F.struct(F.lit(None).cast("string").alias("trip_id"), "from_stop", "to_stop", F.col("arrive").alias("depart"), (F.col("arrive") + F.col("seconds")).alias("arrive")).cast(LEG)
            on_foot = on_foot.select("query_id", F.col("to_stop").alias("stop_id"), "round", (F.col("arrive") + F.col("seconds")).alias("arrive"), F.concat("legs", F.array(new)).alias("legs"))
            step = earliest(step.unionByName(prune(on_foot.join(known, ["query_id", "stop_id"], "left"))))
        now = written(step.where("_best IS NULL OR arrive < _best").drop("_best"), "round")
        every = every.unionByName(now)
        if not now.limit(1).count():
            break
    return every
