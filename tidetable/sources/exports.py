"""JSON documents for a web client, and which raw folders may go."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nested(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One row for each `by`, with its rows as an array of structs in order. Groups must be small (the stops or hours of a route)."""
    kept = [c for c in (columns or rows.columns) if c not in by]
    packed = F.array_sort(F.collect_list(F.struct(*(F.col(c).alias(f"_{i}") for i, c in enumerate(order)), F.struct(*kept).alias("row"))))
    return rows.groupBy(*by).agg(F.transform(packed, lambda x: x["row"]).alias(name))


def dashboard(routes: DataFrame, hours: DataFrame, stops: DataFrame, transfers: DataFrame, *, digits: int = 6) -> DataFrame:
    """One row a route: route_id and json, its summary with hours, stops and the 20 busiest transfers in it (absent parts are absent)."""
    ranked = transfers.withColumn("_neg", -F.col("attempts"))
    top = nested(ranked, ("from_route_id",), ("_neg", "from_stop_id", "to_route_id"), "transfers", ("from_stop_id", "to_route_id", "attempts", "success_rate"))
    top = top.select(F.col("from_route_id").alias("route_id"), F.slice("transfers", 1, 20).alias("transfers"))
    whole = routes.join(nested(hours, ("route_id",), ("hour_of_day",), "hours"), "route_id", "left").join(nested(stops, ("route_id",), ("stop_id",), "stops"), "route_id", "left").join(top, "route_id", "left")
    rounded: list[Column] = [F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in whole.dtypes]
    return whole.select("route_id", F.to_json(F.struct(*rounded)).alias("json"))


def timetable(patterns: DataFrame, stops: DataFrame, footpaths: DataFrame) -> DataFrame:
    """One row: json of a schedule day (stops, patterns and footpaths; one day's schedule is what a client loads whole)."""
    parts = (
        stops.agg(F.array_sort(F.collect_list(F.struct("stop_id", "stop_name", "stop_lat", "stop_lon"))).alias("stops")),
        patterns.agg(F.array_sort(F.collect_list(F.struct("route_id", "direction_id", "stops", "trips"))).alias("patterns")),
        footpaths.agg(F.array_sort(F.collect_list(F.struct("from_stop", "to_stop", "seconds"))).alias("footpaths")),
    )
    whole = parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each
    return whole.select(F.to_json(F.struct("*")).alias("json"))


def write_documents(rows: DataFrame, root: str, *, overwrite: bool = False) -> None:
    """The json column as text, a document a line."""
    rows.select("json").write.mode("overwrite" if overwrite else "errorifexists").text(root)


def removable(local: DataFrame, remote: DataFrame, *, days: int, today: str) -> DataFrame:
    """Folders (feed, date) older than days whose every file is in remote with the same size.

    local and remote: feed, date, name, size. A folder with one file that isn't is kept whole.
    """
    known = remote.select("feed", "date", "name", "size", F.lit(True).alias("_there")).distinct()
    checked = local.join(known, ["feed", "date", "name", "size"], "left").groupBy("feed", "date").agg(F.count("*").alias("files"), F.count("_there").alias("_verified"))
    return checked.where((F.datediff(F.lit(today).cast("date"), F.col("date").cast("date")) > days) & (F.col("files") == F.col("_verified"))).select("feed", "date", "files")


def stale_snapshots(files: DataFrame, *, window_minutes: int, stride_minutes: int, now: Column) -> DataFrame:
    """Snapshots (path, collected_at_utc) that the rolling window doesn't reach any more."""
    return files.where(F.unix_seconds("collected_at_utc") < F.unix_seconds(now) - (window_minutes + stride_minutes) * 60)
