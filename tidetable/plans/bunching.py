"""Headways, bunching and excess wait."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..operators.metrics import bunching
from ..operators.windows import headways

GROUPINGS: dict[str, tuple[str, ...]] = {
    "route_summary": ("route_id",),
    "route_by_hour": ("route_id", "hour_of_day"),
    "stop_summary": ("stop_id",),
    "route_direction": ("route_id", "direction_id"),
}


def events(arrivals: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Headways within the limits, flagged. arrivals: one row a trip and stop, with scheduled_arrival_utc and actual_arrival_utc.

    A negative headway (the follower overtook) counts as bunched.
    """
    return flagged(headways(arrivals), settings)


def flagged(rows: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Rows of headways() within the limits, with is_bunched, is_gapped and is_on_headway."""
    kept = rows.where(
        F.col("leader_trip_id").isNotNull()
        & F.col("scheduled_headway_seconds").between(settings.headway_min_s, settings.headway_max_s)
        & (F.abs("actual_headway_seconds") <= settings.headway_actual_max_s)
    )
    ratio = F.col("headway_ratio")
    return kept.withColumns({"is_bunched": ratio < settings.bunched_below, "is_gapped": ratio > settings.gapped_above, "is_on_headway": ratio.between(settings.bunched_below, settings.gapped_above)})


def rollup(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(*by).agg(*bunching()) if by else rows.agg(*bunching())


def most_bunched(rolled: DataFrame, least: int, n: int, keys: tuple[str, ...] = ("route_id",)) -> DataFrame:
    return rolled.where(F.col("headways") >= least).orderBy(F.col("bunched_rate").desc_nulls_last(), F.col("excess_wait_seconds").desc_nulls_last(), *keys).limit(n)
