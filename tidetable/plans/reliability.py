"""On-time, early and late rollups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.columns import col, quantile
from ..operators import quantiles
from ..operators.metrics import reliability, reliability_of_counts

GROUPINGS: dict[str, tuple[str, ...]] = {
    "system_by_date": ("snapshot_date",),
    "route_summary": ("route_id",),
    "route_by_hour": ("route_id", "hour_of_day"),
    "route_by_day_of_week": ("route_id", "day_of_week"),
    "stop_summary": ("stop_id",),
    "route_stop_summary": ("route_id", "stop_id"),
}


KEYS = tuple(dict.fromkeys(k for by in GROUPINGS.values() for k in by))
#: What a report shows of a group.
SHOWN = ("observations", "on_time_rate", "late_rate", "early_rate", "median_delay_seconds", "p90_delay_seconds")


def base(features: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return features.where(F.col("delay_seconds").isNotNull() & (F.abs("delay_seconds") <= settings.outlier_s))


def rollup(rows: DataFrame, by: tuple[str, ...], settings: Settings = DEFAULT) -> DataFrame:
    """The metrics of each group; stop groupings also have the stop's mean place where the rows have one."""
    return reliability(rows, by, places=[c for c in ("stop_lat", "stop_lon") if "stop_id" in by and c in rows.columns], settings=settings)


def rollups(rows: DataFrame, groupings: Mapping[str, tuple[str, ...]] = GROUPINGS, settings: Settings = DEFAULT) -> DataFrame:
    """The metrics of all groupings in one table: `grouping`, all key columns (null where a grouping lacks them), metrics, and mean places where there is a stop.

    One scan: rows are first counted per (day, keys, trip, delay), and these counts are told to each grouping. Of the groupings each row
    of counts goes to, most share their keys, so they are partly added up before they move.
    """
    keys = tuple(dict.fromkeys(k for by in groupings.values() for k in by))
    places = [c for c in ("stop_lat", "stop_lon") if c in rows.columns]
    cells = rows.select(*keys, *(c for c in ("snapshot_date", "trip_id", "delay_seconds") if c not in keys), *places)
    cells = cells.groupBy(*(c for c in cells.columns if c not in places)).agg(F.count("*").alias("_n"), *(x for c in places for x in (F.sum(c).alias(f"_{c}"), F.count(c).alias(f"_{c}_n"))))
    told = [F.struct(F.lit(name).alias("grouping"), *((F.col(k) if k in by else F.lit(None).cast(rows.schema[k].dataType)).alias(f"_{k}") for k in keys)) for name, by in groupings.items()]
    spread = cells.withColumn("_set", F.explode(F.array(*told)))
    out = reliability_of_counts(spread.select("_set", "snapshot_date", "trip_id", "delay_seconds", "_n", *(c for p in places for c in (f"_{p}", f"_{p}_n"))), "_set", places, settings)
    return out.select("_set.grouping", *(F.col(f"_set._{k}").alias(k) for k in keys), *(c for c in out.columns if c != "_set"))


def of_counts(counts: DataFrame, by: tuple[str, ...], wanted: Mapping[str, float], value: str = "delay_seconds") -> DataFrame:
    """observations and exact percentiles per group, from counts of finer groups (quantiles.value_counts of single days, say)."""
    merged = quantiles.merge_counts(counts, by, value)
    rows = merged.groupBy(quantiles.key_of(by).alias("_key")).agg(F.sum("n").alias("observations"))
    return rows.join(quantiles.percentiles(merged, by, value, wanted), "_key").select("_key.*", "observations", *wanted)


def worst(rolled: DataFrame, least: int, n: int, by: str = "on_time_rate", keys: tuple[str, ...] = ("route_id",)) -> DataFrame:
    """The n least reliable groups with enough observations."""
    return rolled.where(F.col("observations") >= least).orderBy(col(by).asc_nulls_last(), F.col("p90_delay_seconds").desc_nulls_last(), *keys).limit(n)


def of_daily(daily: DataFrame) -> DataFrame:
    """A summary of daily rows: days count alike, whatever they hold."""
    return daily.agg(
        F.sum("observations").alias("observations"), F.avg("on_time_rate").alias("on_time_rate"), F.avg("late_rate").alias("late_rate"), F.median("median_delay_seconds").alias("median_delay_seconds"), quantile("p90_delay_seconds", 0.9).alias("p90_delay_seconds")
    )


def weighted(rows: DataFrame, by: tuple[str, ...], rate: str = "on_time_rate", weight: str = "observations") -> DataFrame:
    """Mean of a rate, weighted by observations."""
    return rows.groupBy(*by).agg(F.try_divide(F.sum(F.col(rate) * F.col(weight)), F.sum(F.col(weight).cast("double"))).alias(rate), F.sum(weight).alias(weight))
