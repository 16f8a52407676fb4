"""Baseline predictors, splits, samples and encodings for the delay model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..operators.joins import fallback_lookup

#: The model's inputs.
NUMERIC = (
    "current_predicted_delay_seconds",
    "stop_sequence_normalized",
    "hour_of_day",
    "minute_of_hour",
    "day_of_week",
    "temperature_c",
    "wind_speed_kmh",
    "precip_probability_pct",
    "prediction_lead_minutes",
    "prior_prediction_count",
    "previous_predicted_delay_seconds",
    "previous_2_predicted_delay_seconds",
    "previous_5_predicted_delay_seconds",
    "predicted_delay_delta_seconds",
    "minutes_since_previous_prediction",
    "recent_predicted_delay_mean_5",
    "recent_predicted_delay_min_5",
    "recent_predicted_delay_max_5",
    "previous_stop_predicted_delay_seconds",
    "previous_stop_predicted_delay_delta_seconds",
    "vehicle_speed",
    "vehicle_current_stop_sequence",
    "vehicle_current_status",
    "vehicle_update_age_seconds",
    "vehicle_distance_to_stop_m",
    "vehicle_stop_sequence_delta",
    "route_type",
)
BOOLEAN = ("is_weekend", "is_rush_hour", "is_rain", "is_snow", "is_precip", "is_vehicle_update_stale")
CATEGORICAL = ("route_id", "stop_id", "direction_id", "transit_mode")

HASH_BINS = 100_000


def lookup(train: DataFrame, by: Sequence[str], value: str = "delay_seconds") -> DataFrame:
    return train.groupBy(*by).agg(F.median(value).alias("median_delay"), F.avg(value).alias("mean_delay"), F.count("*").alias("rows"))


def mae(rows: DataFrame, predicted, observed: str = "delay_seconds", name: str = "mae") -> DataFrame:
    return rows.agg(F.avg(F.abs(F.col(observed) - predicted)).alias(name))


def with_baseline(rows: DataFrame, train: DataFrame, levels: Sequence[Sequence[str]], value: str = "delay_seconds") -> DataFrame:
    """rows with median_delay of the finest level that knows them, else 0."""
    return fallback_lookup(rows, [(lookup(train, by, value), by) for by in levels], "median_delay")


def time_split(rows: DataFrame, day: str = "snapshot_date", share: float = 0.8) -> DataFrame:
    """is_train by day: the first share of the days (one at least); with a single day that day is both."""
    days = rows.select(day).distinct()
    n = days.count()
    cut = max(1, int(n * share))
    ranked = days.withColumn("_k", F.row_number().over(Window.orderBy(day)))  # one row a day
    return ranked.select(day, (F.col("_k") <= cut).alias("is_train"), (F.lit(n == 1) | (F.col("_k") > cut)).alias("is_validation"))


def hash_sample(rows: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The n rows of least hash of their keys: the same ones each time.

    Rows are counted by the hash's first digits; of the slices that fit whole none is sorted, only the one in which n is reached.
    """
    place = F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in keys)))
    marked = rows.select(F.struct("*").alias("row"), place.alias("place"), F.substring(place, 1, 3).alias("slice"))
    whole, edge, left = "", None, n
    for r in sorted(marked.groupBy("slice").count().collect()):  # 4096 rows at most
        if r["count"] > left:
            edge = r["slice"]
            break
        whole, left = r["slice"], left - r["count"]
    taken = marked.where(F.col("slice") <= whole).select("row.*")
    if edge is None or not left:
        return taken
    return taken.unionAll(marked.where(F.col("slice") == edge).orderBy("place", *(f"row.{k}" for k in keys)).limit(left).select("row.*"))


def sample_weight(observed: str = "delay_seconds", late_weight: float = 1.0, settings: Settings = DEFAULT):
    return F.when(F.col(observed) > settings.late_above_s, float(late_weight)).otherwise(1.0)


def encode(rows: DataFrame) -> DataFrame:
    """Model inputs that no null is left in: numbers (0 for null), flags (0 for null), categories as hash bins."""
    have = set(rows.columns)
    number = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0) for c in NUMERIC]
    flag = [F.coalesce(F.col(c), F.lit(False)).cast("double") if c in have else F.lit(0.0) for c in BOOLEAN]
    category = [F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(HASH_BINS)).cast("double") if c in have else F.lit(0.0) for c in CATEGORICAL]
    names = [*NUMERIC, *BOOLEAN, *(f"{c}_bin" for c in CATEGORICAL)]
    return rows.select("*", *(x.alias(f"x_{n}") for x, n in zip([*number, *flag, *category], names)))
