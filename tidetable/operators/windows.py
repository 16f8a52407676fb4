"""Window operators over prediction histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import stride_bucket


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order (which should end in a unique tie-break). Spark cuts each key to its first row before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("bigint")).where(F.col(rank) <= n)


def final_observation(predictions: DataFrame, keys: Sequence[str] = ("snapshot_date", "trip_id", "stop_id"), tie: Sequence[str] = ("stop_sequence", "feed_name")) -> DataFrame:
    """The last prediction made no later than the arrival, for each key."""
    causal = predictions.where("prediction_lead_minutes >= 0")
    return latest_per_key(causal, keys, [F.col("collected_at_utc").desc_nulls_last(), *(F.col(c).asc_nulls_last() for c in tie)])


def stride_thin(predictions: DataFrame, minutes: int, keys: Sequence[str], tie: Sequence[str], ts: str = "collected_at_utc") -> DataFrame:
    """The last row of each key in each stride of time."""
    bucketed = predictions.withColumn("_stride", stride_bucket(ts, minutes))
    return latest_per_key(bucketed, [*keys, "_stride"], [F.col(ts).desc_nulls_last(), *(F.col(c).asc_nulls_last() for c in tie)]).drop("_stride")


def history_features(predictions: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "predicted_delay_seconds", ts: str = "collected_at_utc") -> DataFrame:
    """Lags (1, 2, 5), change, time since the one before, and mean, least and most of the five before, along each key's history. One shuffle and one sort."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).asc_nulls_last() for c in order))
    recent = w.rowsBetween(-5, -1)
    v = F.col(value)
    since = (F.unix_micros(F.col(ts)) - F.unix_micros(F.lag(ts).over(w))).cast("double") / 60e6
    return predictions.withColumns(
        {
            "prior_prediction_count": (F.row_number().over(w) - 1).cast("bigint"),
            "previous_predicted_delay_seconds": F.lag(v).over(w),
            "previous_2_predicted_delay_seconds": F.lag(v, 2).over(w),
            "previous_5_predicted_delay_seconds": F.lag(v, 5).over(w),
            "predicted_delay_delta_seconds": v - F.lag(v).over(w),
            "minutes_since_previous_prediction": since,
            "recent_predicted_delay_mean_5": F.avg(v).over(recent),
            "recent_predicted_delay_min_5": F.min(v).over(recent),
            "recent_predicted_delay_max_5": F.max(v).over(recent),
        }
    )


def previous_stop(predictions: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "predicted_delay_seconds") -> DataFrame:
    """The value at the stop before, in the same snapshot, and the change since."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).asc_nulls_last() for c in order))
    return predictions.withColumns({"previous_stop_predicted_delay_seconds": F.lag(value).over(w), "previous_stop_predicted_delay_delta_seconds": F.col(value) - F.lag(value).over(w)})


def headways(arrivals: DataFrame, keys: Sequence[str] = ("snapshot_date", "route_id", "direction_id", "stop_id"), tie: Sequence[str] = ("trip_id",), scheduled: str = "scheduled_arrival_utc", actual: str = "actual_arrival_utc") -> DataFrame:
    """Each arrival with its leader at the stop, the scheduled and actual seconds behind it, and their ratio (null behind nobody or at a scheduled headway of 0)."""
    w = Window.partitionBy(*keys).orderBy(F.col(scheduled).asc_nulls_last(), *(F.col(c).asc_nulls_last() for c in tie))
    gap = lambda c: F.unix_seconds(F.col(c)) - F.unix_seconds(F.lag(c).over(w))
    out = arrivals.withColumns({"leader_trip_id": F.lag("trip_id").over(w), "scheduled_headway_seconds": gap(scheduled), "actual_headway_seconds": gap(actual)})
    return out.withColumn("headway_ratio", F.try_divide(F.col("actual_headway_seconds").cast("double"), F.col("scheduled_headway_seconds").cast("double")))
