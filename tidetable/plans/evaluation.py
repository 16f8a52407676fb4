"""Logged predictions against what was observed later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.columns import lead_bucket
from ..operators.metrics import errors, intervals, late_detection
from ..operators.windows import latest_per_key

KEYS = ("service_date", "trip_id", "stop_id", "stop_sequence")
INTERVAL = ("predicted_delay_lower_seconds", "predicted_delay_upper_seconds")


def complete(log: DataFrame) -> DataFrame:
    """A log read from files of different ages: columns that old files lack are there, null."""
    return log.withColumns({c: F.lit(None).cast("double") for c in INTERVAL if c not in log.columns})


def observed(delays: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The truth: the last prediction before each arrival, if it was made shortly before."""
    rows = delays.where((F.col("prediction_lead_minutes") >= 0) & (F.col("prediction_lead_minutes") <= settings.final_lead_max_min))
    last = latest_per_key(rows, KEYS, [F.col("collected_at_utc").desc_nulls_last(), F.col("feed_name")])
    return last.select(*KEYS, F.col("delay_seconds").alias("observed_delay_seconds"))


def match(log: DataFrame, truth: DataFrame, settings: Settings = DEFAULT, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Logged predictions that have a truth, with their lead bucket."""
    return complete(log).join(truth, list(keys)).withColumn("lead_bucket", lead_bucket("prediction_lead_minutes", settings.lead_edges_min))


def error_summary(matched: DataFrame, by: tuple[str, ...] = (), least: int = 0, predicted: str = "predicted_delay_seconds", truth: str = "observed_delay_seconds") -> DataFrame:
    rows = matched.groupBy(*by).agg(*errors(predicted, truth)) if by else matched.agg(*errors(predicted, truth))
    return rows.where(F.col("rows") >= least) if least else rows


def late_summary(matched: DataFrame, predicted: str = "predicted_delay_seconds", truth: str = "observed_delay_seconds", settings: Settings = DEFAULT) -> DataFrame:
    return matched.agg(*late_detection(predicted, truth, settings.late_above_s))


def interval_summary(matched: DataFrame, lower: str = INTERVAL[0], upper: str = INTERVAL[1], truth: str = "observed_delay_seconds") -> DataFrame:
    return matched.where(F.col(lower).isNotNull() & F.col(upper).isNotNull()).agg(*intervals(lower, upper, truth))


def coverage(log: DataFrame, truth: DataFrame, day: str = "service_date", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """By day: logged rows, rows with a truth, and their share."""
    marked = log.join(truth.select(*keys, F.lit(1).alias("_hit")).distinct(), list(keys), "left")
    return marked.groupBy(day).agg(F.count("*").alias("logged"), F.count("_hit").alias("matched"), (F.count("_hit").cast("double") / F.count("*").cast("double")).alias("match_rate"))
