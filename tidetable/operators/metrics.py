"""Bundles of aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.columns import col, delay_flags
from . import quantiles as Q


def share(flag: Column) -> Column:
    """Share of rows where flag holds; rows where it is null count as no."""
    return F.avg(F.when(flag, 1.0).otherwise(0.0))


PERCENTILES = {"median_delay_seconds": 0.5, "p75_delay_seconds": 0.75, "p90_delay_seconds": 0.9, "p95_delay_seconds": 0.95}


def reliability(rows: DataFrame, by: Sequence[str] = (), *, places: Sequence[str] = (), settings: Settings = DEFAULT) -> DataFrame:
    """The metrics of each group of rows (snapshot_date, trip_id, delay_seconds), and the means of `places`. Without `by` all rows are one group, which is there even if there are none."""
    told = [x for c in places for x in (F.col(c).alias(f"_{c}"), F.when(F.col(c).isNotNull(), 1).otherwise(0).alias(f"_{c}_n"))]
    cells = rows.select(Q.key_of(by).alias("_set"), "snapshot_date", "trip_id", "delay_seconds", F.lit(1).alias("_n"), *told)
    found = reliability_of_counts(cells, "_set", places, settings, whole=not by)
    return found.select(*(["_set.*"] if by else []), *(c for c in found.columns if c != "_set"))


def reliability_of_counts(cells: DataFrame, key: str, places: Sequence[str] = (), settings: Settings = DEFAULT, *, whole: bool = False) -> DataFrame:
    """The metrics of each `key` (a struct). cells: key, snapshot_date, trip_id, delay_seconds, _n (rows like this) and, of each place, the sum and the number of values.

    Percentiles are selected from counts, different days and trips are counted by groupings of their own: no group is ever
    in one task, and no row is multiplied. whole: there is one key only.
    """
    flags, n, d = delay_flags("delay_seconds", settings), F.col("_n"), F.col("delay_seconds")
    mean = lambda x, of=n: F.try_divide(F.sum(x).cast("double"), F.sum(of).cast("double"))
    known = F.when(d.isNotNull(), n).otherwise(0)
    moments = (cells.groupBy() if whole else cells.groupBy(key)).agg(
        F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("observations"), mean(d * n, known).alias("mean_delay_seconds"), mean(F.abs(d) * n, known).alias("mean_abs_delay_seconds"),
        *(mean(F.when(flags[f"is_{x}"], n).otherwise(0)).alias(f"{x}_rate") for x in ("on_time", "late", "early")), *(mean(F.col(f"_{c}"), F.col(f"_{c}_n")).alias(c) for c in places),
    )
    if whole:
        moments = moments.withColumn(key, Q.key_of(()))
    counts = Q.merge_counts(cells.where(d.isNotNull()), (key,), "delay_seconds", "_n")
    quantiles = Q.percentiles(counts, (key,), "delay_seconds", PERCENTILES, n="_n").withColumn(key, F.col(f"_key.{key}")).drop("_key")
    different = Q.distinct_counts(cells, (key,), {"service_days": "snapshot_date", "trips": "trip_id"}).withColumn(key, F.col(f"_key.{key}")).drop("_key")
    out = moments.join(quantiles, key, "left").join(different, key, "left").na.fill(0, ["service_days", "trips"])
    return out.select(key, "observations", "service_days", "trips", "mean_delay_seconds", *PERCENTILES, "mean_abs_delay_seconds", "on_time_rate", "late_rate", "early_rate", *places)


def excess_wait(actual: str, scheduled: str) -> Column:
    """Mean extra wait of a rider who comes at random: expected wait under the actual less that under the scheduled headways. Null where either has no length."""
    h, s = F.greatest(col(actual).cast("double"), F.lit(0.0)), col(scheduled).cast("double")
    return F.try_divide(F.sum(h * h), 2.0 * F.sum(h)) - F.try_divide(F.sum(s * s), 2.0 * F.sum(s))


def bunching() -> list[Column]:
    return [
        F.count("*").alias("headways"),
        share(F.col("is_bunched")).alias("bunched_rate"),
        share(F.col("is_gapped")).alias("gapped_rate"),
        share(F.col("is_on_headway")).alias("on_headway_rate"),
        F.avg("headway_ratio").alias("mean_headway_ratio"),
        F.median("headway_ratio").alias("median_headway_ratio"),
        F.avg(F.col("scheduled_headway_seconds").cast("double")).alias("mean_scheduled_headway_seconds"),
        excess_wait("actual_headway_seconds", "scheduled_headway_seconds").alias("excess_wait_seconds"),
    ]


def errors(predicted: str, observed: str) -> list[Column]:
    e = F.col(predicted) - F.col(observed)
    return [
        F.count("*").alias("rows"),
        F.round(F.avg(F.abs(e)), 1).alias("mae"),
        F.round(F.median(F.abs(e)), 1).alias("median_ae"),
        F.round(F.sqrt(F.avg(e * e)), 1).alias("rmse"),
        F.round(F.avg(e), 1).alias("bias"),
    ]


def late_detection(predicted: str, observed: str, threshold: float = DEFAULT.late_above_s) -> list[Column]:
    p, o = F.col(predicted) > threshold, F.col(observed) > threshold
    hit, wrong, missed = F.count_if(p & o), F.count_if(p & ~o), F.count_if(~p & o)
    return [hit.alias("true_positive"), wrong.alias("false_positive"), missed.alias("false_negative"), F.try_divide(hit.cast("double"), (hit + wrong).cast("double")).alias("precision"), F.try_divide(hit.cast("double"), (hit + missed).cast("double")).alias("recall")]


def intervals(lower: str, upper: str, observed: str) -> list[Column]:
    lo, hi, o = map(F.col, (lower, upper, observed))
    return [F.count("*").alias("rows"), share((o >= lo) & (o <= hi)).alias("coverage"), share(o < lo).alias("below_rate"), share(o > hi).alias("above_rate"), F.avg(hi - lo).alias("mean_width")]


def pinball(predicted: str, observed: str, q: float) -> Column:
    e = F.col(observed) - F.col(predicted)
    return F.avg(F.greatest(q * e, (q - 1.0) * e))
