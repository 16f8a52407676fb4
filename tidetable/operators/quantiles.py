"""Exact, interpolated percentiles without a buffer of values: selection by counts and prefix sums.

Values are counted per key first (counts add up, so those of days merge to months). A percentile is one or two places in the sorted
values. Each round cuts a key's range of values in slices, sums the counts before each slice and goes on with the slices that
hold a wanted place; only what is left of these is sorted. No task holds the values of a key, however many it has.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col

SLICES = 1024


def key_of(by: Sequence[str]) -> Column:
    """The group as one value: equal where all its columns are equal or both null. All rows are one group where `by` is empty."""
    return F.struct(*(F.col(c) for c in by)) if by else F.struct(F.lit(0).alias("_all"))


def value_counts(rows: DataFrame, by: Sequence[str], value: str, n: str = "n") -> DataFrame:
    """Each group's distinct values (null left out) and how many rows have each."""
    return rows.where(col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias(n))


def merge_counts(counts: DataFrame, by: Sequence[str], value: str, n: str = "n") -> DataFrame:
    """Counts of finer groups as those of coarser ones."""
    return counts.groupBy(*by, value).agg(F.sum(n).alias(n))


def _slices(base: DataFrame, ranges: DataFrame, slices: int) -> DataFrame:
    """The ranges narrowed to the slices of each that hold a wanted place."""
    share = (F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low"))
    at = F.when(F.col("_high") > F.col("_low"), F.least(F.floor(share * slices), F.lit(slices - 1))).otherwise(0)
    inside = base.join(ranges, "_key").where("_v >= _low AND _v <= _high").withColumn("_slice", at)
    sums = inside.groupBy("_key", "_low", "_slice").agg(F.sum("_n").alias("_n"), F.min("_v").alias("_from"), F.max("_v").alias("_to"), F.first("_before").alias("_before"), F.first("_places").alias("_places"))
    before = F.col("_before") + F.coalesce(F.sum("_n").over(Window.partitionBy("_key", "_low").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = sums.withColumn("_upto", before)
    mine = F.filter("_places", lambda p: (p >= F.col("_upto")) & (p < F.col("_upto") + F.col("_n")))
    return told.select("_key", F.col("_from").alias("_low"), F.col("_to").alias("_high"), F.col("_upto").alias("_before"), mine.alias("_places")).where(F.size("_places") > 0)


def percentiles(counts: DataFrame, by: Sequence[str], value: str, wanted: Mapping[str, float], *, n: str = "n", rounds: int = 2, slices: int = SLICES) -> DataFrame:
    """Per group of counts (from value_counts): the key (as key_of has it, `_key`) and a column for each wanted percentile (0 to 1, linear between neighbours).

    Groups without a value have no row. Values are finite numbers. A sorted part holds about 1 / slices^rounds of a group's range of values.
    """
    base = counts.where(col(value).isNotNull()).select(key_of(by).alias("_key"), F.col(value).cast("double").alias("_v"), F.col(n).cast("bigint").alias("_n"))
    totals = base.groupBy("_key").agg(F.sum("_n").alias("_total"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    place = {name: (F.col("_total") - 1).cast("double") * q for name, q in wanted.items()}
    both = [end(x).cast("bigint") for x in place.values() for end in (F.floor, F.ceil)]
    ranges = totals.select("_key", "_low", "_high", F.lit(0).cast("bigint").alias("_before"), F.array_distinct(F.array(*both)).alias("_places"))
    for _ in range(rounds):
        ranges = _slices(base, ranges, slices)
    running = F.sum("_n").over(Window.partitionBy("_key", "_low").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    last = base.join(ranges, "_key").where("_v >= _low AND _v <= _high").withColumn("_upto", F.col("_before") + running)
    here = F.filter("_places", lambda p: (p >= F.col("_upto") - F.col("_n")) & (p < F.col("_upto")))
    found = last.select("_key", "_v", F.explode(here).alias("_place"))
    known = found.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("_place", "_v"))).alias("_at")).join(totals.select("_key", "_total"), "_key")  # two places a percentile

    def between(x: Column) -> Column:
        low, high = (F.element_at("_at", end(x).cast("bigint")) for end in (F.floor, F.ceil))
        return low + (high - low) * (x - F.floor(x))

    return known.select("_key", *(between(x).alias(name) for name, x in place.items()))


def distinct_counts(rows: DataFrame, by: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Per group (`_key`) and name, how many different values (not null) a column has: each column is grouped by itself, so no row is multiplied."""
    out = None
    for name, c in columns.items():
        one = rows.groupBy(key_of(by).alias("_key"), col(c).alias("_x")).agg(F.lit(1).alias("_one")).groupBy("_key").agg(F.count("_x").alias(name))
        out = one if out is None else out.join(one, "_key")
    return out
