"""Streaming: snapshots as they land, last prediction per stride, lags as state, scoring in micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.gtfs_rt import decode_table

LAGS = 5


def landing(spark: SparkSession, root: str, table: str, *, max_files: int = 1000) -> DataFrame:
    """A stream of one realtime table from a landing folder of snapshots."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pb").option("maxFilesPerTrigger", str(max_files)).schema("path string, modificationTime timestamp, length bigint, content binary").load(root)
    return decode_table(files.select("path", "content"), table)


def stride_last(predictions: DataFrame, keys: tuple[str, ...], value: str, *, minutes: int = 10, late: str = "90 minutes", ts: str = "collected_at_utc") -> DataFrame:
    """The last value of each key in each stride, once the watermark has passed it."""
    window = F.window(ts, f"{minutes} minutes")
    out = predictions.withWatermark(ts, late).groupBy(window.alias("stride"), *keys).agg(F.max(F.struct(F.col(ts).alias("at"), F.col(value).alias("value"))).alias("last"))
    return out.select(F.col("stride.end").alias("stride_end"), *keys, F.col("last.at").alias(ts), F.col("last.value").alias(value))


def lag_stream(strided: DataFrame, key: str, value: str, ts: str, *, minutes: int = 90) -> DataFrame:
    """key, ts, value with lag_1 .. lag_5 over what came before, kept as state for `minutes` after a key's last row.

    Rows of one micro-batch are taken in order of time; a row older than what the state has is passed on with its lags as they are.
    """
    schema = f"{key} string, {ts} timestamp, {value} double, " + ", ".join(f"lag_{i} double" for i in range(1, LAGS + 1))

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ring = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(ts, kind="stable")
        out = []
        for at, x in zip(rows[ts], rows[value]):
            out.append((k[0], at, x, *[ring[-i] if len(ring) >= i else None for i in range(1, LAGS + 1)]))
            ring = [*ring, float(x)][-LAGS:]
        state.update((ring,))
        state.setTimeoutDuration(minutes * 60_000)
        yield pd.DataFrame(out, columns=[key, ts, value, *(f"lag_{i}" for i in range(1, LAGS + 1))])

    rows = strided.select(F.col(key).cast("string").alias(key), ts, F.col(value).cast("double").alias(value))
    return rows.groupBy(key).applyInPandasWithState(step, schema, "ring array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def distinct_polls(rows: DataFrame, keys: tuple[str, ...], *, ts: str = "collected_at_utc", late: str = "90 minutes") -> DataFrame:
    """Each poll's rows once, however often a file lands."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([*keys, ts])


def score_batches(stream: DataFrame, score: Callable[[DataFrame], DataFrame], log_root: str, checkpoint: str, *, available_now: bool = False):
    """Starts a query that scores each micro-batch and appends it to a log partitioned by date. A batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        scored = score(batch).withColumn("date", F.to_date("collected_at_utc"))
        scored.write.mode("overwrite").partitionBy("date").parquet(f"{log_root}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="300 seconds")
    return writer.start()
