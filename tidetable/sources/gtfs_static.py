"""Static GTFS archives: every member a table of strings."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("routes", "stops", "trips", "stop_times")
_PATH = re.compile(r"([^/]+)/(\d{4}-\d{2}-\d{2})/[^/]*\.zip$")


class FeedError(ValueError):
    """The archive isn't a GTFS feed."""


def members(data: bytes) -> dict[str, str]:
    """Tables of an archive and their members; FeedError if it is no archive or lacks a required table."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            found = {n.rsplit("/", 1)[-1][:-4]: n for n in z.namelist() if n.endswith(".txt")}
    except zipfile.BadZipFile as e:
        raise FeedError("not a zip archive") from e
    if missing := [t for t in REQUIRED if t not in found]:
        raise FeedError(f"lacks {', '.join(missing)}")
    return found


def rows(data: bytes, table: str) -> Iterator[dict[str, str | None]]:
    """Rows of a table (none if the archive lacks it); a byte-order mark is dropped, empty values are null."""
    member = members(data).get(table)
    if member is None:
        return
    with zipfile.ZipFile(io.BytesIO(data)) as z, z.open(member) as f:
        for row in csv.DictReader(io.TextIOWrapper(f, "utf-8-sig", newline="")):
            yield {k.strip(): (v or None) for k, v in row.items() if k}


def read_table(spark: SparkSession, root: str, table: str, columns: list[str], *, skip_bad: bool = True) -> DataFrame:
    """A table of all archives under root (.../<feed>/<date>/*.zip): columns (null where a header lacks them), feed_name, p_snapshot_date, source_zip."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(root).select("path", "content")
    names = [*columns, "feed_name", "snapshot_date", "source_zip"]
    arrow = pa.schema([(n, pa.string()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                m = _PATH.search(path)
                held: list[dict] = []
                try:
                    for row in rows(data, table):
                        held.append({c: row.get(c) for c in columns} | {"feed_name": m[1] if m else None, "snapshot_date": m[2] if m else None, "source_zip": path})
                        if len(held) == 20_000:
                            yield pa.RecordBatch.from_pylist(held, arrow)
                            held = []
                except FeedError:
                    if not skip_bad:
                        raise
                if held:
                    yield pa.RecordBatch.from_pylist(held, arrow)

    out = files.mapInArrow(run, ", ".join(f"`{n}` string" for n in names))
    return out.withColumn("p_snapshot_date", F.to_date("snapshot_date"))


def latest_complete(tables: dict[str, DataFrame]) -> DataFrame:
    """Per feed, the newest date on which every table has rows."""
    days = None
    for name, df in tables.items():
        part = df.select("feed_name", "p_snapshot_date", F.lit(name).alias("table")).distinct()
        days = part if days is None else days.unionAll(part)
    return days.groupBy("feed_name", "p_snapshot_date").agg(F.countDistinct("table").alias("n")).where(F.col("n") == len(tables)).groupBy("feed_name").agg(F.max("p_snapshot_date").alias("p_snapshot_date"))
