"""GTFS-Realtime snapshots: protobuf feeds as seven flat tables.

A snapshot's metadata is in its path: .../<feed>/<date>/<yyyy-mm-ddTHH-MM-SSZ>.pb. Files are read
by Spark's binary source and decoded in parallel, one table a pass, so that a table's columns
are all that leaves Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .wire import WireError, fields, real, signed, text

_COMMON = "feed_name string, snapshot_path string, snapshot_date string, collected_at_utc timestamp, feed_timestamp_utc timestamp"
_TRIP = "trip_id string, route_id string, direction_id bigint, start_time string, start_date string"
SCHEMAS = {
    "feed_snapshots": f"{_COMMON}, entity_count bigint, vehicle_entity_count bigint, trip_update_entity_count bigint, alert_entity_count bigint, byte_size bigint",
    "vehicle_positions": f"{_COMMON}, entity_id string, {_TRIP}, schedule_relationship bigint, vehicle_id string, vehicle_label string, license_plate string, latitude double, longitude double, bearing double, odometer double, speed double, "
    "current_stop_sequence bigint, stop_id string, current_status bigint, vehicle_timestamp_utc timestamp, congestion_level bigint, occupancy_status bigint",
    "trip_updates": f"{_COMMON}, entity_id string, {_TRIP}, schedule_relationship bigint, vehicle_id string, vehicle_label string, license_plate string, trip_update_timestamp_utc timestamp, trip_delay_seconds bigint, stop_time_update_count bigint",
    "stop_time_updates": f"{_COMMON}, entity_id string, {_TRIP}, trip_schedule_relationship bigint, vehicle_id string, stop_update_index bigint, stop_sequence bigint, stop_id string, stop_schedule_relationship bigint, "
    "arrival_delay_seconds bigint, arrival_time_utc timestamp, arrival_uncertainty_seconds bigint, departure_delay_seconds bigint, departure_time_utc timestamp, departure_uncertainty_seconds bigint",
    "service_alerts": f"{_COMMON}, entity_id string, cause bigint, effect bigint, severity_level bigint, header_text string, description_text string, url string, tts_header_text string, tts_description_text string, active_period_count bigint, informed_entity_count bigint",
    "service_alert_active_periods": f"{_COMMON}, entity_id string, active_period_index bigint, start_time_utc timestamp, end_time_utc timestamp",
    "service_alert_informed_entities": f"{_COMMON}, entity_id string, informed_entity_index bigint, agency_id string, route_id string, route_type bigint, stop_id string, trip_id string, direction_id bigint, start_time string, start_date string, trip_schedule_relationship bigint",
}
_PATH = re.compile(r"([^/]+)/(\d{4}-\d{2}-\d{2})/(\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}Z)\.pb$")


def _one(message: dict[int, list], number: int):
    """The last value of a field, as protobuf has it for fields that are there once."""
    found = message.get(number)
    return found[-1] if found else None


def _sub(message: dict[int, list], number: int) -> dict[int, list]:
    return fields(_one(message, number) or b"")


def _when(seconds) -> datetime | None:
    """Epoch seconds as a UTC time; 0 and nothing are null."""
    return datetime.fromtimestamp(seconds, timezone.utc) if seconds else None


def _trip(message: dict[int, list]) -> dict:
    return {"trip_id": text(_one(message, 1)), "route_id": text(_one(message, 5)), "direction_id": _one(message, 6), "start_time": text(_one(message, 2)), "start_date": text(_one(message, 3))}


def _vehicle(message: dict[int, list]) -> dict:
    return {"vehicle_id": text(_one(message, 1)), "vehicle_label": text(_one(message, 2)), "license_plate": text(_one(message, 3))}


def _translated(message: dict[int, list], number: int) -> str | None:
    """The first English text, else the first."""
    options = [fields(t) for t in _sub(message, number).get(1, [])]
    if not options:
        return None
    english = [t for t in options if (text(_one(t, 2)) or "").lower().startswith("en")]
    return text(_one((english or options)[0], 1))


def _event(message: dict[int, list], name: str) -> dict:
    return {f"{name}_delay_seconds": signed(_one(message, 1), 32), f"{name}_time_utc": _when(signed(_one(message, 2))), f"{name}_uncertainty_seconds": signed(_one(message, 3), 32)}


def path_parts(path: str) -> tuple[str, str, datetime] | None:
    """Feed, date and time of collection; None for other files."""
    m = _PATH.search(path)
    return (m[1], m[2], datetime.strptime(m[3], "%Y-%m-%dT%H-%M-%SZ").replace(tzinfo=timezone.utc)) if m else None


def decode(data: bytes, path: str) -> dict[str, list[dict]]:
    """A snapshot's rows by table. An entity is a vehicle, a trip update or an alert: the first it has, in that order."""
    parts = path_parts(path)
    if parts is None:
        raise WireError(f"not a snapshot's path: {path}")
    feed = fields(data)
    header = _sub(feed, 1)
    common = {"feed_name": parts[0], "snapshot_path": path, "snapshot_date": parts[1], "collected_at_utc": parts[2], "feed_timestamp_utc": _when(_one(header, 3))}
    out: dict[str, list[dict]] = {name: [] for name in SCHEMAS}
    seen = {"vehicle": 0, "trip_update": 0, "alert": 0}
    entities = feed.get(2, [])
    for raw in entities:
        entity = fields(raw)
        own = common | {"entity_id": text(_one(entity, 1))}
        if 4 in entity:
            seen["vehicle"] += 1
            v = _sub(entity, 4)
            trip, place = _sub(v, 1), _sub(v, 2)
            out["vehicle_positions"].append(
                own | _trip(trip) | _vehicle(_sub(v, 8))
                | {"schedule_relationship": _one(trip, 4), "latitude": real(_one(place, 1)), "longitude": real(_one(place, 2)), "bearing": real(_one(place, 3)), "odometer": real(_one(place, 4)), "speed": real(_one(place, 5)),
                   "current_stop_sequence": _one(v, 3), "stop_id": text(_one(v, 7)), "current_status": _one(v, 4), "vehicle_timestamp_utc": _when(_one(v, 5)), "congestion_level": _one(v, 6), "occupancy_status": _one(v, 9)}
            )
        elif 3 in entity:
            seen["trip_update"] += 1
            u = _sub(entity, 3)
            trip, vehicle, stops = _sub(u, 1), _vehicle(_sub(u, 3)), u.get(2, [])
            out["trip_updates"].append(own | _trip(trip) | vehicle | {"schedule_relationship": _one(trip, 4), "trip_update_timestamp_utc": _when(_one(u, 4)), "trip_delay_seconds": signed(_one(u, 5), 32), "stop_time_update_count": len(stops)})
            for i, stop in enumerate(map(fields, stops)):
                out["stop_time_updates"].append(
                    own | _trip(trip) | {"trip_schedule_relationship": _one(trip, 4), "vehicle_id": vehicle["vehicle_id"], "stop_update_index": i, "stop_sequence": _one(stop, 1), "stop_id": text(_one(stop, 4)), "stop_schedule_relationship": _one(stop, 5)}
                    | _event(_sub(stop, 2), "arrival") | _event(_sub(stop, 3), "departure")
                )
        elif 5 in entity:
            seen["alert"] += 1
            a = _sub(entity, 5)
            periods, informed = a.get(1, []), a.get(5, [])
            out["service_alerts"].append(
                own | {"cause": _one(a, 6), "effect": _one(a, 7), "severity_level": _one(a, 14), "url": _translated(a, 8), "header_text": _translated(a, 10), "description_text": _translated(a, 11), "tts_header_text": _translated(a, 12),
                       "tts_description_text": _translated(a, 13), "active_period_count": len(periods), "informed_entity_count": len(informed)}
            )
            for i, p in enumerate(map(fields, periods)):
                out["service_alert_active_periods"].append(own | {"active_period_index": i, "start_time_utc": _when(_one(p, 1)), "end_time_utc": _when(_one(p, 2))})
            for i, e in enumerate(map(fields, informed)):
                trip = _sub(e, 4)
                out["service_alert_informed_entities"].append(
                    own | _trip(trip) | {"informed_entity_index": i, "agency_id": text(_one(e, 1)), "route_id": text(_one(e, 2)), "route_type": signed(_one(e, 3), 32), "stop_id": text(_one(e, 5)), "direction_id": _one(e, 6), "trip_schedule_relationship": _one(trip, 4)}
                )
    out["feed_snapshots"].append(common | {"entity_count": len(entities), "vehicle_entity_count": seen["vehicle"], "trip_update_entity_count": seen["trip_update"], "alert_entity_count": seen["alert"], "byte_size": len(data)})
    return out


def read_table(spark: SparkSession, root: str, name: str, *, glob: str = "*.pb", skip_bad: bool = True) -> DataFrame:
    """One of the tables of all snapshots under root. Files that can't be decoded, or aren't snapshots, are skipped (or fail the job)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "content")
    return decode_table(files, name, skip_bad=skip_bad)


def decode_table(files: DataFrame, name: str, *, skip_bad: bool = True) -> DataFrame:
    """One of the tables of files (path, content); works on streams too."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(SCHEMAS[name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    rows = decode(data, path)[name]
                except WireError:
                    if not skip_bad:
                        raise
                    continue
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return files.mapInArrow(run, schema)


def decode_nested(files: DataFrame, *, skip_bad: bool = True) -> DataFrame:
    """All tables of files (path, content) at once: a row a file, each table an array of its rows. `split` takes one out."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, StructField, StructType

    schema = StructType([StructField(name, ArrayType(StructType.fromDDL(ddl))) for name, ddl in SCHEMAS.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                try:
                    rows = decode(batch.column("content")[i].as_py(), batch.column("path")[i].as_py())
                except WireError:
                    if not skip_bad:
                        raise
                    continue
                yield pa.RecordBatch.from_pylist([rows], arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def split(nested: DataFrame, name: str) -> DataFrame:
    return nested.select(F.explode(name).alias("row")).select("row.*")


def _folders(spark: SparkSession, root: str, dates: list[str] | None, feeds: list[str] | None) -> list[str]:
    """Folders <root>/<feed>/<date> that are there, of the named dates and feeds; only names are listed."""
    given = lambda names: "{" + ",".join(names) + "}" if names else "*"
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{given(feeds)}/{given(dates)}")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return [s.getPath().toString() for s in found or [] if s.isDirectory()]


def snapshots(spark: SparkSession, root: str, *, glob: str = "*.pb", dates: list[str] | None = None, feeds: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Files (path, content) of snapshots under root: of the named dates and feeds, and of those the `most` first by path.

    Dates and feeds choose the folders that are listed at all; `most` chooses paths before any content is read.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    if dates or feeds:
        places = _folders(spark, root, dates, feeds)
        if not places:
            return spark.createDataFrame([], "path string, content binary")
    else:
        reader, places = reader.option("recursiveFileLookup", "true"), [root]
    files = reader.load(places)
    if most is not None:
        names = [r["path"] for r in files.select("path").orderBy("path").limit(most).collect()]  # paths alone, as many as were asked for
        if not names:
            return files.select("path", "content")
        files = spark.read.format("binaryFile").load(names)
    return files.select("path", "content")


def preview(data: bytes, path: str, *, entities: int = 3, stops: int = 5) -> str:
    """A snapshot's counts and first rows as text."""
    tables = decode(data, path)
    lines = [f"{k}: {v}" for k, v in tables["feed_snapshots"][0].items()]
    for name, most in (("trip_updates", entities), ("stop_time_updates", stops), ("vehicle_positions", entities), ("service_alerts", entities)):
        lines += [f"{name} ({len(tables[name])})", *("  " + ", ".join(f"{k}={v}" for k, v in row.items() if v is not None and k not in ("snapshot_path", "snapshot_date")) for row in tables[name][:most])]
    return "\n".join(lines)
