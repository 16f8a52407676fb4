"""Spark data source of realtime snapshots: spark.read.format("tidetable_snapshots"), and the same as a stream.

A partition is a slice of files; dates and feeds, whether options or filters on snapshot_date and feed_name, choose the
folders that are listed, so files of other days are never looked at. Listing and reading go through Arrow's file systems.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from .gtfs_rt import SCHEMAS, decode
from .wire import WireError

FORMAT = "tidetable_snapshots"
_DAY = re.compile(r"\d{4}-\d{2}-\d{2}$")
_NAME = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}Z\.pb$")


def _folder(fs: pafs.FileSystem, path: str) -> list[pafs.FileInfo]:
    return sorted(fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)), key=lambda f: f.base_name)


def list_snapshots(root: str, feeds: set[str] | None = None, dates: set[str] | None = None) -> list[str]:
    """Paths (in the root's file system) of <root>/<feed>/<date>/<time>.pb, by feed, date and time; only the chosen folders are opened."""
    fs, base = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)
    out = []
    for feed in _folder(fs, base):
        if feed.type != pafs.FileType.Directory or feeds is not None and feed.base_name not in feeds:
            continue
        for day in _folder(fs, feed.path):
            if day.type == pafs.FileType.Directory and _DAY.match(day.base_name) and (dates is None or day.base_name in dates):
                out += [f.path for f in _folder(fs, day.path) if f.type == pafs.FileType.File and _NAME.match(f.base_name)]
    return out


def _chosen(text: str | None) -> set[str] | None:
    return {x.strip() for x in text.split(",") if x.strip()} if text is not None else None


@dataclass
class Slice(InputPartition):
    paths: Sequence[str]


class _Decoder:
    """What batch and stream share: options and the reading of a slice."""

    def __init__(self, options, schema: StructType):
        self.root, self.table = options["path"], options.get("table", "stop_time_updates")
        self.each, self.skip = int(options.get("filesperpartition", "64")), options.get("skipbad", "true").lower() == "true"
        self.feeds, self.dates, self.schema = _chosen(options.get("feed")), _chosen(options.get("date")), schema

    def slices(self, paths: list[str]) -> list[Slice]:
        return [Slice(paths[i : i + self.each]) for i in range(0, len(paths), self.each)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fs = pafs.FileSystem.from_uri(self.root)[0] if "://" in self.root else pafs.LocalFileSystem()
        arrow = to_arrow_schema(self.schema)
        for path in partition.paths if partition else ():
            with fs.open_input_stream(path) as f:
                content = f.read()
            try:
                rows = decode(content, path)[self.table]
            except WireError:
                if not self.skip:
                    raise
                continue
            if rows:
                yield pa.RecordBatch.from_pylist(rows, arrow)


class _Batch(_Decoder, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality on snapshot_date and feed_name chooses folders; what isn't understood is left to Spark."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name not in ("snapshot_date", "feed_name"):
                yield f
                continue
            wanted = {str(v) for v in ([f.value] if isinstance(f, EqualTo) else f.value) if v is not None}
            kept = "dates" if name == "snapshot_date" else "feeds"
            had = getattr(self, kept)
            setattr(self, kept, wanted if had is None else had & wanted)

    def partitions(self) -> list[Slice]:
        return self.slices(list_snapshots(self.root, self.feeds, self.dates)) or [Slice([])]


class _Stream(_Decoder, DataSourceStreamReader):
    """The offset is the newest time in a file's name; files that land later under an older time are not seen."""

    def _stems(self) -> list[tuple[str, str]]:
        return sorted((p.rsplit("/", 1)[-1], p) for p in list_snapshots(self.root, self.feeds, self.dates))

    def initialOffset(self) -> dict:
        return {"upto": ""}

    def latestOffset(self) -> dict:
        return {"upto": max((s for s, _ in self._stems()), default="")}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return self.slices([p for s, p in self._stems() if start["upto"] < s <= end["upto"]]) or [Slice([])]

    def commit(self, end: dict) -> None:
        pass


class SnapshotSource(DataSource):
    """Options: path (root), table (one of the seven), date, feed (several with commas between), filesPerPartition, skipBad."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "stop_time_updates")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SnapshotSource)
