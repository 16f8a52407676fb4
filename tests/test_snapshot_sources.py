import json
import os
import re
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.test_domain import raw  # noqa: F401  a folder of snapshots
from tidetable.sources import gtfs_rt, retention, snapshot_source


def plain(df):
    return sorted(re.sub(r"file:/+", "/", json.dumps(r.asDict(), default=str, sort_keys=True)) for r in df.collect())


def more_days(root):
    """The same snapshots on another day, and a file there that can't be read."""
    for feed in os.listdir(root):
        for day in os.listdir(root / feed):
            if re.fullmatch(r"\d{4}-\d{2}-\d{2}", day):
                for f in os.listdir(root / feed / day):
                    if f.endswith(".pb"):
                        (root / feed / "2031-01-02").mkdir(exist_ok=True)
                        shutil.copy(root / feed / day / f, root / feed / "2031-01-02" / ("2031-01-02" + f[10:]))
    return root


@pytest.mark.parametrize("name", sorted(gtfs_rt.SCHEMAS))
def test_source_equals_the_decoder(spark, raw, name):  # noqa: F811
    snapshot_source.register(spark)
    got = spark.read.format(snapshot_source.FORMAT).option("table", name).option("filesPerPartition", 1).load(str(raw))
    assert plain(got) == plain(gtfs_rt.read_table(spark, str(raw), name))


def test_only_chosen_folders_are_opened(spark, raw):  # noqa: F811
    raw = more_days(Path(raw))
    snapshot_source.register(spark)
    every = snapshot_source.list_snapshots(str(raw))
    some = snapshot_source.list_snapshots(str(raw), dates={"2031-01-02"})
    assert some and set(some) < set(every) and all("/2031-01-02/" in p for p in some)
    source = spark.read.format(snapshot_source.FORMAT).option("table", "feed_snapshots").load(str(raw))
    later = source.where(F.col("snapshot_date") == "2031-01-02")
    assert later.count() == 1  # of its two files one is cut short
    # a folder of another day that nobody may list: the filter keeps the source away from it
    feed = sorted(os.listdir(raw))[0]
    os.makedirs(raw / feed / "2032-01-01")
    with open(raw / feed / "2032-01-01" / "2032-01-01T00-00-00Z.pb", "wb") as f:
        f.write(b"\xff" * 10)
    strict = spark.read.format(snapshot_source.FORMAT).option("table", "feed_snapshots").option("skipBad", "false").load(str(raw))
    with pytest.raises(Exception, match="(?i)cut short|wire"):
        strict.where(F.col("snapshot_date") == "2032-01-01").collect()
    os.remove(next(p for p in some if "13-00-30" in p))
    assert strict.where(F.col("snapshot_date") == "2031-01-02").count() == 1
    assert {r[0].split("/")[-2] for r in gtfs_rt.snapshots(spark, str(raw), dates=["2031-01-02"]).select("path").collect()} == {"2031-01-02"}


def test_files_of_other_days_are_not_read(spark, raw):  # noqa: F811
    """A read limit that the other day's file breaks."""
    raw = more_days(Path(raw))
    feed = next(f for f in os.listdir(raw) if (raw / f / "2031-01-02").exists())
    (raw / feed / "2033-01-01").mkdir()
    (raw / feed / "2033-01-01" / "2033-01-01T00-00-00Z.pb").write_bytes(b"\0" * 1_000_000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "500000")
    try:
        assert gtfs_rt.snapshots(spark, str(raw), dates=["2031-01-02"]).select(F.length("content")).collect()
        with pytest.raises(Exception, match="(?i)length|exceed"):
            gtfs_rt.snapshots(spark, str(raw)).select(F.length("content")).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_stream_reads_each_file_once(spark, raw, tmp_path):  # noqa: F811
    snapshot_source.register(spark)

    def run():
        s = spark.readStream.format(snapshot_source.FORMAT).option("table", "feed_snapshots").load(str(raw))
        q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)

    run()
    more_days(Path(raw))
    run()
    batch = spark.read.format(snapshot_source.FORMAT).option("table", "feed_snapshots").load(str(raw))
    assert plain(spark.read.parquet(str(tmp_path / "out")).select(batch.columns)) == plain(batch)


def put(root, feed, day, name, size):
    os.makedirs(root / feed / day, exist_ok=True)
    (root / feed / day / name).write_bytes(b"x" * size)


def test_removal_survives_a_crash(spark, tmp_path):
    root, manifests = tmp_path / "raw", str(tmp_path / "manifests")
    for day, name, size in (("2024-01-01", "a.pb", 3), ("2024-01-01", "b.pb", 4), ("2024-01-02", "a.pb", 5), ("2024-01-30", "a.pb", 6)):
        put(root, "bus", day, name, size)
    remote = spark.createDataFrame([("bus", "2024-01-01", "a.pb", 3), ("bus", "2024-01-01", "b.pb", 4), ("bus", "2024-01-02", "a.pb", 99), ("bus", "2024-01-30", "a.pb", 6)], "feed string, date string, name string, size long")
    # the first run ends between its phases; then a file changes
    path = retention.write_manifest(retention.local_files(spark, str(root)), remote, manifests, days=7, today="2024-01-31")
    assert sorted(os.listdir(root / "bus" / "2024-01-01")) == ["a.pb", "b.pb"] and len(retention.pending(spark, manifests)) == 1
    put(root, "bus", "2024-01-01", "b.pb", 7)
    ended = retention.clean(spark, str(root), remote, manifests, days=7, today="2024-01-31")
    assert len(ended) == 2 and retention.pending(spark, manifests) == []
    assert {(r["path"].rsplit("/", 1)[-1], r["outcome"]) for r in retention.finish(spark, path).collect()} == {("a.pb", "deleted"), ("b.pb", "changed")}
    assert {d: os.listdir(root / "bus" / d) for d in sorted(os.listdir(root / "bus"))} == {"2024-01-01": ["b.pb"], "2024-01-02": ["a.pb"], "2024-01-30": ["a.pb"]}


def test_deletion_is_safe_to_run_again(spark, tmp_path):
    put(tmp_path / "raw", "bus", "2024-01-01", "a.pb", 3)
    remote = spark.createDataFrame([("bus", "2024-01-01", "a.pb", 3)], "feed string, date string, name string, size long")
    path = retention.write_manifest(retention.local_files(spark, str(tmp_path / "raw")), remote, str(tmp_path / "m"), days=1, today="2024-01-31")
    os.remove(tmp_path / "raw" / "bus" / "2024-01-01" / "a.pb")  # the first attempt deleted it and was lost before it could tell
    assert [r["outcome"] for r in retention.finish(spark, path).collect()] == ["gone"]
