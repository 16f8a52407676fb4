import json

import pytest
from pyspark.sql import functions as F

from tests.test_domain import feed, raw  # noqa: F401  a folder of snapshots
from tidetable import cli
from tidetable.plans import boosting
from tidetable.sources import tables


@pytest.fixture()
def run(spark, monkeypatch):
    monkeypatch.setattr(cli, "build", lambda **_: spark)
    return lambda *args: cli.main([str(x) for x in args])


def text(spark, path):
    return spark.read.text(str(path), wholetext=True).first()[0]


def feature_rows(spark):
    return spark.range(2400).selectExpr(
        "CAST(date_add(DATE '2024-01-01', CAST(id % 4 AS int)) AS string) AS snapshot_date", "concat('t', id % 40) AS trip_id", "concat('s', id % 6) AS stop_id", "id % 6 AS stop_sequence", "concat('r', id % 3) AS route_id", "id % 2 AS direction_id", "'bus_x' AS feed_name",
        "CAST(id % 24 AS int) AS hour_of_day", "CAST(id % 7 AS int) AS day_of_week", "timestamp_seconds(1704067200 + (id % 4) * 86400 + id * 30) AS scheduled_arrival_utc", "timestamp_seconds(1704067200 + (id % 4) * 86400 + id * 30 + id % 700 - 100) AS predicted_arrival_utc", "CAST(id % 700 - 100 AS double) AS delay_seconds", "43.0D AS stop_lat", "CASE WHEN id % 6 = 0 THEN NULL ELSE -80.0D END AS stop_lon",
    )


def test_reliability_command(spark, run, tmp_path):
    rows = feature_rows(spark)
    rows.withColumn("date", F.col("snapshot_date")).write.partitionBy("date").parquet(str(tmp_path / "features"))
    run("reliability", "--features", tmp_path / "features", "--output", tmp_path / "out", "--end-date", "2024-01-04", "--start-date", "2024-01-02", "--max-abs-delay-seconds", 500, "--min-observations", 300)
    got = {r["route_id"]: r for r in spark.read.parquet(str(tmp_path / "out/route_summary.parquet")).collect()}
    expected = rows.where("snapshot_date IN ('2024-01-02', '2024-01-03') AND abs(delay_seconds) <= 500").groupBy("route_id").agg(F.count("*").alias("n"), F.median("delay_seconds").alias("m"), F.countDistinct("trip_id").alias("t")).collect()
    assert {r["route_id"]: (r["n"], r["m"], r["t"]) for r in expected} == {k: (r["observations"], r["median_delay_seconds"], r["trips"]) for k, r in got.items()}
    stops = spark.read.parquet(str(tmp_path / "out/stop_summary.parquet"))
    assert "stop_lat" in stops.columns and "route_id" not in stops.columns and stops.where("stop_lon IS NULL").count() == 1
    report = text(spark, tmp_path / "out/report.md")
    assert [x for x in report.split("\n") if x.startswith("## ")] == ["## System", "## By mode", "## Least reliable routes (at least 300 observations)", "## Least reliable route stops (at least 300 observations)", "## Least reliable dates", "## Tables"]
    assert "%" in report and "| r0 |" in report and "| r0 | s0 |" not in report


def test_bunching_and_transfer_commands(spark, run, tmp_path):
    rows = feature_rows(spark)
    rows.withColumn("date", F.col("snapshot_date")).write.partitionBy("date").parquet(str(tmp_path / "features"))
    run("bunching", "--features", tmp_path / "features", "--output", tmp_path / "bunching", "--min-observations", 1, "--bunched-ratio", 0.9, "--min-scheduled-headway-seconds", 1, "--max-scheduled-headway-minutes", 600)
    events = spark.read.parquet(str(tmp_path / "bunching/events"))
    assert events.count() and events.where("is_bunched <> (headway_ratio < 0.9)").count() == 0
    assert "## Most bunched by route_id (at least 1 headways)" in text(spark, tmp_path / "bunching/report.md")
    spark.createDataFrame([(f"s{i}", "bus_x", "43.0", f"-80.000{i}") for i in range(6)], "stop_id string, feed_name string, stop_lat string, stop_lon string").write.parquet(str(tmp_path / "static/stops"))
    run("transfers", "--delay", tmp_path / "features", "--static", tmp_path / "static", "--output", tmp_path / "transfers", "--max-walk-m", 100, "--max-wait-minutes", 20, "--date", "2024-01-01")
    events = spark.read.parquet(str(tmp_path / "transfers/events"))
    assert events.count() and events.agg(F.max("walk_distance_m")).first()[0] <= 100 and events.agg(F.max("scheduled_wait_seconds")).first()[0] <= 1200
    before = spark.read.parquet(str(tmp_path / "transfers/route_pairs.parquet")).count()
    run("transfers", "--delay", tmp_path / "gone", "--static", tmp_path / "gone", "--output", tmp_path / "transfers", "--summaries-only", "--overwrite", "--min-observations", 10**6)
    assert before and spark.read.parquet(str(tmp_path / "transfers/route_pairs.parquet")).count() == 0


def static(spark, root):
    day = "'bus_trip_updates' AS feed_name, DATE '2024-01-09' AS p_snapshot_date, "
    for name, sql in {
        "stop_times": "'t1' AS trip_id, stop_id, CAST(n AS string) AS stop_sequence, concat('08:0', n, ':00') AS arrival_time, concat('08:0', n, ':00') AS departure_time FROM VALUES ('s1', 4), ('s2', 5) t(stop_id, n)",
        "trips": "'t1' AS trip_id, '7' AS route_id, 'wk' AS service_id, 'Centre' AS trip_headsign, '1' AS direction_id, 'sh' AS shape_id",
        "routes": "'7' AS route_id, '7' AS route_short_name, '3' AS route_type",
        "stops": "stop_id, stop_id AS stop_name, '43.5' AS stop_lat, '-80.5' AS stop_lon FROM VALUES ('s1'), ('s2') t(stop_id)",
        "calendar": "'wk' AS service_id, '1' AS monday, '1' AS tuesday, '1' AS wednesday, '1' AS thursday, '1' AS friday, '0' AS saturday, '0' AS sunday, '20240101' AS start_date, '20241231' AS end_date",
        "calendar_dates": "'wk' AS service_id, '20240111' AS date, '2' AS exception_type",
    }.items():
        spark.sql(f"SELECT {day}{sql}").write.parquet(f"{root}/{name}")


def test_live_command(spark, run, raw, tmp_path):  # noqa: F811
    static(spark, str(tmp_path / "static"))
    tree = boosting.Tree()
    tree.value[0] = 11.0
    boosting.save(spark, boosting.Boosted(boosting.Coding({"hour_of_day": [5.0]}, {}), (0.1, 0.5, 0.9), (300.0, 310.0, 320.0), ((), (tree,), ())), str(tmp_path / "model/model"))
    run("live", "--raw", raw, "--static", tmp_path / "static", "--model", tmp_path / "model", "--output", tmp_path / "out", "--now", "2024-01-10T13:00:30+00:00", "--window-minutes", 90)
    told = json.loads(text(spark, tmp_path / "out/live"))
    assert told["totals"] == {"stopArrivals": 1, "trips": 1, "routes": 1} and told["generatedAtUtc"] == "2024-01-10T13:00:30Z" and told["intervalQuantiles"] == [0.1, 0.9]
    assert [(r["route_id"], r["arrivals"], r["late"]) for r in told["routes"]] == [("7", 1, 1)]
    worst = told["worstArrivals"][0]
    assert (worst["stop_id"], worst["predicted_delay_seconds"], worst["predicted_delay_lower_seconds"], worst["predicted_delay_upper_seconds"]) == ("s1", 321.0, 300.0, 321.0)
    assert [(v["route_id"], v["trip_headsign"], v["predicted_delay_seconds"]) for v in told["vehicles"]] == [("7", "Centre", 321.0)]
    assert spark.read.parquet(str(tmp_path / "out/log")).count() == 1


def test_timetable_command(spark, run, tmp_path):
    static(spark, str(tmp_path / "static"))
    run("timetable", "--static", tmp_path / "static", "--output", tmp_path / "out", "--date", "2024-01-10")
    got = json.loads(text(spark, tmp_path / "out/timetable"))
    assert [(p["stops"], p["trips"]) for p in got["patterns"]] == [(["s1", "s2"], ["t1"])] and len(got["footpaths"]) == 1
    run("timetable", "--static", tmp_path / "static", "--output", tmp_path / "off", "--date", "2024-01-11")  # an exception takes the service out
    assert json.loads(text(spark, tmp_path / "off/timetable")).get("patterns", []) == []


def test_retention_command(spark, run, raw, tmp_path, capsys):  # noqa: F811
    spark.createDataFrame([("bus_trip_updates", "2024-01-10", n, len(feed()) - cut) for n, cut in (("2024-01-10T13-00-00Z.pb", 0), ("2024-01-10T13-00-30Z.pb", 3))], "feed string, date string, name string, size long").write.parquet(str(tmp_path / "remote"))
    run("retention", "--raw", raw, "--remote", tmp_path / "remote", "--manifests", tmp_path / "manifests", "--days", 7, "--now", "2024-03-01")
    assert "'deleted': 2" in capsys.readouterr().out


def test_cells():
    assert [tables.cell(*x) for x in ((0.123456, "percent"), (61.6, "seconds"), (None, "percent"), (1.23456,), ("x",), (3,))] == ["12.3%", "62s", "", "1.235", "x", "3"]
