import json

from pyspark.sql import functions as F

from tidetable.sources import exports


def test_dashboard_nests_routes(spark, tmp_path):
    routes = spark.createDataFrame([("7", 0.9123456789), ("8", None)], "route_id string, on_time_rate double")
    hours = spark.createDataFrame([("7", 9, 0.5), ("7", 8, 0.25)], "route_id string, hour_of_day int, on_time_rate double")
    stops = spark.createDataFrame([("7", "s", 1)], "route_id string, stop_id string, observations long")
    moves = spark.createDataFrame([("7", "s", "8", 30 + i % 3, 0.5) for i in range(25)], "from_route_id string, from_stop_id string, to_route_id string, attempts long, success_rate double")
    rows = exports.dashboard(routes, hours, stops, moves)
    got = {r["route_id"]: json.loads(r["json"]) for r in rows.collect()}
    assert [h["hour_of_day"] for h in got["7"]["hours"]] == [8, 9] and got["7"]["on_time_rate"] == 0.912346
    assert len(got["7"]["transfers"]) == 20 and got["7"]["transfers"][0]["attempts"] == 32
    assert got["8"] == {"route_id": "8"}
    exports.write_documents(rows, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2


def test_timetable_document(spark):
    stops = spark.createDataFrame([("s", "Main", 1.0, 2.0)], "stop_id string, stop_name string, stop_lat double, stop_lon double")
    patterns = spark.createDataFrame([("7", 0, ["s", "t"], ["a"])], "route_id string, direction_id int, stops array<string>, trips array<string>")
    walks = spark.createDataFrame([("s", "t", 40)], "from_stop string, to_stop string, seconds long")
    got = json.loads(exports.timetable(patterns, stops, walks).first()["json"])
    assert got["patterns"][0]["trips"] == ["a"] and got["footpaths"][0]["seconds"] == 40 and got["stops"][0]["stop_name"] == "Main"


def test_only_verified_old_folders_go(spark):
    schema = "feed string, date string, name string, size long"
    local = spark.createDataFrame([("f", "2024-01-01", "a", 1), ("f", "2024-01-01", "b", 2), ("f", "2024-01-02", "a", 1), ("f", "2024-02-01", "a", 1)], schema)
    remote = spark.createDataFrame([("f", "2024-01-01", "a", 1), ("f", "2024-01-01", "b", 3), ("f", "2024-01-02", "a", 1), ("f", "2024-02-01", "a", 1)], schema)
    assert [r["date"] for r in exports.removable(local, remote, days=7, today="2024-02-02").collect()] == ["2024-01-02"]


def test_stale_snapshots(spark):
    files = spark.range(3).select(F.col("id").cast("string").alias("path"), F.timestamp_seconds(F.col("id") * 3600).alias("collected_at_utc"))
    got = exports.stale_snapshots(files, window_minutes=50, stride_minutes=10, now=F.timestamp_seconds(F.lit(7200)))
    assert [r["path"] for r in got.collect()] == ["0"]
