import io
import json
import struct
import zipfile
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidetable.cli import parser
from tidetable.functions import columns as C
from tidetable.operators import joins, metrics, windows
from tidetable.plans import baselines, bunching, catalog, dashboard, delay, evaluation, features, model, planner, shapes, timetable, transfers
from tidetable.plans import live as live_plans
from tidetable.sources import gtfs_rt, gtfs_static, tables, weather, wire
from tidetable.streaming import live


def utc(*x):
    return datetime(*x, tzinfo=timezone.utc)


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("day", "time", "start", "expected"),
    [
        ("20240110", "25:30:00", "01:30:00", utc(2024, 1, 10, 6, 30)),  # dated by the new day already
        ("20240110", "25:30:00", "23:00:00", utc(2024, 1, 11, 6, 30)),
        ("20240110", "08:00:00", "07:30:00", utc(2024, 1, 10, 13, 0)),
        ("20240310", "02:30:00", "02:00:00", utc(2024, 3, 10, 7, 30)),  # the hour that spring skips
        ("20241103", "01:30:00", "01:00:00", utc(2024, 11, 3, 6, 30)),  # the hour that comes twice: the later
        ("20240701", "12:00:00", "11:00:00", utc(2024, 7, 1, 16, 0)),
    ],
)
def test_schedule_time(spark, day, time, start, expected):
    seconds = one(spark, F.unix_seconds(C.scheduled_utc(F.lit(day), F.lit(time), F.lit(start))))
    assert seconds == int(expected.timestamp())


def test_bad_schedule_time_is_null(spark):
    assert one(spark, C.gtfs_seconds(F.lit("soon"))) is None


@pytest.mark.parametrize(("delay_s", "flags"), [(-60.0, (False, True, False)), (-60.5, (True, False, False)), (300.0, (False, True, False)), (300.5, (False, False, True))])
def test_delay_limits(spark, delay_s, flags):
    got = spark.createDataFrame([(delay_s,)], "d double").select(*(c.alias(n) for n, c in C.delay_flags("d").items())).first()
    assert (got["is_early"], got["is_on_time"], got["is_late"]) == flags


def test_interval_holds_the_point(spark):
    lo, hi = C.interval_clamp(F.lit(5.0), F.lit(7.0), F.lit(3.0))
    assert (one(spark, lo), one(spark, hi)) == (5.0, 5.0)


def test_lead_buckets(spark):
    rows = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 4.9, 5.0, 40.0)], "m double").select(C.lead_bucket("m").alias("b")).collect()
    assert [r["b"] for r in rows] == [None, "00-05", "00-05", "05-10", "40+"]


def test_loop_trip_keeps_both_visits_only_on_request(spark):
    base = Row(snapshot_date="2024-01-10", collected_at_utc=utc(2024, 1, 10, 12), feed_name="bus_x", trip_id="t", route_id="r", direction_id=0, vehicle_id="v", stop_id="s", start_date="20240110", start_time="07:00:00", arrival_time_utc=utc(2024, 1, 10, 13), departure_time_utc=None, stop_sequence=1).asDict()
    schema = "snapshot_date string, collected_at_utc timestamp, feed_name string, trip_id string, route_id string, direction_id long, vehicle_id string, stop_id string, start_date string, start_time string, arrival_time_utc timestamp, departure_time_utc timestamp, stop_sequence long"
    updates = spark.createDataFrame([base, base | {"stop_sequence": 9}], schema)
    static = spark.createDataFrame([("t", "s", "1", "08:00:00", "bus_x", "2024-01-10"), ("t", "s", "9", "08:05:00", "bus_x", "2024-01-10")], "trip_id string, stop_id string, stop_sequence string, arrival_time string, feed_name string, p_snapshot_date string")
    assert delay.delay_table(updates, static).count() == 1
    both = delay.delay_table(updates, static, dedup_by_sequence=True).orderBy("stop_sequence").collect()
    assert [r["delay_seconds"] for r in both] == [0.0, -300.0]


def test_light_rail_counts_from_one(spark):
    rows = spark.createDataFrame([("lrt_a", 3), ("bus_a", 3)], "feed_name string, stop_sequence long").select(delay.sequence_key().alias("k")).collect()
    assert [r["k"] for r in rows] == [2, 3]


def test_bunching_counts_overtaking_and_undefined_wait(spark):
    rows = spark.createDataFrame([("t1", 0, 0), ("t2", 600, -60), ("t3", 1200, 700)], "trip_id string, s long, a long").select(
        F.lit("d").alias("snapshot_date"), F.lit("r").alias("route_id"), F.lit(0).alias("direction_id"), F.lit("x").alias("stop_id"), "trip_id", F.timestamp_seconds("s").alias("scheduled_arrival_utc"), F.timestamp_seconds("a").alias("actual_arrival_utc")
    )
    events = bunching.events(rows)
    got = {r["trip_id"]: (r["leader_trip_id"], r["is_bunched"], r["is_gapped"]) for r in events.collect()}
    assert got == {"t2": ("t1", True, False), "t3": ("t2", False, False)}
    undefined = bunching.rollup(events.where("trip_id = 't2'"), ("route_id",)).first()
    assert undefined["excess_wait_seconds"] is None


@pytest.mark.parametrize(("depart", "made"), [(130, True), (129, False)])
def test_transfer_at_the_last_second(spark, depart, made):
    schema = "snapshot_date string, trip_id string, route_id string, direction_id int, stop_id string, feed_name string, scheduled_s long, actual_s long"
    observed = spark.createDataFrame([("d", "a", "1", 0, "s", "f", 100, 100), ("d", "b", "2", 0, "s", "f", 200, depart)], schema)
    pairs = transfers.stop_pairs(spark.createDataFrame([("s", "f", 43.4, -80.5)], "stop_id string, feed_name string, stop_lat double, stop_lon double"))
    events = transfers.proposed(transfers.candidates(observed, pairs)).collect()
    assert [(r["from_trip_id"], r["to_trip_id"], r["made_transfer"]) for r in events] == [("a", "b", made)]


def test_connections_are_those_of_all_candidates(spark):
    """Busy stops in walking distance, trips that come twice, equal times and missing values: the same first connections, without a row for each candidate."""
    rng = np.random.default_rng(7)
    pick = lambda *a: a[int(rng.integers(0, len(a)))]
    rows = [(pick("d1", "d2"), f"t{int(rng.integers(0, 90)):02}", pick("1", "2", "3", None), pick(0, 1, None), pick("s", "u", "v"), pick("f", "g"), pick(None, *range(0, 5400, 60)), int(rng.integers(0, 6000))) for _ in range(500)]
    rows = list({(r[0], r[1], r[4], r[5], r[6]): r for r in rows}.values())  # a trip calls at a stop once a second
    observed = spark.createDataFrame(rows, "snapshot_date string, trip_id string, route_id string, direction_id int, stop_id string, feed_name string, scheduled_s long, actual_s long")
    walks = [(a, f, b, f, 40.0 * abs(i - j), max(30.0, 33.5 * abs(i - j))) for f in "fg" for i, a in enumerate("suv") for j, b in enumerate("suv")]
    pairs = spark.createDataFrame(walks, "from_stop_id string, from_feed string, to_stop_id string, to_feed string, walk_distance_m double, walk_seconds double")
    every = transfers.candidates(observed, pairs)
    expected, got = transfers.proposed(every), transfers.connections(observed, pairs)
    assert sorted(got.columns) == sorted(expected.columns)
    key = ["snapshot_date", "from_trip_id", "from_stop_id", "to_route_id", "to_direction_id", "to_scheduled_s", "walk_seconds", "to_trip_id", "to_stop_id"]
    told = lambda df: sorted((tuple(r) for r in df.select(*key).collect()), key=str)
    assert told(got) == told(expected) and len(told(got)) > 500
    assert all(r["actual_margin_seconds"] == r["to_actual_s"] - r["from_actual_s"] - r["walk_seconds"] for r in got.collect())


@pytest.mark.parametrize("name", ["transfer_proposed", "transfer_stop_summary", "transfer_route_pairs", "top_transfers_per_route", "riskiest_transfers", "transfer_rate_lookup"])
def test_transfer_queries_join_no_candidates(spark, monkeypatch, name):
    monkeypatch.setattr(transfers, "candidates", lambda *_: pytest.fail("all candidates"))
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").columns


def test_grid_join_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform((43.4, -80.6), (43.42, -80.58), (120, 2)))]
    df = spark.createDataFrame(points, "stop_id int, lat double, lon double")
    every = df.alias("a").crossJoin(df.alias("b")).where(C.haversine_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) <= 300)
    expected = {tuple(r) for r in every.select("a.stop_id", "b.stop_id").collect()}
    got = [tuple(r) for r in joins.grid_band_join(df, 300.0).select("a_stop_id", "b_stop_id").collect()]
    assert len(got) == len(expected) and set(got) == expected


@pytest.mark.parametrize("pairs", ["all", "once"])
def test_grid_join_meets_places_not_copies(spark, pairs, monkeypatch):
    """Copies of a place in several blocks: all their pairs, none told to all executors."""
    monkeypatch.setattr(joins, "BLOCK", 8)
    points = [(i, 43.4 + i % 3 * 0.001, -80.5, "x" if i % 2 else "y") for i in range(90)] + [(99, None, -80.5, "x")]
    df = spark.createDataFrame(points, "stop_id int, lat double, lon double, kind string")
    found = joins.grid_band_join(df, 150.0, pairs=pairs, same=("kind",))
    got = [(r["a_stop_id"], r["b_stop_id"]) for r in found.collect()]
    near = lambda i, j: points[i][3] == points[j][3] and abs(i % 3 - j % 3) <= 1 and (pairs == "all" or i < j)
    assert sorted(got) == [(i, j) for i in range(90) for j in range(90) if near(i, j)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


@pytest.mark.parametrize("pairs", ["all", "once"])
@pytest.mark.parametrize("columns", [("stop_id", "lat", "lon"), ("kind", "stop_id", "lat", "lon")])
def test_grid_join_rounds_and_keeps_all_columns(spark, pairs, columns, monkeypatch):
    """Rows with one column of their own and with more, null ids among them, places of several blocks."""
    monkeypatch.setattr(joins, "BLOCK", 4)
    points = [(i if i % 7 else None, 43.4 + i % 5 * 0.0007, -80.5 - i % 2 * 0.0005, "x" if i % 3 else None) for i in range(60)]
    df = spark.createDataFrame(points, "stop_id int, lat double, lon double, kind string").select(*columns)
    a, b = (df.select(*(F.col(c).alias(f"{p}_{c}") for c in columns)) for p in "ab")
    every = a.crossJoin(b).withColumn("distance_m", C.haversine_m("a_lat", "a_lon", "b_lat", "b_lon")).where("distance_m <= 150")
    every = every.where("a_stop_id < b_stop_id") if pairs == "once" else every
    found = joins.grid_band_join(df, 150.0, pairs=pairs, digits=3)
    assert found.columns == every.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, every.withColumn("distance_m", F.round("distance_m", 3)).collect()))


def test_spatial_band_join_works_on_places_before_rows(spark):
    """Nothing is worked out anew for each pair of rows, and a task holds the pairs of one row at a time, not of two blocks."""
    plan = catalog.QUERIES["spatial_band_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    rows, held, others = plan.partition("Coalesce")
    assert held and rows.count("Generate explode(_rows_") == 1 and "Generate explode(_rows_" in others
    assert "round(" not in rows and "struct" not in rows and "round(" in others


def test_time_split_of_one_day(spark):
    got = baselines.time_split(spark.createDataFrame([("2024-01-01",)] * 3, "snapshot_date string")).collect()
    assert [(r["is_train"], r["is_validation"]) for r in got] == [(True, True)]


def test_old_log_without_intervals(spark, tmp_path):
    spark.createDataFrame([("a", 1.0)], "trip_id string, predicted_delay_seconds double").write.parquet(str(tmp_path / "log/run=1"))
    spark.createDataFrame([("b", 1.0, 0.0, 2.0)], "trip_id string, predicted_delay_seconds double, predicted_delay_lower_seconds double, predicted_delay_upper_seconds double").write.parquet(str(tmp_path / "log/run=2"))
    both = tables.scan_evolving(spark, str(tmp_path / "log"), {c: "double" for c in evaluation.INTERVAL})
    assert {(r["trip_id"], r["predicted_delay_lower_seconds"]) for r in both.collect()} == {("a", None), ("b", 0.0)}
    assert set(evaluation.INTERVAL) <= set(evaluation.complete(both.drop(*evaluation.INTERVAL)).columns)


def test_guarded_write(spark, tmp_path):
    root = str(tmp_path / "t")
    day = lambda d, v: spark.createDataFrame([(d, v)], "date string, v int")
    tables.write(day("2024-01-01", 1), root)
    with pytest.raises(Exception, match="already exists"):
        tables.write(day("2024-01-02", 1), root)
    tables.write(day("2024-01-02", 2), root, overwrite=True)
    assert {(str(r["date"]), r["v"]) for r in spark.read.parquet(root).collect()} == {("2024-01-01", 1), ("2024-01-02", 2)}
    assert tables.scan(spark, root, dates=["2024-01-02"]).count() == 1
    assert "| v |" in tables.markdown(tables.scan(spark, root).select("v"))


# --- protobuf -------------------------------------------------------------------------------------------------------


def _varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def msg(**f):
    """f1=3 (number), f2="text", f3=b"message", f4=1.5 (float), lists repeat."""
    out = b""
    for key, values in f.items():
        number = int(key[1:])
        for v in values if isinstance(values, list) else [values]:
            if isinstance(v, float):
                out += _varint(number << 3 | 5) + struct.pack("<f", v)
            elif isinstance(v, int):
                out += _varint(number << 3) + _varint(v & (1 << 64) - 1)
            else:
                v = v.encode() if isinstance(v, str) else v
                out += _varint(number << 3 | 2) + _varint(len(v)) + v
    return out


def feed():
    trip = msg(f1="t1", f2="07:00:00", f3="20240110", f4=0, f5="7", f6=1)
    update = msg(f1="e1", f3=msg(f1=trip, f2=[msg(f1=4, f2=msg(f1=-30, f2=1704891600), f4="s1"), msg(f1=5, f3=msg(f2=0), f4="s2")], f3=msg(f1="v1"), f4=1704891500))
    vehicle = msg(f1="e2", f4=msg(f1=trip, f2=msg(f1=43.5, f2=-80.5), f3=4, f5=1704891490, f7="s1", f8=msg(f1="v1", f2="Bus 1")), f3=msg(f1=trip))
    say = lambda *x: msg(f1=[msg(f1=t, f2=lang) for t, lang in x])
    alert = msg(f1="e3", f5=msg(f1=[msg(f1=1, f2=2)], f5=[msg(f1="agency"), msg(f5="s1")], f6=1, f7=2, f10=say(("Bonjour", "fr"), ("Hello", "EN-ca")), f11=say(("Salut", "fr"))))
    return msg(f1=msg(f1="2.0", f3=1704891480), f2=[update, vehicle, alert])


def test_decode_snapshot():
    got = gtfs_rt.decode(feed(), "/raw/bus_trip_updates/2024-01-10/2024-01-10T13-00-00Z.pb")
    assert {k: len(v) for k, v in got.items()} == {"feed_snapshots": 1, "vehicle_positions": 1, "trip_updates": 1, "stop_time_updates": 2, "service_alerts": 1, "service_alert_active_periods": 1, "service_alert_informed_entities": 2}
    first, second = got["stop_time_updates"]
    assert (first["arrival_delay_seconds"], first["arrival_time_utc"], first["stop_id"], first["collected_at_utc"]) == (-30, utc(2024, 1, 10, 13), "s1", utc(2024, 1, 10, 13))
    assert (second["arrival_time_utc"], second["departure_time_utc"], second["stop_update_index"]) == (None, None, 1)
    alert = got["service_alerts"][0]
    assert (alert["header_text"], alert["description_text"], alert["url"]) == ("Hello", "Salut", None)
    snapshot = got["feed_snapshots"][0]
    assert (snapshot["entity_count"], snapshot["vehicle_entity_count"], snapshot["trip_update_entity_count"]) == (3, 1, 1)
    assert got["vehicle_positions"][0]["longitude"] == -80.5


def test_cut_message_is_refused():
    with pytest.raises(wire.WireError):
        wire.fields(feed()[:-3])


@pytest.fixture()
def raw(tmp_path):
    folder = tmp_path / "raw/bus_trip_updates/2024-01-10"
    folder.mkdir(parents=True)
    (folder / "2024-01-10T13-00-00Z.pb").write_bytes(feed())
    (folder / "2024-01-10T13-00-30Z.pb").write_bytes(feed()[:-3])
    return str(tmp_path / "raw")


def test_read_snapshots_skips_bad_files(spark, raw):
    rows = gtfs_rt.read_table(spark, raw, "stop_time_updates")
    assert rows.count() == 2 and rows.first()["feed_name"] == "bus_trip_updates"
    with pytest.raises(Exception, match="cut short"):
        gtfs_rt.read_table(spark, raw, "trip_updates", skip_bad=False).collect()


def archive(**files):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, content in files.items():
            z.writestr(f"{name}.txt", content)
    return buffer.getvalue()


STATIC = {"routes": "route_id,route_short_name\n1,\n", "stops": "﻿stop_id,stop_name\ns1,Main\n", "trips": "trip_id,route_id\nt1,1\n", "stop_times": "trip_id,stop_id\n"}


def test_static_feed(spark, tmp_path):
    folder = tmp_path / "static/bus/2024-01-10"
    folder.mkdir(parents=True)
    (folder / "GTFS.zip").write_bytes(archive(**STATIC))
    read = lambda t, c: gtfs_static.read_table(spark, str(tmp_path / "static"), t, c)
    assert tuple(read("routes", ["route_id", "route_short_name", "route_type"]).first())[:4] == ("1", None, None, "bus")
    assert read("stops", ["stop_id"]).first()["stop_id"] == "s1"  # without the byte-order mark
    assert read("stop_times", ["trip_id"]).count() == 0
    some = {t: read(t, ["trip_id"]) for t in ("trips", "stops")}
    assert str(gtfs_static.latest_complete(some).first()["p_snapshot_date"]) == "2024-01-10"


def test_incomplete_feed_is_refused():
    with pytest.raises(gtfs_static.FeedError, match="stop_times"):
        gtfs_static.members(archive(routes="", stops="", trips=""))
    with pytest.raises(gtfs_static.FeedError):
        gtfs_static.members(b"no archive")


def test_weather(spark, tmp_path):
    def hour(ts, icon):
        return {"timestamp": ts, "iconCode": {"value": icon}, "temperature": {"value": {"en": 3}}, "condition": {"en": "x"}}

    folder = tmp_path / "w/kitchener-waterloo/2024-01-10"
    folder.mkdir(parents=True)
    for name, icon in (("2024-01-10T00-00-00Z", "12"), ("2024-01-10T03-00-00Z", "16")):
        body = {"properties": {"hourlyForecastGroup": {"hourlyForecasts": [hour("2024-01-10T05:00:00Z", icon), hour("2024-01-10T06:00:00Z", None), hour(None, "1")]}}}
        (folder / f"{name}.json").write_text(json.dumps(body))
    got = {r["timestamp_utc_hour"].hour: r for r in weather.weather_features(weather.read_forecasts(spark, str(tmp_path / "w"))).collect()}
    assert (got[5]["is_rain"], got[5]["is_snow"], got[5]["is_precip"], got[5]["location"]) == (False, True, True, "kitchener-waterloo")
    assert (got[6]["is_rain"], got[6]["is_precip"]) == (None, None)


# --- timetable, planner, shapes ------------------------------------------------------------------------------------------


def test_services(spark):
    days = "monday tuesday wednesday thursday friday saturday sunday".split()
    rows = [("all", *["1"] * 7, "20240101", "20240131"), ("gone", *["1"] * 7, "20240101", "20240131"), ("late", *["1"] * 7, "20240201", "20240229"), ("weekend", *["0"] * 5, "1", "1", "20240101", "20240131")]
    calendar = spark.createDataFrame(rows, ["service_id", *days, "start_date", "end_date"])
    exceptions = spark.createDataFrame([("gone", "2"), ("extra", "1")], "service_id string, exception_type string")
    got = timetable.active_services(timetable.calendar_on(calendar, "2024-01-10"), exceptions)
    assert {r[0] for r in got.collect()} == {"all", "extra"}


def test_planner_equals_search(spark):
    rng = np.random.default_rng(5)
    trips = [(f"t{t}", "r", f"s{s}", i, int(60 * (t * 3 + i * 4 + rng.integers(0, 3)))) for t in range(12) for i, s in enumerate(rng.permutation(8)[:4])]
    walks = [("s0", "s1", 90), ("s2", "s5", 120)]
    rides = [(a[0], a[2], a[4], b[2], b[4]) for a in trips for b in trips if a[0] == b[0] and b[3] > a[3]]
    best = {"s0": 0}
    now = {"s0": 0}
    for k in range(1, 4):
        step = {}
        for _, a, d, b, t in rides:
            if a in now and d >= now[a] + (0 if k == 1 else 45):
                step[b] = min(step.get(b, 1 << 40), t)
        for a, b, s in [*walks, *((b, a, s) for a, b, s in walks)]:
            if a in (before := dict(step)):
                step[b] = min(step.get(b, 1 << 40), before[a] + s)
        now = {s: t for s, t in step.items() if t < best.get(s, 1 << 40)}
        best |= now
    times = spark.createDataFrame(trips, "trip_id string, route_id string, stop_id string, stop_sequence int, seconds long")
    found = planner.earliest_arrivals(spark.createDataFrame([(1, "s0", 0)], "query_id int, stop_id string, ready long"), planner.connections(times), spark.createDataFrame(walks, "from_stop string, to_stop string, seconds long"), rounds=3)
    rows = found.collect()
    got = {}
    for r in rows:
        got[r["stop_id"]] = min(got.get(r["stop_id"], 1 << 40), r["arrive"])
        ends = [x for leg in r["legs"] for x in (leg["depart"], leg["arrive"])]
        assert ends == sorted(ends)
    assert got == best


def test_itinerary_score(spark):
    rows = spark.createDataFrame([(1, 1000.0, [(0.5, 60.0, 60.0), (None, 60.0, 60.0)])], "query_id int, arrive_p90 double, transfers array<struct<observed_rate:double,slack_s:double,median_delay_s:double>>")
    got = planner.score(rows).first()
    assert got["success"] == pytest.approx(0.25) and got["score"] == pytest.approx(1000 + 0.75 * 900)


def test_plan_of_journeys(spark):
    """Two places, a direct ride and one with a change that comes earlier; the departure after; observed and estimated transfers."""
    stops = spark.createDataFrame([("a", 43.0, -80.0), ("b", 43.05, -80.0), ("c", 43.1, -80.0), ("far", 44.0, -80.0)], "stop_id string, stop_lat double, stop_lon double")
    trips = []
    for k, start in enumerate((1000, 1600)):
        trips += [(f"slow{k}", "S", "a", 1, start), (f"slow{k}", "S", "c", 2, start + 3000), (f"fast{k}", "F", "a", 1, start), (f"fast{k}", "F", "b", 2, start + 600), (f"on{k}", "G", "b", 1, start + 900), (f"on{k}", "G", "c", 2, start + 1500)]
    times = spark.createDataFrame(trips, "trip_id string, route_id string, stop_id string, stop_sequence int, seconds long")
    hours = spark.createDataFrame([("S", 0, 100, 400), ("G", 5, 40, 90), ("G", 6, 50, 101)], "route_id string, hour_of_day int, median_s long, p90_s long")
    rates = spark.createDataFrame([("F|G|b", 0.5)], "transfer string, success_rate double")
    queries = spark.createDataFrame([(1, 43.0, -80.001, 43.1, -80.001, 900), (2, 43.0, -80.0, 50.0, -80.0, 900)], "query_id int, from_lat double, from_lon double, to_lat double, to_lon double, depart long")
    rows = planner.plan(queries, stops, times, None, hours, rates).orderBy("place").collect()
    walk = round(haversine(43.0, -80.0, 43.0, -80.001) / 1.25)
    assert {r["query_id"] for r in rows} == {1} and [r["place"] for r in rows] == [1, 2, 3, 4]
    got = {r["leg_key"]: r for r in rows}
    # the direct ride is in hour 0; G has no hour 0, so the mean of its hours counts; F|G|b was observed
    one, two = got["S@1000"], got["F@1000>G@1900"]
    assert (one["arrive"], one["arrive_expected"], one["arrive_p90"], one["success"]) == (4000 + walk, 4100 + walk, 4400 + walk, 1.0)
    assert (two["arrive"], two["arrive_expected"], two["arrive_p90"], two["success"]) == (2500 + walk, 2545 + walk, 2596 + walk, 0.5)
    assert two["score"] == 2596 + walk + 450 and set(got) == {"S@1000", "F@1000>G@1900", "S@1600", "F@1600>G@2500"}
    plain = planner.plan(queries, stops, times, None, hours.limit(0), rates.limit(0)).where("leg_key = 'F@1000>G@1900'").first()
    assert plain["arrive_p90"] == 2500 + walk + 240 and plain["success"] == pytest.approx(min(0.98, 1 - 0.5 ** (300 / 60)))
    late = spark.createDataFrame([("F", 400.0), ("G", 900.0)], "route_id string, live_delay_s double")
    for now, success, expected in ((900, 1 - 0.5 ** (300 / 400), 900), (900 - 10**6, min(0.98, 1 - 0.5 ** (300 / 60)), 60)):
        told = planner.plan(queries.withColumn("now", F.lit(now)), stops, times, None, hours.limit(0), rates.limit(0), live=late).where("leg_key = 'F@1000>G@1900'").first()
        assert told["success"] == pytest.approx(success) and told["arrive_expected"] == 2500 + walk + expected


def haversine(lat1, lon1, lat2, lon2):
    a, b, c, d = map(np.radians, (lat1, lon1, lat2, lon2))
    return 2 * 6_371_000.0 * np.arcsin(np.sqrt(np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2))


def test_rounds_that_are_worth_it(spark):
    rows = spark.createDataFrame([(1, 1, 100), (1, 2, 80), (1, 3, 65), (2, 1, 50), (2, 2, 20)], "query_id int, round int, arrive long")
    assert sorted(tuple(r) for r in planner.improving(rows).collect()) == [(1, 1, 100), (1, 3, 65), (2, 1, 50)]


@pytest.mark.parametrize("n", [0, 7, 120, 1000])
def test_hash_sample_equals_a_sort(spark, n):
    import hashlib

    rows = spark.range(400).selectExpr("id", "id % 7 AS k")
    expected = sorted(range(400), key=lambda i: (hashlib.md5(f"{i}|{i % 7}".encode()).hexdigest(), i))[:n]
    assert sorted(r["id"] for r in baselines.hash_sample(rows, ("id", "k"), n).collect()) == sorted(expected)


def test_health_of_feeds(spark):
    from datetime import timedelta

    now = datetime(2024, 1, 10, 12)
    seen = [("bus", now - timedelta(minutes=4)), ("bus", now - timedelta(minutes=90)), ("alerts", now - timedelta(minutes=16))]
    expected = spark.createDataFrame([("bus", "realtime"), ("alerts", "alerts"), ("gone", "static")], "feed string, kind string")
    got = live_plans.health(spark.createDataFrame(seen, "feed string, updated timestamp"), expected, spark.createDataFrame([(now,)], "now timestamp"))
    assert {r["feed"]: (r["age_minutes"], r["is_fresh"]) for r in got.collect()} == {"bus": (4.0, True), "alerts": (16.0, False), "gone": (None, False)}


def test_lookups_as_json(spark):
    hours = spark.createDataFrame([("7", 8, 29, 1.0, 2.0), ("7", 9, 30, 12.5, 99.6), ("8", 9, 31, 13.5, 100.0)], "route_id string, hour_of_day int, observations long, median_delay_seconds double, p90_delay_seconds double")
    sums = spark.createDataFrame([("7", "8", "s1", 25, 0.12345), ("7", "8", "s2", 24, 0.5)], "from_route_id string, to_route_id string, from_stop_id string, attempts long, success_rate double")
    got = dashboard.lookups(dashboard.route_hours(hours), dashboard.transfer_rates(sums)).first()["json"]
    assert json.loads(got) == {"route_hours": {"7": {"9": [12, 100]}, "8": {"9": [14, 100]}}, "transfer_rates": {"7|8|s1": 0.123}}


def test_live_cycle(spark):
    from datetime import timedelta

    now = datetime(2024, 1, 10, 12)
    at = lambda m: now - timedelta(minutes=m)
    updates = spark.createDataFrame([(at(70), "t1", "r", "s1", 1, 60.0, 3.0), (at(20), "t1", "r", "s1", 1, 90.0, 3.0), (at(1), "t1", "r", "s1", 1, 400.0, 2.0), (at(1), "t1", "r", "s2", 2, 420.0, 9.0)], "collected_at_utc timestamp, trip_id string, route_id string, stop_id string, stop_sequence int, feed_delay_seconds double, prediction_lead_minutes double")
    positions = spark.createDataFrame([("v1", "e1", "bus", "r", "t1", None, 43.1234567, -80.0, at(2), at(1)), (None, "e2", "bus", "x", "t9", 1, 43.0, -80.0, None, at(1)), ("v1", "e1", "bus", "r", "t1", None, 42.0, -80.0, at(30), at(29))], "vehicle_id string, entity_id string, feed_name string, route_id string, trip_id string, direction_id long, latitude double, longitude double, vehicle_timestamp_utc timestamp, collected_at_utc timestamp")
    routes = spark.createDataFrame([("bus", "r", "12"), ("bus", "r", "12")], "feed_name string, route_id string, route_short_name string")
    trips = spark.createDataFrame([("bus", "t1", "Centre", "1")], "feed_name string, trip_id string, trip_headsign string, direction_id string")
    sizes = []

    def score(rows):
        sizes.append(rows.count())
        return rows.withColumn("predicted_delay_seconds", F.col("feed_delay_seconds") + 0.4)

    out = live_plans.cycle(updates, score, positions, routes, trips, F.lit(now))
    assert sizes == [3] and out["scored"].count() == 2
    assert [(r["arrivals"], r["late"]) for r in out["summary"].collect()] == [(2, 2)]
    got = sorted((json.loads(r["json"]) for r in out["markers"].collect()), key=lambda m: m["route_id"])
    assert got[0] == {"route_id": "r", "route_short_name": "12", "trip_headsign": "Centre", "direction_id": 1, "lat": 43.123457, "lon": -80.0, "position_age_seconds": 120, "next_stop_id": "s1", "predicted_delay_seconds": 400.0}
    assert got[1] == {"route_id": "x", "route_short_name": "x", "direction_id": 1, "lat": 43.0, "lon": -80.0}


def test_train_and_predict_commands(spark, tmp_path, monkeypatch):
    from tidetable import cli

    monkeypatch.setattr(cli, "build", lambda **_: spark)
    monkeypatch.setattr(spark, "stop", lambda: None, raising=False)
    rows = spark.range(3000).selectExpr("date_add(DATE '2024-01-01', CAST(id % 5 AS int)) AS snapshot_date", "concat('t', id % 50) AS trip_id", "concat('s', id % 9) AS stop_id", "CAST(id % 9 AS int) AS stop_sequence", "timestamp_seconds(1704067200 + (id % 5) * 86400 + id) AS collected_at_utc", "concat('r', id % 3) AS route_id", "CAST(id % 40 AS double) AS prediction_lead_minutes", "CAST((id % 3) * 100 + id % 11 AS double) AS delay_seconds", "CAST((id % 3) * 90 AS double) AS feed_delay_seconds")
    rows.withColumn("date", F.col("snapshot_date").cast("string")).write.partitionBy("date").parquet(str(tmp_path / "features"))
    cli.main(["train", "--features", str(tmp_path / "features"), "--output", str(tmp_path / "model"), "--rounds", "3", "--rate", "0.5", "--max-train-rows", "1500"])
    told = json.loads(spark.read.text(str(tmp_path / "model/evaluation.json")).first()[0])
    assert told["train_rows"] == 1500 and told["validation_rows"] == 600 and set(told["errors"]) == {"model", "feed", "interval"} and abs(sum(told["importance"].values()) - 1) < 1e-6
    cli.main(["predict", "--features", str(tmp_path / "features"), "--model", str(tmp_path / "model"), "--output", str(tmp_path / "scored"), "--all-snapshots"])
    scored = spark.read.parquet(str(tmp_path / "scored/scored"))
    assert scored.count() == 3000 and not scored.where("predicted_delay_lower_seconds > predicted_delay_seconds").count()


def test_snapshots_are_found_and_decoded_once(spark, raw):
    files = gtfs_rt.snapshots(spark, str(raw))
    nested = gtfs_rt.decode_nested(files)
    for name in gtfs_rt.SCHEMAS:
        a, b = gtfs_rt.split(nested, name), gtfs_rt.read_table(spark, str(raw), name)
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    feeds = {r[0].split("/")[-3] for r in files.select("path").collect()}
    one = sorted(feeds)[0]
    assert {r[0].split("/")[-3] for r in gtfs_rt.snapshots(spark, str(raw), feeds=[one]).select("path").collect()} == {one}
    assert gtfs_rt.snapshots(spark, str(raw), most=1).count() == 1 and gtfs_rt.snapshots(spark, str(raw), dates=["1999-01-01"]).count() == 0


def test_simplify_and_stitch(spark):
    line = [(0.0, float(i)) for i in range(10)] + [(5.0, 10.0)]
    assert shapes.keep_points(np.array(line), 0.1).nonzero()[0].tolist() == [0, 9, 10]
    df = spark.createDataFrame([([{"lat": a, "lon": b} for a, b in line],), (None,)], "points array<struct<lat:double,lon:double>>")
    assert [None if r["points"] is None else len(r["points"]) for r in shapes.simplify(df, 0.1).collect()] == [3, None]
    ring = shapes.stitch([[(0, 0), (0, 1)], [(1, 1), (0, 1)], [(1, 1), (0, 0)]])
    assert len(ring) == 1 and ring[0][0] == ring[0][-1]


def test_stop_progress(spark):
    points = spark.createDataFrame([("a", i, 43.0 + i * 0.01, -80.0) for i in range(5)], "shape_id string, shape_pt_sequence int, lat double, lon double")
    stops = spark.createDataFrame([("a", "s", 43.021, -80.0)], "shape_id string, stop_id string, stop_lat double, stop_lon double")
    assert shapes.stop_progress(stops, points).first()["progress"] == pytest.approx(0.5)


def test_model_beats_nothing(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 100, 400)
    rows = spark.createDataFrame([(float(v), float(v * 2 + e), float(i % 50)) for i, (v, e) in enumerate(zip(x, rng.normal(0, 5, 400)))], "current_predicted_delay_seconds double, delay_seconds double, prediction_lead_minutes double")
    fitted = model.train(rows, rounds=8)
    scored = model.predict(fitted, rows)
    error = lambda df: df.agg(F.avg(F.abs(F.col("delay_seconds") - F.col("predicted_delay_seconds")))).first()[0]
    assert error(scored) < 0.5 * float(np.abs(x * 2).mean())
    bounds = model.predict(fitted, rows, model.residual_quantiles(scored))
    inside = bounds.agg(*metrics.intervals("predicted_delay_lower_seconds", "predicted_delay_upper_seconds", "delay_seconds")).first()
    assert inside["coverage"] > 0.6
    assert bounds.where("predicted_delay_seconds NOT BETWEEN predicted_delay_lower_seconds AND predicted_delay_upper_seconds").count() == 0


# --- streams ---------------------------------------------------------------------------------------------------------------


def test_stride_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).select(F.timestamp_seconds(F.col("id") * 37 + 1704891600).alias("collected_at_utc"), (F.col("id") % 3).cast("string").alias("trip_id"), F.col("id").cast("double").alias("v"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = live.stride_last(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), ("trip_id",), "v", late="1 minute")
    q = stream.writeStream.format("memory").queryName("strides").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r["trip_id"], r["v"]) for r in spark.table("strides").collect()}
    batch = windows.stride_thin(rows, 10, ["trip_id"], ("v",)).collect()
    assert got == {(r["trip_id"], r["v"]) for r in batch}


def test_lags_in_state(spark, tmp_path):
    schema = "trip_id string, collected_at_utc timestamp, v double"
    for k in range(2):
        spark.createDataFrame([("a", utc(2024, 1, 1, k, m), float(k * 10 + m)) for m in range(3)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.lag_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "trip_id", "v", "collected_at_utc")
    q = stream.writeStream.format("memory").queryName("lags").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = {r["v"]: (r["lag_1"], r["lag_2"], r["lag_5"]) for r in spark.table("lags").collect()}
    assert got[0.0] == (None, None, None) and got[10.0] == (2.0, 1.0, None) and got[12.0] == (11.0, 10.0, 0.0)


def test_landing_and_scoring(spark, raw, tmp_path):
    stream = live.landing(spark, raw, "stop_time_updates")
    q = live.score_batches(stream, lambda b: b.withColumn("predicted_delay_seconds", F.lit(1.0)), str(tmp_path / "log"), str(tmp_path / "cp"), available_now=True)
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_feature_table(spark):
    t = lambda m: utc(2024, 1, 10, 12, m)
    schema = "snapshot_date string, collected_at_utc timestamp, feed_name string, trip_id string, route_id string, stop_id string, stop_sequence long, scheduled_arrival_utc timestamp, predicted_arrival_utc timestamp, delay_seconds double, prediction_lead_minutes double"
    rows = spark.createDataFrame([("2024-01-10", t(m), "bus_x", "t", "r", "s", 2, utc(2024, 1, 10, 13), utc(2024, 1, 10, 13), float(m), float(30 - m)) for m in (0, 10, 20, 31)], schema)
    day = "feed_name string, p_snapshot_date string, "
    static = {
        "routes": spark.createDataFrame([("bus_x", "2024-01-10", "r", "7", "3")], day + "route_id string, route_short_name string, route_type string"),
        "trips": spark.createDataFrame([("bus_x", "2024-01-10", "t", "Downtown")], day + "trip_id string, trip_headsign string"),
        "stops": spark.createDataFrame([("bus_x", "2024-01-10", "s", "Main", "43.0", "-80.0")], day + "stop_id string, stop_name string, stop_lat string, stop_lon string"),
        "stop_times": spark.createDataFrame([("bus_x", "2024-01-10", "t", "4")], day + "trip_id string, stop_sequence string"),
    }
    got = features.feature_table(rows, static).orderBy("collected_at_utc").collect()
    assert [r["current_predicted_delay_seconds"] for r in got] == [0.0, 10.0, 20.0]  # the one after the arrival doesn't count
    assert [r["delay_seconds"] for r in got] == [20.0] * 3
    assert [r["previous_predicted_delay_seconds"] for r in got] == [None, 0.0, 10.0]
    assert (got[0]["stop_sequence_normalized"], got[0]["trip_headsign"], got[0]["hour_of_day"], got[0]["is_rain"], got[0]["vehicle_lat"]) == (0.5, "Downtown", 8, None, None)


def test_command_line():
    a = parser().parse_args(["delay-table", "--parsed", "p", "--static", "s", "--output", "o", "--date", "2024-01-10", "--overwrite"])
    assert (a.date, a.overwrite, a.keep_all_snapshots) == (["2024-01-10"], True, False)
