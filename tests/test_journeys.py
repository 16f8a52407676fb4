import numpy as np
import pytest

from tidetable.operators import joins
from tidetable.plans import planner, raptor


def network(spark, seed, trips=60, stops=12):
    """Lines that share stops, with trips that overtake each other and loops."""
    rng = np.random.default_rng(seed)
    routes = [rng.choice(stops, int(rng.integers(2, 7))).tolist() for _ in range(9)]
    rows = []
    for t in range(trips):
        at = int(rng.integers(0, 4000))
        for i, stop in enumerate(routes[t % len(routes)]):
            at += int(rng.integers(20, 400))
            rows.append((f"t{t}", f"r{t % len(routes)}", f"s{stop}", i * 2, at))
    return spark.createDataFrame(rows, "trip_id string, route_id string, stop_id string, stop_sequence int, seconds long")


@pytest.mark.parametrize("seed", [0, 1])
def test_scanned_lines_find_what_all_rides_find(spark, seed, monkeypatch):
    times = network(spark, seed)
    origins = spark.createDataFrame([(q, f"s{q}", 100 * q) for q in range(8)] + [(0, "s5", 50)], "query_id int, stop_id string, ready long")
    walks = spark.createDataFrame([("s1", "s7", 60), ("s3", "s9", 45)], "from_stop string, to_stop string, seconds long")
    monkeypatch.setattr(raptor, "QUERIES", 3)
    got = raptor.arrivals(origins, raptor.lines(times), walks).collect()
    expected = planner.earliest_arrivals(origins, planner.connections(times), walks).collect()
    key = lambda rows: sorted((r["query_id"], r["stop_id"], r["round"], r["arrive"]) for r in rows)
    assert key(got) == key(expected)
    for r in got:
        ends = [x for leg in r["legs"] for x in (leg["depart"], leg["arrive"])]
        assert ends == sorted(ends) and (not ends or ends[-1] == r["arrive"]) and sum(leg["trip_id"] is not None for leg in r["legs"]) == r["round"]


def test_queries_meet_their_lines_in_any_number_of_partitions(spark):
    """Larger days aren't merged to one partition: both sides of the cogroup must be hashed alike."""
    times = network(spark, 5)
    origins = spark.createDataFrame([(q, f"s{q}", 100 * q) for q in range(8)], "query_id int, stop_id string, ready long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = raptor.arrivals(origins, raptor.lines(times), rounds=2).select("query_id", "stop_id", "round", "arrive").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = planner.earliest_arrivals(origins, planner.connections(times), rounds=2).select("query_id", "stop_id", "round", "arrive").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected))


def test_targets_prune_but_keep_the_best(spark):
    times = network(spark, 2)
    origins = spark.createDataFrame([(q, f"s{q}", 0) for q in range(8)], "query_id int, stop_id string, ready long")
    targets = spark.createDataFrame([(q, f"s{(q + 5) % 12}", 30) for q in range(8)] + [(1, "s2", 500)], "query_id int, stop_id string, walk_s long")
    day = raptor.lines(times)
    every, fewer = raptor.arrivals(origins, day), raptor.arrivals(origins, day, targets=targets)
    best = lambda rows: {r["query_id"]: r["best"] for r in rows.where("round > 0").join(targets, ["query_id", "stop_id"]).selectExpr("query_id", "arrive + walk_s AS t").groupBy("query_id").agg({"t": "min"}).withColumnRenamed("min(t)", "best").collect()}
    assert best(fewer) == best(every)
    assert fewer.count() < every.count()


def test_lines_never_overtake(spark):
    day = raptor.lines(network(spark, 3, trips=200)).collect()
    assert sum(len(r["trips"]) for r in day) == 200
    for r in day:
        t = np.array(r["times"]).reshape(len(r["trips"]), len(r["stops"]))
        assert (np.diff(t, axis=0) >= 0).all()
    empty = spark.createDataFrame([], "trip_id string, stop_id string, stop_sequence int, seconds long")
    origins = spark.createDataFrame([(1, "a", 5)], "query_id int, stop_id string, ready long")
    assert [tuple(r)[:4] for r in raptor.arrivals(origins, raptor.lines(empty)).collect()] == [(1, "a", 0, 5)]


def metres(a, b):
    (lat1, lon1), (lat2, lon2) = np.radians(a), np.radians(b)
    h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * 6_371_000.0 * np.arcsin(np.sqrt(min(1.0, h)))


@pytest.mark.parametrize("within", [None, 800.0])
def test_nearest_k_is_complete(spark, within):
    rng = np.random.default_rng(4)
    places = [(i, float(a), float(b)) for i, (a, b) in enumerate(np.concatenate([rng.normal([43.4, -80.5], 0.01, (60, 2)), rng.normal([43.4, -80.5], 3, (20, 2)), [[0, 179.999], [0, -179.999], [89.9, 10], [89.9, -170], [-33, 151]]]))]
    places += [(900 + i, 43.4, -80.5) for i in range(4)]
    rows = [*places, (990, None, 1.0)]
    stops = spark.createDataFrame(rows, "stop_id int, lat double, lon double")
    points = spark.createDataFrame([(i + 5, a, b) for i, a, b in rows], "query_id int, lat double, lon double")
    got = {}
    for r in joins.nearest_k(points, stops, 3, within_m=within, first_m=100.0, others=True).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["distance_m"], r["stop_id"]))
    for i, a, b in places:
        expected = sorted((round(metres((a, b), (c, e)), 3), j) for j, c, e in places if j != i + 5)
        expected = [x for x in expected if within is None or x[0] <= within][:3]
        assert [j for _, j in got.get(i + 5, [])] == [j for _, j in expected]
    assert 995 not in got


def test_fewer_stops_than_wanted(spark):
    stops = spark.createDataFrame([(1, 10.0, 10.0), (2, -10.0, -170.0)], "stop_id int, lat double, lon double")
    points = spark.createDataFrame([(7, 10.0, 10.0)], "query_id int, lat double, lon double")
    assert [r["stop_id"] for r in joins.nearest_k(points, stops, 5).orderBy("rank").collect()] == [1, 2]
    assert joins.nearest_k(points, stops.limit(0), 5).count() == 0
    assert joins.nearest_k(points.limit(0), stops, 5).count() == 0


def test_stops_of_one_place_are_no_pairs(spark, tmp_path):
    """Many copies of few places: the nearest of each, without a round that writes or meets every pair of copies."""
    at = [(43.4, -80.5), (43.4005, -80.5), (44.0, -80.5)]
    rows = [(i, *at[i % 3]) for i in range(300)]
    stops = spark.createDataFrame(rows, "stop_id int, lat double, lon double")
    kept = []
    with pytest.MonkeyPatch.context() as m:
        real = joins.written
        m.setattr(joins, "written", lambda df, label="state": kept.append((label, out := real(df, label))) or out)
        got = joins.nearest_k(stops.withColumnRenamed("stop_id", "query_id"), stops, 4, others=True).collect()
    assert len(got) == 300 * 4
    for i in (0, 1, 5, 299):
        expected = [j for j in range(i % 3, 300, 3) if j != i][:4]
        assert [r["stop_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i] == expected
    assert all(df.count() <= 3 * 5 for _, df in kept)
