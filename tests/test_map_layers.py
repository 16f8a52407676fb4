import numpy as np

from tests.compare import duck, same
from tidetable.plans import catalog, map_layers, shapes

POINTS = "array<struct<lat:double,lon:double>>"


def lines_of(spark, ways):
    df = spark.createDataFrame([(r, w, [{"lat": float(a), "lon": float(b)} for a, b in p] if p is not None else None) for r, w, p in ways], f"relation int, way long, points {POINTS}")
    return {(r["relation"], r["line"]): (r["closed"], r["ways"], [(p["lat"], p["lon"]) for p in r["points"]]) for r in map_layers.assemble(df).collect()}


def turned(line, closed):
    """A line whatever end or point it starts at."""
    body = line[:-1] if closed else line
    turns = [body[i:] + body[:i] for i in range(len(body))] if closed else [body]
    return min(tuple(x) for t in turns for x in (t, t[::-1]))


def test_rings_and_chains_are_those_of_stitching(spark):
    rng = np.random.default_rng(1)
    ways, number = [], 0
    for relation in range(12):
        n = int(rng.integers(3, 40))
        corners = [(relation + np.cos(2 * np.pi * i / n) / 4, np.sin(2 * np.pi * i / n) / 4) for i in range(n)]
        edges = [[corners[i], tuple(np.add(corners[i], 0.001)), corners[(i + 1) % n]] for i in range(n)][: n - (relation % 3 == 0)]
        for i in rng.permutation(len(edges)):
            number += 1
            ways.append((relation % 5, number, edges[i][::-1] if rng.random() < 0.5 else edges[i]))
    got = lines_of(spark, ways)
    for relation in range(5):
        expected = shapes.stitch([p for r, _, p in ways if r == relation])
        assert sorted(turned(p, c) for (r, _), (c, _, p) in got.items() if r == relation) == sorted(turned([tuple(map(float, x)) for x in p], p[0] == p[-1]) for p in expected)


def test_odd_ways(spark):
    square = [(0, 0), (0, 1), (1, 1), (0, 0)]
    got = lines_of(spark, [(1, 1, square), (2, 2, [(5, 5)]), (2, 3, None), (3, 4, [(0, 0), (0, 1)]), (4, 5, [(0, 0), (1, 0)]), (4, 6, [(0, 0), (0, 1)]), (4, 7, [(0, 0), (1, 1)]), (5, 8, [(0, 0), (0, 1)]), (5, 9, [(0, 1), (0, 0)])])
    assert got[1, 1][0] and got[1, 1][1] == 1 and got[3, 4] == (False, 1, [(0, 0), (0, 1)])
    assert {k for k in got if k[0] == 2} == set() and all(not got[4, w][0] and got[4, w][1] == 1 for w in (5, 6, 7))  # three ways meet: a chain each
    assert got[5, 8][0] and got[5, 8][1] == 2 and len(got[5, 8][2]) == 3
    assert lines_of(spark, []) == {}


def test_layers(spark):
    side = 0.01
    ring = [[(43.0, -80.0), (43.0, -80.0 + side)], [(43.0 + side, -80.0 + side), (43.0, -80.0 + side)], [(43.0 + side, -80.0 + side), (43.0 + side / 2, -80.0 + side / 2), (43.0, -80.0)]]
    df = spark.createDataFrame([(1, i, [{"lat": a, "lon": b} for a, b in p]) for i, p in enumerate(ring)], f"relation int, way long, points {POINTS}")
    area = map_layers.layer(df, closed=True).select(map_layers.extent_m2().alias("m2")).first()["m2"]
    assert abs(area / (1111.9 * 1111.9 * np.cos(np.radians(43.0)) / 2) - 1) < 0.01
    assert map_layers.layer(df, closed=True, least_m2=area * 1.1).count() == 0 and map_layers.layer(df, closed=False).count() == 0
    assert len(map_layers.layer(df, closed=True, tolerance=0.0001).first()["points"]) == 4


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    same(catalog.QUERIES["map_rings"](spark, sf), duck(sf), catalog.SQL["map_rings"])


def test_small_relations_are_followed_in_their_group(spark, monkeypatch):
    """Rings, chains and junctions of several sizes: the same lines by both ways of ranking, and no written round for small relations."""
    rng = np.random.default_rng(3)
    ways = [(r, int(w), [(r, float(a)), (r + 0.25, float(a)), (r, float(b))]) for r in range(6) for w, (a, b) in enumerate(rng.integers(0, 40, (30, 2)))]
    ways += [(9, i, [(9, i), (9.5, i), (9, (i + 1) % 50)][:: -1 if i % 3 else 1]) for i in range(50)]
    told, real = [], map_layers.written
    monkeypatch.setattr(map_layers, "written", lambda df, label="state": told.append(label) or real(df, label))
    followed = lines_of(spark, ways)
    assert "jumped" not in told
    monkeypatch.setattr(map_layers, "POINTS", 0)
    jumped = lines_of(spark, ways)
    assert "jumped" in told and followed == jumped and followed[9, 0][:2] == (True, 50)
    monkeypatch.setattr(map_layers, "POINTS", 100)
    assert lines_of(spark, ways) == followed
