import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidetable.llm import exponion


def brute(rows, k, rounds, dims):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest()))[:k]
    centroids = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for c, vs in groups.items():
            centroids[c] = [sum(x) // len(vs) for x in zip(*vs)]
    return sorted(((i, nearest(v)[1], nearest(v)[0]) for i, v in kept), key=str), centroids


def found(spark, rows, k, rounds, dims, extra=False):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    df = df.selectExpr("*", "1 AS place", "2 AS data", "3 AS cluster", "4 AS sums") if extra else df
    got, centroids = exponion.cluster(df, k=k, rounds=rounds, dims=dims)
    return sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got.collect()), key=str), [[int(x) for x in c] for c in centroids]


ODD = [(1, None), (2, [1.0]), (3, [1.0, None, 2.0]), (4, [1.0, math.nan, 0.0]), (5, [math.inf, 0.0, 0.0]), (6, [-0.0, -1 / 128, 3.0]), (7, [1.0, 2.0, 3.0, 4.0])]


def grid(seed, n, dims=3):
    """Few distinct places, so that distances tie and vectors repeat."""
    rng = np.random.default_rng(seed)
    return [(i, (rng.integers(-3, 4, dims) / 64).tolist()) for i in range(100, 100 + n)]


@pytest.mark.parametrize("k, rounds", [(1, 2), (4, 0), (4, 3), (9, 5), (16, 3)])
def test_equal_to_brute_force(spark, k, rounds):
    rows = ODD + grid(k, 150) + [(900, [0.5, 0.5, 0.5])] * 60 + [(None, [0.25, 0.0, 0.0])]
    assert found(spark, rows, k, rounds, 3) == brute(rows, k, rounds, 3)


def test_few_or_no_vectors(spark):
    assert found(spark, [], 4, 2, 3) == ([], [])
    assert found(spark, ODD[:5], 4, 2, 3) == ([], [])
    rows = grid(1, 2)
    assert found(spark, rows, 4, 2, 3) == brute(rows, 4, 2, 3)


def test_clashing_names(spark):
    rows = ODD + grid(8, 40)
    assert found(spark, rows, 4, 2, 3, extra=True) == brute(rows, 4, 2, 3)


def test_large_components(spark):
    rows = [(i, [2.0**25 + i, -(2.0**25), float(i % 3)]) for i in range(20)]
    assert found(spark, rows, 3, 2, 3) == brute(rows, 3, 2, 3)
    with pytest.raises(Exception, match="(?i)overflow|out of bounds|too large|int64"):
        found(spark, [(1, [1e30, 0.0, 0.0]), (2, [-1e30, 0.0, 0.0])], 1, 1, 3)


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 8), st.integers(1, 4))
def test_assignment_is_exact_and_bounds_hold(seed, k, dims):
    rng = np.random.default_rng(seed)
    x = rng.integers(-6, 7, (200, dims))
    now = x[rng.permutation(200)[:k]]
    state = np.zeros(200, np.int64), np.full(200, np.inf), np.zeros(200)
    to = exponion.Centroids.of(now)
    for _ in range(4):
        cluster, upper, lower, _ = exponion.assign(x, *state, to)
        square = ((x[:, None] - to.values[None]) ** 2).sum(2)
        assert (cluster == square.argmin(1)).all()
        away = np.sqrt(square)
        assert (upper >= away[np.arange(200), cluster]).all()
        away[np.arange(200), cluster] = np.inf
        assert (lower <= away.min(1)).all()
        state = cluster, upper, lower
        after = np.array([x[cluster == c].sum(0) // max(1, (cluster == c).sum()) if (cluster == c).any() else to.values[c] for c in range(k)])
        to = exponion.Centroids.of(after, to.values)


def test_few_distances_are_computed():
    rng = np.random.default_rng(2)
    centers = rng.integers(-2000, 2000, (32, 8))
    x = centers[rng.integers(0, 32, 5000)] + rng.integers(-40, 41, (5000, 8))
    state, to, computed = (np.zeros(5000, np.int64), np.full(5000, np.inf), np.zeros(5000)), exponion.Centroids.of(centers + 7), []
    for _ in range(3):
        *state, n = exponion.assign(x, *state, to)
        computed.append(n)
        to = exponion.Centroids.of(np.array([x[state[0] == c].sum(0) // (state[0] == c).sum() for c in range(32)]), to.values)
    assert computed[1] < 5000 * 3 and computed[2] <= computed[1]
