import statistics
from collections import defaultdict

import numpy as np
import pytest

from tidetable.operators import quantiles
from tidetable.plans import catalog, reliability
from tests.compare import duck, same

QS = {"low": 0.0, "p10": 0.1, "mid": 0.5, "p90": 0.9, "high": 1.0}


def rows_of(seed=0):
    rng = np.random.default_rng(seed)
    rows = [("hot", float(x)) for x in rng.normal(0, 100, 3000)] + [("ties", float(x)) for x in rng.integers(0, 4, 500)] + [(None, float(x)) for x in rng.exponential(1e6, 301)]
    return rows + [("wide", v) for v in (-1e300, -5.0, 0.0, 1e-300, 7.0, 1e300)] + [("one", 3.5), ("none", None), ("hot", None)]


@pytest.mark.parametrize("rounds, slices", [(0, 1), (1, 3), (2, 1024), (4, 2)])
def test_percentiles_are_exact(spark, rounds, slices):
    rows = rows_of()
    counts = quantiles.value_counts(spark.createDataFrame(rows, "k string, v double"), ("k",), "v")
    got = {r["_key"]["k"]: r for r in quantiles.percentiles(counts, ("k",), "v", QS, rounds=rounds, slices=slices).collect()}
    groups = defaultdict(list)
    for k, v in rows:
        if v is not None:
            groups[k].append(v)
    assert set(got) == set(groups)
    for k, values in groups.items():
        for name, q in QS.items():
            assert got[k][name] == pytest.approx(float(np.percentile(values, q * 100)), rel=1e-12, abs=1e-300), (k, name)


def test_without_keys_and_without_rows(spark):
    df = spark.createDataFrame([(float(x),) for x in (5, 1, 4)], "v double")
    assert [r["mid"] for r in quantiles.percentiles(quantiles.value_counts(df, (), "v"), (), "v", QS).collect()] == [4.0]
    assert quantiles.percentiles(quantiles.value_counts(df.limit(0), (), "v"), (), "v", QS).count() == 0
    empty = reliability.reliability(spark.createDataFrame([], "snapshot_date string, trip_id string, delay_seconds double")).collect()
    assert [(r["observations"], r["trips"], r["median_delay_seconds"]) for r in empty] == [(0, 0, None)]


def test_counts_of_days_are_those_of_months(spark):
    rows = rows_of(1)
    df = spark.createDataFrame([(k, i % 7, v) for i, (k, v) in enumerate(rows)], "k string, day int, v double")
    found = reliability.of_counts(quantiles.value_counts(df, ("k", "day"), "v"), ("k",), {"mid": 0.5}, "v").collect()
    for r in found:
        values = [v for k, v in rows if k == r["k"] and v is not None]
        assert (r["observations"], r["mid"]) == (len(values), pytest.approx(statistics.median(values)))


def test_all_groupings_are_the_single_ones(spark):
    base = catalog.base(spark, "/root/testdata/sf0.001").withColumns({"stop_lat": catalog.F.col("stop_id") * 1.5, "stop_lon": catalog.F.lit(None).cast("double")})
    every = catalog.tidy(reliability.rollups(base)).collect()
    for name, by in reliability.GROUPINGS.items():
        one = catalog.tidy(reliability.rollup(base, by))
        names = [c for c in one.columns if c not in ("stop_lat", "stop_lon") or "stop_id" in by]
        assert sorted(map(str, (tuple(r[c] for c in names) for r in one.collect()))) == sorted(map(str, (tuple(r[c] for c in names) for r in every if r["grouping"] == name)))


def test_no_row_is_multiplied_and_no_values_are_buffered(spark, capsys):
    catalog.QUERIES["system_overall"](spark, "/root/testdata/sf0.001").explain("formatted")
    plan = capsys.readouterr().out
    assert "percentile(" not in plan and "Expand" not in plan


def test_queries(spark):
    sf = "/root/testdata/sf0.001"
    for name in ("reliability_all", "monthly_percentiles"):
        same(catalog.QUERIES[name](spark, sf), duck(sf), catalog.SQL[name])
