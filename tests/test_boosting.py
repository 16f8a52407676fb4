import numpy as np
import pytest

from tidetable.plans import boosting, catalog


def pinball(y, f, q, w=None):
    off = y - f
    return float(np.average(np.maximum(q * off, (q - 1) * off), weights=w))


def weighted_quantile(values, weights, q):
    order = np.argsort(values, kind="stable")
    return float(values[order][np.searchsorted(np.cumsum(weights[order]), q * weights.sum() * (1 - 1e-12), "left")])


def brute_tree(bins, off, w, q, ordered, least, depth, rows=None):
    """leaf of each row by trying every cut, and the value of each leaf."""
    rows = np.arange(len(off)) if rows is None else rows
    found = None
    if depth:
        g = np.where(off < 0, 1 - q, -q) * w
        for f in range(bins.shape[1]):
            values = sorted(set(bins[rows, f].tolist()))
            if not ordered[f]:
                values.sort(key=lambda b: (w[rows][(bins[rows, f] == b) & (off[rows] < 0)].sum() / w[rows][bins[rows, f] == b].sum(), b))
            for k in range(1, len(values)):
                left = np.isin(bins[rows, f], values[:k])
                a, b = rows[left], rows[~left]
                if min(len(a), len(b)) < least:
                    continue
                gain = g[a].sum() ** 2 / w[a].sum() + g[b].sum() ** 2 / w[b].sum() - g[rows].sum() ** 2 / w[rows].sum()
                if gain > 1e-9 and (found is None or gain > found[0] + 1e-9):
                    found = gain, a, b
    if found is None:
        return {tuple(rows.tolist()): weighted_quantile(off[rows], w[rows], q)}
    return {**brute_tree(bins, off, w, q, ordered, least, depth - 1, found[1]), **brute_tree(bins, off, w, q, ordered, least, depth - 1, found[2])}


def rows_of(n=600, seed=0):
    rng = np.random.default_rng(seed)
    x, z, c = rng.integers(0, 8, n).astype(float), rng.normal(0, 1, n).round(1), rng.choice(["a", "b", "c", "d"], n)
    y = 10 * x + np.where(c == "b", 40, 0) + rng.exponential(20, n).round(2) * (1 + (c == "d"))
    return [(float(a) if a != 3 else None, float(b), str(k) if k != "c" else None, float(t), float(1 + i % 3), i % 4 == 0) for i, (a, b, k, t) in enumerate(zip(x, z, c, y))]


SCHEMA = "x double, z double, c string, delay_seconds double, w double, held boolean"


@pytest.mark.parametrize("weight", [None, "w"])
def test_one_tree_is_that_of_brute_force(spark, weight):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    qs = (0.1, 0.5, 0.9)
    got = boosting.fit(df, ["x", "z"], ["c"], quantiles=qs, weight=weight, rounds=1, rate=1.0, depth=3, least=20)
    table = df.toArrow().combine_chunks().to_batches()[0]
    bins, y = got.coding.bins(table), table.column("delay_seconds").to_numpy()
    w = table.column("w").to_numpy() if weight else np.ones(len(y))
    for m, q in enumerate(qs):
        start = weighted_quantile(y, w, q)
        assert got.start[m] == start
        expected = np.empty(len(y))
        for part, value in brute_tree(bins, y - start, w, q, [True, True, False], 20, 3).items():
            expected[list(part)] = start + value
        assert np.allclose(got.scores(bins)[:, m], expected, atol=1e-9)


def test_rounds_lower_the_loss_and_validation_stops(spark):
    df = spark.createDataFrame(rows_of(1200, 1), SCHEMA)
    got = boosting.fit(df, ["x", "z"], ["c"], quantiles=(0.1, 0.9), held="held", rounds=12, rate=0.3, depth=2, least=20, patience=2)
    for m, q in enumerate((0.1, 0.9)):
        losses = got.losses[m]
        assert losses[len(got.trees[m])] == min(losses) < 0.9 * losses[0]
        told = boosting.predict(got, df, {q: "p"}).where("held").toPandas()
        assert pinball(told["delay_seconds"], told["p"], q) == pytest.approx(min(losses))
    noise = df.withColumn("delay_seconds", catalog.F.rand(5))
    assert len(boosting.fit(noise, ["z"], quantiles=(0.5,), held="held", rounds=30, rate=1.0, depth=2, least=5, patience=2).trees[0]) < 5
    assert boosting.importance(got, 0.9)[0][0] in ("x", "c")


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    got = boosting.fit(empty, ["x", "not there"], ["c"], rounds=2)
    rows = spark.createDataFrame([(None, None, None, None, 1.0, False), (1.0, float("nan"), "a", 5.0, 1.0, False)], SCHEMA)
    assert [r["p"] for r in boosting.predict(got, rows, {0.5: "p"}).collect()] == [0.0, 0.0]
    got = boosting.fit(rows, ["x", "z"], ["c"], rounds=2)
    assert [r["p"] for r in boosting.predict(got, rows.drop("x"), {0.9: "p"}).collect()] == [5.0, 5.0]
    assert boosting.from_json(boosting.to_json(got)) == got


def test_query_beats_residual_quantiles(spark):
    sf = "/root/testdata/sf0.001"
    rows = catalog.QUERIES["boosted_quantiles"](spark, sf).toPandas().merge(catalog.obs(spark, sf).select("event_id", "delay_seconds", "predicted_delay_seconds", "snapshot_date", "prediction_lead_minutes").toPandas(), on="event_id")
    late = rows[rows["held"]]
    for q, c in ((0.1, "lower"), (0.9, "upper")):
        plain = np.quantile(rows[~rows["held"]]["delay_seconds"], q)
        assert pinball(late["delay_seconds"], late[c], q) < pinball(late["delay_seconds"], plain, q)
    assert 0.6 < ((late["delay_seconds"] >= late["lower"]) & (late["delay_seconds"] <= late["upper"])).mean() <= 1
