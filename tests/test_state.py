import datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidetable.plans import catalog
from tidetable.streaming import state

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def at(s):
    return START + datetime.timedelta(seconds=s)


def run(stream, out, checkpoint):
    q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    assert q.awaitTermination(90)


def put(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


LAG = "trip_id string, event_id long, collected_at_utc timestamp, v double"


def test_lags_after_a_restart_are_those_of_a_batch(spark, tmp_path):
    """Rows out of order over micro-batches and restarts; a key that is silent for long begins anew."""
    rows = [(f"t{i % 3}", i, at(i * 40 + (9000 if i > 60 else 0)), float(i * i % 17) if i % 11 else None) for i in range(90)]
    for part in (rows[1:30:2] + rows[40:50], rows[0:30:2] + rows[30:40], rows[50:]):  # at most some minutes behind
        put(spark, part, LAG, tmp_path / "in")
        stream = spark.readStream.schema(LAG).parquet(str(tmp_path / "in"))
        run(state.event_time_lags(stream, "trip_id", "v", "collected_at_utc", "event_id", late="40 minutes"), tmp_path / "out", tmp_path / "cp")
    put(spark, [("flush", -1, at(10**6), 0.0)], LAG, tmp_path / "in")
    run(state.event_time_lags(spark.readStream.schema(LAG).parquet(str(tmp_path / "in")), "trip_id", "v", "collected_at_utc", "event_id", late="40 minutes"), tmp_path / "out", tmp_path / "cp")
    got = {r["event_id"]: tuple(r[f"lag_{i}"] for i in range(1, 6)) for r in spark.read.parquet(str(tmp_path / "out")).where("event_id >= 0").collect()}
    w = Window.partitionBy("trip_id", F.col("event_id") > 60).orderBy("collected_at_utc", "event_id")
    batch = spark.createDataFrame(rows, LAG).select("event_id", *(F.lag("v", i).over(w).alias(f"l{i}") for i in range(1, 6)))
    assert got == {r[0]: tuple(r)[1:] for r in batch.collect()}


def test_cadence_and_reuse(spark, tmp_path):
    schema = "feed string, at_s long, kind string, payload string"
    parts = [[("alerts", 0, "tick", None), ("trips", 0, "tick", None), ("weather", 5, "got", "f1"), ("weather", 6, "tick", None)], [("alerts", 30, "tick", None), ("trips", 30, "tick", None), ("weather", 40, "tick", None)], [("alerts", 300, "tick", None), ("weather", 11000, "tick", None), ("weather", 10990, "got", "f2")], [("trips", 100_000, "tick", None)], [("weather", 100_001, "tick", None)]]
    base = 1_700_000_000
    for part in parts:
        put(spark, [(f, base + t, k, x) for f, t, k, x in part], schema, tmp_path / "in")
        run(state.cadence(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), {"alerts": 300, "trips": 30, "weather": 10800}), tmp_path / "out", tmp_path / "cp")
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).selectExpr("feed", f"at_s - {base}", "action", "payload", "payload_age_s").collect())
    assert got == [
        ("alerts", 0, "poll", None, None), ("alerts", 30, "reuse", None, None), ("alerts", 300, "poll", None, None), ("trips", 0, "poll", None, None), ("trips", 30, "poll", None, None), ("trips", 100_000, "poll", None, None),
        ("weather", 6, "poll", "f1", 1), ("weather", 40, "reuse", "f1", 35), ("weather", 11000, "poll", "f2", 10), ("weather", 100_001, "poll", None, None),
    ]


def test_streamed_evaluation_is_the_batch(spark, tmp_path):
    sf, keys = "/root/testdata/sf0.001", ("service_date", "trip_id", "route_id")
    log = catalog.log(spark, sf).withColumn("collected_at_utc", F.col("service_date").cast("timestamp"))
    truth = catalog._truth(spark, sf).withColumn("observed_at_utc", F.col("service_date").cast("timestamp") + F.expr("INTERVAL 20 hours"))
    for name, df, ts in (("log", log, "collected_at_utc"), ("truth", truth, "observed_at_utc")):
        for i in range(2):
            df.where(F.pmod(F.xxhash64("trip_id"), F.lit(2)) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        df.limit(1).withColumns({"trip_id": F.lit(-1).cast("bigint"), "service_date": F.lit("2030-01-01").cast("date"), ts: F.lit("2030-01-01").cast("timestamp")}).write.mode("append").parquet(str(tmp_path / name))
    read = lambda n, df: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n))
    matched = state.match_stream(read("log", log), read("truth", truth), keys, within="1 days", late="60 days")
    run(matched, tmp_path / "out", tmp_path / "cp")
    found = spark.read.parquet(str(tmp_path / "out")).where("trip_id >= 0")
    assert found.count() == log.count()
    assert sorted((r[0], r[1]) for r in found.where("truth IS NOT NULL").select("event_id", "truth").collect()) == sorted((r["event_id"], pytest.approx(r["truth"], abs=1e-6)) for r in catalog.QUERIES["eval_match"](spark, sf).collect())
    rates = catalog.tidy(state.match_rates(found, "service_date", "truth"))
    assert sorted(map(tuple, rates.collect())) == sorted(map(tuple, catalog.QUERIES["eval_coverage"](spark, sf).select(rates.columns).collect()))
