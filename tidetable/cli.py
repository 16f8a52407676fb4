"""Commands: python -m tidetable.cli <command> --help."""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Sequence
from dataclasses import replace
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from .config import DEFAULT
from .functions.columns import interval_clamp, transit_mode
from .plans import baselines, boosting, bunching, dashboard, delay, evaluation, features, live, model, reliability, timetable, transfers
from .session import build
from .sources import exports, gtfs_rt, gtfs_static, retention, tables, weather
from .sources.shared import written

STATIC_COLUMNS = {
    "stop_times": ["trip_id", "stop_id", "stop_sequence", "arrival_time", "departure_time"],
    "trips": ["trip_id", "route_id", "service_id", "trip_headsign", "direction_id", "shape_id"],
    "routes": ["route_id", "route_short_name", "route_type"],
    "stops": ["stop_id", "stop_name", "stop_lat", "stop_lon"],
    "shapes": ["shape_id", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence"],
    "calendar": ["service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "start_date", "end_date"],
    "calendar_dates": ["service_id", "date", "exception_type"],
}


def _dated(df, column="snapshot_date"):
    return df.withColumn("date", F.col(column).cast("string"))


def _static(spark, root):
    return {t: gtfs_static.read_table(spark, root, t, c) for t, c in STATIC_COLUMNS.items()}


def parse_realtime(spark, a):
    nested = written(gtfs_rt.decode_nested(gtfs_rt.snapshots(spark, a.raw, dates=a.date, feeds=a.feed, most=a.limit_files)), "decoded")  # each file is decoded once
    for name in gtfs_rt.SCHEMAS:
        tables.write(_dated(gtfs_rt.split(nested, name)), f"{a.output}/{name}", overwrite=a.overwrite)


def parse_static(spark, a):
    for name, df in _static(spark, a.raw).items():
        tables.write(df, f"{a.output}/{name}", partition="p_snapshot_date", overwrite=a.overwrite)


def weather_features(spark, a):
    tables.write(weather.weather_features(weather.read_forecasts(spark, a.raw)), a.output, partition=None, overwrite=a.overwrite)


def delay_table(spark, a):
    updates = tables.scan(spark, f"{a.parsed}/stop_time_updates", dates=a.date).drop("date")
    static = spark.read.parquet(f"{a.static}/stop_times")
    tables.write(_dated(delay.delay_table(updates, static, keep_all=a.keep_all_snapshots)), a.output, overwrite=a.overwrite)


def feature_table(spark, a):
    rows = tables.scan(spark, a.delay, dates=a.date).drop("date")
    static = {t: spark.read.parquet(f"{a.static}/{t}") for t in ("routes", "trips", "stops", "stop_times")}
    positions = tables.scan(spark, f"{a.parsed}/vehicle_positions", dates=a.date).drop("date") if a.parsed else None
    hours = spark.read.parquet(a.weather) if a.weather else None
    tables.write(_dated(features.feature_table(rows, static, positions=positions, weather=hours, stride_minutes=a.snapshot_stride_minutes)), a.output, overwrite=a.overwrite)


def _settings(a):
    """The domain's constants with what the command line changes."""
    minutes = lambda x: None if x is None else x * 60.0
    given = {
        "outlier_s": a.max_abs_delay_seconds,
        "headway_min_s": a.min_scheduled_headway_seconds,
        "headway_max_s": minutes(a.max_scheduled_headway_minutes),
        "bunched_below": a.bunched_ratio,
        "gapped_above": a.gapped_ratio,
        "transfer_walk_m": a.max_walk_m,
        "transfer_wait_s": minutes(a.max_wait_minutes),
        "final_lead_max_min": a.max_final_lead_minutes,
        "late_above_s": a.late_delay_threshold_seconds,
    }
    return replace(DEFAULT, **{k: float(v) for k, v in given.items() if v is not None})


def _scan(spark, root, a):
    return tables.scan(spark, root, dates=a.date, start=a.start_date, end=a.end_date)


def _least(a, usual):
    return usual if a.min_observations is None else a.min_observations


def reliability_tables(spark, a):
    settings, least = _settings(a), _least(a, 1000)
    rows = reliability.base(_scan(spark, a.features, a), settings)
    every = written(reliability.rollups(rows, settings=settings), "rollups")
    for name, by in reliability.GROUPINGS.items():
        mine = every.where(F.col("grouping") == name)
        tables.write_summary(mine.drop("grouping", *(k for k in every.columns if k in reliability.KEYS and k not in by), *([] if "stop_id" in by else [c for c in ("stop_lat", "stop_lon") if c in every.columns])), f"{a.output}/{name}", overwrite=a.overwrite)
    modes = [("By mode", reliability.reliability(rows.withColumn("transit_mode", transit_mode("feed_name")), ("transit_mode",), settings=settings).orderBy("transit_mode"))] if "feed_name" in rows.columns else []
    worst = lambda name, *keys: reliability.worst(every.where(F.col("grouping") == name), least, 15, keys=keys).select(*keys, *reliability.SHOWN)
    sections = [("System", reliability.reliability(rows, settings=settings)), *modes, (f"Least reliable routes (at least {least} observations)", worst("route_summary", "route_id")), (f"Least reliable route stops (at least {least} observations)", worst("route_stop_summary", "route_id", "stop_id")), ("Least reliable dates", reliability.worst(every.where("grouping = 'system_by_date'"), 1, 15, keys=("snapshot_date",)).select("snapshot_date", *reliability.SHOWN)), ("Tables", "\n".join(f"- `{name}`" for name in reliability.GROUPINGS))]
    _text(spark, a.output, "report.md", tables.report("Reliability", sections))


def bunching_tables(spark, a):
    settings, least = _settings(a), _least(a, 1000)
    rows = _scan(spark, a.features, a).where(F.abs("delay_seconds") <= settings.outlier_s).withColumn("actual_arrival_utc", F.col("predicted_arrival_utc"))
    tables.write(_dated(bunching.events(rows, settings)), f"{a.output}/events", overwrite=a.overwrite)
    events = _scan(spark, f"{a.output}/events", a)
    for name, by in bunching.GROUPINGS.items():
        tables.write_summary(bunching.rollup(events, by), f"{a.output}/{name}", overwrite=a.overwrite)
    sections = [("System", bunching.rollup(events, ())), *((f"Most bunched by {', '.join(by)} (at least {least} headways)", bunching.most_bunched(spark.read.parquet(f"{a.output}/{name}.parquet"), least, 15, keys=by)) for name, by in bunching.GROUPINGS.items())]
    _text(spark, a.output, "report.md", tables.report("Bunching", sections))


def transfer_tables(spark, a):
    settings, least = _settings(a), _least(a, DEFAULT.transfer_min_rows)
    if not a.summaries_only:
        finals = _scan(spark, a.delay, a).where(F.abs("delay_seconds") < settings.outlier_s)
        stops = spark.read.parquet(f"{a.static}/stops").select("stop_id", "feed_name", F.col("stop_lat").try_cast("double").alias("stop_lat"), F.col("stop_lon").try_cast("double").alias("stop_lon"))
        seen = finals.withColumns({"scheduled_s": F.unix_seconds("scheduled_arrival_utc"), "actual_s": F.unix_seconds("predicted_arrival_utc")})
        events = transfers.connections(seen, transfers.stop_pairs(stops, settings), settings)
        tables.write(_dated(events), f"{a.output}/events", overwrite=a.overwrite)
    done = spark.read.parquet(f"{a.output}/events")
    told = []
    for name, by in (("stop_summary", ("from_stop_id", "from_route_id", "to_route_id")), ("route_pairs", ("from_route_id", "to_route_id"))):
        tables.write_summary(transfers.summary(done, by, least), f"{a.output}/{name}", overwrite=a.overwrite)
        summary = spark.read.parquet(f"{a.output}/{name}.parquet")
        told.append((f"Riskiest by {', '.join(by)} (at least {least} attempts)", summary.orderBy("success_rate", F.desc("attempts"), *by)))
    _text(spark, a.output, "report.md", tables.report("Transfers", told, n=15))


def evaluate(spark, a):
    settings = _settings(a)
    log = tables.scan_evolving(spark, a.log, {c: "double" for c in evaluation.INTERVAL})
    log = log.where(F.col("date").cast("string").isin(*a.date)) if a.date and "date" in log.columns else log
    truth = evaluation.observed(spark.read.parquet(a.delay), settings)
    matched = written(evaluation.match(log, truth, settings), "matched")
    summaries = {"overall": (), "by_lead": ("lead_bucket",), "by_mode": ("transit_mode",), "by_route": ("route_id",)}
    told = [("Coverage by day", evaluation.coverage(log, truth).orderBy("service_date"))]
    for name, by in summaries.items():
        if set(by) <= set(matched.columns):
            tables.write_summary(evaluation.error_summary(matched, by, a.min_route_rows if name == "by_route" else 0), f"{a.output}/error_{name}", overwrite=a.overwrite)
            summary = spark.read.parquet(f"{a.output}/error_{name}.parquet")
            told.append((f"Error {name.replace('_', ' ')}", summary.orderBy(F.desc("mae"), *by) if name == "by_route" else summary.orderBy(*by) if by else summary))
    tables.write_summary(evaluation.interval_summary(matched), f"{a.output}/intervals", overwrite=a.overwrite)
    told += [(f"Late arrivals (over {settings.late_above_s:.0f} s)", evaluation.late_summary(matched, settings=settings)), ("Intervals", spark.read.parquet(f"{a.output}/intervals.parquet"))]
    _text(spark, a.output, "report.md", tables.report("Live predictions", told))


def _text(spark, root, name, content):
    spark.createDataFrame([(content,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/{name}")


def _scored(found, rows):
    """rows with the point prediction of a boosted model, and its interval where the model has outer quantiles (never without the point in it)."""
    low, high = min(found.quantiles), max(found.quantiles)
    names = {0.5: "predicted_delay_seconds"} | ({low: "_low", high: "_high"} if low < 0.5 < high else {})
    out = boosting.predict(found, rows, names)
    if len(names) == 1:
        return out
    lower, upper = interval_clamp("predicted_delay_seconds", F.least("_low", "_high"), F.greatest("_low", "_high"))
    return out.withColumns({"predicted_delay_lower_seconds": lower, "predicted_delay_upper_seconds": upper}).drop("_low", "_high")


def train(spark, a):
    """Quantile boosting of the median (the point) and of the given quantiles; days that weren't trained on decide when to stop."""
    settings = _settings(a)
    rows = _scan(spark, a.features, a).where(F.abs("delay_seconds") < settings.outlier_s)
    days = written(baselines.time_split(rows), "days")
    marked = rows.join(F.broadcast(days), "snapshot_date")  # a row a day
    keys = [c for c in ("snapshot_date", "trip_id", "stop_id", "stop_sequence", "collected_at_utc") if c in rows.columns]
    fitted = written(baselines.hash_sample(marked.where("is_train"), keys, a.max_train_rows), "train")
    held = written(baselines.hash_sample(marked.where("is_validation"), keys, a.max_validation_rows), "validation")
    stops = days.count() > 1
    both = fitted.withColumn("_held", F.lit(False)).unionByName(held.withColumn("_held", F.lit(True))) if stops else fitted.withColumn("_held", F.lit(False))
    both = both.withColumn("_weight", baselines.sample_weight("delay_seconds", a.late_weight, settings))
    quantiles = sorted({0.5, *(a.quantiles or (0.1, 0.9))})
    found = boosting.fit(both, [*baselines.NUMERIC, *baselines.BOOLEAN], baselines.CATEGORICAL, quantiles=quantiles, weight="_weight", held="_held" if stops else None, rounds=a.rounds, patience=a.patience, rate=a.rate)
    boosting.save(spark, found, f"{a.output}/model", overwrite=a.overwrite)
    errors, gains = model.evaluation(_scored(found, held)), boosting.importance(found, 0.5)
    losses = {str(q): {"rounds": len(t), "pinball_loss": (x[len(t)] if x else None)} for q, t, x in zip(found.quantiles, found.trees, found.losses or [()] * len(quantiles))}
    _text(spark, a.output, "evaluation.json", json.dumps({"errors": errors, "quantiles": losses, "importance": dict(gains), "train_rows": fitted.count(), "validation_rows": held.count()}))
    _text(spark, a.output, "evaluation.md", model.report(errors, gains))


def predict(spark, a):
    found = boosting.load(spark, f"{a.model}/model")
    rows = _scan(spark, a.features, a)
    tables.write(_dated(_scored(found, rows if a.all_snapshots else live.newest_snapshot(rows))), f"{a.output}/scored", overwrite=a.overwrite)
    done = spark.read.parquet(f"{a.output}/scored")
    if "feed_delay_seconds" in done.columns:
        tables.write_summary(live.route_summary(done), f"{a.output}/routes", overwrite=a.overwrite)
    tables.write_summary(live.next_stops(done), f"{a.output}/next_stops", overwrite=a.overwrite)


def live_cycle(spark, a):
    """A live cycle, every --every-seconds (once where that isn't given): window, features, scores, log and the document clients load."""
    found = boosting.load(spark, f"{a.model}/model")
    static = {t: spark.read.parquet(f"{a.static}/{t}") for t in ("routes", "trips", "stops", "stop_times")}
    newest = {t: live.newest_of(df, "p_snapshot_date", ("feed_name",)) for t, df in static.items()}
    hours = spark.read.parquet(a.weather) if a.weather else None
    while True:
        now = datetime.fromisoformat(a.now) if a.now else datetime.now(timezone.utc)
        days = sorted({(now - timedelta(minutes=m)).strftime("%Y-%m-%d") for m in (0, a.window_minutes)})
        nested = written(gtfs_rt.decode_nested(gtfs_rt.snapshots(spark, a.raw, dates=days, feeds=a.feed)), "window")
        updates, positions = gtfs_rt.split(nested, "stop_time_updates"), gtfs_rt.split(nested, "vehicle_positions")

        def inputs(recent, positions=positions):
            rows = delay.delay_table(recent, newest["stop_times"], by_date=False, keep_all=True)
            return features.feature_table(rows, newest, positions=positions, weather=hours, stride_minutes=a.snapshot_stride_minutes or DEFAULT.stride_minutes, by_date=False, targets=False)

        out = live.cycle(updates, lambda rows: _scored(found, rows), positions, newest["routes"], newest["trips"], F.lit(now), features=inputs, window_minutes=a.window_minutes)
        tables.write(out["scored"].withColumns({"date": F.to_date("collected_at_utc").cast("string")}), f"{a.output}/log/run={now:%Y%m%dT%H%M%S}", overwrite=True)
        scored = spark.read.parquet(f"{a.output}/log/run={now:%Y%m%dT%H%M%S}")
        told = out | {"scored": scored, "summary": live.route_summary(scored, feed="current_predicted_delay_seconds"), "markers": live.markers(out["vehicles"], scored, F.lit(now))}
        exports.write_documents(live.document(told, F.lit(now), quantiles=(min(found.quantiles), max(found.quantiles))), f"{a.output}/live", overwrite=True)
        if not a.every_seconds:
            return
        time.sleep(max(0.0, a.every_seconds - (datetime.now(timezone.utc) - now).total_seconds()))


def timetable_document(spark, a):
    """The schedule of one day (--date) as one document: stops, patterns with their trips, footpaths."""
    day = a.date[0]
    static = {t: live.newest_of(spark.read.parquet(f"{a.static}/{t}"), "p_snapshot_date", ("feed_name",)) for t in ("stop_times", "trips", "stops", "calendar", "calendar_dates")}
    services = timetable.active_services(timetable.calendar_on(static["calendar"], day), static["calendar_dates"].where(F.to_date("date", "yyyyMMdd") == F.lit(day).cast("date")))
    trips = static["trips"].join(services, "service_id", "left_semi").select("feed_name", "trip_id", "route_id", F.col("direction_id").try_cast("bigint").alias("direction_id"))
    times = static["stop_times"].join(trips, ["feed_name", "trip_id"]).withColumn("stop_sequence", F.col("stop_sequence").try_cast("bigint"))
    stops = static["stops"].select("stop_id", "stop_name", F.round(F.col("stop_lat").try_cast("double"), 6).alias("stop_lat"), F.round(F.col("stop_lon").try_cast("double"), 6).alias("stop_lon")).where("stop_lat IS NOT NULL AND stop_lon IS NOT NULL").dropDuplicates(["stop_id"])
    exports.write_documents(exports.timetable(timetable.trip_patterns(times), stops, timetable.footpaths(stops)), f"{a.output}/timetable", overwrite=a.overwrite)


def retain(spark, a):
    """Removes local snapshots older than --days that the remote listing (Parquet: feed, date, name, size) confirms."""
    ended = retention.clean(spark, a.raw, spark.read.parquet(a.remote), a.manifests, days=a.days, today=a.now or f"{datetime.now(timezone.utc):%Y-%m-%d}")
    for m in ended:
        counts = {r["outcome"]: r["count"] for r in retention.finish(spark, m).groupBy("outcome").count().collect()}  # three outcomes
        print(f"{m}: {counts}")


def export(spark, a):
    hours = spark.read.parquet(f"{a.reliability}/route_by_hour.parquet")
    rates = dashboard.transfer_rates(spark.read.parquet(f"{a.transfers}/stop_summary.parquet"))
    exports.write_documents(dashboard.lookups(dashboard.route_hours(hours), rates), f"{a.output}/lookups", overwrite=a.overwrite)
    stops = spark.read.parquet(f"{a.reliability}/route_stop_summary.parquet")
    routes = exports.dashboard(spark.read.parquet(f"{a.reliability}/route_summary.parquet"), hours, stops, spark.read.parquet(f"{a.transfers}/stop_summary.parquet"))
    exports.write_documents(routes, f"{a.output}/routes", overwrite=a.overwrite)


def health(spark, a):
    """Prints each feed's state; exit code 1 where one is stale or missing. Feeds are named as feed=kind."""
    limits = DEFAULT.freshness_minutes | {k: v for k, v in (("realtime", a.max_realtime_age_minutes), ("alerts", a.max_alert_age_minutes), ("static", a.max_static_age_hours and a.max_static_age_hours * 60), ("weather", a.max_weather_age_hours and a.max_weather_age_hours * 60)) if v}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(a.raw).select(F.element_at(F.split("path", "/"), -3).alias("feed"), F.col("modificationTime").alias("updated"))
    expected = spark.createDataFrame([tuple(x.split("=", 1)) for x in a.expect or []], "feed string, kind string")
    told = live.health(files, expected, spark.range(1).select(F.current_timestamp().alias("now")), replace(DEFAULT, freshness_minutes=limits)).orderBy("feed").collect()  # a row a feed
    for r in told:
        print(f"[{'OK' if r['is_fresh'] else 'FAIL'}] {r['feed']} ({r['kind']}): " + ("nothing found" if r["age_minutes"] is None else f"{r['age_minutes']:.1f} minutes old"))
    raise SystemExit(0 if all(r["is_fresh"] for r in told) else 1)


#: Command: what runs it, and its folders in order of need (a leading ? marks one that may be left out).
COMMANDS = {
    "parse-realtime": (parse_realtime, ("raw", "output")),
    "parse-static": (parse_static, ("raw", "output")),
    "weather-features": (weather_features, ("raw", "output")),
    "delay-table": (delay_table, ("parsed", "static", "output")),
    "features": (feature_table, ("delay", "static", "?parsed", "?weather", "output")),
    "reliability": (reliability_tables, ("features", "output")),
    "bunching": (bunching_tables, ("features", "output")),
    "transfers": (transfer_tables, ("delay", "static", "output")),
    "evaluate": (evaluate, ("log", "delay", "output")),
    "train": (train, ("features", "output")),
    "predict": (predict, ("features", "model", "output")),
    "live": (live_cycle, ("raw", "static", "model", "?weather", "output")),
    "timetable": (timetable_document, ("static", "output")),
    "retention": (retain, ("raw", "remote", "manifests")),
    "export": (export, ("reliability", "transfers", "output")),
    "health": (health, ("raw",)),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidetable")
    commands = top.add_subparsers(dest="command", required=True)
    for name, (_, folders) in COMMANDS.items():
        p = commands.add_parser(name)
        for f in folders:
            p.add_argument(f"--{f.lstrip('?')}", required=not f.startswith("?"))
        p.add_argument("--date", action="append", help="only this date; may be repeated")
        p.add_argument("--start-date")
        p.add_argument("--end-date", help="dates before this one")
        p.add_argument("--overwrite", action="store_true")
        p.add_argument("--keep-all-snapshots", action="store_true")
        p.add_argument("--snapshot-stride-minutes", type=int)
        p.add_argument("--min-observations", type=int, help="in a report's lists: 1000, of transfers 10")
        p.add_argument("--max-abs-delay-seconds", type=float)
        p.add_argument("--min-scheduled-headway-seconds", type=float)
        p.add_argument("--max-scheduled-headway-minutes", type=float)
        p.add_argument("--bunched-ratio", type=float)
        p.add_argument("--gapped-ratio", type=float)
        p.add_argument("--max-walk-m", type=float)
        p.add_argument("--max-wait-minutes", type=float)
        p.add_argument("--max-final-lead-minutes", type=float)
        p.add_argument("--late-delay-threshold-seconds", type=float)
        p.add_argument("--min-route-rows", type=int, default=200)
        p.add_argument("--summaries-only", action="store_true", help="of transfer events that are there already")
        p.add_argument("--quantiles", type=float, nargs="+", help="of the interval: 0.1 0.9")
        p.add_argument("--patience", type=int, default=20)
        p.add_argument("--rate", type=float, default=0.05)
        p.add_argument("--window-minutes", type=int, default=60)
        p.add_argument("--every-seconds", type=float, help="of a live cycle; once if not given")
        p.add_argument("--now", help="an ISO time instead of the clock's")
        p.add_argument("--days", type=int, default=14)
        p.add_argument("--feed", action="append", help="only this feed; may be repeated")
        p.add_argument("--limit-files", type=int, help="at most so many files, the first by path")
        p.add_argument("--max-train-rows", type=int, default=2_000_000)
        p.add_argument("--max-validation-rows", type=int, default=500_000)
        p.add_argument("--rounds", type=int, default=200)
        p.add_argument("--late-weight", type=float, default=3.0)
        p.add_argument("--all-snapshots", action="store_true", help="score every poll, not the newest alone")
        p.add_argument("--expect", action="append", help="feed=kind, with kind realtime, alerts, static or weather; may be repeated")
        p.add_argument("--max-realtime-age-minutes", type=float)
        p.add_argument("--max-alert-age-minutes", type=float)
        p.add_argument("--max-static-age-hours", type=float)
        p.add_argument("--max-weather-age-hours", type=float)
        p.add_argument("--master")
    return top


def main(argv: Sequence[str] | None = None) -> None:
    a = parser().parse_args(argv)
    COMMANDS[a.command][0](build(master=a.master), a)


if __name__ == "__main__":
    main()
