"""Queries over the driver's tables, each with its SQL.

The transit tables aren't there, so adapters give `events`, `orders`, `part` and `lineitem` their shape: most queries
then run the library's own transforms, a few show an operator by itself. The SQL says the same independently of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import quantiles as QT
from ..operators import windows as W
from ..sources import gtfs_static, tables
from . import baselines, boosting, bunching, dashboard, delay, evaluation, features, live, map_layers, raptor, reliability, timetable, transfers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


# --- adapters -----------------------------------------------------------------------------------------------------


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as predictions: user is the trip, event type the route, props.k the stop and the lead time."""
    k = F.get_json_object("props", "$.k").cast("int")
    ts = F.col("ts").cast("timestamp")
    e = read(spark, sf_dir, "events").select("event_id", ts.alias("collected_at_utc"), "user_id", "event_type", "value", k.alias("k"))
    minute = (F.floor(F.unix_seconds("collected_at_utc") / 60) * 60).cast("bigint")
    late = F.col("value") * 20.0 - 200.0
    out = e.select(
        "event_id",
        "collected_at_utc",
        F.col("collected_at_utc").cast("date").alias("snapshot_date"),
        F.col("user_id").alias("trip_id"),
        F.col("event_type").alias("route_id"),
        (F.col("event_id") % 2).alias("direction_id"),
        (F.col("k") % 10).cast("bigint").alias("stop_id"),
        (F.col("k") % 10).cast("bigint").alias("stop_sequence"),
        F.when(F.col("user_id") % 5 == 0, "lrt_trip_updates").otherwise("bus_trip_updates").alias("feed_name"),
        late.alias("delay_seconds"),
        (F.col("value") * 18.0 - 150.0).alias("predicted_delay_seconds"),
        (F.col("k") - 10).cast("double").alias("prediction_lead_minutes"),
        minute.alias("scheduled_s"),
        (minute + F.floor(late)).cast("bigint").alias("actual_s"),
    )
    local = C.local_parts("collected_at_utc")
    return out.withColumns({"scheduled_arrival_utc": F.timestamp_seconds("scheduled_s"), "actual_arrival_utc": F.timestamp_seconds("actual_s"), "predicted_arrival_utc": F.timestamp_seconds("actual_s"), "hour_of_day": local["hour_of_day"], "day_of_week": local["day_of_week"]})


OBS = """obs AS (
  SELECT event_id, ts AS collected_at, CAST(ts AS DATE) AS snapshot_date, user_id AS trip_id, event_type AS route_id, event_id % 2 AS direction_id,
    CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS BIGINT) AS stop_id, CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS BIGINT) AS stop_sequence,
    CASE WHEN user_id % 5 = 0 THEN 'lrt_trip_updates' ELSE 'bus_trip_updates' END AS feed_name,
    value * CAST(20 AS DOUBLE) - 200 AS delay_seconds, value * CAST(18 AS DOUBLE) - 150 AS predicted_delay_seconds,
    CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) - 10 AS DOUBLE) AS prediction_lead_minutes,
    (epoch_us(ts) // 60000000) * 60 AS scheduled_s,
    (epoch_us(ts) // 60000000) * 60 + CAST(floor(value * CAST(20 AS DOUBLE) - 200) AS BIGINT) AS actual_s,
    epoch_us(ts) // 1000000 AS collected_s,
    extract(hour FROM timezone('America/Toronto', timezone('UTC', ts))) AS hour_of_day,
    extract(dow FROM timezone('America/Toronto', timezone('UTC', ts))) AS day_of_week
  FROM events)"""


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        p.alias("stop_id"), (43.40 + (p * 7919 % 1000) / 5000.0).alias("lat"), (-80.60 + (p * 104729 % 1000) / 5000.0).alias("lon"), F.when(F.col("p_size") % 2 == 0, "bus").otherwise("lrt").alias("feed_name")
    )


STOPS = """stops AS (
  SELECT p_partkey AS stop_id, 43.40::DOUBLE + (p_partkey * 7919 % 1000) / 5000.0::DOUBLE AS lat, -80.60::DOUBLE + (p_partkey * 104729 % 1000) / 5000.0::DOUBLE AS lon,
    CASE WHEN p_size % 2 = 0 THEN 'bus' ELSE 'lrt' END AS feed_name FROM part)"""
HAVERSINE = "2 * 6371000.0::DOUBLE * asin(sqrt(least(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 1)))"


def sched(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return read(spark, sf_dir, "orders").select(
        key.alias("trip_id"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("start_date"),
        F.concat(two(key % 30), F.lit(":"), two(customer % 60), F.lit(":00")).alias("arrival_time"),
        F.concat(two(key % 30 % 24), F.lit(":00:00")).alias("start_time"),
        F.when(key % 5 == 0, "lrt_trip_updates").otherwise("bus_trip_updates").alias("feed_name"),
        (customer % 20 + 1).alias("stop_sequence"),
    )


SCHED = """sched AS (
  SELECT o_orderkey AS trip_id, strftime(o_orderdate, '%Y%m%d') AS start_date,
    lpad(CAST(o_orderkey % 30 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0') || ':00' AS arrival_time,
    lpad(CAST(o_orderkey % 30 % 24 AS VARCHAR), 2, '0') || ':00:00' AS start_time,
    CASE WHEN o_orderkey % 5 = 0 THEN 'lrt_trip_updates' ELSE 'bus_trip_updates' END AS feed_name, o_custkey % 20 + 1 AS stop_sequence
  FROM orders)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("date").alias("service_date"), F.col("user_id").alias("trip_id"), F.col("event_type").alias("route_id"), (k - 10).cast("double").alias("prediction_lead_minutes"),
        (v * 20.0 - 200.0).alias("observed_delay_seconds"), (v * 18.0 - 150.0).alias("predicted_delay_seconds"), (v * 25.0 - 220.0).alias("feed_delay_seconds"), (v * 18.0 - 350.0).alias("predicted_delay_lower_seconds"), (v * 18.0 + 50.0).alias("predicted_delay_upper_seconds"),
        F.when(F.col("user_id") % 5 == 0, "lrt").otherwise("bus").alias("transit_mode"),
    ).withColumn("lead_bucket", C.lead_bucket("prediction_lead_minutes"))


LOG = """log AS (
  SELECT *, CASE WHEN lead >= 0 AND lead < 5 THEN '00-05' WHEN lead >= 5 AND lead < 10 THEN '05-10' WHEN lead >= 10 AND lead < 20 THEN '10-20' WHEN lead >= 20 AND lead < 40 THEN '20-40' WHEN lead >= 40 THEN '40+' END AS lead_bucket
  FROM (SELECT event_id, CAST(ts AS DATE) AS service_date, user_id AS trip_id, event_type AS route_id, CAST(json_extract_string(props, '$.k') AS INTEGER) - 10 AS lead,
    value * CAST(20 AS DOUBLE) - 200 AS observed, value * CAST(18 AS DOUBLE) - 150 AS predicted, value * CAST(25 AS DOUBLE) - 220 AS feed,
    value * CAST(18 AS DOUBLE) - 350 AS lo, value * CAST(18 AS DOUBLE) + 50 AS hi, CASE WHEN user_id % 5 = 0 THEN 'lrt' ELSE 'bus' END AS transit_mode FROM events))"""


# --- registration -------------------------------------------------------------------------------------------------


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, dates as text, integers as long: values that compare across engines."""
    out = []
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        out.append((F.round(c, 6) if kind == "double" else c.cast("string") if kind == "date" else c.cast("bigint") if kind in ("integer", "short", "byte") else c.cast("double") if kind.startswith("decimal") else c).alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None, *ctes: str, tidied: bool = False) -> Callable:
    """Registers a query with its SQL. tidied: its rows are as tidy would make them, which would work on each row of a large result."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f if tidied else lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if sql is not None:
            SQL[name] = (("WITH " + ",\n".join(ctes) + "\n") if ctes else "") + sql
        return f

    return add


def q(x: str, name: str) -> str:
    return f"round({x}, 6) AS {name}"


def text_date(x: str = "snapshot_date") -> str:
    return f"CAST({x} AS VARCHAR) AS {x}"


# --- reliability ----------------------------------------------------------------------------------------------------

METRICS = ", ".join(
    [
        "count(*) AS observations", "count(DISTINCT snapshot_date) AS service_days", "count(DISTINCT trip_id) AS trips", q("avg(delay_seconds)", "mean_delay_seconds"), q("median(delay_seconds)", "median_delay_seconds"),
        q("quantile_cont(delay_seconds, 0.75)", "p75_delay_seconds"), q("quantile_cont(delay_seconds, 0.90)", "p90_delay_seconds"), q("quantile_cont(delay_seconds, 0.95)", "p95_delay_seconds"), q("avg(abs(delay_seconds))", "mean_abs_delay_seconds"),
        q("avg(CASE WHEN delay_seconds BETWEEN -60 AND 300 THEN 1.0 ELSE 0.0 END)", "on_time_rate"), q("avg(CASE WHEN delay_seconds > 300 THEN 1.0 ELSE 0.0 END)", "late_rate"), q("avg(CASE WHEN delay_seconds < -60 THEN 1.0 ELSE 0.0 END)", "early_rate"),
    ]
)
GOOD = "delay_seconds IS NOT NULL AND abs(delay_seconds) <= 3600"


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliability.base(obs(spark, sf_dir))


def _keys_sql(by: tuple[str, ...]) -> tuple[str, str]:
    return ", ".join(text_date(k) if k == "snapshot_date" else k for k in by), ", ".join(f"obs.{k}" if k == "snapshot_date" else k for k in by)


for _name, _by in reliability.GROUPINGS.items():
    _select, _group = _keys_sql(_by)
    query(f"reliability_{_name}", f"SELECT {_select}, {METRICS} FROM obs WHERE {GOOD} GROUP BY {_group}", OBS)(lambda s, d, by=_by: reliability.rollup(base(s, d), by))


@query("system_overall", f"SELECT {METRICS} FROM obs WHERE {GOOD}", OBS)
def _(s, d):
    return M.reliability(base(s, d))


@query("by_mode", f"SELECT CASE WHEN feed_name LIKE 'bus_%' THEN 'bus' WHEN feed_name LIKE 'lrt_%' THEN 'lrt' ELSE 'unknown' END AS transit_mode, {METRICS} FROM obs WHERE {GOOD} GROUP BY 1", OBS)
def _(s, d):
    return base(s, d).withColumn("transit_mode", C.transit_mode("feed_name")).transform(M.reliability, ("transit_mode",))


@query("delay_flags", "SELECT event_id, delay_seconds < -60 AS is_early, delay_seconds BETWEEN -60 AND 300 AS is_on_time, delay_seconds > 300 AS is_late FROM obs", OBS)
def _(s, d):
    return obs(s, d).withColumns(C.delay_flags("delay_seconds")).select("event_id", "is_early", "is_on_time", "is_late")


_ALL_KEYS = tuple(dict.fromkeys(k for by in reliability.GROUPINGS.values() for k in by))
_ALL_SETS = "\nUNION ALL ".join(
    f"SELECT '{name}' AS grouping, " + ", ".join((text_date(k) if k == "snapshot_date" else k) if k in by else f"CAST(NULL AS {'VARCHAR' if k in ('snapshot_date', 'route_id') else 'BIGINT'}) AS {k}" for k in _ALL_KEYS) + f", {METRICS} FROM obs WHERE {GOOD} GROUP BY {', '.join(f'obs.{k}' for k in by)}"
    for name, by in reliability.GROUPINGS.items()
)


@query("reliability_all", _ALL_SETS, OBS)
def _(s, d):
    return reliability.rollups(base(s, d))


for _name, _key in (("routes", "route_id"), ("stops", "stop_id"), ("dates", "snapshot_date")):
    _shown, _grouped = _keys_sql((_key,))
    query(f"worst_{_name}", f"SELECT * FROM (SELECT {_shown}, {METRICS} FROM obs WHERE {GOOD} GROUP BY {_grouped}) WHERE observations >= 20 ORDER BY on_time_rate NULLS LAST, p90_delay_seconds DESC NULLS LAST, {_key} LIMIT 10", OBS)(
        lambda s, d, key=_key: reliability.worst(tidy(reliability.rollup(base(s, d), (key,))), 20, 10, keys=(key,))
    )

_DAILY = f"daily AS (SELECT snapshot_date, {METRICS} FROM obs WHERE {GOOD} GROUP BY snapshot_date)"


@query("rollup_of_rollup", f"SELECT CAST(sum(observations) AS BIGINT) AS observations, {q('avg(on_time_rate)', 'on_time_rate')}, {q('avg(late_rate)', 'late_rate')}, {q('median(median_delay_seconds)', 'median_delay_seconds')}, {q('quantile_cont(p90_delay_seconds, 0.9)', 'p90_delay_seconds')} FROM daily", OBS, _DAILY)
def _(s, d):
    return reliability.of_daily(tidy(reliability.rollup(base(s, d), ("snapshot_date",))))


_HOURLY = f"hourly AS (SELECT route_id, hour_of_day, {METRICS} FROM obs WHERE {GOOD} GROUP BY route_id, hour_of_day)"


@query("weighted_rate", f"SELECT route_id, {q('sum(on_time_rate * observations) / sum(observations)', 'on_time_rate')}, CAST(sum(observations) AS BIGINT) AS observations FROM hourly GROUP BY route_id", OBS, _HOURLY)
def _(s, d):
    return reliability.weighted(tidy(reliability.rollup(base(s, d), ("route_id", "hour_of_day"))), ("route_id",))


@query("system_hour_weighted", f"SELECT hour_of_day, {q('sum(on_time_rate * observations) / sum(observations)', 'on_time_rate')}, CAST(sum(observations) AS BIGINT) AS observations FROM hourly GROUP BY hour_of_day", OBS, _HOURLY)
def _(s, d):
    return reliability.weighted(tidy(reliability.rollup(base(s, d), ("route_id", "hour_of_day"))), ("hour_of_day",))


@query("reliability_band", f"SELECT route_id, hour_of_day, CASE WHEN on_time_rate >= 0.95 THEN 'good' WHEN on_time_rate >= 0.9 THEN 'fair' WHEN on_time_rate >= 0.85 THEN 'poor' ELSE 'bad' END AS band FROM hourly", OBS, _HOURLY)
def _(s, d):
    return tidy(reliability.rollup(base(s, d), ("route_id", "hour_of_day"))).select("route_id", "hour_of_day", C.reliability_band("on_time_rate").alias("band"))


@query("delay_stats", f"SELECT count(*) AS rows, count(DISTINCT trip_id) AS trips, count(DISTINCT route_id) AS routes, count(DISTINCT stop_id) AS stops, {q('min(delay_seconds)', 'min_delay')}, {q('max(delay_seconds)', 'max_delay')}, {q('avg(delay_seconds)', 'mean_delay')}, {q('median(delay_seconds)', 'median_delay')}, {q('quantile_cont(delay_seconds, 0.95)', 'p95_delay')} FROM obs", OBS)
def _(s, d):
    return delay.delay_stats(obs(s, d))


_MONTHLY = "month AS (SELECT strftime(snapshot_date, '%Y-%m') AS month, route_id, delay_seconds FROM obs WHERE delay_seconds IS NOT NULL)"


@query("monthly_percentiles", f"SELECT month, route_id, count(*) AS observations, {q('median(delay_seconds)', 'median_delay_seconds')}, {q('quantile_cont(delay_seconds, 0.90)', 'p90_delay_seconds')} FROM month GROUP BY month, route_id", OBS, _MONTHLY)
def _(s, d):
    daily = QT.value_counts(obs(s, d), ("snapshot_date", "route_id"), "delay_seconds")  # what a day's job would have kept
    return reliability.of_counts(daily.withColumn("month", F.date_format("snapshot_date", "yyyy-MM")), ("month", "route_id"), {"median_delay_seconds": 0.5, "p90_delay_seconds": 0.9})


# --- scans, filters, projections ----------------------------------------------------------------------------------------


@query("scan_parquet", "SELECT event_type, count(*) AS rows, round(sum(value), 6) AS value FROM events GROUP BY event_type")
def _(s, d):
    return tables.scan(s, f"{d}/events.parquet").groupBy("event_type").agg(F.count("*").alias("rows"), F.sum("value").alias("value"))


@query("scan_pruned", "SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'")
def _(s, d):
    return tables.scan(s, f"{d}/events.parquet", start="2024-01-10", end="2024-01-11", column="ts").select("event_id", "value")


@query("project_exclude", "SELECT * EXCLUDE (props, ts) FROM events")
def _(s, d):
    return read(s, d, "events").drop("props", "ts")


@query("filter_not_null", "SELECT event_id, user_id FROM events WHERE value IS NOT NULL AND props IS NOT NULL")
def _(s, d):
    return read(s, d, "events").where("value IS NOT NULL AND props IS NOT NULL").select("event_id", "user_id")


@query("filter_outlier", "SELECT event_id, round(delay_seconds, 6) AS delay_seconds FROM obs WHERE abs(delay_seconds) < 3600", OBS)
def _(s, d):
    return obs(s, d).where(F.abs("delay_seconds") < 3600).select("event_id", "delay_seconds")


@query("filter_causal", "SELECT event_id FROM obs WHERE prediction_lead_minutes >= 0", OBS)
def _(s, d):
    return obs(s, d).where("prediction_lead_minutes >= 0").select("event_id")


@query("filter_date_in", "SELECT event_id FROM obs WHERE snapshot_date IN (DATE '2024-01-03', DATE '2024-01-07')", OBS)
def _(s, d):
    return obs(s, d).where("snapshot_date IN (DATE '2024-01-03', DATE '2024-01-07')").select("event_id")


@query("case_like_map", "SELECT event_id, CASE WHEN feed_name LIKE 'bus_%' THEN 'bus' WHEN feed_name LIKE 'lrt_%' THEN 'lrt' ELSE 'unknown' END AS transit_mode FROM obs", OBS)
def _(s, d):
    return obs(s, d).select("event_id", C.transit_mode("feed_name").alias("transit_mode"))


@query("case_day_name", "SELECT event_id, CASE day_of_week WHEN 0 THEN 'Sunday' WHEN 1 THEN 'Monday' WHEN 2 THEN 'Tuesday' WHEN 3 THEN 'Wednesday' WHEN 4 THEN 'Thursday' WHEN 5 THEN 'Friday' ELSE 'Saturday' END AS day_name FROM obs", OBS)
def _(s, d):
    return obs(s, d).select("event_id", C.day_name("day_of_week").alias("day_name"))


@query("newest_snapshot", "SELECT event_id FROM obs WHERE snapshot_date = (SELECT max(snapshot_date) FROM obs)", OBS)
def _(s, d):
    rows = obs(s, d)
    newest = rows.agg(F.max("snapshot_date").alias("newest"))  # one row
    return rows.join(F.broadcast(newest), rows["snapshot_date"] == newest["newest"]).select("event_id")


@query("latest_snapshot", "SELECT event_type, CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS latest FROM events GROUP BY event_type")
def _(s, d):
    return read(s, d, "events").groupBy("event_type").agg(F.max(F.col("ts").cast("date")).cast("string").alias("latest"))


@query("latest_complete_snapshot", "SELECT user_id, CAST(max(day) AS VARCHAR) AS latest FROM (SELECT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1, 2 HAVING count(DISTINCT event_type) = 3) GROUP BY user_id")
def _(s, d):
    rows = read(s, d, "events").select(F.col("user_id").alias("feed_name"), F.col("ts").cast("date").alias("p_snapshot_date"), "event_type")
    kinds = {t: rows.where(F.col("event_type") == t) for t in ("click", "view", "purchase")}
    return gtfs_static.latest_complete(kinds).select(F.col("feed_name").alias("user_id"), F.col("p_snapshot_date").cast("string").alias("latest"))


@query("json_nested_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(s, d):
    return read(s, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("route_search", "SELECT DISTINCT route_id, feed_name FROM obs WHERE contains(lower(concat_ws(' ', route_id, feed_name)), 'lrt')", OBS)
def _(s, d):
    return obs(s, d).select("route_id", "feed_name").distinct().where(F.contains(F.lower(F.concat_ws(" ", "route_id", "feed_name")), F.lit("lrt")))


@query("route_sort_natural", "SELECT route, row_number() OVER (ORDER BY TRY_CAST(route AS INTEGER) NULLS LAST, route) AS place FROM (SELECT DISTINCT CASE WHEN p_size % 7 = 0 THEN 'X' || CAST(p_size AS VARCHAR) ELSE CAST(p_size AS VARCHAR) END AS route FROM part)")
def _(s, d):
    size = F.col("p_size").cast("string")
    routes = read(s, d, "part").select(F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("X"), size)).otherwise(size).alias("route")).distinct()
    return routes.withColumn("place", F.row_number().over(Window.orderBy(F.col("route").try_cast("int").asc_nulls_last(), "route")))  # one row a route


@query("union_by_name", "SELECT id, name, note FROM (SELECT n_nationkey AS id, n_name AS name, NULL::VARCHAR AS note FROM nation UNION ALL BY NAME SELECT r_regionkey AS id, r_name AS name, 'region' AS note FROM region)")
def _(s, d):
    a = read(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    b = read(s, d, "region").select(F.lit("region").alias("note"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("id"))
    return a.unionByName(b, allowMissingColumns=True).select("id", "name", "note")


@query("distinct_dims", "SELECT DISTINCT route_id, feed_name, direction_id FROM obs", OBS)
def _(s, d):
    return obs(s, d).select("route_id", "feed_name", "direction_id").distinct()


# --- windows ----------------------------------------------------------------------------------------------------------

_KEY = ("snapshot_date", "route_id", "stop_id")


@query("final_observation", "SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_date, route_id, stop_id ORDER BY collected_at DESC, event_id) AS rn FROM obs WHERE prediction_lead_minutes >= 0) WHERE rn = 1", OBS)
def _(s, d):
    return W.final_observation(obs(s, d), _KEY, ("event_id",)).select("event_id")


@query("latest_vehicle", "SELECT trip_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY scheduled_s DESC NULLS LAST, collected_at DESC, event_id) AS rn FROM obs) WHERE rn = 1", OBS)
def _(s, d):
    return W.latest_per_key(obs(s, d), ["trip_id"], [F.col("scheduled_s").desc_nulls_last(), F.col("collected_at_utc").desc(), F.col("event_id")]).select("trip_id", "event_id")


@query("latest_weather", "SELECT route_id, hour_s, event_id FROM (SELECT *, collected_s // 3600 * 3600 AS hour_s, row_number() OVER (PARTITION BY route_id, collected_s // 3600 ORDER BY collected_at DESC, event_id) AS rn FROM obs) WHERE rn = 1", OBS)
def _(s, d):
    rows = obs(s, d).withColumn("hour_s", F.unix_seconds(F.date_trunc("hour", "collected_at_utc")))
    return W.latest_per_key(rows, ["route_id", "hour_s"], [F.col("collected_at_utc").desc(), F.col("event_id")]).select("route_id", "hour_s", "event_id")


@query("stride_thin", "SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY trip_id, route_id, collected_s // 86400 ORDER BY collected_at DESC, event_id) AS rn FROM obs) WHERE rn = 1", OBS)
def _(s, d):
    return W.stride_thin(obs(s, d), 1440, ["trip_id", "route_id"], ("event_id",)).select("event_id")


_V = "predicted_delay_seconds"


@query(
    "lag_features",
    f"SELECT event_id, row_number() OVER w - 1 AS prior, {q(f'lag({_V}) OVER w', 'lag_1')}, {q(f'lag({_V}, 2) OVER w', 'lag_2')}, {q(f'lag({_V}, 5) OVER w', 'lag_5')}, {q(f'{_V} - lag({_V}) OVER w', 'delta')}, epoch_us(collected_at) - epoch_us(lag(collected_at) OVER w) AS micros FROM obs WINDOW w AS (PARTITION BY trip_id ORDER BY collected_at, event_id)",
    OBS,
)
def _(s, d):
    rows = W.history_features(obs(s, d), ["trip_id"], ["collected_at_utc", "event_id"])
    return rows.select("event_id", F.col("prior_prediction_count").alias("prior"), F.col(f"previous_{_V}").alias("lag_1"), F.col(f"previous_2_{_V}").alias("lag_2"), F.col(f"previous_5_{_V}").alias("lag_5"), F.col("predicted_delay_delta_seconds").alias("delta"), F.round(F.col("minutes_since_previous_prediction") * 60e6).cast("bigint").alias("micros"))


@query("recent_frame", f"SELECT event_id, {q(f'avg({_V}) OVER w', 'mean_5')}, {q(f'min({_V}) OVER w', 'min_5')}, {q(f'max({_V}) OVER w', 'max_5')} FROM obs WINDOW w AS (PARTITION BY trip_id ORDER BY collected_at, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)", OBS)
def _(s, d):
    rows = W.history_features(obs(s, d), ["trip_id"], ["collected_at_utc", "event_id"])
    return rows.select("event_id", F.col("recent_predicted_delay_mean_5").alias("mean_5"), F.col("recent_predicted_delay_min_5").alias("min_5"), F.col("recent_predicted_delay_max_5").alias("max_5"))


@query("previous_stop_lag", f"SELECT event_id, {q(f'lag({_V}) OVER w', 'previous')}, {q(f'{_V} - lag({_V}) OVER w', 'delta')} FROM obs WINDOW w AS (PARTITION BY snapshot_date, trip_id ORDER BY stop_sequence, event_id)", OBS)
def _(s, d):
    rows = W.previous_stop(obs(s, d), ["snapshot_date", "trip_id"], ["stop_sequence", "event_id"])
    return rows.select("event_id", F.col(f"previous_stop_{_V}").alias("previous"), F.col("previous_stop_predicted_delay_delta_seconds").alias("delta"))


@query("final_target_join", f"SELECT o.event_id, {q('t.final', 'delay_seconds')} FROM obs o JOIN (SELECT snapshot_date, trip_id, stop_id, arg_max({_V}, (collected_at, event_id)) AS final FROM obs WHERE prediction_lead_minutes >= 0 GROUP BY 1, 2, 3) t ON o.snapshot_date = t.snapshot_date AND o.trip_id = t.trip_id AND o.stop_id = t.stop_id", OBS)
def _(s, d):
    return features.with_final_target(obs(s, d).drop("delay_seconds")).select("event_id", "delay_seconds")


@query("final_targets", f"SELECT {text_date()}, trip_id, stop_id, {q(f'arg_max({_V}, (collected_at, event_id))', 'delay_seconds')}, max(collected_s) AS final_s FROM obs WHERE prediction_lead_minutes >= 0 GROUP BY obs.snapshot_date, trip_id, stop_id", OBS)
def _(s, d):
    return features.final_targets(obs(s, d)).select("snapshot_date", "trip_id", "stop_id", "delay_seconds", F.unix_seconds("final_collected_at_utc").alias("final_s"))


# --- bunching ---------------------------------------------------------------------------------------------------------

_HEAD = """heads AS (
  SELECT *, scheduled_s - lag(scheduled_s) OVER w AS scheduled_headway, actual_s - lag(actual_s) OVER w AS actual_headway, lag(trip_id) OVER w AS leader
  FROM obs WINDOW w AS (PARTITION BY snapshot_date, route_id, direction_id, stop_id ORDER BY scheduled_s, trip_id, event_id))"""
_BUNCH = _HEAD.strip() + """,
bunch AS (SELECT *, CAST(actual_headway AS DOUBLE) / scheduled_headway AS ratio FROM heads WHERE leader IS NOT NULL AND scheduled_headway BETWEEN 120 AND 86400 AND abs(actual_headway) <= 86400)"""
_WAIT = "sum(pow(greatest(actual_headway, 0), 2)) / nullif(2 * sum(greatest(actual_headway, 0)), 0) - sum(pow(scheduled_headway, 2)) / nullif(2 * sum(scheduled_headway), 0)"
_BUNCH_METRICS = ", ".join(
    [
        "count(*) AS headways", q("avg(CASE WHEN ratio < 0.5 THEN 1.0 ELSE 0.0 END)", "bunched_rate"), q("avg(CASE WHEN ratio > 1.5 THEN 1.0 ELSE 0.0 END)", "gapped_rate"), q("avg(CASE WHEN ratio BETWEEN 0.5 AND 1.5 THEN 1.0 ELSE 0.0 END)", "on_headway_rate"),
        q("avg(ratio)", "mean_headway_ratio"), q("median(ratio)", "median_headway_ratio"), q("avg(scheduled_headway)", "mean_scheduled_headway_seconds"), q(_WAIT, "excess_wait_seconds"),
    ]
)


def _bunching(s, d):
    from dataclasses import replace

    from ..config import DEFAULT

    kept = W.headways(obs(s, d), tie=("trip_id", "event_id"))
    settings = replace(DEFAULT, headway_max_s=86400.0, headway_actual_max_s=86400.0)
    return bunching.flagged(kept, settings)


@query("headways", f"SELECT event_id, leader AS leader_trip_id, scheduled_headway AS scheduled_headway_seconds, actual_headway AS actual_headway_seconds, {q('CAST(actual_headway AS DOUBLE) / nullif(scheduled_headway, 0)', 'headway_ratio')} FROM heads", OBS, _HEAD)
def _(s, d):
    return W.headways(obs(s, d), tie=("trip_id", "event_id")).select("event_id", "leader_trip_id", "scheduled_headway_seconds", "actual_headway_seconds", "headway_ratio")


for _name, _by in bunching.GROUPINGS.items():
    query(f"bunching_{_name}", f"SELECT {', '.join(_by)}, {_BUNCH_METRICS} FROM bunch GROUP BY {', '.join(_by)}", OBS, _BUNCH)(lambda s, d, by=_by: bunching.rollup(_bunching(s, d), by))

for _name, _by in (("routes", "route_id"), ("stops", "stop_id")):
    query(f"most_bunched_{_name}", f"SELECT * FROM (SELECT {_by}, {_BUNCH_METRICS} FROM bunch GROUP BY {_by}) WHERE headways >= 5 ORDER BY bunched_rate DESC NULLS LAST, excess_wait_seconds DESC NULLS LAST, {_by} LIMIT 5", OBS, _BUNCH)(
        lambda s, d, by=_by: bunching.most_bunched(tidy(bunching.rollup(_bunching(s, d), (by,))), 5, 5, keys=(by,))
    )


# --- joins ------------------------------------------------------------------------------------------------------------


@query("spatial_band_join", f"SELECT a.stop_id AS a_stop, b.stop_id AS b_stop, round({HAVERSINE}, 3) AS metres FROM stops a, stops b WHERE abs(a.lat - b.lat) < 0.01 AND abs(a.lon - b.lon) < 0.01 AND {HAVERSINE} <= 150", STOPS, tidied=True)
def _(s, d):
    near = J.grid_band_join(stops(s, d).select("stop_id", "lat", "lon"), 150.0, digits=3)
    return near.select(F.col("a_stop_id").alias("a_stop"), F.col("b_stop_id").alias("b_stop"), F.col("distance_m").alias("metres"))


@query("footpaths", f"SELECT a.stop_id AS a_stop, b.stop_id AS b_stop, CAST(floor({HAVERSINE} / 1.25) AS BIGINT) + 30 AS seconds FROM stops a, stops b WHERE a.stop_id < b.stop_id AND abs(a.lat - b.lat) < 0.01 AND abs(a.lon - b.lon) < 0.01 AND {HAVERSINE} <= 250", STOPS)
def _(s, d):
    near = timetable.footpaths(stops(s, d).select("stop_id", F.col("lat").alias("stop_lat"), F.col("lon").alias("stop_lon")))
    return near.select(F.col("from_stop").alias("a_stop"), F.col("to_stop").alias("b_stop"), "seconds")


@query("nearest_stops", "SELECT stop_id, metres, rank FROM (SELECT b.stop_id, round(" + HAVERSINE + ", 3) AS metres, row_number() OVER (ORDER BY round(" + HAVERSINE + ", 3), b.stop_id) AS rank FROM (SELECT 43.47::DOUBLE AS lat, -80.52::DOUBLE AS lon) a, stops b WHERE " + HAVERSINE + " <= 5000) WHERE rank <= 6", STOPS)
def _(s, d):
    here = s.range(1).select(F.col("id").alias("query_id"), F.lit(43.47).alias("lat"), F.lit(-80.52).alias("lon"))
    return J.nearest_k(here, stops(s, d), 6, within_m=5000.0).select("stop_id", F.col("distance_m").alias("metres"), "rank")


@query("nearest_k", "SELECT stop_id, neighbour, metres, rank FROM (SELECT a.stop_id, b.stop_id AS neighbour, round(" + HAVERSINE + ", 3) AS metres, row_number() OVER (PARTITION BY a.stop_id ORDER BY round(" + HAVERSINE + ", 3), b.stop_id) AS rank FROM stops a JOIN stops b ON a.stop_id <> b.stop_id) WHERE rank <= 5", STOPS)
def _(s, d):
    places = stops(s, d)
    near = J.nearest_k(places.withColumnRenamed("stop_id", "query_id"), places, 5, others=True)
    return near.select(F.col("query_id").alias("stop_id"), F.col("stop_id").alias("neighbour"), F.col("distance_m").alias("metres"), "rank")


@query("haversine", f"SELECT b.stop_id, round({HAVERSINE}, 3) AS metres FROM (SELECT 43.47::DOUBLE AS lat, -80.52::DOUBLE AS lon) a, stops b", STOPS)
def _(s, d):
    return stops(s, d).select("stop_id", F.round(C.haversine_m(F.lit(43.47), F.lit(-80.52), "lat", "lon"), 3).alias("metres"))


@query("join_schedule", "SELECT o.o_orderkey AS trip_id, o.o_custkey % 3 + 1 AS stop_sequence, CAST(l.l_linenumber AS BIGINT) AS seq_key, l.l_partkey AS stop_id FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_linenumber = CASE WHEN o.o_orderkey % 5 = 0 THEN o.o_custkey % 3 ELSE o.o_custkey % 3 + 1 END")
def _(s, d):
    updates = read(s, d, "orders").select(F.col("o_orderkey").alias("trip_id"), (F.col("o_custkey") % 3 + 1).alias("stop_sequence"), F.when(F.col("o_orderkey") % 5 == 0, "lrt_x").otherwise("bus_x").alias("feed_name"))
    static = read(s, d, "lineitem").select(F.col("l_orderkey").alias("trip_id"), F.col("l_linenumber").cast("bigint").alias("seq_key"), F.col("l_partkey").alias("stop_id"))
    return updates.withColumn("seq_key", delay.sequence_key()).join(static, ["trip_id", "seq_key"]).select("trip_id", "stop_sequence", "seq_key", "stop_id")


@query("enrich_dims", "SELECT c.c_custkey, n.n_name, r.r_name FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey AND n.n_nationkey % 7 <> 0 LEFT JOIN region r ON n.n_regionkey = r.r_regionkey")
def _(s, d):
    nation = read(s, d, "nation").where("n_nationkey % 7 <> 0").select("n_nationkey", "n_name", "n_regionkey").dropDuplicates(["n_nationkey"])
    region = read(s, d, "region").select("r_regionkey", "r_name")
    rows = read(s, d, "customer")
    rows = rows.join(nation, rows["c_nationkey"] == nation["n_nationkey"], "left")
    return rows.join(region, rows["n_regionkey"] == region["r_regionkey"], "left").select("c_custkey", "n_name", "r_name")


_VEH = "veh AS (SELECT trip_id, scheduled_s, min(delay_seconds) AS speed FROM obs WHERE event_id % 3 = 0 GROUP BY trip_id, scheduled_s)"


@query("vehicle_join", f"SELECT o.event_id, {q('v.speed', 'speed')} FROM obs o LEFT JOIN veh v ON o.trip_id = v.trip_id AND o.scheduled_s = v.scheduled_s", OBS, _VEH)
def _(s, d):
    rows = obs(s, d)
    vehicles = rows.where("event_id % 3 = 0").groupBy("trip_id", "scheduled_s").agg(F.min("delay_seconds").alias("speed"))
    return rows.join(vehicles, ["trip_id", "scheduled_s"], "left").select("event_id", "speed")


@query("vehicle_dedup", "SELECT trip_id, scheduled_s, round(min(delay_seconds), 6) AS speed, max(collected_s) AS newest_s FROM obs GROUP BY trip_id, scheduled_s", OBS)
def _(s, d):
    rows = obs(s, d).select("snapshot_date", F.col("scheduled_s").alias("collected_at_utc"), "trip_id", F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude"), F.lit(0.0).alias("bearing"), F.col("delay_seconds").alias("speed"), F.lit(0).alias("current_stop_sequence"), F.lit(0).alias("current_status"), F.col("collected_at_utc").alias("vehicle_timestamp_utc"))
    return features.vehicle_dedup(rows).select("trip_id", F.col("collected_at_utc").alias("scheduled_s"), "speed", F.unix_seconds("vehicle_timestamp_utc").alias("newest_s"))


@query("trip_max_seq", "SELECT l_orderkey AS trip_id, CAST(max(CAST(l_linenumber AS INTEGER)) AS BIGINT) AS longest FROM lineitem GROUP BY l_orderkey")
def _(s, d):
    return read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("trip_id")).agg(F.max("l_linenumber").cast("bigint").alias("longest"))


@query("hour_bucket_join", "SELECT o.event_id, w.n FROM obs o LEFT JOIN (SELECT collected_s // 3600 AS h, count(*) AS n FROM obs WHERE route_id = (SELECT min(route_id) FROM obs) GROUP BY 1) w ON o.scheduled_s // 3600 = w.h", OBS)
def _(s, d):
    rows = obs(s, d)
    least = rows.agg(F.min("route_id").alias("route_id"))  # one row
    hourly = rows.join(F.broadcast(least), "route_id").groupBy(F.date_trunc("hour", "collected_at_utc").alias("hour")).agg(F.count("*").alias("n"))
    return rows.withColumn("hour", F.date_trunc("hour", "scheduled_arrival_utc")).join(hourly, "hour", "left").select("event_id", "n")


@query("active_trips_semi", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000)")
def _(s, d):
    active = read(s, d, "orders").where("o_orderstatus = 'F' AND o_totalprice > 150000").select(F.col("o_orderkey").alias("l_orderkey"))
    return read(s, d, "lineitem").join(active, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("active_services", "SELECT user_id AS service_id FROM (SELECT DISTINCT user_id FROM events WHERE event_type <> 'error' AND user_id % 3 = 0 UNION SELECT DISTINCT user_id FROM events WHERE user_id % 7 = 1) EXCEPT SELECT user_id FROM events WHERE user_id % 5 = 2")
def _(s, d):
    from .timetable import active_services

    e = read(s, d, "events")
    calendar = e.where("event_type <> 'error' AND user_id % 3 = 0").select(F.col("user_id").alias("service_id"))
    added = e.where("user_id % 7 = 1").select(F.col("user_id").alias("service_id"), F.lit("1").alias("exception_type"))
    removed = e.where("user_id % 5 = 2").select(F.col("user_id").alias("service_id"), F.lit("2").alias("exception_type"))
    return active_services(calendar, added.unionByName(removed))


# --- transfers --------------------------------------------------------------------------------------------------------

_CAND = """cand AS (
  SELECT a.snapshot_date, a.event_id AS from_trip_id, a.route_id AS from_route_id, a.stop_id AS from_stop_id, b.event_id AS to_trip_id, b.route_id AS to_route_id, b.direction_id AS to_direction_id,
    b.scheduled_s AS to_s, a.scheduled_s AS from_s, b.actual_s - a.actual_s - 30.0 AS margin
  FROM obs a JOIN obs b ON a.snapshot_date = b.snapshot_date AND a.stop_id = b.stop_id AND a.feed_name = b.feed_name AND a.route_id <> b.route_id AND b.scheduled_s BETWEEN a.scheduled_s + 30 AND a.scheduled_s + 1800)"""
_PROP = _CAND + """,
prop AS (SELECT *, margin >= 0 AS made FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_date, from_trip_id, from_stop_id, to_route_id, to_direction_id ORDER BY to_s, to_trip_id) AS rn FROM cand) WHERE rn = 1)"""


def _observed(s, d):
    rows = obs(s, d).withColumn("trip_id", F.col("event_id"))
    pairs = rows.select(F.col("stop_id").alias("from_stop_id"), F.col("feed_name").alias("from_feed")).distinct()
    pairs = pairs.select("*", F.col("from_stop_id").alias("to_stop_id"), F.col("from_feed").alias("to_feed"), F.lit(0.0).alias("walk_distance_m"), F.lit(30.0).alias("walk_seconds"))
    return rows, pairs


@query("transfer_candidates", "SELECT from_trip_id, to_trip_id, to_s - from_s AS wait FROM cand", OBS, _CAND)
def _(s, d):
    return transfers.candidates(*_observed(s, d)).select("from_trip_id", "to_trip_id", (F.col("to_scheduled_s") - F.col("from_scheduled_s")).alias("wait"))


@query("transfer_proposed", f"SELECT from_trip_id, to_trip_id, {q('CAST(margin AS DOUBLE)', 'margin')}, made FROM prop", OBS, _PROP)
def _(s, d):
    return transfers.connections(*_observed(s, d)).select("from_trip_id", "to_trip_id", F.col("actual_margin_seconds").alias("margin"), F.col("made_transfer").alias("made"))


_TRANSFER = "count(*) AS attempts, CAST(sum(CASE WHEN made THEN 1 ELSE 0 END) AS BIGINT) AS made, round(avg(CASE WHEN made THEN 1.0 ELSE 0.0 END), 6) AS success_rate, round(CAST(median(margin) AS DOUBLE), 6) AS median_margin_seconds, round(CAST(quantile_cont(margin, 0.1) AS DOUBLE), 6) AS p10_margin_seconds, count(DISTINCT snapshot_date) AS service_days".replace("(margin", "(CAST(margin AS DOUBLE)")
for _name, _by in (("transfer_stop_summary", ("from_stop_id", "from_route_id", "to_route_id")), ("transfer_route_pairs", ("from_route_id", "to_route_id"))):
    query(_name, f"SELECT {', '.join(_by)}, {_TRANSFER} FROM prop GROUP BY {', '.join(_by)} HAVING count(*) >= 2", OBS, _PROP)(lambda s, d, by=_by: transfers.summary(transfers.connections(*_observed(s, d)), by, 2))

_STOPSUM = f"sums AS (SELECT from_stop_id, from_route_id, to_route_id, {_TRANSFER} FROM prop GROUP BY 1, 2, 3)"


@query("top_transfers_per_route", "SELECT from_route_id, from_stop_id, to_route_id, attempts, rank FROM (SELECT *, row_number() OVER (PARTITION BY from_route_id ORDER BY attempts DESC, from_stop_id, to_route_id) AS rank FROM sums) WHERE rank <= 3", OBS, _PROP, _STOPSUM)
def _(s, d):
    sums = transfers.summary(transfers.connections(*_observed(s, d)), ("from_stop_id", "from_route_id", "to_route_id"), 1)
    return W.top_per_key(sums, ["from_route_id"], [F.desc("attempts"), F.col("from_stop_id"), F.col("to_route_id")], 3).select("from_route_id", "from_stop_id", "to_route_id", "attempts", "rank")


@query("riskiest_transfers", "SELECT from_stop_id, from_route_id, to_route_id, attempts, success_rate FROM sums WHERE attempts >= 2 ORDER BY success_rate, attempts DESC, from_stop_id, from_route_id, to_route_id LIMIT 5", OBS, _PROP, _STOPSUM)
def _(s, d):
    sums = tidy(transfers.summary(transfers.connections(*_observed(s, d)), ("from_stop_id", "from_route_id", "to_route_id"), 2))
    return sums.orderBy("success_rate", F.desc("attempts"), "from_stop_id", "from_route_id", "to_route_id").limit(5).select("from_stop_id", "from_route_id", "to_route_id", "attempts", "success_rate")


# --- baselines ----------------------------------------------------------------------------------------------------------

for _name, _by in (("baseline_route_hour", ("route_id", "hour_of_day")), ("baseline_route_stop_hour", ("route_id", "stop_id", "hour_of_day"))):
    query(_name, f"SELECT {', '.join(_by)}, {q('median(delay_seconds)', 'median_delay')}, {q('avg(delay_seconds)', 'mean_delay')}, count(*) AS rows FROM obs WHERE abs(delay_seconds) < 3600 GROUP BY {', '.join(_by)}", OBS)(
        lambda s, d, by=_by: baselines.lookup(obs(s, d).where(F.abs("delay_seconds") < 3600), by)
    )


@query(
    "baseline_fallback_mae",
    f"SELECT {q('avg(abs(o.delay_seconds - coalesce(a.m, b.m, 0)))', 'mae')} FROM obs o LEFT JOIN (SELECT route_id, stop_id, hour_of_day, median(delay_seconds) AS m FROM obs WHERE snapshot_date < DATE '2024-01-20' GROUP BY 1, 2, 3) a ON o.route_id = a.route_id AND o.stop_id = a.stop_id AND o.hour_of_day = a.hour_of_day LEFT JOIN (SELECT route_id, hour_of_day, median(delay_seconds) AS m FROM obs WHERE snapshot_date < DATE '2024-01-20' GROUP BY 1, 2) b ON o.route_id = b.route_id AND o.hour_of_day = b.hour_of_day WHERE o.snapshot_date >= DATE '2024-01-20'",
    OBS,
)
def _(s, d):
    rows = obs(s, d)
    train, test = rows.where("snapshot_date < DATE '2024-01-20'"), rows.where("snapshot_date >= DATE '2024-01-20'")
    return baselines.mae(baselines.with_baseline(test, train, [("route_id", "stop_id", "hour_of_day"), ("route_id", "hour_of_day")]), F.col("median_delay"))


@query("mae_schedule", f"SELECT {q('avg(abs(delay_seconds))', 'mae')} FROM obs", OBS)
def _(s, d):
    return baselines.mae(obs(s, d), F.lit(0.0))


@query("mae_feed", f"SELECT {q('avg(abs(delay_seconds - predicted_delay_seconds))', 'mae')} FROM obs", OBS)
def _(s, d):
    return baselines.mae(obs(s, d), F.col("predicted_delay_seconds"))


@query("time_split", f"SELECT {text_date('day')}, k <= greatest(1, CAST(floor(n * 0.8) AS BIGINT)) AS is_train, n = 1 OR k > greatest(1, CAST(floor(n * 0.8) AS BIGINT)) AS is_validation FROM (SELECT day, row_number() OVER (ORDER BY day) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT snapshot_date AS day FROM obs))", OBS)
def _(s, d):
    return baselines.time_split(obs(s, d)).withColumnRenamed("snapshot_date", "day")


@query("hash_sample", "SELECT event_id FROM (SELECT event_id, md5(concat_ws('|', CAST(event_id AS VARCHAR), route_id)) AS h FROM obs) ORDER BY h, event_id LIMIT 500", OBS)
def _(s, d):
    return baselines.hash_sample(obs(s, d), ("event_id", "route_id"), 500).select("event_id")


@query("sample_weights", "SELECT event_id, CASE WHEN delay_seconds > 300 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM obs", OBS)
def _(s, d):
    return obs(s, d).select("event_id", baselines.sample_weight(late_weight=3.0).alias("weight"))


@query("encode_features", None)
def _(s, d):
    coded = baselines.encode(obs(s, d).withColumnRenamed("predicted_delay_seconds", "current_predicted_delay_seconds"))
    return coded.select("event_id", *(c for c in coded.columns if c.startswith("x_")))


def _model_rows(s, d):
    """Inputs of all kinds; some columns are null in part, most aren't there."""
    id = F.col("event_id")
    return obs(s, d).select(
        "event_id", "route_id", "stop_id", "direction_id", "prediction_lead_minutes", "hour_of_day", "day_of_week", F.when(id % 3 != 0, F.col("predicted_delay_seconds")).alias("current_predicted_delay_seconds"),
        F.when(id % 4 != 0, id % 9).alias("vehicle_current_stop_sequence"), F.when(id % 5 != 0, F.col("day_of_week").isin(0, 6)).alias("is_weekend"), (id % 2 == 0).alias("is_rain"),
    )


_CODED = {"current_predicted_delay_seconds": "CASE WHEN event_id % 3 <> 0 THEN predicted_delay_seconds END", "hour_of_day": "hour_of_day", "day_of_week": "day_of_week", "prediction_lead_minutes": "prediction_lead_minutes", "vehicle_current_stop_sequence": "CASE WHEN event_id % 4 <> 0 THEN event_id % 9 END", "is_weekend": "CASE WHEN event_id % 5 <> 0 AND day_of_week IN (0, 6) THEN 1 END", "is_rain": "CASE WHEN event_id % 2 = 0 THEN 1 END"}


@query("encode_inputs", "SELECT event_id, " + ", ".join(f"round(coalesce(CAST({_CODED.get(c, 'NULL')} AS DOUBLE), 0.0::DOUBLE), 6) AS x_{c}" for c in (*baselines.NUMERIC, *baselines.BOOLEAN)) + " FROM obs", OBS)
def _(s, d):
    return baselines.encode(_model_rows(s, d)).select("event_id", *(f"x_{c}" for c in (*baselines.NUMERIC, *baselines.BOOLEAN)))


@query("boosted_quantiles", None)
def _(s, d):
    """Intervals by quantile boosting; the last fifth of the days decides when to stop."""
    rows = obs(s, d).where(F.abs("delay_seconds") < 3600)
    days = baselines.time_split(rows)
    marked = rows.join(F.broadcast(days), "snapshot_date").withColumn("held", F.col("is_validation") & ~F.col("is_train"))  # a row a day
    found = boosting.fit(marked, ("predicted_delay_seconds", "prediction_lead_minutes", "hour_of_day", "day_of_week"), ("route_id", "stop_id"), quantiles=(0.1, 0.9), held="held", rounds=6, rate=0.4, depth=3)
    return boosting.predict(found, marked, {0.1: "lower", 0.9: "upper"}).select("event_id", "held", "lower", "upper")


# --- evaluation -----------------------------------------------------------------------------------------------------------

_E = "predicted - observed"
_ERR = f"count(*) AS rows, round(avg(abs({_E})), 1) AS mae, round(median(abs({_E})), 1) AS median_ae, round(sqrt(avg(pow({_E}, 2))), 1) AS rmse, round(avg({_E}), 1) AS bias"


@query("error_summary", f"SELECT {_ERR} FROM log", LOG)
def _(s, d):
    return evaluation.error_summary(log(s, d))


for _name, _key, _least in (("lead", "lead_bucket", 0), ("mode", "transit_mode", 0), ("route", "route_id", 200)):
    query(f"error_by_{_name}", f"SELECT {_key}, {_ERR} FROM log GROUP BY {_key} HAVING count(*) >= {_least}", LOG)(lambda s, d, key=_key, least=_least: evaluation.error_summary(log(s, d), (key,), least))


@query("lead_buckets", "SELECT event_id, lead_bucket FROM log", LOG)
def _(s, d):
    return log(s, d).select("event_id", "lead_bucket")


@query(
    "late_detection",
    f"SELECT tp AS true_positive, fp AS false_positive, fn AS false_negative, {q('CAST(tp AS DOUBLE) / nullif(tp + fp, 0)', 'precision')}, {q('CAST(tp AS DOUBLE) / nullif(tp + fn, 0)', 'recall')} FROM (SELECT count(*) FILTER (predicted > 300 AND observed > 300) AS tp, count(*) FILTER (predicted > 300 AND observed <= 300) AS fp, count(*) FILTER (predicted <= 300 AND observed > 300) AS fn FROM log)",
    LOG,
)
def _(s, d):
    return evaluation.late_summary(log(s, d))


@query("interval_summary", f"SELECT count(*) AS rows, {q('avg(CASE WHEN observed BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END)', 'coverage')}, {q('avg(CASE WHEN observed < lo THEN 1.0 ELSE 0.0 END)', 'below_rate')}, {q('avg(CASE WHEN observed > hi THEN 1.0 ELSE 0.0 END)', 'above_rate')}, {q('avg(hi - lo)', 'mean_width')} FROM log", LOG)
def _(s, d):
    return evaluation.interval_summary(log(s, d))


_TRUTH = "truth AS (SELECT service_date, trip_id, route_id, max(observed) AS truth FROM log WHERE event_id % 3 = 0 GROUP BY 1, 2, 3)"


def _truth(s, d):
    return log(s, d).where("event_id % 3 = 0").groupBy("service_date", "trip_id", "route_id").agg(F.max("observed_delay_seconds").alias("truth"))


@query("eval_match", f"SELECT l.event_id, {q('t.truth', 'truth')} FROM log l JOIN truth t USING (service_date, trip_id, route_id)", LOG, _TRUTH)
def _(s, d):
    return evaluation.match(log(s, d), _truth(s, d), keys=("service_date", "trip_id", "route_id")).select("event_id", "truth")


@query("eval_coverage", f"SELECT {text_date('service_date')}, count(*) AS logged, count(truth) AS matched, {q('CAST(count(truth) AS DOUBLE) / count(*)', 'match_rate')} FROM log l LEFT JOIN truth t USING (service_date, trip_id, route_id) GROUP BY l.service_date".replace("CAST(service_date AS VARCHAR) AS service_date", "CAST(l.service_date AS VARCHAR) AS service_date"), LOG, _TRUTH)
def _(s, d):
    return evaluation.coverage(log(s, d), _truth(s, d), keys=("service_date", "trip_id", "route_id"))


@query("interval_clamp", f"SELECT event_id, {q('least(lo, feed)', 'lower')}, {q('greatest(hi, feed)', 'upper')} FROM log", LOG)
def _(s, d):
    lower, upper = C.interval_clamp("feed_delay_seconds", "predicted_delay_lower_seconds", "predicted_delay_upper_seconds")
    return log(s, d).select("event_id", lower.alias("lower"), upper.alias("upper"))


@query("pinball_loss", f"SELECT {q('avg(greatest(0.1::DOUBLE * (observed - lo), -0.9::DOUBLE * (observed - lo)))', 'q10')}, {q('avg(greatest(0.9::DOUBLE * (observed - hi), -0.1::DOUBLE * (observed - hi)))', 'q90')} FROM log", LOG)
def _(s, d):
    return log(s, d).agg(M.pinball("predicted_delay_lower_seconds", "observed_delay_seconds", 0.1).alias("q10"), M.pinball("predicted_delay_upper_seconds", "observed_delay_seconds", 0.9).alias("q90"))


@query("risk_means", f"SELECT {q('avg(greatest(observed - predicted, 0))', 'wait_risk')}, {q('avg(greatest(predicted - observed, 0))', 'miss_risk')} FROM log", LOG)
def _(s, d):
    e = F.col("observed_delay_seconds") - F.col("predicted_delay_seconds")
    return log(s, d).agg(F.avg(F.greatest(e, F.lit(0.0))).alias("wait_risk"), F.avg(F.greatest(-e, F.lit(0.0))).alias("miss_risk"))


# --- live ---------------------------------------------------------------------------------------------------------------------


@query("live_route_summary", f"SELECT route_id, count(*) AS arrivals, count(DISTINCT trip_id) AS trips, {q('avg(predicted)', 'mean_predicted')}, {q('max(predicted)', 'max_predicted')}, {q('avg(feed)', 'mean_feed')}, count(*) FILTER (predicted > 300) AS late FROM log GROUP BY route_id", LOG)
def _(s, d):
    from .live import route_summary

    return route_summary(log(s, d))


@query("next_stop_per_trip", "SELECT trip_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY lead, event_id) AS rn FROM log WHERE lead >= 0) WHERE rn = 1", LOG)
def _(s, d):
    from .live import next_stops

    return next_stops(log(s, d), tie="event_id").select("trip_id", "event_id")


@query("worst_arrivals", f"SELECT event_id, {q('predicted', 'predicted')} FROM log ORDER BY predicted DESC, event_id LIMIT 40", LOG)
def _(s, d):
    return live.worst_arrivals(log(s, d), tie="event_id").select("event_id", F.col("predicted_delay_seconds").alias("predicted"))


@query("feed_freshness", f"SELECT event_type AS feed, {q('(epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts))) / 60000000.0::DOUBLE', 'age_minutes')}, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts))) / 60000000.0::DOUBLE <= 5 AS is_fresh FROM events GROUP BY event_type")
def _(s, d):
    from .live import freshness

    e = read(s, d, "events").select(F.col("event_type").alias("feed"), F.col("ts").cast("timestamp").alias("updated"))
    return freshness(e, e.agg(F.max("updated").alias("now")), F.lit(5.0))


# --- time and shape functions ---------------------------------------------------------------------------------------------------


@query("gtfs_seconds", "SELECT trip_id, CAST(split_part(arrival_time, ':', 1) AS BIGINT) * 3600 + CAST(split_part(arrival_time, ':', 2) AS BIGINT) * 60 + CAST(split_part(arrival_time, ':', 3) AS BIGINT) AS seconds FROM sched", SCHED)
def _(s, d):
    return sched(s, d).select("trip_id", C.gtfs_seconds("arrival_time").alias("seconds"))


@query(
    "gtfs_time_utc",
    "SELECT trip_id, CAST(epoch(timezone('America/Toronto', strptime(start_date, '%Y%m%d') + to_seconds(CAST(split_part(arrival_time, ':', 1) AS BIGINT) * 3600 + CAST(split_part(arrival_time, ':', 2) AS BIGINT) * 60) - CASE WHEN CAST(split_part(arrival_time, ':', 1) AS INTEGER) >= 24 AND CAST(split_part(start_time, ':', 1) AS INTEGER) < 6 THEN to_days(1) ELSE to_days(0) END)) AS BIGINT) AS utc_s FROM sched",
    SCHED,
)
def _(s, d):
    return sched(s, d).select("trip_id", F.unix_seconds(C.scheduled_utc("start_date", "arrival_time", "start_time")).alias("utc_s"))


@query("local_time_parts", "SELECT event_id, hour_of_day, extract(minute FROM timezone('America/Toronto', timezone('UTC', collected_at))) AS minute_of_hour, day_of_week, day_of_week IN (0, 6) AS is_weekend, hour_of_day BETWEEN 7 AND 8 OR hour_of_day BETWEEN 16 AND 17 AS is_rush_hour FROM obs", OBS)
def _(s, d):
    parts = C.local_parts("collected_at_utc")
    return obs(s, d).select("event_id", *(parts[n].alias(n) for n in parts))


@query("seq_normalized", f"SELECT s.trip_id, {q('CASE WHEN t.longest > 0 THEN CAST(s.stop_sequence - CASE WHEN s.trip_id % 5 = 0 THEN 1 ELSE 0 END AS DOUBLE) / t.longest ELSE 0.0 END', 'place')} FROM sched s LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS longest FROM lineitem GROUP BY 1) t ON s.trip_id = t.l_orderkey", SCHED)
def _(s, d):
    longest = read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("trip_id")).agg(F.max("l_linenumber").alias("longest"))
    return sched(s, d).join(longest, "trip_id", "left").select("trip_id", C.seq_normalized("stop_sequence", "feed_name", "longest").alias("place"))


@query("make_rate_estimate", f"SELECT event_id, {q('greatest(0.05, least(0.98, 1 - pow(0.5::DOUBLE, lead * 60.0::DOUBLE / greatest(observed, 30))))', 'rate')} FROM log", LOG)
def _(s, d):
    return log(s, d).select("event_id", C.make_rate_estimate(F.col("prediction_lead_minutes") * 60.0, "observed_delay_seconds").alias("rate"))


@query("trip_patterns", "SELECT pattern, count(*) AS trips, min(l_orderkey) AS first_trip FROM (SELECT l_orderkey, array_to_string(list(CAST(l_partkey % 5 AS VARCHAR) ORDER BY l_linenumber, CAST(l_partkey % 5 AS VARCHAR)), '>') AS pattern FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 2) GROUP BY pattern")
def _(s, d):
    from .timetable import trip_patterns

    rows = read(s, d, "lineitem").select(F.col("l_orderkey").alias("trip_id"), F.col("l_linenumber").alias("stop_sequence"), (F.col("l_partkey") % 5).cast("string").alias("stop_id"))
    found = trip_patterns(rows, ())
    return found.groupBy(F.array_join("stops", ">").alias("pattern")).agg(F.sum(F.size("trips")).alias("trips"), F.min(F.array_min("trips")).alias("first_trip"))


# --- journeys -----------------------------------------------------------------------------------------------------------


def day_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a schedule day: orders are trips of twelve routes, which start at any time and overtake each other."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trip_id"), (F.col("o_orderkey") % 12).alias("route_id"), (F.col("o_orderkey") * 37 % 1200 * 60).alias("start"))
    n = F.col("l_linenumber").cast("bigint")
    cells = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trip_id"), n.alias("stop_sequence"), (F.col("l_suppkey") % 4 * 59).alias("late"))
    stop = (F.col("route_id") * 3 + F.col("stop_sequence") * 5) % 40
    return cells.join(o, "trip_id").select("trip_id", "route_id", stop.alias("stop_id"), "stop_sequence", (F.col("start") + F.col("stop_sequence") * 240 + F.col("late")).cast("bigint").alias("seconds")).groupBy("trip_id", "route_id", "stop_id", "stop_sequence").agg(F.min("seconds").alias("seconds"))  # line numbers repeat


_TIMES = """times AS (
  SELECT l_orderkey AS trip, l_linenumber AS i, (l_orderkey % 12 * 3 + l_linenumber * 5) % 40 AS stop, min(o_orderkey * 37 % 1200 * 60 + l_linenumber * 240 + l_suppkey % 4 * 59) AS at FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
rides AS (SELECT a.stop AS a, a.at AS depart, b.stop AS b, b.at AS arrive FROM times a JOIN times b ON a.trip = b.trip AND a.i < b.i),
n0 AS (SELECT DISTINCT stop AS q, stop, 28800 AS arrive FROM times),
walks AS (SELECT s AS a, (s + 1) % 40 AS b FROM range(0, 40, 5) t(s) UNION ALL SELECT (s + 1) % 40, s FROM range(0, 40, 5) t(s))"""
_ROUNDS = ",\n".join(
    f"""s{k} AS (SELECT q, b AS stop, min(r.arrive) AS arrive FROM n{k - 1} n JOIN rides r ON n.stop = r.a AND r.depart >= n.arrive + {0 if k == 1 else 45} GROUP BY q, b),
w{k} AS (SELECT q, stop, min(arrive) AS arrive FROM (SELECT * FROM s{k} UNION ALL SELECT q, b, arrive + 200 FROM s{k} JOIN walks ON stop = a) GROUP BY q, stop),
n{k} AS (SELECT w.q, w.stop, w.arrive FROM w{k} w LEFT JOIN (SELECT q, stop, min(arrive) AS best FROM ({' UNION ALL '.join(f'SELECT * FROM n{j}' for j in range(k))}) GROUP BY q, stop) e ON w.q = e.q AND w.stop = e.stop WHERE e.best IS NULL OR w.arrive < e.best)"""
    for k in (1, 2, 3)
)


@query("raptor_arrivals", " UNION ALL ".join(f"SELECT q AS query_id, CAST(stop AS VARCHAR) AS stop_id, {k} AS round, CAST(arrive AS BIGINT) AS arrive FROM n{k}" for k in range(4)), _TIMES, _ROUNDS)
def _(s, d):
    times = day_times(s, d)
    origins = times.select(F.col("stop_id").alias("query_id"), "stop_id", F.lit(28800).alias("ready")).distinct()
    walks = s.range(0, 40, 5).select(F.col("id").alias("from_stop"), ((F.col("id") + 1) % 40).alias("to_stop"), F.lit(200).alias("seconds"))
    return raptor.arrivals(origins, raptor.lines(times), walks, rounds=3).select("query_id", "stop_id", "round", "arrive")


# --- map layers ---------------------------------------------------------------------------------------------------------


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways cut from lineitem: a supplier's parts are corners of a ring, a way leads from each to the next (every third supplier lacks the way home); half are drawn backwards."""
    corner = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("relation"), F.col("l_partkey").alias("part")).distinct()
    of = Window.partitionBy("relation").orderBy("part")
    n = F.count("*").over(Window.partitionBy("relation"))
    told = corner.withColumns({"next": F.coalesce(F.lead("part").over(of), F.min("part").over(Window.partitionBy("relation"))), "home": F.row_number().over(of) == n, "n": n})
    point = lambda c, shift=0.0: F.struct(((F.col("relation") % 89).cast("double") + F.col(c) / 1e6 + shift).alias("lat"), (F.col(c) / 1e3).cast("double").alias("lon"))
    line = F.array(point("part"), point("part", 0.25), point("next"))
    kept = told.where("n >= 3 AND NOT (home AND relation % 3 = 0)")
    return kept.select("relation", F.col("part").alias("way"), F.when(F.col("part") % 2 == 0, F.reverse(line)).otherwise(line).alias("points"))


@query(
    "map_rings",
    "SELECT relation, relation % 3 <> 0 AS closed, n - CASE WHEN relation % 3 = 0 THEN 1 ELSE 0 END AS ways, 2 * (n - CASE WHEN relation % 3 = 0 THEN 1 ELSE 0 END) + 1 AS points, first AS line FROM (SELECT l_suppkey AS relation, count(DISTINCT l_partkey) AS n, min(l_partkey) AS first FROM lineitem GROUP BY l_suppkey) WHERE n >= 3",
)
def _(s, d):
    return map_layers.assemble(ways(s, d)).select("relation", "closed", "ways", F.size("points").alias("points"), "line")


# --- live vehicles, shapes, lookups ------------------------------------------------------------------------------------

VEHICLES = """vehicles AS (
  SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END AS vehicle_id, event_id AS entity_id, event_type AS route_id, user_id AS trip_id, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS feed_name,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS latitude, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 2 END AS direction_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END AS seen, ts AS collected FROM events)"""


def _vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    id, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    return read(spark, sf_dir, "events").select(
        F.when(id % 7 != 0, F.col("user_id")).alias("vehicle_id"), id.alias("entity_id"), F.col("event_type").alias("route_id"), F.col("user_id").alias("trip_id"), F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("feed_name"),
        F.when(id % 11 != 0, F.col("value")).alias("latitude"), F.lit(1.0).alias("longitude"), F.when(id % 3 != 0, id % 2).alias("direction_id"), F.when(id % 5 != 0, ts).alias("vehicle_timestamp_utc"), ts.alias("collected_at_utc"),
    )


@query(
    "live_vehicles",
    """SELECT coalesce(CAST(vehicle_id AS VARCHAR), CAST(entity_id AS VARCHAR)) AS vehicle, v.route_id, coalesce(r.short, v.route_id) AS route_short_name, coalesce(v.direction_id, CAST(t.c_nationkey AS BIGINT)) AS direction_id, t.c_name AS trip_headsign, round(latitude, 6) AS lat
  FROM (SELECT * FROM vehicles WHERE latitude IS NOT NULL QUALIFY row_number() OVER (PARTITION BY coalesce(CAST(vehicle_id AS VARCHAR), CAST(entity_id AS VARCHAR)) ORDER BY seen DESC NULLS LAST, collected DESC, entity_id) = 1) v
  LEFT JOIN (SELECT DISTINCT event_type AS route_id, upper(event_type) AS short, 'a' AS feed_name FROM events) r ON v.route_id = r.route_id AND v.feed_name = r.feed_name
  LEFT JOIN customer t ON v.trip_id = t.c_custkey AND v.feed_name = CASE WHEN t.c_custkey % 2 = 0 THEN 'a' ELSE 'b' END""",
    VEHICLES,
)
def _(s, d):
    routes = read(s, d, "events").select(F.lit("a").alias("feed_name"), F.col("event_type").alias("route_id"), F.upper("event_type").alias("route_short_name"))
    trips = read(s, d, "customer").select(F.when(F.col("c_custkey") % 2 == 0, "a").otherwise("b").alias("feed_name"), F.col("c_custkey").alias("trip_id"), F.col("c_name").alias("trip_headsign"), F.col("c_nationkey").cast("string").alias("direction_id"))
    return live.live_vehicles(_vehicles(s, d), routes, trips).select("vehicle", "route_id", "route_short_name", "direction_id", "trip_headsign", "lat")


POINTS = """points AS (
  SELECT DISTINCT p.route_id, p.shape_id, e.event_id AS seq, e.value AS lat, CAST(CAST(json_extract_string(e.props, '$.k') AS INTEGER) AS DOUBLE) AS lon
  FROM events e JOIN (SELECT DISTINCT event_type AS route_id, user_id AS shape_id, CAST(ts AS DATE) AS day FROM events WHERE event_id % 10 = 0) p ON e.user_id = p.shape_id AND CAST(e.ts AS DATE) = p.day
  WHERE e.value IS NOT NULL AND json_extract_string(e.props, '$.k') IS NOT NULL)"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").alias("shape_id"), F.lit("f").alias("feed_name"), F.col("ts").cast("date").alias("p_snapshot_date"), F.col("event_id").cast("string").alias("shape_pt_sequence"), F.col("value").cast("string").alias("shape_pt_lat"), F.get_json_object("props", "$.k").alias("shape_pt_lon"))
    return dashboard.shape_points(e.where("event_id % 10 = 0").withColumnRenamed("event_type", "route_id"), e)


@query("shape_points", "SELECT route_id, shape_id, seq, round(lat, 6) AS lat, round(lon, 6) AS lon FROM points", POINTS)
def _(s, d):
    return _points(s, d)


@query("bounds", "SELECT round(min(lat), 6) AS min_lat, round(max(lat), 6) AS max_lat, round(min(lon), 6) AS min_lon, round(max(lon), 6) AS max_lon FROM points", POINTS)
def _(s, d):
    return dashboard.bounds(_points(s, d))


@query("route_hour_lookup", "SELECT route_id, hour_of_day, CAST(round_even(median_delay_seconds, 0) AS BIGINT) AS median_s, CAST(round_even(p90_delay_seconds, 0) AS BIGINT) AS p90_s FROM hourly WHERE observations >= 30", OBS, _HOURLY)
def _(s, d):
    return dashboard.route_hours(tidy(reliability.rollup(reliability.base(obs(s, d)), ("route_id", "hour_of_day"))))


@query("transfer_rate_lookup", "SELECT concat_ws('|', from_route_id, to_route_id, from_stop_id) AS transfer, round(success_rate, 3) AS success_rate FROM sums WHERE attempts >= 2", OBS, _PROP, _STOPSUM)
def _(s, d):
    return dashboard.transfer_rates(tidy(transfers.summary(transfers.connections(*_observed(s, d)), ("from_stop_id", "from_route_id", "to_route_id"), 1)), 2)
