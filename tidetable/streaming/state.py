"""Keyed state of live streams: lag rings in event time, poll cadences and reused forecasts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LAGS = 5


class LagRing(StatefulProcessor):
    """A key's last values in order of event time. Rows wait until the watermark has passed them, so that those that come late or
    out of order get the lags that a batch would give them; the ring goes when the key has been silent for `silent_ms` of event time."""

    def __init__(self, silent_ms: int, lags: int = LAGS):
        self.silent_ms, self.lags = silent_ms, lags

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, tie bigint, value double")
        self.ring = handle.getValueState("ring", "last bigint, size int, " + ", ".join(f"v{i} double" for i in range(self.lags)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = set()
        for part in rows:
            at = part["at_us"].tolist()
            self.waiting.appendList([(int(a), int(t), None if v != v or v is None else float(v)) for a, t, v in zip(at, part["tie"].tolist(), part["value"].tolist())])
            times |= {a // 1000 + 1 for a in at}  # rounded up: a timer is due when the watermark has reached it
        for t in times:
            self.handle.registerTimer(t)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        ring, last = [], None
        if self.ring.exists():
            last, size, *values = self.ring.get()
            ring = list(values[:size])
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        due = [r for r in rows if r[0] < now]
        out = []
        for at, tie, value in due:
            if last is not None and at - last > self.silent_ms * 1000:
                ring = []
            out.append((key[0], at, tie, value, *[ring[-i] if len(ring) >= i else None for i in range(1, self.lags + 1)]))
            ring, last = [*ring, value][-self.lags :], at
        if due:
            if len(due) < len(rows):
                self.waiting.put([r for r in rows if r[0] >= now])
            else:
                self.waiting.clear()
            self.ring.update((last, len(ring), *ring, *[None] * (self.lags - len(ring))))
            self.handle.registerTimer(last // 1000 + self.silent_ms + 1)
        elif last is not None and now - last > self.silent_ms * 1000 and not rows:
            self.ring.clear()
        if out:
            yield pd.DataFrame(out, columns=["key", "at_us", "tie", "value", *(f"lag_{i}" for i in range(1, self.lags + 1))])


def event_time_lags(rows: DataFrame, key: str, value: str, ts: str, tie: str, *, late: str = "10 minutes", silent_minutes: int = 90) -> DataFrame:
    """key, tie, ts, value and lag_1 .. lag_5 over the key's rows before, by ts and tie (a whole number): a stream's rows as a batch over all of them would have them.

    Rows may come in any order and in any micro-batch as long as they aren't behind the watermark (late). A row is told once the
    watermark has passed it. After silent_minutes without rows a key begins anew. Needs the RocksDB state store.
    """
    told = rows.where(F.col(ts).isNotNull()).withWatermark(ts, late)
    told = told.select(F.col(key).cast("string").alias("key"), F.unix_micros(ts).alias("at_us"), F.col(tie).cast("bigint").alias("tie"), F.col(value).cast("double").alias("value"), F.col(ts).alias("_at"))
    schema = "key string, at_us bigint, tie bigint, value double, " + ", ".join(f"lag_{i} double" for i in range(1, LAGS + 1))
    found = told.groupBy("key").transformWithStateInPandas(LagRing(silent_minutes * 60_000), schema, "append", "eventTime")
    return found.select(F.col("key").alias(key), F.col("tie").alias(tie), F.timestamp_micros("at_us").alias(ts), F.col("value").alias(value), *(f"lag_{i}" for i in range(1, LAGS + 1)))


class Cadence(StatefulProcessor):
    """When a feed was last polled and what it last gave. A timer in event time lets both go when the feed hasn't been heard of for `ttl_ms`.

    (Spark's own time to live needs processing time, and a query in processing time that runs once over what is there never ends.)
    """

    def __init__(self, seconds: dict[str, int], default: int, ttl_ms: int):
        self.seconds, self.default, self.ttl_ms = seconds, default, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.polled = handle.getValueState("polled", "at bigint")
        self.held = handle.getValueState("held", "at bigint, payload string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = self.seconds.get(key[0], self.default)
        out = []
        for r in pd.concat(list(rows)).sort_values(["at_s", "kind"], kind="stable").itertuples():
            if r.kind == "got":
                if not self.held.exists() or self.held.get()[0] <= r.at_s:
                    self.held.update((int(r.at_s), r.payload))
                continue
            due = not self.polled.exists() or r.at_s - self.polled.get()[0] >= every
            if due:
                self.polled.update((int(r.at_s),))
            held = self.held.get() if self.held.exists() else (None, None)
            out.append((key[0], int(r.at_s), "poll" if due else "reuse", held[1], None if held[0] is None else int(r.at_s - held[0])))
        self.handle.registerTimer(self._last() * 1000 + self.ttl_ms)
        if out:
            yield pd.DataFrame(out, columns=["feed", "at_s", "action", "payload", "payload_age_s"]).astype({"payload_age_s": "Int64"})

    def _last(self) -> int:
        return max([s.get()[0] for s in (self.polled, self.held) if s.exists()], default=0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self._last() * 1000 + self.ttl_ms <= timerValues.getCurrentWatermarkInMs():
            self.polled.clear()
            self.held.clear()
        return iter([])


def cadence(rows: DataFrame, seconds: dict[str, int], *, default: int = 30, ttl_hours: int = 12, late: str = "10 minutes") -> DataFrame:
    """feed, at_s, action, payload, payload_age_s for each tick: whether its feed is due ('poll') or what it last gave still serves ('reuse').

    rows (a stream): feed, at_s (seconds), kind, payload: 'tick' asks, 'got' tells what a poll has brought (a forecast, a file's name). seconds: how
    often each feed is polled (default for others). The first tick of a feed is due. Within a micro-batch rows go by time, 'got' before 'tick'.
    """
    schema = "feed string, at_s bigint, action string, payload string, payload_age_s bigint"
    told = rows.select(F.col("feed").cast("string").alias("feed"), F.col("at_s").cast("bigint").alias("at_s"), "kind", F.col("payload").cast("string").alias("payload"), F.timestamp_seconds("at_s").alias("_at"))
    told = told.where("feed IS NOT NULL AND at_s IS NOT NULL").withWatermark("_at", late)
    return told.groupBy("feed").transformWithStateInPandas(Cadence(seconds, default, ttl_hours * 3_600_000), schema, "append", "eventTime")


def match_stream(log: DataFrame, truth: DataFrame, keys: tuple[str, ...], *, at: str = "collected_at_utc", seen: str = "observed_at_utc", within: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """Logged predictions with what was observed for the same keys at most `within` after them, as a stream-stream outer join.

    Both sides have a watermark; a prediction that nothing was observed for is told, with nulls, once nothing can come any more, and
    both sides' state is let go then. log: keys, at, ...; truth: keys, seen, ...; their other columns differ in name.
    """
    right = truth.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in truth.columns if c not in keys)).withWatermark(seen, late)
    left = log.withWatermark(at, late)
    on = (F.col(seen) >= F.col(at)) & (F.col(seen) <= F.col(at) + F.expr(f"INTERVAL {within}"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return left.join(right, on, "left").drop(*(f"_{k}" for k in keys))


def match_rates(matched: DataFrame, day: str, truth: str) -> DataFrame:
    """By day of a table that match_stream has filled: logged and matched rows and their share."""
    return matched.groupBy(day).agg(F.count("*").alias("logged"), F.count(truth).alias("matched"), (F.count(truth).cast("double") / F.count("*").cast("double")).alias("match_rate"))
