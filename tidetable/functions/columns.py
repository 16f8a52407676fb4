"""Column functions of the transit domain; all stay in generated JVM code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings

DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine_m(lat1, lon1, lat2, lon2, settings: Settings = DEFAULT) -> Column:
    """Great-circle distance in metres; null where a coordinate is."""
    a, b, c, d = map(col, (lat1, lon1, lat2, lon2))
    half_lat, half_lon = F.radians(c - a) / 2, F.radians(d - b) / 2
    h = F.pow(F.sin(half_lat), 2.0) + F.cos(F.radians(a)) * F.cos(F.radians(c)) * F.pow(F.sin(half_lon), 2.0)
    return 2.0 * settings.earth_radius_m * F.asin(F.sqrt(F.when(h > 1.0, 1.0).otherwise(h)))


def gtfs_seconds(text) -> Column:
    """Seconds since the service day began of HH:MM:SS, where HH may pass 23; null where it isn't such a time."""
    part = lambda i: F.split_part(F.trim(col(text)), F.lit(":"), F.lit(i)).try_cast("int")
    return (part(1) * 3600 + part(2) * 60 + part(3)).cast("bigint")


def local_to_utc(naive: Column, time_zone: str) -> Column:
    """UTC instant of a local wall-clock time; of an hour that comes twice, the later one."""
    early = F.to_utc_timestamp(naive, time_zone)
    later = early + F.expr("INTERVAL 1 HOUR")
    return F.when(F.from_utc_timestamp(later, time_zone) == naive, later).otherwise(early)


def scheduled_utc(start_date, static_time, start_time, settings: Settings = DEFAULT) -> Column:
    """UTC instant of a schedule time (HH:MM:SS, HH may pass 23) on a service date (yyyyMMdd).

    A trip that the schedule has after midnight (HH >= 24) but whose realtime start is before six is already dated by the
    new day, so a day is taken off.
    """
    seconds = gtfs_seconds(static_time)
    start_hour = F.split_part(col(start_time), F.lit(":"), F.lit(1)).try_cast("int")
    wraps = (seconds >= 86400) & (start_hour < 6)
    day = F.to_date(col(start_date), "yyyyMMdd").cast("timestamp")
    naive = F.timestamp_seconds(F.unix_seconds(day) + seconds - F.when(wraps, F.lit(86400)).otherwise(F.lit(0)))
    return local_to_utc(naive, settings.time_zone)


def local_parts(ts, settings: Settings = DEFAULT) -> dict[str, Column]:
    """hour_of_day, minute_of_hour, day_of_week (Sunday 0), is_weekend, is_rush_hour at the local wall clock."""
    local = F.from_utc_timestamp(col(ts), settings.time_zone)
    hour, day = F.hour(local), F.dayofweek(local) - 1
    return {
        "hour_of_day": hour.cast("bigint"),
        "minute_of_hour": F.minute(local).cast("bigint"),
        "day_of_week": day.cast("bigint"),
        "is_weekend": day.isin(0, 6),
        "is_rush_hour": hour.between(7, 8) | hour.between(16, 17),
    }


def day_name(day_of_week) -> Column:
    d = col(day_of_week)
    chain = F.when(d == 0, DAY_NAMES[0])
    for k, name in enumerate(DAY_NAMES[1:], 1):
        chain = chain.when(d == k, name)
    return chain


def transit_mode(feed_name) -> Column:
    f = col(feed_name)
    return F.when(f.like("bus_%"), "bus").when(f.like("lrt_%"), "lrt").otherwise(F.lit("unknown"))


def delay_flags(delay, settings: Settings = DEFAULT) -> dict[str, Column]:
    d = col(delay)
    return {"is_early": d < settings.early_below_s, "is_on_time": d.between(settings.early_below_s, settings.late_above_s), "is_late": d > settings.late_above_s}


def stride_bucket(ts, minutes: int = DEFAULT.stride_minutes) -> Column:
    return F.floor(F.unix_seconds(col(ts)) / F.lit(minutes * 60)).cast("bigint")


def lead_bucket(lead_minutes, edges: Sequence[float] = DEFAULT.lead_edges_min) -> Column:
    """Label of the lead-time bucket, e.g. 05-10 or 40+; null below the first edge."""
    x = col(lead_minutes)
    chain = None
    for low, high in zip(edges, [*edges[1:], None]):
        inside = (x >= low) if high is None else (x >= low) & (x < high)
        label = f"{int(low):02d}+" if high is None else f"{int(low):02d}-{int(high):02d}"
        chain = F.when(inside, label) if chain is None else chain.when(inside, label)
    return chain


def seq_normalized(sequence, feed_name, longest) -> Column:
    """Place of a stop along its trip, 0 to 1; light-rail sequences count from one. 0 where the trip's length is unknown."""
    seq = col(sequence) - F.when(col(feed_name).like("lrt_%"), 1).otherwise(0)
    return F.when(col(longest) > 0, seq.cast("double") / col(longest)).otherwise(F.lit(0.0))


def reliability_band(rate) -> Column:
    r = col(rate)
    return F.when(r.isNull(), "none").when(r >= 0.95, "good").when(r >= 0.90, "fair").when(r >= 0.85, "poor").otherwise(F.lit("bad"))


def transfer_band(rate) -> Column:
    r = col(rate)
    return F.when(r.isNull(), "none").when(r >= 0.9, "good").when(r >= 0.8, "fair").when(r >= 0.7, "poor").otherwise(F.lit("bad"))


def delay_band(delay_s) -> Column:
    d = F.abs(col(delay_s))
    return F.when(d.isNull(), "none").when(d <= 120, "good").when(d <= 300, "fair").otherwise(F.lit("bad"))


def make_rate_estimate(slack_s, median_delay_s) -> Column:
    """Chance of making a transfer from its slack when nothing was observed: half is lost per median delay, within 0.05 to 0.98."""
    halves = col(slack_s).cast("double") / F.greatest(col(median_delay_s).cast("double"), F.lit(30.0))
    return F.greatest(F.lit(0.05), F.least(F.lit(0.98), 1.0 - F.pow(F.lit(0.5), halves)))


def interval_clamp(point, lower, upper) -> tuple[Column, Column]:
    """Bounds that hold the point between them."""
    return F.least(col(lower), col(point)), F.greatest(col(upper), col(point))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double; null where whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def quantile(x, q: float) -> Column:
    """Exact, interpolated."""
    return F.percentile(col(x), F.lit(q))
