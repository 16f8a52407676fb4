"""Hourly forecasts: nested JSON, one file a location and collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings

_VALUE = "struct<value:struct<en:{0}>>"
SCHEMA = (
    "properties struct<hourlyForecastGroup:struct<hourlyForecasts:array<struct<timestamp:string,iconCode:struct<value:string>,"
    + f"temperature:{_VALUE.format('double')},condition:struct<en:string>,wind:struct<speed:{_VALUE.format('double')},gust:{_VALUE.format('double')},direction:{_VALUE.format('string')}>,"
    + f"lop:struct<value:struct<en:double>,category:struct<en:string>>,uv:struct<index:{_VALUE.format('string')}>>>>>"
)


def read_forecasts(spark: SparkSession, root: str, settings: Settings = DEFAULT) -> DataFrame:
    """Rows of all forecasts under root (.../<location>/<date>/<time>.json). Hours without a timestamp are left out; flags are null where the icon is."""
    raw = spark.read.schema(SCHEMA).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(root).withColumn("_path", F.input_file_name())
    hours = raw.select("_path", F.explode("properties.hourlyForecastGroup.hourlyForecasts").alias("h")).where("h.timestamp IS NOT NULL")
    icon = F.col("h.iconCode.value").try_cast("int")
    rain, snow, freezing = (icon.isin(*x) for x in (settings.rain_icons, settings.snow_icons, settings.freezing_icons))
    return hours.select(
        F.regexp_extract("_path", r"([^/]+)/[^/]+/[^/]+\.json$", 1).alias("location"),
        F.col("h.timestamp").alias("forecast_timestamp_utc"),
        F.regexp_extract("_path", r"([^/]+)\.json$", 1).alias("collected_at_filename"),
        F.col("h.temperature.value.en").cast("bigint").alias("temperature_c"),
        F.col("h.condition.en").alias("weather_condition"),
        icon.alias("icon_code"),
        F.col("h.wind.speed.value.en").cast("bigint").alias("wind_speed_kmh"),
        F.col("h.wind.gust.value.en").cast("bigint").alias("wind_gust_kmh"),
        F.col("h.wind.direction.value.en").alias("wind_direction"),
        F.col("h.lop.value.en").cast("bigint").alias("precip_probability_pct"),
        F.col("h.lop.category.en").alias("precip_category"),
        F.col("h.uv.index.value.en").alias("uv_index"),
        rain.alias("is_rain"),
        snow.alias("is_snow"),
        freezing.alias("is_freezing_rain"),
        (rain | snow | freezing).alias("is_precip"),
    )


def weather_features(forecasts: DataFrame) -> DataFrame:
    """The forecast collected last for each location and hour."""
    hour = F.date_trunc("hour", F.col("forecast_timestamp_utc").cast("timestamp"))
    w = Window.partitionBy("location", "timestamp_utc_hour").orderBy(F.col("collected_at_filename").desc_nulls_last())
    rows = forecasts.withColumn("timestamp_utc_hour", hour).withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return rows.drop("_rn", "forecast_timestamp_utc", "collected_at_filename")
