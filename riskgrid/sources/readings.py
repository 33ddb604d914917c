"""Sub-daily readings in long form, daily feeds, and stored tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.functions import constants as K
from riskgrid.functions import weather_math as wm
from riskgrid.sources.detections import read_or_none

READING_KEY = ["valid_time", "latitude", "longitude"]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is NULL from here on: NaN would count as the largest number."""
    floating = {c for c, t in df.dtypes if t in ("double", "float")}
    return df.select(*[wm.nan_to_null(F.col(f"`{c}`")).alias(c) if c in floating else F.col(f"`{c}`") for c in df.columns])


def read_readings(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Rows of many files as one table; a variable a file lacks is NULL."""
    frames = [spark.read.parquet(p) for p in paths]
    return nan_to_null(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames))


def merge_readings(first: DataFrame, second: DataFrame) -> DataFrame:
    """Variables of both tables on shared coordinates; the first wins a conflict."""
    a, b = first.alias("a"), second.alias("b")
    condition = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in READING_KEY])
    names = [c for c in first.columns if c not in READING_KEY]
    names += [c for c in second.columns if c not in READING_KEY and c not in names]

    def merged(name: str):
        sides = [F.col(f"{side}.{name}") for side, df in (("a", first), ("b", second)) if name in df.columns]
        return F.coalesce(*sides).alias(name)

    return a.join(b, condition, "full_outer").select(*[merged(k) for k in READING_KEY], *[merged(n) for n in names])


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace the Parquet table at `path`; parent folders are made."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored static table, built and stored on the first call."""
    stored = read_or_none(spark, path)
    if stored is None:
        write_table(build(), path)
        stored = spark.read.parquet(path)
    return stored


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Only the named columns; the file reader skips the others."""
    return spark.read.parquet(path).select(*[F.col(f"`{c}`") for c in columns])


# Names of the daily feed and of the model's columns.
FEED_COLUMNS = {
    "time": "date",
    "temperature_2m_mean": "t2m",
    "relative_humidity_2m_mean": "relative_humidity",
    "precipitation_sum": "precip_mm",
    "soil_moisture_0_to_7cm_mean": "swvl1",
    "wind_speed_10m_mean": "wind_speed",
}


def rename_feed(feed: DataFrame) -> DataFrame:
    """The daily feed under the model's names, temperature in Kelvin."""
    renamed = feed.withColumnsRenamed(FEED_COLUMNS)
    return renamed.withColumn("t2m", wm.celsius_to_kelvin(F.col("t2m"))).withColumn("date", F.to_date("date"))


def recent_weather(
    feed: DataFrame, end_date: str | dt.date, lookback_days: int = K.LIVE_LOOKBACK_DAYS
) -> DataFrame:
    """Days end - lookback to end, both included."""
    end = F.lit(end_date).cast("date")
    return rename_feed(feed).filter(F.col("date").between(F.date_sub(end, lookback_days), end))
