"""Hourly archive keys: ``<prefix>/<YYYYMMDD>/<HH>.lz4``, one object per UTC hour."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filltape import params
from filltape.functions import floor_hour, hour_key_parts, hour_label, instant


def hour_range(spark: SparkSession, start: datetime, end: datetime) -> DataFrame:
    """One row ``hour_start`` per hour of the half-open, hour-aligned window."""
    start, end = params.utc(start), params.utc(end)
    if end < start:
        raise ValueError(f"hours run backwards: {start} to {end}")
    for name, value in (("start", start), ("end", end)):
        if (value.minute, value.second, value.microsecond) != (0, 0, 0):
            raise ValueError(f"{name} of an hour range must be a full hour, got {value}")
    hours = (end - start) // timedelta(hours=1)
    first = instant(start)
    return spark.range(hours).select(
        (first + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("hour_start")
    )


def hour_keys_between(
    spark: SparkSession, prefix: str, start: datetime, end: datetime
) -> DataFrame:
    """Keys and hour starts of the half-open window ``[start, end)``."""
    base = prefix.strip("/")
    base = f"{base}/" if base else ""
    return hour_range(spark, start, end).select(
        F.concat(F.lit(base), hour_label(F.col("hour_start"), "/"), F.lit(".lz4")).alias("key"),
        "hour_start",
    )


def hour_keys(spark: SparkSession, prefix: str, from_day: str, to_day: str) -> DataFrame:
    """Keys of every hour of an inclusive UTC day range, 24 per day."""
    first, last = params.day_range(from_day, to_day)
    midnight = datetime.min.time()
    return hour_keys_between(
        spark,
        prefix,
        datetime.combine(first, midnight),
        datetime.combine(last + timedelta(days=1), midnight),
    )


def key_hour_start(key: Column) -> Column:
    """Hour start of an object key, NULL when its date or hour segment is not valid."""
    day, hour = hour_key_parts(key)
    iso = F.regexp_replace(day, r"^(\d{4})(\d{2})(\d{2})\z", "$1-$2-$3")
    hours = F.when(hour.rlike(r"^\+?\d+\z"), hour.try_cast("int"))
    date = F.when(day.rlike(r"^\d{8}\z"), iso.try_cast("date"))
    return F.when(
        hours.between(0, 23), date.cast("timestamp_ntz") + F.make_dt_interval(hours=hours)
    )


def hour_window(key: Column) -> Column:
    """The half-open hour ``struct(start, end)`` an object key stands for."""
    start = key_hour_start(key)
    return F.when(
        start.isNotNull(),
        F.struct(start.alias("start"), (start + F.make_dt_interval(hours=F.lit(1))).alias("end")),
    )


def missing_hours(df: DataFrame, from_day: str, to_day: str, time: str = "time") -> DataFrame:
    """Hours of an inclusive day range in which ``df`` has no row."""
    first, last = params.day_range(from_day, to_day)
    midnight = datetime.min.time()
    start = datetime.combine(first, midnight)
    end = datetime.combine(last + timedelta(days=1), midnight)
    expected = hour_range(df.sparkSession, start, end)
    # One row per hour and task before the shuffle, whatever the table holds.
    seen = (
        df.filter((F.col(time) >= instant(start)) & (F.col(time) < instant(end)))
        .select(floor_hour(F.col(time)).alias("hour_start"))
        .distinct()
    )
    return expected.join(seen, "hour_start", "left_anti")
