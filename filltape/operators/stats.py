"""Table statistics, retention and hour replacement as plain frames."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filltape import params
from filltape.functions import day_label, instant


def _day(df: DataFrame) -> Column:
    """The day partition of a row; a stored table has it as a column already."""
    return F.col("event_date") if "event_date" in df.columns else F.col("time").cast("date")


def db_stats(fills: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Row counts of both tables and the time span of the fills, in one row."""
    none = F.lit(None).cast("timestamp_ntz")
    parts = fills.agg(
        F.count("*").alias("fills_count"),
        F.lit(0).cast("bigint").alias("quarantine_count"),
        F.min("time").alias("min_time"),
        F.max("time").alias("max_time"),
    ).unionByName(
        quarantine.agg(
            F.lit(0).cast("bigint").alias("fills_count"),
            F.count("*").alias("quarantine_count"),
            none.alias("min_time"),
            none.alias("max_time"),
        )
    )
    return parts.agg(
        F.sum("fills_count").alias("fills_count"),
        F.sum("quarantine_count").alias("quarantine_count"),
        F.min("min_time").alias("min_time"),
        F.max("max_time").alias("max_time"),
    )


def partition_counts(df: DataFrame) -> DataFrame:
    """Rows per day, oldest first. ``store.partition_counts`` knows them without the rows."""
    counts = df.groupBy(_day(df).alias("day")).agg(F.count("*").alias("row_count"))
    return counts.select(day_label(F.col("day")).alias("date"), "row_count").orderBy("date")


def keep_from(df: DataFrame, before_day: str) -> DataFrame:
    """The rows a purge of all days strictly before ``before_day`` leaves."""
    return df.filter(_day(df) >= F.lit(params.day(before_day, "before_date")))


def partitions_before(df: DataFrame, before_day: str) -> DataFrame:
    """The days such a purge drops."""
    day = _day(df)
    dropped = df.filter(day < F.lit(params.day(before_day, "before_date")))
    return dropped.select(day_label(day).alias("date")).distinct()


def replace_hour(
    existing: DataFrame, incoming: DataFrame, start: datetime, end: datetime
) -> DataFrame:
    """``existing`` without its rows in ``[start, end)``, plus ``incoming``.

    Applied twice with the same rows of that window it changes nothing more.
    """
    start, end = params.time_range(start, end)
    inside = (F.col("time") >= instant(start)) & (F.col("time") < instant(end))
    return existing.filter(~inside).unionByName(incoming)
