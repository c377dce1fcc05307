"""Time helpers on zone-less UTC timestamps."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from filltape import params


def instant(value: datetime) -> Column:
    """A constant zone-less UTC timestamp. ``lit`` alone would tie it to the session time zone."""
    return F.lit(params.utc(value).isoformat(sep=" ")).cast("timestamp_ntz")


def bucket(time: Column, width: str) -> Column:
    """Start of the calendar-aligned UTC bucket that holds ``time``."""
    return F.window(time, params.INTERVALS[params.interval(width)]).start


def epoch_ms_to_time(ms: Column) -> Column:
    """Milliseconds since 1970 to a timestamp. The caller keeps ``ms`` in range."""
    return F.timestamp_add("MILLISECOND", ms, instant(datetime(1970, 1, 1)))


def iso_to_time(text: Column) -> Column:
    """ISO text with up to nine fraction digits, cut to microseconds; NULL when unreadable."""
    return text.try_cast("timestamp_ntz")


def floor_hour(time: Column) -> Column:
    """Start of the hour that holds ``time``, without a detour over the session time zone."""
    past = F.make_dt_interval(mins=F.minute(time), secs=F.extract(F.lit("SECOND"), time))
    return time - past


def hour_key_parts(key: Column) -> tuple[Column, Column]:
    """Date and hour text of an hourly object key, ``unknown`` where a segment is absent."""
    parts = F.reverse(F.split(key, "/"))
    day = F.coalesce(F.get(parts, F.lit(1)), F.lit("unknown"))
    hour = F.regexp_replace(F.get(parts, F.lit(0)), r"\.lz4\z", "")
    return day, hour


def day_label(day: Column) -> Column:
    """``YYYYMMDD`` of a date or a zone-less timestamp."""
    return F.translate(day.cast("date").cast("string"), "-", "")


def hour_label(time: Column, separator: str = "") -> Column:
    """``YYYYMMDD``, the separator and ``HH`` of a zone-less timestamp."""
    return F.concat(day_label(time), F.lit(separator), F.lpad(F.hour(time).cast("string"), 2, "0"))
