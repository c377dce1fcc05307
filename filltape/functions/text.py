"""Text helpers."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from filltape.functions.times import day_label


def trim_white(text: Column) -> Column:
    """Strip every Unicode white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def ascii_upper(text: Column) -> Column:
    """Upper-case a-z only, leaving every other letter alone."""
    return F.translate(text, string.ascii_lowercase, string.ascii_uppercase)


def _date_parts(text: Column, pattern: str) -> Column:
    """``YYYYMMDD`` from the first three groups of ``pattern``, NULL unless it is a real date."""
    iso = F.concat_ws("-", *[F.regexp_extract(text, pattern, g) for g in (1, 2, 3)])
    return F.when(text.rlike(pattern), day_label(iso.try_cast("date")))


# Fixed patterns: the date texts a partition name may come in.
_DASHED = r"^(\d{4})-(\d{1,2})-(\d{1,2})\z"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})\z"
_DAY_AND_TIME = r"^(\d{4})-(\d{1,2})-(\d{1,2})[T ]\d{1,2}:\d{1,2}:\d{1,2}(?:\.\d+)?\z"
_WITH_OFFSET = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})\z"


def normalize_date(text: Column) -> Column:
    """Date text to ``YYYYMMDD``; an offset is converted to UTC first; other text comes back trimmed."""
    trimmed = trim_white(text)
    clock = F.regexp_extract(trimmed, r"[T ](\d{1,2}:\d{1,2}:\d{1,2})", 1)
    local = F.concat_ws(" ", F.substring(trimmed, 1, 10), F.substring(trimmed, 12, 8)).try_cast(
        "timestamp_ntz"
    )
    sign = F.when(trimmed.rlike(r"-\d{2}:\d{2}\z"), F.lit(-1)).otherwise(F.lit(1))
    minutes = F.coalesce(
        F.regexp_extract(trimmed, r"(\d{2}):\d{2}\z", 1).try_cast("int") * 60
        + F.regexp_extract(trimmed, r"\d{2}:(\d{2})\z", 1).try_cast("int"),
        F.lit(0),
    )
    offset = F.when(trimmed.rlike(r"[Zz]\z"), F.lit(0)).otherwise(sign * minutes)
    shifted = local - F.make_dt_interval(mins=offset)
    valid_clock = F.concat(F.lit("2000-01-01 "), clock).try_cast("timestamp_ntz").isNotNull()
    return F.coalesce(
        _date_parts(trimmed, _DASHED),
        _date_parts(trimmed, _COMPACT),
        F.when(trimmed.rlike(_WITH_OFFSET), day_label(shifted)),
        F.when(valid_clock, _date_parts(trimmed, _DAY_AND_TIME)),
        trimmed,
    )
