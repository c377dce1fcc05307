"""Validation, quarantine routing and ingest counters."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filltape import params
from filltape.functions import finite_sql, hour_key_parts
from filltape.schema import FILL_COLUMNS

# First instant of the archive, and how far a time may lie outside.
FIRST_HOUR = datetime(2025, 7, 27)
EARLY_SKEW = timedelta(minutes=5)
LATE_SKEW = timedelta(hours=24)

PARSE_ERROR = "parse_error"
_NUMBERS = ["px", "sz", "start_position", "closed_pnl", "fee"]
_EPOCH = datetime(1970, 1, 1)


def _ms(value: datetime) -> int:
    return (params.utc(value) - _EPOCH) // timedelta(milliseconds=1)


def reason(as_of: datetime | None = None, min_time: datetime = FIRST_HOUR) -> Column:
    """First rule a parsed row breaks, in fixed order; NULL for a valid fill.

    The finite test of a number comes before its sign test: in Spark NaN is
    greater than every number. Time is compared in milliseconds, as the raw
    value may be too large for a timestamp.
    """
    earliest = _ms(min_time - EARLY_SKEW)
    latest = _ms((as_of or params.now()) + LATE_SKEW)
    rules = [("parse_error", PARSE_ERROR)]
    for name in ("px", "sz"):
        rules.append((f"NOT {finite_sql(name)}", f"{name}_not_finite"))
        rules.append((f"{name} <= 0", f"{name}<=0"))
    for name in ("start_position", "closed_pnl", "fee"):
        rules.append((f"NOT {finite_sql(name)}", f"{name}_not_finite"))
    rules.append((f"time_ms NOT BETWEEN {earliest} AND {latest}", "bad_time"))
    cases = " ".join(f"WHEN {broken} THEN '{name}'" for broken, name in rules)
    return F.expr(f"CASE {cases} END")


def validate(
    parsed: DataFrame, as_of: datetime | None = None, min_time: datetime = FIRST_HOUR
) -> DataFrame:
    """Add ``reason`` to the rows of :func:`filltape.operators.decode.parse_lines`."""
    return parsed.withColumn("reason", reason(as_of, min_time))


def parse_error_hash(key: Column, line_no: Column) -> Column:
    day, hour = hour_key_parts(key)
    return F.format_string("parse_error:%s/%s:%d", day, hour, line_no)


def _quarantine_time() -> Column:
    """A rejected row keeps its own time, unless that is what is wrong with it."""
    lost = F.col("reason").isin("bad_time", PARSE_ERROR) | F.col("time").isNull()
    return F.when(lost, F.col("hour_start")).otherwise(F.col("time"))


def route(validated: DataFrame) -> DataFrame:
    """Give every row its stored form: fills unchanged, rejected rows as quarantine keeps them.

    Quarantined numbers that are not finite become NULL, and a rejected line
    becomes a row with its hour, a made-up hash and nothing else.
    """
    rejected = F.col("reason").isNotNull()
    changed = {
        "time": F.when(rejected, _quarantine_time()).otherwise(F.col("time")),
        "hash": F.when(
            F.col("reason") == PARSE_ERROR, parse_error_hash(F.col("key"), F.col("line_no"))
        ).otherwise(F.col("hash")),
    }
    # Valid rows hold finite numbers only, so this leaves them alone.
    changed |= {
        name: F.expr(f"CASE WHEN {finite_sql(name)} THEN {name} END") for name in _NUMBERS
    }
    return validated.withColumns(changed)


def valid_fills(validated: DataFrame) -> DataFrame:
    """The rows that go to ``fills``."""
    return validated.filter(F.col("reason").isNull()).select(
        *FILL_COLUMNS, F.col("key").alias("src_key"), "line_no", "event_pos"
    )


def quarantined(validated: DataFrame) -> DataFrame:
    """The rows that go to ``fills_quarantine``."""
    return (
        route(validated)
        .filter(F.col("reason").isNotNull())
        .select(*FILL_COLUMNS, "reason", F.col("key").alias("src_key"), "line_no", "event_pos")
    )


def ingest_counts(validated: DataFrame) -> DataFrame:
    """Counters per source object. A rejected line counts as quarantined and as parse error."""
    return validated.groupBy(F.col("key").alias("src_key")).agg(
        F.count_if(F.col("reason").isNull()).alias("rows_inserted"),
        F.count_if(F.col("reason").isNotNull()).alias("rows_quarantined"),
        F.count_if(F.col("parse_error")).alias("parse_errors"),
    )


def quarantine_reasons(quarantine: DataFrame) -> DataFrame:
    """Rows per reason."""
    return quarantine.groupBy("reason").agg(F.count("*").alias("n"))
