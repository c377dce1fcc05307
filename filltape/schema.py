"""Fixed schemas of the tables and results.

All instants are zone-less UTC (``TimestampNTZType``), so no result depends on
the session time zone.
"""

from pyspark.sql import types as T

_TS, _LONG, _DBL, _STR, _BOOL = (
    T.TimestampNTZType(),
    T.LongType(),
    T.DoubleType(),
    T.StringType(),
    T.BooleanType(),
)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


# One side of one trade.
FILL = _struct(
    ("time", _TS),
    ("block_time", _TS),
    ("block_number", _LONG),
    ("address", _STR),
    ("coin", _STR),
    ("type", _STR),
    ("px", _DBL),
    ("sz", _DBL),
    ("is_buy", _BOOL),
    ("start_position", _DBL),
    ("is_gaining_inventory", _BOOL),
    ("closed_pnl", _DBL),
    ("hash", _STR),
    ("oid", _LONG),
    ("crossed", _BOOL),
    ("fee", _DBL),
    ("tid", _LONG),
    ("fee_token", _STR),
    ("cloid", _STR),
    ("builder_fee", _STR),
    ("builder", _STR),
    ("local_time", _TS),
)
FILL_COLUMNS = FILL.fieldNames()

# The quarantine table carries the same payload plus the first failed rule.
QUARANTINE = T.StructType(FILL.fields + [T.StructField("reason", _STR, True)])
QUARANTINE_COLUMNS = QUARANTINE.fieldNames()

# Lineage kept in storage and hidden from query results: the object a row came
# from, its line and its position in that line's event list.
LINEAGE = _struct(("src_key", _STR), ("line_no", _LONG), ("event_pos", _LONG))

# Partition columns of both stored tables.
PARTITIONS = _struct(("event_date", T.DateType()), ("src_hour", _STR))
PARTITION_COLUMNS = PARTITIONS.fieldNames()

STORED_FILLS = T.StructType(FILL.fields + LINEAGE.fields + PARTITIONS.fields)
STORED_QUARANTINE = T.StructType(QUARANTINE.fields + LINEAGE.fields + PARTITIONS.fields)

VWAP = _struct(
    ("time", _TS), ("vwap", _DBL), ("volume", _DBL), ("notional", _DBL), ("fill_count", _LONG)
)

TIME_BARS = _struct(
    ("time", _TS),
    ("open", _DBL),
    ("high", _DBL),
    ("low", _DBL),
    ("close", _DBL),
    ("base_volume", _DBL),
    ("notional_volume", _DBL),
    ("trade_count", _LONG),
    ("buy_volume", _DBL),
    ("sell_volume", _DBL),
)

WALLET_SUMMARY = _struct(
    ("fill_count", _LONG),
    ("unique_coins", _LONG),
    ("total_volume", _DBL),
    ("total_notional", _DBL),
    ("maker_count", _LONG),
    ("taker_count", _LONG),
    ("maker_taker_ratio", _DBL),
    ("first_fill_time", _TS),
    ("last_fill_time", _TS),
)

WALLET_PER_COIN = _struct(
    ("coin", _STR),
    ("volume", _DBL),
    ("notional_volume", _DBL),
    ("fill_count", _LONG),
    ("maker_count", _LONG),
    ("taker_count", _LONG),
    ("maker_taker_ratio", _DBL),
)

COINS = _struct(("coin", _STR), ("fill_count", _LONG))

# One row per source hour of a load.
HOUR_STATUS = _struct(
    ("key", _STR),
    ("hour_start", _TS),
    ("status", _STR),
    ("rows_inserted", _LONG),
    ("rows_quarantined", _LONG),
    ("parse_errors", _LONG),
)

# One row per state change of a load run; the latest row is its status.
RUNS = _struct(
    ("run_id", _STR),
    ("state", _STR),
    ("started_at", _TS),
    ("last_updated_at", _TS),
    ("finished_at", _TS),
    ("current_hour", _STR),
    ("hours_done", _LONG),
    ("hours_total", _LONG),
    ("rows_inserted", _LONG),
    ("rows_quarantined", _LONG),
    ("files_missing", _LONG),
    ("files_failed", _LONG),
)

# One row per hour of a commit (``kind`` is ``hours``), and one per stored partition the
# hour consists of from then on, with what is known of it. See ``sources/commits.py``.
COMMITS = T.StructType(
    _struct(
        ("commit_id", _STR),
        ("load_id", _STR),
        ("run_id", _STR),
        ("loaded_at", _TS),
        ("committed_at", _TS),
        ("src_hour", _STR),
        ("src_key", _STR),
        ("status", _STR),
        ("kind", _STR),
        ("event_date", T.DateType()),
        ("folder", _STR),
        ("rows", _LONG),
        ("min_time", _TS),
        ("max_time", _TS),
        ("clustered", _BOOL),
    ).fields
    + [T.StructField("reasons", T.MapType(_STR, _LONG), True)]
)
