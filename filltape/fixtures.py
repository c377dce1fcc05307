"""Fills and raw block lines derived from an ``events`` table, for tests, checks and benchmarks.

``events`` holds ``event_id, ts, user_id, event_type, value, props``. Prices and
sizes are multiples of 1/64 and 1/128, so sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filltape.functions import hour_label
from filltape.schema import FILL_COLUMNS

KEY_PREFIX = "fills"


_EVENTS = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double,"
    " props string"
)

# One fill per event, column by column.
_FILL = {
    "time": "ts",
    "block_time": "ts",
    "block_number": "event_id DIV 8",
    "address": "concat('w', cast(user_id AS STRING))",
    "coin": (
        "CASE event_type WHEN 'click' THEN 'BTC' WHEN 'view' THEN 'ETH' WHEN 'purchase' THEN 'SOL'"
        " WHEN 'signup' THEN '@1' ELSE '@107' END"
    ),
    "type": "CASE WHEN event_type IN ('signup', 'error') THEN 'SPOT' ELSE 'PERP' END",
    "px": "floor(value * 64) / 64.0e0 + 1.0e0",
    "sz": "(cast(get_json_object(props, '$.k') AS INT) + 1) / 128.0e0",
    "is_buy": "event_id % 2 = 0",
    "start_position": "(event_id % 21) - 10.0e0",
    "closed_pnl": "((event_id % 17) - 8) / 4.0e0",
    "hash": "concat('0xh', cast(event_id DIV 3 AS STRING))",
    "oid": "event_id DIV 4 + 1",
    "crossed": "event_id % 3 <> 0",
    "fee": "((event_id % 9) - 2) / 64.0e0",
    "tid": "event_id DIV 2",
    "fee_token": "CASE WHEN event_id % 10 = 0 THEN 'HYPE' ELSE 'USDC' END",
    "cloid": "CASE WHEN event_id % 5 = 0 THEN concat('0xc', cast(event_id AS STRING)) END",
    "builder_fee": "CASE WHEN event_id % 7 = 0 THEN '0.25' END",
    "builder": "CASE WHEN event_id % 7 = 0 THEN '0xb' END",
    "local_time": "ts + INTERVAL 1 SECOND",
    "event_pos": "event_id",
    # The columns above may be used by name.
    "is_gaining_inventory": (
        "abs(start_position + CASE WHEN is_buy THEN sz ELSE -sz END)"
        " > abs(start_position) + 1e-12"
    ),
}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(_EVENTS).parquet(f"{sf_dir}/events.parquet")


def fills_from_events(source: DataFrame) -> DataFrame:
    """One fill per event, with its position ``event_pos``."""
    columns = [*FILL_COLUMNS, "event_pos"]
    return source.selectExpr(*[f"{_FILL[name]} AS {name}" for name in columns])


# The JSON keys of a fill; ``{...}`` marks where a fault may replace the value.
_RAW_FILL = {
    "coin": "coin",
    "px": "{px}",
    "sz": "{sz}",
    "side": "CASE WHEN is_buy THEN 'B' ELSE 'A' END",
    "time": "{time}",
    "startPosition": "cast(start_position AS STRING)",
    "closedPnl": "cast(closed_pnl AS STRING)",
    "hash": "hash",
    "oid": "oid",
    "crossed": "crossed",
    "fee": "{fee}",
    "tid": "{tid}",
    "feeToken": "fee_token",
    "cloid": "cloid",
    "builderFee": "builder_fee",
    "builder": "builder",
    "newField": "{extra}",
}
# Milliseconds since 1970, worked out without the session time zone.
_MS = (
    "(datediff(cast(time AS DATE), DATE'1970-01-01') * 86400000L"
    " + hour(time) * 3600000L + minute(time) * 60000L"
    " + cast(floor(extract(SECOND FROM time) * 1000) AS BIGINT))"
)
_VALUES = {
    "px": "cast(px AS STRING)",
    "sz": "cast(sz AS STRING)",
    "time": _MS,
    "fee": "cast(fee AS STRING)",
    "tid": "tid",
    "extra": "cast(NULL AS STRING)",
}
_FAULTY_VALUES = {
    "px": (
        "CASE WHEN event_pos % 107 = 4 THEN 'NaN' WHEN event_pos % 101 = 2 THEN '0'"
        " ELSE cast(px AS STRING) END"
    ),
    "sz": (
        "CASE WHEN event_pos % 107 = 4 THEN '0' WHEN event_pos % 103 = 3 THEN '-1.5'"
        " ELSE cast(sz AS STRING) END"
    ),
    "time": f"CASE WHEN event_pos % 113 = 6 THEN 9000000000000000L ELSE {_MS} END",
    "fee": "CASE WHEN event_pos % 109 = 5 THEN 'inf' ELSE cast(fee AS STRING) END",
    "tid": "CASE WHEN NOT (block_number % 89 = 1 AND event_pos % 8 = 0) THEN tid END",
    "extra": "CASE WHEN block_number % 13 = 0 THEN 'x' END",
}


def _iso(time: Column) -> Column:
    """ISO text with nine fraction digits."""
    text = time.cast("string")
    second = F.lpad(F.extract(F.lit("SECOND"), time).cast("string"), 9, "0")
    return F.concat(
        F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 6), second, F.lit("000")
    )


def raw_lines(source: DataFrame, faults: bool = True) -> DataFrame:
    """Block lines ``(key, line_no, line)`` of eight events each, in the raw input format.

    With ``faults`` some fills get wrong values, some blocks lack a key, are cut off, have
    another member behind them, hold a key twice or half a character, and some carry keys
    that are not part of the format.
    """
    values = _FAULTY_VALUES if faults else _VALUES
    body = ", ".join(f"'{key}', {sql.format(**values)}" for key, sql in _RAW_FILL.items())
    # A block has eight events by construction, so the list is bounded.
    blocks = (
        fills_from_events(source)
        .groupBy("block_number")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("event_pos", "address", F.expr(f"named_struct({body})").alias("body"))
                )
            ).alias("fills"),
            F.min("time").alias("first"),
        )
    )
    pair = """fill -> concat('["', fill.address, '",', to_json(fill.body), ']')"""
    version = "CASE WHEN block_number % 13 = 0 THEN ',\"version\":2' ELSE '' END" if faults else "''"
    line = F.concat(
        F.lit('{"local_time":"'),
        _iso(F.expr("first + INTERVAL 1 SECOND")),
        F.lit('","block_time":"'),
        _iso(F.col("first")),
        F.expr(f"""concat('","block_number":', block_number, {version})"""),
        F.expr(f"""concat(',"events":[', array_join(transform(fills, {pair}), ','), ']}}')"""),
    )
    if faults:
        line = (
            F.when(F.expr("block_number % 97 = 0"), F.substring(line, 1, 20))
            .when(F.expr("block_number % 83 = 2"), F.concat(line, F.lit(',"x":1')))
            .when(
                F.expr("block_number % 79 = 3"),
                F.concat(F.substring(line, F.lit(1), F.length(line) - 1), F.lit(',"block_number":1}')),
            )
            .when(F.expr("block_number % 73 = 5"), F.replace(line, F.lit('"oid":'), F.lit('"oid":1,"oid":')))
            .when(
                F.expr("block_number % 71 = 6"),
                F.replace(line, F.lit('"feeToken":"'), F.lit('"feeToken":"\\ud800')),
            )
            .otherwise(line)
        )
    return blocks.select(
        F.concat(F.lit(f"{KEY_PREFIX}/"), hour_label(F.col("first"), "/"), F.lit(".lz4")).alias(
            "key"
        ),
        F.expr("block_number + 1").alias("line_no"),
        line.alias("line"),
    )
