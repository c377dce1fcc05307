"""

All queries run over fills derived from the ``events`` table, or over raw block
lines generated from it, see ``filltape/fixtures.py``.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filltape import fixtures
from filltape.functions import normalize_date
from filltape.operators import bars, coins, decode, lookup, stats, validate, wallets
from filltape.plans import runs, sync
from filltape.schema import FILL_COLUMNS
from filltape.sources import hours

# The operators for training text are optional: the rest works without them.
try:
    import corpus_pipeline
    from filltape.llm import queries as llm
except ImportError:
    corpus_pipeline = llm = None

# The whole span any table may have, and a window inside the generated data.
FIRST, LAST = datetime(2000, 1, 1), datetime(2100, 1, 1)
START, END = datetime(2024, 1, 5, 7, 30), datetime(2024, 1, 21)
MIN_TIME, AS_OF = datetime(2024, 1, 1), datetime(2024, 3, 1)
HOUR_START, HOUR_END = datetime(2024, 1, 10, 9), datetime(2024, 1, 10, 10)
WALLET = "w46"


def _fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.fills_from_events(fixtures.events(spark, sf_dir))


def _dense(fills: DataFrame) -> DataFrame:
    """Fills moved to the start of their hour, with block and position in another order.

    Buckets then hold several fills of one instant, and only ties decide their order.
    """
    return fills.withColumns(
        {
            "time": F.date_trunc("HOUR", "time").cast("timestamp_ntz"),
            "block_number": F.col("event_pos") * 7 % 11,
            "event_pos": 10_000_000 - F.col("event_pos"),
        }
    )


def _lines(spark: SparkSession, sf_dir: str, faults: bool = True) -> DataFrame:
    return fixtures.raw_lines(fixtures.events(spark, sf_dir), faults)


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate(decode.parse_lines(_lines(spark, sf_dir)), AS_OF, MIN_TIME)


def _quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.quarantined(_validated(spark, sf_dir))


def _parse_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = decode.parse_lines(_lines(spark, sf_dir, faults=False))
    return parsed.select("key", "line_no", "event_pos", "parse_error", "time_ms", *FILL_COLUMNS)


def _validate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir).select(
        "key", "line_no", "event_pos", F.col("reason").isNull().alias("valid"), "reason"
    )


def _hour_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = validate.ingest_counts(_validated(spark, sf_dir))
    # Every kind of failure, by the hour of the day at the end of the key.
    hour = F.substring("src_key", -6, 2).cast("int")
    status = F.lit(runs.PROCESSED)
    for number, failure in enumerate(runs.FAILED):
        status = F.when(hour == 3 * number + 2, failure).otherwise(status)
    attempts = counts.select(F.col("src_key").alias("key"), status.alias("status"))
    expected = hours.hour_keys(spark, fixtures.KEY_PREFIX, "20240101", "20240131")
    return runs.hour_status(expected, attempts, counts)


def _run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per day of fills, as its log would stand at the end of that day."""
    day = F.col("time").cast("date")
    return (
        _fills(spark, sf_dir)
        .groupBy(day.alias("day"))
        .agg(
            F.min("time").alias("started_at"),
            F.max("time").alias("finished_at"),
            F.count("*").alias("rows_inserted"),
            F.count_if("crossed").alias("rows_quarantined"),
        )
        .select(
            F.col("day").cast("string").alias("run_id"),
            F.lit(runs.SUCCEEDED).alias("state"),
            "started_at",
            F.col("finished_at").alias("last_updated_at"),
            "finished_at",
            F.concat(F.col("day").cast("string"), F.lit("/23")).alias("current_hour"),
            F.lit(24).cast("bigint").alias("hours_done"),
            F.lit(24).cast("bigint").alias("hours_total"),
            "rows_inserted",
            "rows_quarantined",
            F.lit(0).cast("bigint").alias("files_missing"),
            F.lit(0).cast("bigint").alias("files_failed"),
        )
    )


def _replace_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills = _fills(spark, sf_dir).select(*FILL_COLUMNS)
    repriced = lookup.between(fills, HOUR_START, HOUR_END).withColumn("px", F.col("px") * 2)
    return stats.replace_hour(fills, repriced, HOUR_START, HOUR_END)


def _normalize_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fill time written in one of nine ways, plus its normal form."""
    text = F.col("time").cast("string")
    day, clock = F.substring(text, 1, 10), F.substring(text, 12, 8)
    second = F.concat(F.substring(text, 1, 11), clock)
    iso = F.concat(day, F.lit("T"), clock)
    ways = [
        day,
        F.translate(day, "-", ""),
        F.concat(iso, F.lit("Z")),
        F.concat(iso, F.lit("+05:30")),
        F.concat(iso, F.lit("-08:00")),
        iso,
        F.concat(iso, F.lit(".25")),
        F.concat(F.lit("  "), second, F.lit(" ")),
        F.concat(F.lit("day "), day, F.lit(" ")),
    ]
    chosen = ways[-1]
    for number, way in enumerate(ways[:-1]):
        chosen = F.when(F.col("event_pos") % len(ways) == number, way).otherwise(chosen)
    return (
        _fills(spark, sf_dir)
        .select("event_pos", chosen.alias("raw"))
        .withColumn("date", normalize_date(F.col("raw")))
    )


def _on_fills(query: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(_fills(spark, sf_dir))


def entry(spark: SparkSession) -> DataFrame:
    """One-hour bars of one coin."""
    fills = _fills(spark, "/root/testdata/sf0.001")
    return bars.time_bars(fills, "BTC", "1h", FIRST, LAST)


def _llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return llm.QUERIES | {"pipeline": corpus_pipeline.run} if llm else {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    table = {
        "get_fills_range": lambda f: lookup.get_fills(f, START, END),
        "get_fills_coin": lambda f: lookup.get_fills(f, FIRST, LAST, coin=" BTC "),
        "get_fills_wallet": lambda f: lookup.get_fills(f, FIRST, LAST, wallet=WALLET),
        "get_fills_side_crossed": lambda f: lookup.get_fills(
            f, FIRST, LAST, side="sell", crossed_only=True
        ),
        "fill_by_hash": lambda f: lookup.get_fill_by_hash(f, "0xh100"),
        "fills_by_oid": lambda f: lookup.get_fills_by_oid(f, 25),
        "vwap_all_coins_1s": lambda f: bars.vwap_by_coin(f, "1s"),
        "vwap_all_coins_1h": lambda f: bars.vwap_by_coin(f, "1h"),
        "time_bars_all_coins_1s": lambda f: bars.time_bars_by_coin(f, "1s"),
        "time_bars_all_coins_1h": lambda f: bars.time_bars_by_coin(f, "1h"),
        "get_fills_ties": lambda f: lookup.get_fills(_dense(f), FIRST, LAST),
        "vwap_dense_1s": lambda f: bars.vwap(_dense(f), "ETH", "1s", FIRST, LAST),
        "time_bars_dense_1s": lambda f: bars.time_bars_by_coin(_dense(f), "1s"),
        "time_bars_dense_5s": lambda f: bars.time_bars_by_coin(_dense(f), "5s"),
        "wallet_per_coin": lambda f: wallets.wallet_per_coin(f, WALLET, FIRST, LAST),
        "wallet_summary": lambda f: wallets.wallet_totals(f, WALLET, FIRST, LAST),
        "wallet_summary_empty": lambda f: wallets.wallet_totals(f, "nobody", FIRST, LAST),
        "wallet_summary_all": lambda f: wallets.wallet_totals_all(f, FIRST, LAST),
        "wallet_top_coins": lambda f: wallets.wallet_top_coins(f, WALLET, FIRST, LAST, 3),
        "list_coins": coins.list_coins,
        "top_coin": coins.top_coin,
        "bars_totals": lambda f: bars.bars_totals(bars.time_bars(f, "ETH", "5m", FIRST, LAST)),
        "max_fill_time": coins.max_fill_time,
        "missing_hours": lambda f: hours.missing_hours(f, "20231230", "20240202"),
        "sync_window": lambda f: sync.sync_window(
            coins.max_fill_time(f), datetime(2024, 2, 3, 4, 5), MIN_TIME
        ),
        "partition_counts": stats.partition_counts,
        "purge_before": lambda f: stats.keep_from(f, "20240115").select(*FILL_COLUMNS),
        "purge_days": lambda f: stats.partitions_before(f, "20240115"),
    }
    for width in _WIDTHS:
        table[f"vwap_{width}"] = lambda f, w=width: bars.vwap(f, "ETH", w, START, END)
        table[f"time_bars_{width}"] = lambda f, w=width: bars.time_bars(f, "BTC", w, START, END)
    return {name: _on_fills(query) for name, query in table.items()} | {
        "parse_derive": _parse_derive,
        "unknown_keys": lambda spark, sf_dir: decode.unknown_keys(_lines(spark, sf_dir)),
        "validate_split": _validate_split,
        "valid_fills": lambda spark, sf_dir: validate.valid_fills(_validated(spark, sf_dir)),
        "quarantine_rows": _quarantine,
        "ingest_counts": lambda spark, sf_dir: validate.ingest_counts(_validated(spark, sf_dir)),
        "quarantine_reasons": lambda spark, sf_dir: validate.quarantine_reasons(
            _quarantine(spark, sf_dir)
        ),
        "replace_hour": _replace_hour,
        "hour_status": _hour_status,
        "run_report": lambda spark, sf_dir: runs.run_report(
            _hour_status(spark, sf_dir), "20240101", "20240131"
        ),
        "ingest_status": lambda spark, sf_dir: runs.ingest_status(_run_log(spark, sf_dir)),
        "db_stats": lambda spark, sf_dir: stats.db_stats(
            validate.valid_fills(_validated(spark, sf_dir)), _quarantine(spark, sf_dir)
        ),
        "normalize_date": _normalize_date,
        **_llm_queries(),
    }


_WIDTHS = {
    "1s": "1 second",
    "5s": "5 seconds",
    "30s": "30 seconds",
    "1m": "1 minute",
    "5m": "5 minutes",
    "15m": "15 minutes",
    "30m": "30 minutes",
    "1h": "1 hour",
    "4h": "4 hours",
    "1d": "1 day",
}

_FILLS_SQL = """
fills AS (
  SELECT time, block_time, block_number, address, coin, type, px, sz, is_buy, start_position,
         abs(start_position + CASE WHEN is_buy THEN sz ELSE -sz END)
           > abs(start_position) + 1e-12 AS is_gaining_inventory,
         closed_pnl, hash, oid, crossed, fee, tid, fee_token, cloid, builder_fee, builder,
         local_time, event_pos
  FROM (
    SELECT ts AS time, ts AS block_time, event_id // 8 AS block_number,
           concat('w', cast(user_id AS VARCHAR)) AS address,
           CASE event_type WHEN 'click' THEN 'BTC' WHEN 'view' THEN 'ETH'
                           WHEN 'purchase' THEN 'SOL' WHEN 'signup' THEN '@1'
                           ELSE '@107' END AS coin,
           CASE WHEN event_type IN ('signup', 'error') THEN 'SPOT' ELSE 'PERP' END AS type,
           floor(value * 64) / 64.0e0 + 1.0e0 AS px,
           (cast(json_extract(props, '$.k') AS INT) + 1) / 128.0e0 AS sz,
           event_id % 2 = 0 AS is_buy,
           (event_id % 21) - 10.0e0 AS start_position,
           ((event_id % 17) - 8) / 4.0e0 AS closed_pnl,
           concat('0xh', cast(event_id // 3 AS VARCHAR)) AS hash,
           event_id // 4 + 1 AS oid,
           event_id % 3 <> 0 AS crossed,
           ((event_id % 9) - 2) / 64.0e0 AS fee,
           event_id // 2 AS tid,
           CASE WHEN event_id % 10 = 0 THEN 'HYPE' ELSE 'USDC' END AS fee_token,
           CASE WHEN event_id % 5 = 0 THEN concat('0xc', cast(event_id AS VARCHAR)) END AS cloid,
           CASE WHEN event_id % 7 = 0 THEN '0.25' END AS builder_fee,
           CASE WHEN event_id % 7 = 0 THEN '0xb' END AS builder,
           ts + INTERVAL 1 SECOND AS local_time,
           event_id AS event_pos
    FROM events) e)"""

# Fills as they come out of the raw lines: block times are those of the first
# fill, times are cut to milliseconds, and the injected faults apply.
_INGEST_SQL = (
    _FILLS_SQL
    + """,
placed AS (
  SELECT f.* REPLACE (date_trunc('millisecond', time) AS time, first AS block_time,
                      first + INTERVAL 1 SECOND AS local_time, event_pos % 8 AS event_pos),
         event_pos AS event_id,
         'fills/' || strftime(first, '%Y%m%d/%H') || '.lz4' AS key,
         date_trunc('hour', first) AS hour_start,
         block_number + 1 AS line_no
  FROM (SELECT *, min(time) OVER (PARTITION BY block_number) AS first FROM fills) f),
faulty AS (
  SELECT *, block_number % 97 = 0 OR block_number % 89 = 1 OR block_number % 83 = 2
              OR block_number % 79 = 3 OR block_number % 73 = 5 OR block_number % 71 = 6 AS lost,
         CASE WHEN event_id % 107 = 4 THEN 'px_not_finite'
              WHEN event_id % 101 = 2 THEN 'px<=0'
              WHEN event_id % 103 = 3 THEN 'sz<=0'
              WHEN event_id % 109 = 5 THEN 'fee_not_finite'
              WHEN event_id % 113 = 6 THEN 'bad_time' END AS fault,
         CASE WHEN event_id % 107 = 4 THEN 0.0e0
              WHEN event_id % 103 = 3 THEN -1.5e0 ELSE sz END AS bad_sz
  FROM placed),
validated AS (
  SELECT key, hour_start, line_no, event_pos, fault AS reason, event_id, block_number,
         CASE WHEN fault = 'bad_time' THEN hour_start
              WHEN event_id % 113 = 6 THEN hour_start ELSE time END AS time,
         block_time, address, coin, type,
         CASE WHEN event_id % 107 = 4 THEN NULL WHEN event_id % 101 = 2 THEN 0.0e0
              ELSE px END AS px,
         bad_sz AS sz, is_buy, start_position,
         abs(start_position + CASE WHEN is_buy THEN bad_sz ELSE -bad_sz END)
           > abs(start_position) + 1e-12 AS is_gaining_inventory,
         closed_pnl, hash, oid, crossed,
         CASE WHEN event_id % 109 = 5 THEN NULL ELSE fee END AS fee,
         tid, fee_token, cloid, builder_fee, builder, local_time
  FROM faulty WHERE NOT lost
  UNION ALL BY NAME
  SELECT DISTINCT key, hour_start, line_no, 'parse_error' AS reason, hour_start AS time,
         'parse_error:' || strftime(hour_start, '%Y%m%d/%H') || ':' || cast(line_no AS VARCHAR)
           AS hash
  FROM faulty WHERE lost),
counts AS (
  SELECT key AS src_key, count(*) FILTER (WHERE reason IS NULL) AS rows_inserted,
         count(*) FILTER (WHERE reason IS NOT NULL) AS rows_quarantined,
         count(*) FILTER (WHERE reason = 'parse_error') AS parse_errors
  FROM validated GROUP BY key),
hours AS (
  SELECT 'fills/' || strftime(hour_start, '%Y%m%d/%H') || '.lz4' AS key, hour_start,
         CASE WHEN src_key IS NULL THEN 'missing' WHEN hour(hour_start) = 2 THEN 'failed_download'
              WHEN hour(hour_start) = 5 THEN 'failed_decompress'
              WHEN hour(hour_start) = 8 THEN 'failed_dedup'
              WHEN hour(hour_start) = 11 THEN 'failed_ingest' ELSE 'processed' END AS status,
         CASE WHEN status = 'processed' THEN rows_inserted ELSE 0 END AS rows_inserted,
         CASE WHEN status = 'processed' THEN rows_quarantined ELSE 0 END AS rows_quarantined,
         CASE WHEN status = 'processed' THEN parse_errors ELSE 0 END AS parse_errors
  FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31 23:00:00',
                                      INTERVAL 1 HOUR)) AS hour_start) h
  LEFT JOIN counts ON src_key = 'fills/' || strftime(hour_start, '%Y%m%d/%H') || '.lz4')"""
)

_COLUMNS = ", ".join(FILL_COLUMNS)
_EPOCH = "TIMESTAMP '1970-01-01'"
_RATIO = "CASE WHEN {t} = 0 THEN 0.0e0 ELSE cast({m} AS DOUBLE) / {t} END AS maker_taker_ratio"


def _range(start: datetime, end: datetime) -> str:
    return f"time >= TIMESTAMP '{start}' AND time < TIMESTAMP '{end}'"


def _vwap_sql(width: str, keys: str, where: str, source: str = "fills") -> str:
    return f"""
      SELECT {keys} time_bucket(INTERVAL '{width}', time, {_EPOCH}) AS time,
             CASE WHEN sum(sz) = 0 THEN 0.0e0 ELSE sum(px * sz) / sum(sz) END AS vwap,
             sum(sz) AS volume, sum(px * sz) AS notional, count(*) AS fill_count
      FROM {source} AS fills WHERE {where} GROUP BY ALL"""


_DENSE = """(
      SELECT * REPLACE (date_trunc('hour', time) AS time, event_pos * 7 % 11 AS block_number,
                        10000000 - event_pos AS event_pos) FROM fills)"""


def _bars_sql(width: str, keys: str, where: str, source: str = "fills") -> str:
    return f"""
      SELECT {keys} time_bucket(INTERVAL '{width}', fills.time, {_EPOCH}) AS time,
             arg_min(px, (fills.time, block_number, event_pos)) AS open,
             max(px) AS high, min(px) AS low,
             arg_max(px, (fills.time, block_number, event_pos)) AS close,
             sum(sz) AS base_volume, sum(px * sz) AS notional_volume, count(*) AS trade_count,
             sum(CASE WHEN is_buy THEN sz ELSE 0.0e0 END) AS buy_volume,
             sum(CASE WHEN is_buy THEN 0.0e0 ELSE sz END) AS sell_volume
      FROM {source} AS fills WHERE crossed AND {where}
      GROUP BY {keys} time_bucket(INTERVAL '{width}', fills.time, {_EPOCH})"""


def oracle_sql() -> dict[str, str]:
    per_coin = f"""
      SELECT address, coin, sum(sz) AS volume, sum(px * sz) AS notional_volume,
             count(*) AS fill_count, count(*) FILTER (WHERE NOT crossed) AS maker_count,
             count(*) FILTER (WHERE crossed) AS taker_count,
             {_RATIO.format(m="maker_count", t="taker_count")}
      FROM fills GROUP BY address, coin"""
    totals = f"""
      SELECT count(*) AS fill_count, count(DISTINCT coin) AS unique_coins,
             coalesce(sum(sz), 0.0e0) AS total_volume,
             coalesce(sum(px * sz), 0.0e0) AS total_notional,
             count(*) FILTER (WHERE NOT crossed) AS maker_count,
             count(*) FILTER (WHERE crossed) AS taker_count,
             {_RATIO.format(m="maker_count", t="taker_count")},
             min(time) AS first_fill_time, max(time) AS last_fill_time"""
    coin_columns = (
        "coin, volume, notional_volume, fill_count, maker_count, taker_count, maker_taker_ratio"
    )
    in_order = "ORDER BY time, block_number, event_pos"
    fills = {
        "get_fills_range": f"SELECT {_COLUMNS} FROM fills WHERE {_range(START, END)} {in_order}",
        "get_fills_coin": f"SELECT {_COLUMNS} FROM fills WHERE coin = 'BTC' {in_order}",
        "get_fills_wallet": f"SELECT {_COLUMNS} FROM fills WHERE address = '{WALLET}' {in_order}",
        "get_fills_side_crossed": f"""
          SELECT {_COLUMNS} FROM fills WHERE NOT is_buy AND crossed {in_order}""",
        "get_fills_ties": f"SELECT {_COLUMNS} FROM {_DENSE} {in_order}",
        "fill_by_hash": f"SELECT {_COLUMNS} FROM fills WHERE hash = '0xh100' {in_order}",
        "fills_by_oid": f"SELECT {_COLUMNS} FROM fills WHERE oid = 25 {in_order}",
        "vwap_dense_1s": _vwap_sql("1 second", "", "coin = 'ETH'", _DENSE) + " ORDER BY time",
        "time_bars_dense_1s": _bars_sql("1 second", "coin,", "true", _DENSE),
        "time_bars_dense_5s": _bars_sql("5 seconds", "coin,", "true", _DENSE),
        "vwap_all_coins_1s": _vwap_sql("1 second", "coin,", "true"),
        "vwap_all_coins_1h": _vwap_sql("1 hour", "coin,", "true"),
        "time_bars_all_coins_1s": _bars_sql("1 second", "coin,", "true"),
        "time_bars_all_coins_1h": _bars_sql("1 hour", "coin,", "true"),
        "wallet_per_coin": f"""
          SELECT {coin_columns} FROM ({per_coin}) WHERE address = '{WALLET}'
          ORDER BY fill_count DESC, coin""",
        "wallet_summary": f"{totals} FROM fills WHERE address = '{WALLET}'",
        "wallet_summary_empty": f"{totals} FROM fills WHERE address = 'nobody'",
        "wallet_summary_all": f"SELECT address, {totals.strip()[7:]} FROM fills GROUP BY address",
        "wallet_top_coins": f"""
          SELECT {coin_columns} FROM ({per_coin}) WHERE address = '{WALLET}'
          ORDER BY notional_volume DESC, coin LIMIT 3""",
        "list_coins": """
          SELECT coin, count(*) AS fill_count FROM fills GROUP BY coin
          ORDER BY fill_count DESC, coin""",
        "top_coin": """
          SELECT coin, count(*) AS fill_count FROM fills GROUP BY coin
          ORDER BY fill_count DESC, coin LIMIT 1""",
        "bars_totals": f"""
          SELECT count(*) AS bars, coalesce(sum(notional_volume), 0.0e0) AS total_notional
          FROM ({_bars_sql("5 minutes", "", "coin = 'ETH'")})""",
        "max_fill_time": "SELECT max(time) AS max_time FROM fills",
        "missing_hours": """
          SELECT hour_start
          FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-30',
                              TIMESTAMP '2024-02-02 23:00:00', INTERVAL 1 HOUR)) AS hour_start)
          WHERE hour_start NOT IN (SELECT date_trunc('hour', time) FROM fills)""",
        "sync_window": f"""
          SELECT greatest(coalesce(date_trunc('hour', max(time)) - INTERVAL 1 HOUR,
                          TIMESTAMP '{MIN_TIME}'), TIMESTAMP '{MIN_TIME}') AS start,
                 TIMESTAMP '2024-02-03 04:00:00' AS "end" FROM fills""",
        "partition_counts": """
          SELECT strftime(time, '%Y%m%d') AS date, count(*) AS row_count FROM fills
          GROUP BY 1 ORDER BY 1""",
        "purge_before": f"SELECT {_COLUMNS} FROM fills WHERE time >= TIMESTAMP '2024-01-15'",
        "purge_days": """
          SELECT DISTINCT strftime(time, '%Y%m%d') AS date FROM fills
          WHERE time < TIMESTAMP '2024-01-15'""",
        "replace_hour": f"""
          SELECT {_COLUMNS.replace("px", f"CASE WHEN {_range(HOUR_START, HOUR_END)}"
                                         " THEN px * 2 ELSE px END AS px", 1)} FROM fills""",
        "ingest_status": """
          SELECT 'succeeded' AS state, min(time) AS started_at, max(time) AS last_updated_at,
                 max(time) AS finished_at, cast(cast(max(time) AS DATE) AS VARCHAR) || '/23'
                   AS current_hour,
                 cast(24 AS BIGINT) AS hours_done, cast(24 AS BIGINT) AS hours_total,
                 count(*) AS rows_inserted, count(*) FILTER (WHERE crossed) AS rows_quarantined,
                 cast(0 AS BIGINT) AS files_missing, cast(0 AS BIGINT) AS files_failed
          FROM fills
          WHERE cast(time AS DATE) = (SELECT cast(max(time) AS DATE) FROM fills)""",
        "normalize_date": """
          SELECT event_pos, raw, CASE way
                   WHEN 3 THEN strftime(second - INTERVAL 330 MINUTE, '%Y%m%d')
                   WHEN 4 THEN strftime(second + INTERVAL 8 HOUR, '%Y%m%d')
                   WHEN 8 THEN trim(raw) ELSE strftime(second, '%Y%m%d') END AS date
          FROM (SELECT *, CASE way WHEN 0 THEN strftime(second, '%Y-%m-%d')
                   WHEN 1 THEN strftime(second, '%Y%m%d')
                   WHEN 2 THEN strftime(second, '%Y-%m-%dT%H:%M:%SZ')
                   WHEN 3 THEN strftime(second, '%Y-%m-%dT%H:%M:%S+05:30')
                   WHEN 4 THEN strftime(second, '%Y-%m-%dT%H:%M:%S-08:00')
                   WHEN 5 THEN strftime(second, '%Y-%m-%dT%H:%M:%S')
                   WHEN 6 THEN strftime(second, '%Y-%m-%dT%H:%M:%S.25')
                   WHEN 7 THEN strftime(second, '  %Y-%m-%d %H:%M:%S ')
                   ELSE strftime(second, 'day %Y-%m-%d ') END AS raw
                FROM (SELECT event_pos, event_pos % 9 AS way,
                             date_trunc('second', time) AS second FROM fills))""",
    }
    for width, name in _WIDTHS.items():
        inside = _range(START, END).replace("time", "fills.time")
        fills[f"vwap_{width}"] = (
            _vwap_sql(name, "", f"coin = 'ETH' AND {inside}") + " ORDER BY 1"
        )
        fills[f"time_bars_{width}"] = (
            _bars_sql(name, "", f"coin = 'BTC' AND {inside}") + " ORDER BY 1"
        )
    lineage = "key AS src_key, line_no, event_pos"
    ingest = {
        "parse_derive": f"""
          SELECT key, line_no, event_pos, false AS parse_error,
                 epoch_ms(time) AS time_ms, {_COLUMNS} FROM placed""",
        "unknown_keys": """
          SELECT 'envelope' AS kind, 'version' AS key, count(DISTINCT block_number) AS n
          FROM faulty WHERE NOT lost AND block_number % 13 = 0
          UNION ALL
          SELECT 'fill', 'newField', count(*)
          FROM faulty WHERE NOT lost AND block_number % 13 = 0""",
        "validate_split": """
          SELECT key, line_no, event_pos, reason IS NULL AS valid, reason FROM validated""",
        "valid_fills": f"SELECT {_COLUMNS}, {lineage} FROM validated WHERE reason IS NULL",
        "quarantine_rows": f"""
          SELECT {_COLUMNS}, reason, {lineage} FROM validated WHERE reason IS NOT NULL""",
        "ingest_counts": "SELECT * FROM counts",
        "quarantine_reasons": """
          SELECT reason, count(*) AS n FROM validated WHERE reason IS NOT NULL GROUP BY reason""",
        "hour_status": "SELECT * FROM hours",
        "run_report": """
          SELECT '20240101' AS "from", '20240131' AS "to", count(*) AS hours_total,
                 count(*) FILTER (WHERE status = 'processed') AS hours_processed,
                 count(*) FILTER (WHERE status <> 'processed') AS hours_skipped,
                 count(*) FILTER (WHERE status = 'missing') AS hours_missing,
                 count(*) FILTER (WHERE status LIKE 'failed%') AS failed_hours,
                 count(*) FILTER (WHERE status = 'failed_download') AS failed_download,
                 count(*) FILTER (WHERE status = 'failed_decompress') AS failed_decompress,
                 count(*) FILTER (WHERE status = 'failed_dedup') AS failed_dedup,
                 count(*) FILTER (WHERE status = 'failed_ingest') AS failed_ingest,
                 cast(sum(rows_inserted) AS BIGINT) AS rows_inserted,
                 cast(sum(rows_quarantined) AS BIGINT) AS rows_quarantined,
                 cast(sum(parse_errors) AS BIGINT) AS parse_errors
          FROM hours""",
        "db_stats": """
          SELECT count(*) FILTER (WHERE reason IS NULL) AS fills_count,
                 count(*) FILTER (WHERE reason IS NOT NULL) AS quarantine_count,
                 min(time) FILTER (WHERE reason IS NULL) AS min_time,
                 max(time) FILTER (WHERE reason IS NULL) AS max_time
          FROM validated""",
    }
    return {name: f"WITH {_FILLS_SQL} {sql}" for name, sql in fills.items()} | {
        name: f"WITH {_INGEST_SQL} {sql}" for name, sql in ingest.items()
    } | (llm.ORACLE_SQL if llm else {})
