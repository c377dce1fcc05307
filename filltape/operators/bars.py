"""Time buckets: VWAP and OHLCV bars.

Bars count taker fills only, VWAP counts both sides of every trade, so their
volumes differ for the same bucket. Empty buckets are not filled in. The time
filter runs before the bucketing, so the first label may lie before ``start``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filltape import params
from filltape.functions import bucket, safe_ratio
from filltape.operators.lookup import between, order_columns
from filltape.schema import TIME_BARS, VWAP


def _window(
    df: DataFrame, coin: str | None, start: datetime | None, end: datetime | None
) -> DataFrame:
    if start is not None or end is not None:
        df = between(df, start, end)
    return df if coin is None else df.filter(F.col("coin") == coin)


def _notional() -> Column:
    return F.sum(F.col("px") * F.col("sz"))


def vwap_by_coin(
    df: DataFrame,
    interval: str,
    start: datetime | None = None,
    end: datetime | None = None,
    coin: str | None = None,
) -> DataFrame:
    """VWAP per coin and bucket, unordered. Every task sends one row per coin and bucket."""
    sums = (
        _window(df, coin, start, end)
        .withColumn("bucket", bucket(F.col("time"), interval))
        .groupBy("coin", "bucket")
        .agg(
            F.sum("sz").alias("volume"),
            _notional().alias("notional"),
            F.count("*").alias("fill_count"),
        )
    )
    return sums.withColumn("vwap", safe_ratio(F.col("notional"), F.col("volume"))).select(
        "coin", *_labelled(VWAP.fieldNames())
    )


def vwap(df: DataFrame, coin: str, interval: str, start: datetime, end: datetime) -> DataFrame:
    """VWAP of one coin, in time order."""
    coin, (start, end) = params.text(coin, "coin"), params.time_range(start, end)
    rows = vwap_by_coin(df, interval, start, end, coin)
    return rows.drop("coin").orderBy("time")


def time_bars_by_coin(
    df: DataFrame,
    interval: str,
    start: datetime | None = None,
    end: datetime | None = None,
    coin: str | None = None,
) -> DataFrame:
    """OHLCV bars per coin and bucket, unordered.

    Open and close are the prices at the smallest and largest order key, which
    needs no sorted input and combines on the map side, so one busy coin does
    not end up in one task.
    """
    order = F.struct(*order_columns(df))
    buy = F.col("is_buy")
    bars = (
        _window(df, coin, start, end)
        .filter(F.col("crossed"))
        .withColumn("bucket", bucket(F.col("time"), interval))
        .groupBy("coin", "bucket")
        .agg(
            F.min_by("px", order).alias("open"),
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            F.max_by("px", order).alias("close"),
            F.sum("sz").alias("base_volume"),
            _notional().alias("notional_volume"),
            F.count("*").alias("trade_count"),
            F.sum(F.when(buy, F.col("sz")).otherwise(0.0)).alias("buy_volume"),
            F.sum(F.when(~buy, F.col("sz")).otherwise(0.0)).alias("sell_volume"),
        )
    )
    return bars.select("coin", *_labelled(TIME_BARS.fieldNames()))


def time_bars(
    df: DataFrame, coin: str, interval: str, start: datetime, end: datetime
) -> DataFrame:
    """OHLCV bars of one coin, in time order."""
    coin, (start, end) = params.text(coin, "coin"), params.time_range(start, end)
    rows = time_bars_by_coin(df, interval, start, end, coin)
    return rows.drop("coin").orderBy("time")


def bars_totals(bars: DataFrame) -> DataFrame:
    """Number of bars and their notional."""
    return bars.agg(
        F.count("*").alias("bars"),
        F.coalesce(F.sum("notional_volume"), F.lit(0.0)).alias("total_notional"),
    )


def _labelled(names: list[str]) -> list[Column]:
    return [F.col("bucket").alias("time") if name == "time" else F.col(name) for name in names]
