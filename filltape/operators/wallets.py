"""Wallet summaries.

The per-coin aggregate also carries the first and last fill time, so the totals
are a second aggregate over a few rows per wallet and need no second scan.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filltape import params
from filltape.functions import safe_ratio
from filltape.operators.lookup import between
from filltape.schema import WALLET_PER_COIN, WALLET_SUMMARY


def _of_wallet(df: DataFrame, wallet: str, start: datetime, end: datetime) -> DataFrame:
    wallet = params.text(wallet, "wallet")
    return between(df, start, end).filter(F.col("address") == wallet)


def wallet_coins(df: DataFrame) -> DataFrame:
    """Activity per wallet and coin, unordered."""
    return (
        df.groupBy("address", "coin")
        .agg(
            F.sum("sz").alias("volume"),
            F.sum(F.col("px") * F.col("sz")).alias("notional_volume"),
            F.count("*").alias("fill_count"),
            F.count_if(~F.col("crossed")).alias("maker_count"),
            F.count_if(F.col("crossed")).alias("taker_count"),
            F.min("time").alias("first_fill_time"),
            F.max("time").alias("last_fill_time"),
        )
        .withColumn("maker_taker_ratio", safe_ratio(F.col("maker_count"), F.col("taker_count")))
    )


def _totals(coins: DataFrame, *keys: str) -> DataFrame:
    def total(name: str, zero: int | float):
        return F.coalesce(F.sum(name), F.lit(zero))

    totals = coins.groupBy(*keys).agg(
        total("fill_count", 0).alias("fill_count"),
        F.count("*").alias("unique_coins"),
        total("volume", 0.0).alias("total_volume"),
        total("notional_volume", 0.0).alias("total_notional"),
        total("maker_count", 0).alias("maker_count"),
        total("taker_count", 0).alias("taker_count"),
        F.min("first_fill_time").alias("first_fill_time"),
        F.max("last_fill_time").alias("last_fill_time"),
    )
    ratio = safe_ratio(F.col("maker_count"), F.col("taker_count"))
    return totals.withColumn("maker_taker_ratio", ratio).select(*keys, *WALLET_SUMMARY.fieldNames())


def wallet_per_coin(df: DataFrame, wallet: str, start: datetime, end: datetime) -> DataFrame:
    """One wallet's coins, most fills first."""
    coins = wallet_coins(_of_wallet(df, wallet, start, end))
    return coins.select(*WALLET_PER_COIN.fieldNames()).orderBy(F.desc("fill_count"), "coin")


def wallet_totals(df: DataFrame, wallet: str, start: datetime, end: datetime) -> DataFrame:
    """One wallet's totals: always one row, all zero and without times when it has no fills."""
    return _totals(wallet_coins(_of_wallet(df, wallet, start, end)))


def wallet_summary(
    df: DataFrame, wallet: str, start: datetime, end: datetime
) -> dict[str, DataFrame]:
    """Totals and per-coin breakdown of one wallet."""
    return {
        "summary": wallet_totals(df, wallet, start, end),
        "per_coin": wallet_per_coin(df, wallet, start, end),
    }


def wallet_totals_all(df: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """The totals of every wallet that has fills in the window."""
    return _totals(wallet_coins(between(df, start, end)), "address")


def wallet_top_coins(
    df: DataFrame, wallet: str, start: datetime, end: datetime, n: int = 20
) -> DataFrame:
    """A wallet's coins with the largest notional."""
    coins = wallet_coins(_of_wallet(df, wallet, start, end)).select(*WALLET_PER_COIN.fieldNames())
    return coins.orderBy(F.desc("notional_volume"), "coin").limit(n)
