"""Coin activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coin_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("coin").agg(F.count("*").alias("fill_count"))


def list_coins(df: DataFrame) -> DataFrame:
    """Coins with their number of fills, most active first."""
    return coin_counts(df).orderBy(F.desc("fill_count"), "coin")


def top_coin(df: DataFrame) -> DataFrame:
    """The most active coin as one row. Reading an empty table is an error when it runs."""
    top = coin_counts(df).agg(
        F.max("fill_count").alias("fill_count"),
        F.min_by("coin", F.struct(-F.col("fill_count"), "coin")).alias("coin"),
    )
    empty = F.raise_error(F.lit("no coins available; load data first")).cast("string")
    return top.select(F.coalesce("coin", empty).alias("coin"), "fill_count")


def max_fill_time(df: DataFrame) -> DataFrame:
    """Time of the newest fill, NULL for an empty table."""
    return df.agg(F.max("time").alias("max_time"))
