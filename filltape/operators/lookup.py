"""Filters, point lookups and their order."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filltape import params
from filltape.functions import instant
from filltape.schema import FILL_COLUMNS

# Fills of one instant keep the order of their blocks and of the events in a block.
_ORDER = ["time", "block_number", "event_pos", "tid"]


def order_columns(df: DataFrame) -> list[str]:
    return [name for name in _ORDER if name in df.columns]


def project(df: DataFrame, ordered: bool = True) -> DataFrame:
    """The 22 public columns, in time order unless ``ordered`` is off."""
    if ordered:
        df = df.orderBy(*order_columns(df))
    return df.select(*FILL_COLUMNS)


def between(df: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Rows of the half-open window ``[start, end)``.

    On a stored table the day partitions are pruned as well: a predicate on
    ``time`` alone would still list and open every day.
    """
    start, end = params.time_range(start, end)
    inside = (F.col("time") >= instant(start)) & (F.col("time") < instant(end))
    if "event_date" in df.columns:
        last = (end - timedelta(microseconds=1)).date()
        inside = inside & F.col("event_date").between(F.lit(start.date()), F.lit(last))
    return df.filter(inside)


def get_fills(
    df: DataFrame,
    start: datetime,
    end: datetime,
    coin: str | None = None,
    wallet: str | None = None,
    side: str | None = None,
    crossed_only: bool = False,
    ordered: bool = True,
) -> DataFrame:
    """Fills of a time window, with optional coin, wallet, side and taker filters."""
    wanted: list[Column] = []
    if (name := params.text(coin, "coin", may_be_absent=True)) is not None:
        wanted.append(F.col("coin") == name)
    if (name := params.text(wallet, "wallet", may_be_absent=True)) is not None:
        wanted.append(F.col("address") == name)
    if (buy := params.side_is_buy(side)) is not None:
        wanted.append(F.col("is_buy") == buy)
    if crossed_only:
        wanted.append(F.col("crossed"))
    rows = between(df, start, end)
    for condition in wanted:
        rows = rows.filter(condition)
    return project(rows, ordered)


def get_fill_by_hash(df: DataFrame, hash: str) -> DataFrame:
    """All fills of one transaction."""
    return project(df.filter(F.col("hash") == params.text(hash, "hash")))


def get_fills_by_oid(df: DataFrame, oid: int) -> DataFrame:
    """All fills of one order."""
    return project(df.filter(F.col("oid") == params.positive(oid, "oid")))


def fills_matching(df: DataFrame, keys: DataFrame, column: str, ordered: bool = True) -> DataFrame:
    """The lookups above for many hashes or order ids at once, given as a frame of keys.

    No broadcast is forced: Spark measures ``keys`` at run time and picks the join.
    """
    return project(df.join(keys.select(column), column, "left_semi"), ordered)
