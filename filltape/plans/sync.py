"""Which hours an incremental load has to fetch."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filltape import params
from filltape.functions import floor_hour, instant
from filltape.operators.validate import FIRST_HOUR

# Fixed value: the last loaded hour may have been loaded while still growing.
OVERLAP = timedelta(hours=1)


def sync_window(
    newest: DataFrame, as_of: datetime | None = None, first_hour: datetime = FIRST_HOUR
) -> DataFrame:
    """The window ``start, end`` to load, from the one row ``max_time`` of a table.

    Starts an hour before the newest fill, or at ``first_hour`` for an empty table,
    and ends before the current hour. No row comes back when nothing is left to do.
    """
    now = (params.utc(as_of) if as_of else params.now()).replace(minute=0, second=0, microsecond=0)
    overlap = floor_hour(F.col("max_time")) - F.lit(OVERLAP)
    first = instant(first_hour)
    return newest.select(
        F.greatest(F.coalesce(overlap, first), first).alias("start"), instant(now).alias("end")
    ).filter(F.col("start") < F.col("end"))
