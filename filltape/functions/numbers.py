"""Number helpers that behave the same with ANSI mode on or off."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern: the decimal texts accepted as a double. Spark's own cast also
# takes blanks, hex floats and the suffixes d and f, which are not valid here.
_DOUBLE_TEXT = r"(?i)^[+-]?(nan|inf|infinity|(\d+\.?\d*|\.\d+)(e[+-]?\d+)?)\z"


def double_sql(text: str) -> str:
    """SQL for a text as double, NULL when it is not a number; ``nan`` and ``inf`` are numbers."""
    return (
        f"CASE WHEN {text} RLIKE r'{_DOUBLE_TEXT}' THEN"
        f" CASE WHEN lower({text}) IN ('+nan', '-nan') THEN double('NaN')"
        f" ELSE try_cast({text} AS DOUBLE) END END"
    )


def finite_sql(value: str) -> str:
    """SQL for whether a number is neither NULL, NaN nor infinite."""
    return f"({value} IS NOT NULL AND NOT isnan({value}) AND abs({value}) < double('Infinity'))"


def safe_ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` as a double, 0.0 when ``bottom`` is zero."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(
        top.cast("double") / bottom.cast("double")
    )
