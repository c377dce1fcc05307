"""Column expressions, as columns or, where a lambda needs it, as SQL text. None is a UDF."""

from filltape.functions.numbers import double_sql, finite_sql, safe_ratio
from filltape.functions.text import ascii_upper, normalize_date, trim_white
from filltape.functions.times import (
    bucket,
    day_label,
    epoch_ms_to_time,
    floor_hour,
    hour_key_parts,
    hour_label,
    instant,
    iso_to_time,
)

__all__ = [
    "ascii_upper",
    "bucket",
    "day_label",
    "double_sql",
    "epoch_ms_to_time",
    "finite_sql",
    "floor_hour",
    "hour_key_parts",
    "hour_label",
    "instant",
    "iso_to_time",
    "normalize_date",
    "safe_ratio",
    "trim_white",
]
