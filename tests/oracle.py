"""Run every query and its SQL side by side: ``python tests/oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


#: Queries whose operator promises an order; their SQL ends with the same one.
ORDERED = {
    "get_fills_range",
    "get_fills_coin",
    "get_fills_wallet",
    "get_fills_side_crossed",
    "get_fills_ties",
    "fill_by_hash",
    "fills_by_oid",
    "wallet_per_coin",
    "wallet_top_coins",
    "list_coins",
    "partition_counts",
    "vwap_dense_1s",
    *[f"{bars}_{width}" for bars in ("vwap", "time_bars") for width in contract._WIDTHS],
}


def normal(frame: pd.DataFrame, ordered: bool) -> list[tuple]:
    """Rows in a comparable form, in their own order or in none."""
    rows = []
    for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False):
        rows.append(
            tuple(
                None if pd.isna(v) else str(pd.Timestamp(v)) if hasattr(v, "year") else v
                for v in row
            )
        )
    return rows if ordered else sorted(rows, key=lambda row: tuple(str(v) for v in row))


TYPES = {
    "BIGINT": "bigint",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz",
}


def compare(spark, con, sf_dir: str, name: str) -> int:
    """Number of rows both engines agree on; fails on any difference."""
    frame, relation = contract.queries()[name](spark, sf_dir), con.sql(contract.oracle_sql()[name])
    mine, theirs = dict(frame.dtypes), dict(zip(relation.columns, relation.types, strict=True))
    assert mine == {column: TYPES[str(kind)] for column, kind in theirs.items()}, name
    spark_rows, duck_rows = frame.toPandas(), relation.df()
    left, right = normal(spark_rows, name in ORDERED), normal(duck_rows, name in ORDERED)
    assert len(left) == len(right), f"{name}: {len(left)} rows, expected {len(right)}"
    for mine, theirs in zip(left, right, strict=True):
        assert mine == theirs, f"{name}: {mine} expected {theirs}"
    return len(left)


if __name__ == "__main__":
    from tests.conftest import session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = session(), connect(sf_dir)
    for name in sys.argv[2:] or contract.queries():
        began = time.time()
        try:
            print(f"{name}: {compare(spark, con, sf_dir, name)} rows", end="")
        except Exception as error:  # noqa: BLE001
            print(f"{name}: FAILED {str(error)[:600]}", end="")
        print(f" ({time.time() - began:.1f} s)", flush=True)
