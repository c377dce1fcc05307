"""Hand-written raw block lines and helpers to store them as archive objects."""

from __future__ import annotations

import json
from pathlib import Path

import pyarrow as pa

BASE_FILL = {
    "coin": "BTC",
    "px": "2048.75",
    "sz": "0.5",
    "side": "B",
    "time": 1753605667625,
    "startPosition": "-1.5",
    "closedPnl": "-0.25",
    "hash": "0xaa",
    "oid": 4400123,
    "crossed": True,
    "fee": "-0.125",
    "tid": 77001234567,
    "feeToken": "USDC",
}


def fill(**changes) -> dict:
    """The base fill with some keys changed; ``None`` removes a key."""
    return {k: v for k, v in (BASE_FILL | changes).items() if v is not None}


def block(*fills: dict, **changes) -> str:
    envelope = {
        "local_time": "2025-07-27T08:41:08.125375250",
        "block_time": "2025-07-27T08:41:07.500250100",
        "block_number": 31415926,
        "events": [[f"0x{i}", f] for i, f in enumerate(fills, 1)],
    }
    return json.dumps(envelope | changes)


def lines(spark, *texts: str, key: str = "a/20250727/08.lz4"):
    rows = [(key, number, text) for number, text in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "key string, line_no bigint, line string")


def lz4(text: str | bytes) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, "lz4") as stream:
        stream.write(text if isinstance(text, bytes) else text.encode())
    return sink.getvalue().to_pybytes()


def store(root: Path, key: str, content: bytes) -> None:
    path = root / key
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)
