"""Byte-level BPE with a rank file, by the tiktoken library, and decoding to raw bytes.

Long texts are cut before they reach the splitting pattern, so that its memory and its
look-ahead stay small. A cut is safe where no match of the pattern can span it and no
look-ahead can see across it, namely

* before white space that follows something else: a match never goes on from a letter,
  digit or mark into white space, and
* before the last character of a run of white space that something else follows: there
  the pattern ends its own match.

The ranks are read once by the driver and sent to the executors: the file has a fixed
size, which is checked.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Rank files larger than this are refused.
MAX_RANK_BYTES = 64 << 20
#: Texts above this many characters are cut.
CHUNK_CHARS = 1 << 16
#: White space as the pattern's engine sees it (the Unicode property).
_W = "\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SAFE = re.compile(f"(?<=[^{_W}])(?=[{_W}])|(?<=[{_W}])(?=[{_W}][^{_W}])")
_LONG_RUN = re.compile(f"[{_W}]{{4096,}}")


def _cut(text: str, size: int) -> Iterator[tuple[str, bool]]:
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()], False
        start = cut.start()
    if start < len(text):
        yield text[start:], False


def pieces(text: str, size: int = CHUNK_CHARS) -> Iterator[tuple[str, bool]]:
    """The text in order, cut at the first safe place after every ``size`` characters.

    A very long run of white space comes alone and is marked: it is one match of the
    pattern, whose look-ahead cannot digest it.
    """
    start = 0
    for run in _LONG_RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        yield from _cut(text[start : run.start()], size)
        yield text[run.start() : end], True
        start = end
    yield from _cut(text[start:], size)


def load_ranks(spark: SparkSession, path: str) -> Broadcast:
    """The rank file's bytes on every executor."""
    if os.path.getsize(path) > MAX_RANK_BYTES:
        raise ValueError(f"rank file above {MAX_RANK_BYTES} bytes")
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {
        base64.b64decode(token): int(rank)
        for token, rank in (line.split() for line in ranks.splitlines() if line.strip())
    }
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def encode_text(encoding: tiktoken.Encoding, text: str) -> list[int]:
    if len(text) <= CHUNK_CHARS:
        return encoding.encode_ordinary(text)
    ids: list[int] = []
    for piece, is_match in pieces(text):
        ids += encoding._encode_single_piece(piece) if is_match else encoding.encode_ordinary(piece)
    return ids


def encode(text: Column, ranks: Broadcast, pattern: str) -> Column:
    """Token ids of a text, without special tokens; a null or empty text has none."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding = _encoding(ranks.value, pattern)
        for batch in batches:
            values = pa.array([], pa.int32())
            parts, ends = [], [0]
            for text_ in batch:
                found = encode_text(encoding, text_.as_py() or "")
                parts.append(np.array(found, np.int32))
                ends.append(ends[-1] + len(found))
            if parts:
                values = pa.array(np.concatenate(parts))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    return ids(text)


def decode(ids: Column, ranks: Broadcast, pattern: str) -> Column:
    """The bytes that ids stand for; they need not be valid UTF-8. Null ids give no bytes."""

    @F.arrow_udf("binary")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding = _encoding(ranks.value, pattern)
        for batch in batches:
            yield pa.array(
                [encoding.decode_bytes(row.as_py() or []) for row in batch], pa.binary()
            )

    return text(ids)
