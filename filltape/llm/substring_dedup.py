"""Removal of passages that an earlier document has, by looking up windows of words.

A word goes if a window of ``WINDOW`` words around it also starts in a document with a
smaller id. Neighbouring known windows are merged into the spans to remove. This stands in
for relative Lempel-Ziv parsing: a span is not a factor, as its windows may come from
several documents, but the words inside matches of ``WINDOW`` words or more are the same.

Blocks of ``ANCHOR`` words index the reference. From every window the block with the least
hash is chosen, so equal windows choose equal blocks, wherever they are; neighbouring
windows mostly choose the same, which leaves one block for about sixteen words. A block
that only one document has rules all its windows out. Only the windows of shared blocks
are looked up one by one.

Documents with equal words are one class; its least id is parsed, the others are copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_intdigest

from filltape.llm.common import stored
from filltape.llm.shingles import runs, word_hashes

WINDOW, ANCHOR = 50, 20
_ROWS = 256


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _digest(hashes: np.ndarray) -> tuple[int, int]:
    digest = xxh3_128_intdigest(hashes.tobytes())
    return (digest & (1 << 64) - 1) - (1 << 63), (digest >> 64) - (1 << 63)


def chosen_blocks(hashes: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> np.ndarray:
    """For every window, the least hash of the blocks inside it."""
    least, have, want = runs(hashes, anchor), 1, window - anchor + 1
    if len(least) < want:
        return np.empty(0, np.uint64)
    while have < want:
        step = min(have, want - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return least


_BLOCKS = "doc_id long, n_words long, low long, high long, blocks array<long>"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            part = batch.slice(start, _ROWS)
            counts, low, high, blocks = [], [], [], []
            for text in part["text"]:
                hashes = word_hashes(_words(text.as_py()))
                digest = _digest(hashes)
                counts.append(len(hashes))
                low.append(digest[0])
                high.append(digest[1])
                blocks.append(np.unique(chosen_blocks(hashes)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    part["doc_id"],
                    *(pa.array(c, pa.int64()) for c in (counts, low, high)),
                    pa.array(blocks, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_words", "low", "high", "blocks"],
            )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of shared blocks: hash, and place with the lower digest half above it."""
    rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def batch_of_rows() -> pa.RecordBatch:
        columns = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*rows, strict=True)]
        rows.clear()
        return pa.RecordBatch.from_arrays(columns, names=["hash", "doc_id", "at"])

    for batch in batches:
        for row in range(batch.num_rows):
            hashes = word_hashes(_words(batch["text"][row].as_py()))
            low = _digest(hashes)[0]
            if low != batch["low"][row].as_py():
                continue
            shared = batch["shared"][row].values.to_numpy().view(np.uint64)
            places = np.flatnonzero(np.isin(chosen_blocks(hashes), shared))
            values = runs(hashes, WINDOW)[places].view(np.int64)
            doc_id = np.full(len(places), batch["doc_id"][row].as_py(), np.int64)
            rows.append((values, doc_id, places | (low & 0x7FFFFFFF) << 32))
            if sum(len(r[0]) for r in rows) > 50_000:
                yield batch_of_rows()
    if rows:
        yield batch_of_rows()


def factors(starts: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """Spans ``(first word, words)`` from the sorted starts of known windows.

    Windows whose words touch or overlap are one span, whichever documents they come from.
    """
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > window) + 1
    return [
        (int(group[0]), int(group[-1] - group[0]) + window) for group in np.split(starts, cut)
    ]


_REWRITTEN = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField(
            "spans",
            T.ArrayType(
                T.StructType(
                    [T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]
                )
            ),
        ),
        T.StructField("kept_text", T.StringType()),
    ]
)


def _removed(words: list[bytes], copies: pa.Scalar, found: pa.Scalar) -> list[tuple[int, int]]:
    """Spans of a text to remove, from what is known about its id."""
    if not (copies.is_valid or found.is_valid):
        return []
    low = _digest(word_hashes(words))[0]
    if copies.is_valid and low in copies.as_py():
        return [(0, len(words))] if len(words) >= WINDOW else []
    if not found.is_valid:
        return []
    at = np.unique(found.values.to_numpy())
    return factors(at[at >> 32 == low & 0x7FFFFFFF] & 0xFFFFFFFF)


@F.arrow_udf(_REWRITTEN)
def _rewritten(texts: pa.Array, copies: pa.Array, found: pa.Array) -> pa.Array:
    rows = []
    for text, copied, windows in zip(texts, copies, found, strict=True):
        words = _words(text.as_py())
        spans = _removed(words, copied, windows)
        kept, last = [], 0
        for first, length in spans:
            kept += words[last:first]
            last = first + length
        kept += words[last:]
        rows.append(
            {
                "n_words": len(words),
                "spans": [{"start": first, "length": length} for first, length in spans],
                "kept_text": b" ".join(kept).decode("utf-8", "surrogatepass"),
            }
        )
    span = pa.struct([("start", pa.int64()), ("length", pa.int64())])
    fields = [("n_words", pa.int64()), ("spans", pa.list_(span)), ("kept_text", pa.string())]
    return pa.array(rows, pa.struct(fields))


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, n_words, spans, kept_text``, and its input as ``row``.

    ``spans`` are the removed runs of words (``start``, ``length``); ``kept_text`` is the
    other words joined by one space. A word goes if a window of ``WINDOW`` words around it
    also starts in a document with a smaller id; all windows are judged on the input.

    Defined results: null and empty texts have no words and stay empty; texts shorter than
    a window keep all words; a null id neither loses words nor makes others lose any; rows
    with equal ids never remove each other's words, whatever their texts, and repeated rows
    are alike; an empty table gives no rows; other columns only appear inside ``row``.
    """
    whole = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.struct(*(docs[name] for name in docs.columns)).alias("row"),
    )
    rows = whole.select("doc_id", "text")
    described = stored(rows.mapInArrow(_describe, _BLOCKS), "blocks")
    taking = described.filter(f"doc_id is not null and n_words >= {WINDOW}")
    least = taking.groupBy("low", "high").agg(F.min("doc_id").alias("least"))
    classed = stored(
        taking.select("doc_id", "low", "high").distinct().join(least, ["low", "high"]), "classes"
    )
    copies = (
        classed.filter("doc_id != least").groupBy("doc_id").agg(F.collect_set("low").alias("copies"))
    )
    parsed = classed.filter("doc_id = least").select("doc_id", "low")
    entries = (
        taking.select("doc_id", "low", "blocks")
        .join(parsed, ["doc_id", "low"], "left_semi")
        .select("doc_id", "low", F.explode("blocks").alias("block"))
    )
    shared = (
        entries.groupBy("block")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .filter("first < last")
        .select("block")
    )
    asked = (
        entries.join(shared, "block")
        .groupBy("doc_id", "low")
        .agg(F.collect_list("block").alias("shared"))
    )
    windows = stored(
        rows.join(asked, "doc_id").mapInArrow(_windows, "hash long, doc_id long, at long"),
        "windows",
    )
    first = (
        windows.groupBy("hash")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .filter("first < last")
        .select("hash", "first")
    )
    found = (
        windows.join(first, "hash")
        .filter("doc_id > first")
        .groupBy("doc_id")
        .agg(F.collect_list("at").alias("found"))
    )
    known = copies.join(found, "doc_id", "full")
    done = _rewritten("text", "copies", "found")
    return (
        whole.join(known, "doc_id", "left")
        .withColumn("done", done)
        .select("doc_id", "done.n_words", "done.spans", "done.kept_text", "row")
    )
