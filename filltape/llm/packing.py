"""Length buckets with the least padding, and token-budget batches inside each bucket.

A histogram of all lengths of all documents decides where buckets end. Dynamic
programming finds the boundaries with the least total padding. The histogram has a row
for every different length on the driver; n different lengths need n * n / 2 words of
text at least, so ten thousand billion words have fewer than five million of them, and
far fewer where lengths repeat. The program takes buckets times lengths steps.

Batches need a running number of every document in its bucket. A bucket may hold a
third of all rows, so rows are numbered in slices, and the slices' counts give the
offsets.
"""

from __future__ import annotations

from collections import deque
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from filltape.llm.common import SPACE, SPACE_CHARS, stored

BUCKETS = 16
#: Tokens of a batch, padding included.
BUDGET = 32_768
#: Rows of a bucket that one task numbers, about.
SLICE_ROWS = 200_000


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def boundaries(lengths: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets with the least padding.

    ``lengths`` are ``(length, rows)`` in order of length. ``best[j]`` is the least padded
    size of the first ``j`` lengths with the buckets used so far; a further bucket that
    ends at length ``j`` and starts after ``i`` adds its rows times its longest. For a
    given ``i`` that is a line in the longest length, flatter for a greater ``i``, so the
    best ``i`` for rising lengths lies on the lower hull of the lines. All sums are exact.
    """
    if not lengths:
        return []
    tops = [length for length, _ in lengths]
    rows = list(accumulate((n for _, n in lengths), initial=0))
    count = len(lengths)
    best = [0, *(rows[j + 1] * tops[j] for j in range(count))]
    back: list[list[int]] = []
    for _ in range(min(buckets, count) - 1):
        new, start = best.copy(), [-1] * (count + 1)
        hull: deque[int] = deque([0])
        for j in range(1, count + 1):
            top = tops[j - 1]
            while len(hull) > 1 and _at(best, rows, hull[1], top) <= _at(best, rows, hull[0], top):
                hull.popleft()
            cost = _at(best, rows, hull[0], top) + rows[j] * top
            if cost < new[j]:
                new[j], start[j] = cost, hull[0]
            while len(hull) > 1 and _hidden(best, rows, hull[-2], hull[-1], j):
                hull.pop()
            hull.append(j)
        best = new
        back.append(start)
    ends, j = [], count
    for start in reversed(back):
        if start[j] == -1:
            continue
        ends.append(tops[j - 1])
        j = start[j]
    if j:
        ends.append(tops[j - 1])
    return sorted(ends)


def _at(best: list[int], rows: list[int], i: int, top: int) -> int:
    """The line of ``i`` at ``top``: what lies before, less the rows it covers."""
    return best[i] - rows[i] * top


def _hidden(best: list[int], rows: list[int], a: int, b: int, c: int) -> bool:
    """Whether the line of ``b`` is nowhere below both others; slopes fall from a to c."""
    return (best[c] - best[a]) * (rows[b] - rows[a]) <= (best[b] - best[a]) * (rows[c] - rows[a])


def histogram(lengths: DataFrame) -> list[tuple[int, int]]:
    """``(length, rows)`` of every length in order, from a column ``length``."""
    counts = lengths.groupBy("length").agg(F.count("*").alias("n"))
    return sorted((row["length"], row["n"]) for row in counts.collect())


def pack(
    docs: DataFrame,
    length: Column,
    id_col: str = "doc_id",
    buckets: int = BUCKETS,
    budget: int = BUDGET,
) -> DataFrame:
    """One row per document: ``doc_id, length, bucket, width, batch, place, padding``.

    ``width`` is the padded length of the bucket, ``batch`` numbers its batches from 0 and
    ``place`` the documents of a batch. A batch holds as many documents of the padded
    width as the budget allows, one at least; only the last batch of a bucket may be
    shorter. A document longer than the budget is a batch of its own.

    Defined results: a null length counts as 0, documents of length 0 have a bucket like
    any other; rows with equal ids get places of their own, null ids come first; an empty
    table gives no rows; other columns are ignored.
    """
    # Two numbers a row: no later step reads the texts again.
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.coalesce(length, F.lit(0)).cast("long").alias("length"),
        ),
        "lengths",
    )
    lengths = histogram(rows)
    ends = boundaries(lengths, buckets)
    in_bucket = [
        sum(n for length, n in lengths if low < length <= end)
        for low, end in zip([-1, *ends], ends, strict=False)
    ]
    slices = [max(1, -(-n // SLICE_ROWS)) for n in in_bucket]
    bucket, width, parts = F.lit(None), F.lit(None), F.lit(1)
    for number in reversed(range(len(ends))):
        inside = F.col("length") <= ends[number]
        bucket = F.when(inside, number).otherwise(bucket)
        width = F.when(inside, ends[number]).otherwise(width)
        parts = F.when(inside, slices[number]).otherwise(parts)
    placed = rows.select(
        "*",
        bucket.cast("int").alias("bucket"),
        width.cast("long").alias("width"),
        F.pmod(F.xxhash64("doc_id", "length"), parts).cast("int").alias("part"),
    )
    counts = placed.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("part")
    starts = counts.select(
        "bucket",
        "part",
        F.coalesce(
            F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("start"),
    )
    inside = Window.partitionBy("bucket", "part").orderBy("doc_id", "length")
    per_batch = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest("width", F.lit(1))))
    number = F.col("start") + F.row_number().over(inside) - 1
    return (
        placed.join(starts, ["bucket", "part"])
        .withColumn("number", number)
        .select(
            "doc_id",
            "length",
            "bucket",
            "width",
            F.floor(F.col("number") / per_batch).alias("batch"),
            (F.col("number") % per_batch).cast("int").alias("place"),
            (F.col("width") - F.col("length")).alias("padding"),
        )
    )
