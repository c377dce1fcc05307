"""Byte-balanced shards by a minimax contiguous partition.

Rows with equal texts form an atomic group. Groups are laid out in the order of a
64-bit hash of their text and cut into contiguous shards. Their sizes are summed in
``CELLS`` equal ranges of the hash; the cells in which a cut would fall are looked at again
in ``PARTS`` ranges each. These sums are the only thing the driver sees, so what it holds
does not grow with the data, and no range splits a group. It finds the smallest capacity
for which a greedy pass needs no more shards than there are, and cuts there, as evenly
as that capacity allows.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

CELLS, PARTS = 1 << 16, 1 << 10
#: Rows of one cell that are numbered by one task.
SLICE_ROWS = 1_000_000
OVERHEAD = 16


def size_of(text: Column) -> Column:
    """UTF-8 bytes plus a fixed overhead per row; a null text has no bytes."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def cuts(sizes: list[int], shards: int) -> list[int]:
    """Shard of each size, in order: contiguous, with the smallest possible largest shard.

    Of all such partitions one whose shards are near equal: a shard ends where its sum is
    nearest to a fair share of what is left, as long as the capacity suffices for the rest
    and every shard behind can have a size of its own. Sizes above the fair share are left
    out of it, since they fill a shard whatever is done with the others.
    """
    count = len(sizes)
    if not count:
        return []
    sums = list(accumulate(sizes, initial=0))

    def ends(capacity: int) -> list[int]:
        """Where a shard that starts at each place ends at the latest."""
        return [bisect_right(sums, low + capacity) - 1 for low in sums[:-1]]

    def needed(capacity: int) -> int:
        number, start = 0, 0
        while start < count:
            start, number = bisect_right(sums, sums[start] + capacity) - 1, number + 1
        return number

    low, high = max(sizes), sums[-1]
    while low < high:
        middle = (low + high) // 2
        if needed(middle) <= shards:
            high = middle
        else:
            low = middle + 1

    # Sizes that stand alone in a fair partition, from the largest on.
    alone, rest, left = set(), sums[-1], shards
    for index in sorted(range(count), key=lambda i: (-sizes[i], i)):
        if left <= 1 or sizes[index] * left <= rest:
            break
        alone.add(index)
        rest, left = rest - sizes[index], left - 1
    others = list(accumulate((0 if i in alone else s for i, s in enumerate(sizes)), initial=0))
    large = list(accumulate((int(i in alone) for i in range(count)), initial=0))

    latest = ends(low)
    least = [0] * (count + 1)
    for start in reversed(range(count)):
        least[start] = 1 + least[latest[start]]
    placed, start = [], 0
    for shard in range(shards):
        if start == count:
            break
        behind = shards - shard - 1
        last = min(latest[start], max(count - behind, start + 1))
        # ``least`` never rises, so the first end that leaves few enough is found by halves.
        first = start + 1
        stop = last
        while first < stop:
            middle = (first + stop) // 2
            if least[middle] <= behind:
                stop = middle
            else:
                first = middle + 1
        free = max(1, behind + 1 - (large[count] - large[start]))
        wanted = sums[start] + (others[count] - others[start]) / free
        near = bisect_right(sums, wanted) - 1
        end = min((min(max(e, first), last) for e in (near, near + 1)), key=lambda e: abs(sums[e] - wanted))
        placed += [shard] * (end - start)
        start = end
    return placed


def _sums(rows: DataFrame) -> list[Row]:
    """Bytes and rows of every atom, in order."""
    sums = rows.groupBy("atom").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    return sorted(sums.collect(), key=lambda own: own["atom"])


def shard(
    docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, shard, slot``.

    Slots count the rows of a shard from 0 without gaps, in the order of hash range and
    id. Shards are ranges of the hash, and none is empty as long as there are ranges enough. Defined results: rows with equal texts share a shard, null texts among
    themselves too; a null or empty text has the size of the overhead and CRC 0; repeated
    rows get slots of their own, null ids sort first; an empty table gives no rows; other
    columns are ignored. A group of copies larger than a fair share makes its shard larger,
    and its rows are numbered in slices of about ``SLICE_ROWS`` by several tasks.
    """
    text = F.col(text_col)
    bits, more = (CELLS - 1).bit_length(), (PARTS - 1).bit_length()
    hash_ = F.xxhash64(text.isNull(), text)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        size_of(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        # The top bits of the hash, so that a cell is a range of it, and a part of the cell.
        F.shiftrightunsigned(hash_, 64 - bits - more).alias("atom"),
    )
    cell = F.shiftright("atom", more)
    whole = _sums(rows.withColumn("atom", F.shiftleft(cell, more)))
    placed = cuts([own["bytes"] for own in whole], shards)
    # On both sides of a cut: the exact one may fall into either cell.
    beside = [i for i in range(1, len(whole)) if placed[i] != placed[i - 1]]
    looked_at = sorted({whole[i]["atom"] >> more for cut in beside for i in (cut - 1, cut)})
    refined = cell.isin(looked_at) if looked_at else F.lit(False)
    rows = rows.withColumn(
        "atom", F.when(refined, F.col("atom")).otherwise(F.shiftleft(cell, more))
    )
    atoms = [own for own in whole if own["atom"] >> more not in set(looked_at)]
    atoms = sorted(atoms + _sums(rows.filter(refined)), key=lambda own: own["atom"])
    placed = cuts([own["bytes"] for own in atoms], shards)
    slices = {own["atom"]: -(-own["n"] // SLICE_ROWS) for own in atoms}
    schema = T.StructType.fromDDL("atom long, shard int, slices int")
    spark = docs.sparkSession
    plan = spark.createDataFrame(
        [(a["atom"], p, slices[a["atom"]]) for a, p in zip(atoms, placed, strict=True)], schema
    )
    # At most CELLS rows and PARTS for each side of a cut, of three numbers.
    sliced = rows.join(F.broadcast(plan), "atom").withColumn(
        "part", F.when(F.col("slices") == 1, 0).otherwise(
            F.pmod(F.xxhash64("doc_id"), F.col("slices")).cast("int")
        ),
    )
    counts = {(a["atom"], 0): a["n"] for a in atoms if slices[a["atom"]] == 1}
    if len(counts) < len(atoms):
        several = sliced.filter("slices > 1").groupBy("atom", "part").count().collect()
        counts |= {(a["atom"], a["part"]): a["count"] for a in several}
    shard_of = dict(zip((a["atom"] for a in atoms), placed, strict=True))
    offsets, filled = [], [0] * shards
    for atom, part in sorted(counts):
        offsets.append((atom, part, filled[shard_of[atom]]))
        filled[shard_of[atom]] += counts[atom, part]
    starts = spark.createDataFrame(offsets, T.StructType.fromDDL("atom long, part int, start long"))
    inside = Window.partitionBy("atom", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        sliced.join(F.broadcast(starts), ["atom", "part"])
        .withColumn("slot", F.col("start") + F.row_number().over(inside) - 1)
        .select("doc_id", "size", "text_crc32", "shard", "slot")
    )
