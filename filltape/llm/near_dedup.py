"""Near duplicates by MinHash with sequential Bayesian verification.

1. Every text becomes the set of its word shingles and a signature of ``HASHES`` minimum
   hashes. Equal sets are one class, whose least id stands for it.
2. Signatures are cut into bands; classes that share a band are candidates. The number of
   rows of a band is the largest for which a pair at the threshold is missed with a
   probability of at most ``MISS``.
3. Classes of one band value are compared batch by batch of their signatures. With a
   uniform prior, ``m`` agreements of ``n`` leave a posterior probability of
   ``P(Binomial(n + 1, t) <= m)`` for a similarity of ``t`` or more; a pair is dropped
   when it falls below ``PRUNE``. What is left is compared by the full sets, unless both are
   linked already by verified links.
4. Links become components.

No pair is emitted but verified links, and of those only a spanning forest per group.
A band value that many classes share is cut into blocks; each block also holds the least
class of the band value, so one round joins what is alike. Only classes that are then
still apart from that class's part meet all blocks of their band value, in blocks as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_intdigest

from filltape.llm.common import stored
from filltape.llm.components import components
from filltape.llm.shingles import mixed, shingle_set

WIDTH, HASHES, BATCH = 5, 256, 32
#: Chance of missing a pair at the threshold: by the bands, and by the posterior bound.
MISS, PRUNE = 1e-4, 1e-6
#: Classes of one band value that are compared by one task.
BLOCK = 512
_RNG = np.random.default_rng(5)
_SCALE = (_RNG.integers(0, 1 << 31, HASHES, np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFT = _RNG.integers(0, 1 << 32, HASHES, np.uint32)


def band_rows(percent: int) -> int:
    """Rows of a band for a threshold in percent."""
    share = percent / 100
    fitting = [r for r in range(1, 17) if (1 - share**r) ** (HASHES // r) <= MISS]
    return max(fitting, default=1)


def least_agreements(percent: int) -> list[int]:
    """For every batch, the fewest agreements so far that keep a pair."""
    share, found = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, 0
        while m <= n:
            below += comb(n + 1, m) * share**m * (1 - share) ** (n + 1 - m)
            if below >= PRUNE:
                break
            m += 1
        found.append(m)
    return found


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum hashes of a set, 16 bits each.

    Minima are mixed before they are cut: the upper bits of those of a long text are all 0.
    """
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(values), 1024):
        block = values[start : start + 1024, None] * _SCALE
        block += _SHIFT
        np.minimum(best, block.min(0), out=best)
    return (mixed(best.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


_SETS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text_hash", pa.int64()),
        ("n_shingles", pa.int64()),
        ("low", pa.int64()),
        ("high", pa.int64()),
        ("signature", pa.binary()),
    ]
)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            rows: list[list] = [[], [], [], []]
            for text in part["text"]:
                shingles = shingle_set(text.as_py(), WIDTH)
                digest = xxh3_128_intdigest(shingles.tobytes())
                rows[0].append(len(shingles))
                rows[1].append((digest & (1 << 64) - 1) - (1 << 63))
                rows[2].append((digest >> 64) - (1 << 63))
                rows[3].append(signature(shingles).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    part["doc_id"],
                    part["text_hash"],
                    *(pa.array(r, t) for r, t in zip(rows, _SETS.types[2:], strict=True)),
                ],
                schema=_SETS,
            )


def _bands(per_band: int):
    count = HASHES // per_band
    place = mixed(np.arange(1, count + 1, dtype=np.uint64))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                rows = np.frombuffer(b"".join(part["signature"].to_pylist()), np.uint16)
                rows = rows.reshape(-1, HASHES)[:, : count * per_band]
                rows = rows.reshape(-1, count, per_band).astype(np.uint64)
                key = np.repeat(place[None, :], len(rows), 0)
                for i in range(per_band):
                    key = mixed(key ^ rows[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
                ids = part["id"].to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64).ravel()), pa.array(np.repeat(ids, count))],
                    names=["band", "id"],
                )

    return keys


def similar(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold, in whole numbers."""
    if len(one) > len(other):
        one, other = other, one
    place = np.minimum(np.searchsorted(other, one), len(other) - 1)
    shared = int((other[place] == one).sum())
    return 100 * shared >= percent * (len(one) + len(other) - shared)


def _verify(percent: int):
    fewest = least_agreements(percent)
    links = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def verify(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        ids, sizes = group["id"].to_numpy(), group["n_shingles"].to_numpy()
        part, home = group["part"].to_numpy(), group["home"].to_numpy(zero_copy_only=False)
        signatures = np.frombuffer(
            b"".join(group["signature"].to_pylist()), np.uint16
        ).reshape(-1, HASHES)
        texts, sets = group["text"], {}
        # Known parts first: members of one part need no comparison.
        leader = {p: i for i, p in reversed(list(enumerate(part)))}
        parent = np.array([leader[p] for p in part])
        found: list[tuple[int, int]] = []

        def shingles(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_set(texts[i].as_py(), WIDTH)
            return sets[i]

        for i in range(1, len(ids)):
            small, large = np.minimum(sizes[:i], sizes[i]), np.maximum(sizes[:i], sizes[i])
            apart = (parent[:i] != parent[i]) & (home[:i] | home[i])
            alive = np.flatnonzero(apart & (100 * small >= percent * large))
            agreed = np.zeros(len(alive), int)
            for batch, least in enumerate(fewest):
                columns = slice(batch * BATCH, (batch + 1) * BATCH)
                agreed += (signatures[alive, columns] == signatures[i, columns]).sum(1)
                near = agreed >= least
                alive, agreed = alive[near], agreed[near]
                if not len(alive):
                    break
            for j in alive[np.argsort(-agreed, kind="stable")]:
                if parent[i] != parent[j] and similar(shingles(i), shingles(j), percent):
                    found.append((ids[i], ids[j]))
                    parent[parent == parent[i]] = parent[j]
        columns = [np.array(c, np.int64) for c in zip(*found, strict=True)] or [[], []]
        return pa.table(dict(zip(links.names, columns, strict=True)), schema=links)

    return verify


def in_pairs_of_blocks(parts: DataFrame) -> DataFrame:
    """``band, id, block, slot, part, home``: classes that are apart, with all of their band.

    ``parts`` has ``band, id, block, blocks, part, apart``. The classes of a band value that
    are apart are cut into slots of about ``BLOCK``; each slot meets each block in a group
    of its own, so no group has more than two blocks however many classes are apart.
    """
    slots = (
        parts.filter("apart")
        .groupBy("band")
        .agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("slots"))
    )
    own = F.pmod(F.xxhash64("id", F.lit(1)), F.col("slots")).cast("int")
    every_slot = F.sequence(F.lit(0), F.col("slots") - 1)
    every_block = F.sequence(F.lit(0), F.col("blocks") - 1)

    def at(block: Column, slot: Column) -> Column:
        return F.struct(block.alias("block"), slot.alias("slot"))

    home = F.transform(every_slot, lambda slot: at(F.col("block"), slot))
    away = F.transform(every_block, lambda block: at(block, own))
    places = F.when(F.col("apart"), F.array_union(home, away)).otherwise(home)
    return (
        parts.join(slots, "band")
        .withColumn("at", F.explode(places))
        .select(
            "band",
            "id",
            F.col("at.block").alias("block"),
            F.col("at.slot").alias("slot"),
            "part",
            (F.col("at.block") == F.col("block")).alias("home"),
        )
    )


def near_duplicates(
    docs: DataFrame, percent: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked if their shingle sets share at least ``percent`` of their union;
    ``component_id`` is the least id reachable over links, and that document is kept.

    Defined results: null texts and texts without words have an empty set, are linked with
    nothing and kept; a null id takes no part, has no component and is kept; rows with the
    same id and text are alike in every column; rows with the same id and different texts
    are judged one by one, except that they count as one where they are the least of their
    class; an empty table gives no rows; other columns are ignored.
    """
    found = judged_texts(docs, percent, id_col, text_col)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def judged_texts(
    docs: DataFrame, percent: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``near_duplicates`` with ``text_hash``, Spark's ``xxhash64`` of a row's text."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    sets = stored(
        rows.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
            _describe,
            "doc_id long, text_hash long, n_shingles long, low long, high long, signature binary",
        ),
        "sets",
    )
    taking = sets.filter("n_shingles > 0 and doc_id is not null")
    classes = taking.groupBy("low", "high", "n_shingles").agg(
        F.min(F.struct("doc_id", "signature")).alias("least")
    )
    named = stored(
        classes.select(
            F.col("least.doc_id").alias("id"),
            "low",
            "high",
            "n_shingles",
            F.col("least.signature").alias("signature"),
        ),
        "classes",
    )
    bands = named.select("id", "signature").mapInArrow(
        _bands(band_rows(percent)), "band long, id long"
    )
    groups = (
        bands.groupBy("band")
        .agg(
            F.count("*").alias("n"),
            F.min("id").alias("first"),
            F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("members"),
        )
        .filter("n > 1")
        # Bands with the same members are compared once.
        .groupBy("n", "first", "members")
        .agg(F.min("band").alias("band"))
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        .select("band", "first", "blocks")
    )
    members = stored(
        bands.join(groups, "band").withColumn(
            "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        ),
        "members",
    )
    asked = members.select("id").distinct()
    texts = rows.withColumnRenamed("doc_id", "id")
    payload = asked.join(named.drop("low", "high"), "id").join(texts, "id")
    verify = _verify(percent)

    def compared(placed: DataFrame) -> DataFrame:
        return (
            placed.join(payload, "id")
            .groupBy("band", "block", "slot")
            .applyInArrow(verify, "a long, b long")
        )

    # The first class of a band value stands in every block of it.
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    in_blocks = F.when(F.col("id") == F.col("first"), every).otherwise(F.array("block"))
    first = members.select(
        "band",
        "id",
        F.explode(in_blocks).alias("block"),
        F.lit(0).alias("slot"),
        F.col("id").alias("part"),
        F.lit(True).alias("home"),
    )
    links = stored(compared(first), "verified")
    found = components(links)
    wide = members.filter("blocks > 1")
    if not wide.isEmpty():
        part = F.coalesce("component", "id")
        parts = wide.join(found, "id", "left").withColumn("part", part).drop("component")
        main = parts.filter("id = first").select("band", F.col("part").alias("main"))
        apart = F.col("part") != F.col("main")
        parts = parts.join(main, "band").withColumn("apart", apart)
        second = in_pairs_of_blocks(parts)
        # The parts found so far are stars already, which need fewer rounds than their links.
        stars = found.select(F.col("id").alias("a"), F.col("component").alias("b"))
        found = components(stars.union(stored(compared(second), "verified")))
    ids = named.select("low", "high", "n_shingles", "id")
    judged = (
        taking.select("doc_id", "text_hash", "n_shingles", "low", "high")
        .join(ids, ["low", "high", "n_shingles"])
        .join(found, "id", "left")
        .select(
            "doc_id",
            "text_hash",
            "n_shingles",
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    others = sets.filter("n_shingles = 0 or doc_id is null").select(
        "doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id")
    )
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return judged.union(others).withColumn("kept", kept)
