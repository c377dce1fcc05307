"""Token ids as files of entropy-coded blocks, written and read in parallel.

Texts become ids by the tokenizers library. One table of frequencies, counted over all
ids and scaled to ``2 ** SCALE``, is shared by the whole file set. Ids are coded by a
range asymmetric numeral system: a block deals its ids to lanes in turn, every lane is a
64-bit state, and lanes that overflow write 32-bit words to one common stream. A block
needs nothing but the table, so blocks are decoded wherever they lie.

A file set is a folder: ``table`` holds the frequencies; ``blocks`` holds segments, which
are whole documents in the order of their ids, with the documents' ids and lengths, the
coded blocks, and a checkpoint for every block: its place in the payload, its number of
ids and their CRC-32. Parts ascend: part 0 holds the smallest ids of documents. A reader
knows from the parts' totals, which are as few as the files, where in the whole stream any
document starts.

Both are Parquet files, so that a commit is Spark's and segments can be skipped.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from filltape.llm.common import stored

#: Tokenizer files larger than this are refused.
MAX_TOKENIZER_BYTES = 64 << 20
#: Frequencies add up to ``2 ** SCALE``; at most half as many different ids.
SCALE = 20
#: Ids of a block, lanes of a block, ids of a segment (documents are never split over two).
BLOCK_IDS, LANES, SEGMENT_IDS = 1 << 18, 1024, 1 << 18
_LOWEST = np.uint64(1 << 31)
_HEAD = struct.Struct("<III")
#: Pieces of text that a worker remembers, about, and their length; bytes coded together.
_CACHED, _CACHED_BYTES, _TOGETHER, _FEW = 1 << 20, 64, 1 << 24, 1 << 12
#: White space as the tokenizer's pattern sees it (the Unicode property).
_W = "\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# A run of white space goes with what follows it, so no match of a byte-level pattern
# spans two pieces, and no look-ahead sees across.
_PIECE = re.compile(f"[{_W}]*[^{_W}]+|[{_W}]+")
#: A space between white space, or after white space at the end of a text.
_ODD = f"[{_W}] (?:[{_W}]|$)"

SEGMENTS = (
    "part int, segment int, first long, doc_ids array<long>, lengths array<long>, "
    "checkpoints array<struct<offset: long, ids: int, crc32: long>>, "
    "table_crc32 long, payload binary"
)
_CHECKPOINT = pa.struct([("offset", pa.int64()), ("ids", pa.int32()), ("crc32", pa.int64())])
_SEGMENTS_ARROW = pa.schema(
    [
        ("part", pa.int32()),
        ("segment", pa.int32()),
        ("first", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("checkpoints", pa.list_(_CHECKPOINT)),
        ("table_crc32", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def load_tokenizer(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file's text on every executor."""
    if os.path.getsize(path) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"tokenizer file above {MAX_TOKENIZER_BYTES} bytes")
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


class _Encoder:
    """Ids of texts as little-endian numbers; pieces that come again are remembered."""

    def __init__(self, tokenizer: str, kind: str):
        # A task has one core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._tokenizer, self._kind = Tokenizer.from_str(tokenizer), kind
        self._tokenizer.encode_special_tokens = True
        self._known = pa.array([], pa.string())
        self._ids = pa.array([], pa.binary())

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of each text; nulls are not allowed."""
        odd = pc.match_substring_regex(texts, _ODD)
        groups = [self._joined(*_at_spaces(texts.filter(pc.invert(odd))))]
        groups.append(self._joined(*_at_words(texts.filter(odd))))
        order = np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return pa.concat_arrays(groups).take(pa.array(back))

    def _joined(self, pieces: pa.Array, bounds: np.ndarray) -> pa.Array:
        """The ids of texts whose pieces lie between ``bounds``."""
        coded = pieces.dictionary_encode()
        places = pc.index_in(coded.dictionary, value_set=self._known)
        new = coded.dictionary.filter(places.is_null())
        ids = self._encoded(new.to_pylist())
        places = places.fill_null(-1).to_numpy().copy()
        places[places < 0] = np.arange(len(self._known), len(self._known) + len(new))
        chosen = places[coded.indices.to_numpy()]
        values = pa.concat_arrays([self._ids, ids]).take(pa.array(chosen))
        # What comes first is what is common; a full memory just takes no more.
        if len(self._known) < _CACHED:
            short = pc.less_equal(pc.binary_length(new), _CACHED_BYTES)
            self._known = pa.concat_arrays([self._known, new.filter(short)])
            self._ids = pa.concat_arrays([self._ids, ids.filter(short)])
        return _binary(values, bounds)

    def _encoded(self, pieces: list[str]) -> pa.Array:
        ids: list[list[int]] = []
        # A few at a time: what the library returns is much larger than the ids.
        for start in range(0, len(pieces), _FEW):
            few = pieces[start : start + _FEW]
            found = self._tokenizer.encode_batch_fast(few, add_special_tokens=False)
            ids += [own.ids for own in found]
        ends = np.cumsum([0, *map(len, ids)])
        numbers = np.fromiter(chain.from_iterable(ids), self._kind, ends[-1])
        ends = (ends * numbers.itemsize).astype(np.int32)
        buffers = [None, pa.py_buffer(ends), pa.py_buffer(numbers)]
        return pa.BinaryArray.from_buffers(pa.binary(), len(ids), buffers)


def _binary(values: pa.Array, bounds: np.ndarray) -> pa.Array:
    """The values between each two bounds as one."""
    _, offsets, data = values.buffers()
    starts = np.zeros(len(bounds), np.int32)
    if len(values):
        starts = np.frombuffer(offsets, np.int32, len(values) + 1)[bounds]
    buffers = [None, pa.py_buffer(starts), data or pa.py_buffer(b"")]
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, buffers)


def _at_spaces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts cut in front of every space, and where each text's pieces start.

    No match of the pattern goes from something else on into white space, and before the
    last of several white space characters with something behind it a match ends. Texts
    with any other space (``_ODD``) must not come here.
    """
    lists = pc.split_pattern(texts, " ")
    pieces, bounds = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    first = np.zeros(len(pieces), bool)
    first[bounds[:-1]] = True
    spaced = pc.binary_join_element_wise(pa.scalar(""), pieces, pa.scalar(" "))
    return pc.if_else(pa.array(first), pieces, spaced), bounds


def _at_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The same for any text: a run of white space stays whole, with what follows it."""
    pieces = [_PIECE.findall(text) for text in texts.to_pylist()]
    bounds = np.concatenate([[0], np.cumsum([len(own) for own in pieces])]).astype(np.int64)
    return pa.array([piece for own in pieces for piece in own], pa.string()), bounds


@lru_cache(maxsize=1)
def _encoder(tokenizer: str, kind: str) -> _Encoder:
    """One encoder for all tasks of a worker, so that they share what it remembers."""
    return _Encoder(tokenizer, kind)


def encode(text: Column, tokenizer: Broadcast, end: int, kind: str = "<u4") -> Column:
    """Ids of a text and the end id, as little-endian numbers; null is an empty text."""

    @F.arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, last = _encoder(tokenizer.value, kind), np.array(end, kind).tobytes()
        for batch in batches:
            texts = pc.fill_null(batch, "")
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            cuts = np.searchsorted(sizes, np.arange(0, sizes[-1] if len(sizes) else 0, _TOGETHER))
            cuts = [*np.unique(np.concatenate([[0], cuts])), len(texts)]
            groups = [
                encoder.encode(texts.slice(low, high - low))
                for low, high in pairwise(cuts)
                if high > low
            ]
            coded = pa.concat_arrays(groups) if groups else pa.array([], pa.binary())
            yield pc.binary_join_element_wise(coded, pa.scalar(last), pa.scalar(b""))

    return ids(text)


def scaled(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and their frequencies, none 0, that add up to ``2 ** SCALE``.

    What rounding leaves over goes to the commonest ids, one each.
    """
    total, room = sum(counts.values()), (1 << SCALE) - len(counts)
    if room < 1 << (SCALE - 1):
        raise ValueError(f"more than {1 << (SCALE - 1)} different ids")
    ids = sorted(counts)
    share = [1 + counts[i] * room // total for i in ids]
    common = sorted(range(len(ids)), key=lambda i: (-counts[ids[i]], ids[i]))
    for i in common[: (1 << SCALE) - sum(share)]:
        share[i] += 1
    return np.array(ids, np.uint32), np.array(share, np.uint64)


class Table:
    """A shared table of frequencies, ready for coding."""

    def __init__(self, ids: np.ndarray, share: np.ndarray):
        self.ids, self.share = ids, share
        self.below = np.concatenate([[0], np.cumsum(share)[:-1]]).astype(np.uint64)
        self.crc32 = zlib.crc32(share.tobytes(), zlib.crc32(ids.tobytes()))
        self._place = np.zeros(int(ids[-1]) + 1 if len(ids) else 1, np.uint32)
        self._place[ids] = np.arange(len(ids), dtype=np.uint32)
        self._slots: np.ndarray | None = None

    def encode_block(self, ids: np.ndarray) -> bytes:
        """One block: number of ids, lanes and words, then the states, then the words."""
        lanes = min(LANES, 1 << max(0, (len(ids) // 64).bit_length() - 1))
        places = self._place[ids]
        share, below = self.share[places], self.below[places]
        states = np.full(lanes, _LOWEST, np.uint64)
        words: list[np.ndarray] = []
        shift, low = np.uint64(SCALE), np.uint64(32)
        room = np.uint64(63 - SCALE)
        for start in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
            f = share[start : start + lanes]
            x = states[: len(f)]
            full = x >= f << room
            words.append(x[full].astype(np.uint32))
            x = np.where(full, x >> low, x)
            q = x // f
            states[: len(f)] = (q << shift) + (x - q * f) + below[start : start + lanes]
        stream = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
        head = _HEAD.pack(len(ids), lanes, len(stream))
        return head + states.astype("<u8").tobytes() + stream.astype("<u4").tobytes()

    def decode_block(self, block: memoryview) -> np.ndarray:
        """The ids of a block that starts where ``block`` does."""
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.ids), dtype=np.uint32), self.share.astype(int))
        count, lanes, length = _HEAD.unpack_from(block)
        states = np.frombuffer(block, "<u8", lanes, _HEAD.size).copy()
        words = np.frombuffer(block, "<u4", length, _HEAD.size + 8 * lanes).astype(np.uint64)
        places = np.empty(count, np.uint32)
        mask, shift, low = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
        at = 0
        for start in range(0, count, lanes):
            x = states[: min(lanes, count - start)]
            slot = x & mask
            own = self._slots[slot]
            places[start : start + lanes] = own
            x = self.share[own] * (x >> shift) + slot - self.below[own]
            short = np.flatnonzero(x < _LOWEST)
            x[short] = (x[short] << low) | words[at : at + len(short)]
            at += len(short)
            states[: len(x)] = x
        if at != length or (states != _LOWEST).any():
            raise ValueError("a coded block does not end where it should")
        return self.ids[places]


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of little-endian numbers, and where each row starts."""
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32, len(column) + 1, 4 * column.offset)
    bounds = bounds // np.dtype(kind).itemsize
    held = int(bounds[-1])
    return np.frombuffer(data, kind, held) if held else np.empty(0, kind), bounds


def _count(kind: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers, bounds = _flat(batch.column(0), kind)
            own = np.bincount(numbers[bounds[0] :], minlength=len(counts))
            own[: len(counts)] += counts
            counts = own
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found, pa.int64()), pa.array(counts[found], pa.int64())], names=["id", "n"]
        )

    return count


def _segments(table: Broadcast, kind: str):
    """Rows ``part, doc_id, ids`` of one part, in order, to its segments."""

    def segment(part: int, number: int, first: int, docs: list, parts: list, coder: Table):
        ids = np.concatenate(parts)
        payload, checkpoints = bytearray(), []
        blocks = max(1, round(len(ids) / BLOCK_IDS))
        for block in np.array_split(ids, blocks):
            checkpoints.append(
                {"offset": len(payload), "ids": len(block), "crc32": zlib.crc32(block)}
            )
            payload += coder.encode_block(block)
        row = [part, number, first, docs, [len(p) for p in parts], checkpoints, coder.crc32]
        arrays = [
            pa.array([value], field.type)
            for value, field in zip([*row, bytes(payload)], _SEGMENTS_ARROW, strict=True)
        ]
        return pa.RecordBatch.from_arrays(arrays, schema=_SEGMENTS_ARROW)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Table(*table.value)
        part = number = first = held = 0
        docs: list[int | None] = []
        parts: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers, bounds = _flat(batch.column("ids"), kind)
            own = batch.column("doc_id").to_pylist()
            part = batch.column("part")[0].as_py()
            for row, doc_id in enumerate(own):
                ids = numbers[bounds[row] : bounds[row + 1]]
                docs.append(doc_id)
                parts.append(ids.astype("<u4"))
                held += len(ids)
                if held >= SEGMENT_IDS:
                    yield segment(part, number, first, docs, parts, coder)
                    number, first, held, docs, parts = number + 1, first + held, 0, [], []
        if docs:
            yield segment(part, number, first, docs, parts, coder)

    return segments


def write(
    docs: DataFrame,
    path: str,
    tokenizer: Broadcast,
    end: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Write the ids of all texts, each followed by the id ``end``, as a file set.

    Defined results: a null or empty text is the end id alone; texts go in the order of
    their ids with null first, rows with equal ids in the order of their token ids, so
    repeated rows are kept and equal; a text of any length is one document in one segment
    of many blocks; an empty table gives a file set without segments; other columns are
    ignored, whatever they are called.
    """
    spark = docs.sparkSession
    # Half the bytes to store and sort, where the tokenizer's ids allow it.
    ids = Tokenizer.from_str(tokenizer.value).get_vocab(with_added_tokens=True).values()
    kind = "<u2" if max(end, *ids) < 1 << 16 else "<u4"
    coded = stored(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            encode(F.col(text_col), tokenizer, end, kind).alias("ids"),
        ),
        "ids",
    )
    counts = coded.select("ids").mapInArrow(_count(kind), "id long, n long")
    counts = counts.groupBy("id").agg(F.sum("n").alias("n"))
    # At most as many rows as the tokenizer has ids.
    found = {row["id"]: row["n"] for row in counts.collect()}
    ids, share = scaled(found) if found else (np.empty(0, np.uint32), np.empty(0, np.uint64))
    rows = [(int(i), int(f)) for i, f in zip(ids, share, strict=True)]
    spark.createDataFrame(rows, "id long, frequency long").coalesce(1).write.parquet(f"{path}/table")
    keys = ["doc_id", "crc32", "n"]
    ordered = (
        coded.withColumns(
            {
                "crc32": F.crc32("ids"),
                "n": F.octet_length("ids"),
                "salt": F.monotonically_increasing_id(),
            }
        )
        .repartitionByRange(*keys, "salt")
        .sortWithinPartitions(*keys, "ids")
        .select(F.spark_partition_id().alias("part"), "doc_id", "ids")
    )
    table = spark.sparkContext.broadcast((ids, share))
    ordered.mapInArrow(_segments(table, kind), SEGMENTS).write.parquet(f"{path}/blocks")


def _documents(table: Broadcast):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Table(*table.value)
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(name)[row].as_py()  # noqa: B023, E731
                if get("table_crc32") != coder.crc32:
                    raise ValueError("blocks and table of frequencies do not belong together")
                payload = memoryview(batch.column("payload")[row].as_buffer())
                blocks = []
                for checkpoint in get("checkpoints"):
                    ids = coder.decode_block(payload[checkpoint["offset"] :])
                    if len(ids) != checkpoint["ids"] or zlib.crc32(ids) != checkpoint["crc32"]:
                        raise ValueError("a block does not match its checksum")
                    blocks.append(ids)
                ids = np.concatenate(blocks)
                lengths = np.array(get("lengths"), np.int64)
                ends = np.concatenate([[0], np.cumsum(lengths)])
                own = pa.BinaryArray.from_buffers(
                    pa.binary(),
                    len(lengths),
                    [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(ids)],
                )
                starts = get("start") + ends[:-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(get("doc_ids"), pa.int64()), pa.array(starts), own], schema=schema
                )

    return documents


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids`` of all documents of a file set.

    ``start`` counts the ids of all documents before, ``ids`` holds the document's own as
    little-endian 32-bit numbers, the end id included. A block that fails its checksum, or
    does not belong to the table, is an error.
    """
    rows = spark.read.schema("id long, frequency long").parquet(f"{path}/table").collect()
    rows.sort(key=lambda row: row["id"])
    table = spark.sparkContext.broadcast(
        (
            np.array([row["id"] for row in rows], np.uint32),
            np.array([row["frequency"] for row in rows], np.uint64),
        )
    )
    blocks = spark.read.schema(SEGMENTS).parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(
        F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda n, own: n + own)).alias("n")
    )
    starts, before = [], 0
    # One row per file.
    for row in sorted(totals.collect(), key=lambda row: row["part"]):
        starts.append((row["part"], before))
        before += row["n"]
    starts = spark.createDataFrame(starts, "part int, before long")
    return (
        blocks.join(F.broadcast(starts), "part")
        .withColumn("start", F.col("before") + F.col("first"))
        .mapInArrow(_documents(table), "doc_id long, start long, ids binary")
    )
