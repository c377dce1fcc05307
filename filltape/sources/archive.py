"""Hourly archives: LZ4 frames of newline-delimited JSON blocks."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filltape import params
from filltape.sources import files

LINES = "key string, status string, line_no bigint, line string"
_LINES_ARROW = pa.schema(
    [("key", pa.string()), ("status", pa.string()), ("line_no", pa.int64()), ("line", pa.string())]
)
_CHUNK_BYTES = 4 << 20

# The characters Unicode calls white space, and outcomes of an object.
_WHITE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_PROCESSED, _NO_FRAME, _NO_TEXT = "processed", "failed_decompress", "failed_ingest"
_BLANK = rf"\A[{_WHITE}]*\z"


class Object(NamedTuple):
    """One archive object: its key, full path and size."""

    key: str
    path: str
    length: int


def hour_of(key: str) -> str:
    """``YYYYMMDDHH`` of an object's key, which ends in ``<YYYYMMDD>/<HH>.lz4``."""
    return key[-15:-4].replace("/", "")


def existing_objects(
    spark: SparkSession, root: str, prefix: str, start: datetime, end: datetime
) -> list[Object]:
    """The objects present for the hours of ``[start, end)``. Lists names, reads no data."""
    base = prefix.strip("/")
    expected = set()
    hour = params.utc(start)
    while hour < params.utc(end):
        expected.add(hour.strftime("%Y%m%d/%H.lz4"))
        hour += timedelta(hours=1)
    if not expected:
        return []
    days = ",".join(sorted({name[:8] for name in expected}))
    folder = "/".join(part for part in (root.rstrip("/"), base) if part)
    objects = []
    for path, length in files.matching(spark, f"{folder}/{{{days}}}/*.lz4").items():
        name = "/".join(path.rsplit("/", 2)[1:])
        if name in expected:
            objects.append(Object(f"{base}/{name}" if base else name, path, length))
    return objects


def largest(spark: SparkSession) -> int:
    """Bytes that an object may have to be read: the reader hands out each as one value."""
    return int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))


def read_hours(spark: SparkSession, objects: list[Object]) -> DataFrame:
    """``key, content`` of the given objects, all through Spark's own file system.

    An object that is missing or cannot be read is left out, so the others go on; whoever
    asked for it sees that it has no outcome, and opens it to learn why.
    """
    if not objects:
        return spark.createDataFrame([], "key string, content binary")
    # All paths end in <prefix>/<YYYYMMDD>/<HH>.lz4, so the key is a fixed number of segments.
    depth = objects[0].key.count("/") + 1
    reader = (
        spark.read.format("binaryFile")
        .option("ignoreCorruptFiles", "true")
        .option("ignoreMissingFiles", "true")
    )
    try:
        found = reader.load([o.path for o in objects])
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        # Gone since they were listed.
        return read_hours(spark, [o for o in objects if files.matching(spark, o.path)])
    return found.select(F.substring_index("path", "/", -depth).alias("key"), "content")


def _line_groups(stream: pa.NativeFile) -> Iterator[pa.Array]:
    """Complete lines as bytes, one group per decoded chunk; a line may span any number of chunks."""
    pending: list[bytes] = []
    while chunk := stream.read(_CHUNK_BYTES):
        head, newline, tail = chunk.rpartition(b"\n")
        if not newline:
            pending.append(chunk)
            continue
        whole = b"".join([*pending, head]) if pending else head
        pending = [tail] if tail else []
        yield pc.split_pattern(pa.array([whole], pa.binary()), b"\n").flatten()
    if pending:
        yield pa.array([b"".join(pending)], pa.binary())


def _rows(key: str, status: str | None, numbers: pa.Array, lines: pa.Array) -> pa.RecordBatch:
    count = len(numbers)
    columns = [pa.repeat(pa.scalar(key, pa.string()), count)]
    columns.append(pa.repeat(pa.scalar(status, pa.string()), count))
    return pa.RecordBatch.from_arrays([*columns, numbers, lines], schema=_LINES_ARROW)


def _decoded(key: str, content: pa.Buffer) -> Iterator[pa.RecordBatch]:
    """The lines of one object, then its outcome."""
    status, seen = _PROCESSED if content.size else _NO_FRAME, 0
    try:
        with pa.CompressedInputStream(pa.BufferReader(content), "lz4") as stream:
            for group in _line_groups(stream) if content.size else ():
                if status != _PROCESSED:
                    # What is left is read only to see whether the frame is whole.
                    continue
                try:
                    lines = group.cast(pa.string())
                except pa.ArrowInvalid:
                    status = _NO_TEXT
                    continue
                numbers = np.arange(seen + 1, seen + 1 + len(lines))
                seen += len(lines)
                told = pc.invert(pc.match_substring_regex(lines, _BLANK))
                yield _rows(key, None, pa.array(numbers).filter(told), lines.filter(told))
    except (OSError, pa.ArrowException):
        status = _NO_FRAME
    yield _rows(key, status, pa.array([None], pa.int64()), pa.array([None], pa.string()))


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, content in zip(batch.column("key"), batch.column("content"), strict=True):
            yield from _decoded(key.as_py(), content.as_buffer())


def decode_lines(objects: DataFrame) -> DataFrame:
    """Lines ``key, status, line_no, line`` of a frame ``key, content``, each object read once.

    Lines are numbered from 1; blank ones count but are left out. After its lines every
    object yields one row without a line that holds its outcome. Lines of an object with
    any other outcome than ``processed`` are not to be used.
    """
    return objects.mapInArrow(_decode, LINES)
