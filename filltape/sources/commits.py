"""Commit records: which folders hold the rows of an hour, and what is in them.

Data files are written to a new folder each time and never changed. They count only once
a commit names them: for every hour it touches, a commit lists all partitions the hour
consists of from then on. One commit is one small Parquet file, so it appears whole or not
at all, and readers see every hour as it was before or as it is after.

A load replaces the content of an hour. A layout commit (``commit_id`` differs from
``load_id``) names other folders for the same load; it counts only as long as that load is
the newest, so layout work that runs beside a load can never bring old rows back.

The records hold rows, time span and rejection reasons of every partition, so statistics
of the tables need no data file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filltape import params
from filltape.schema import COMMITS

# The kind of a record that stands for its hour, and its good outcome.
HOURS = "hours"
PROCESSED = "processed"

Record = dict[str, Any]


def commits_path(root: str) -> str:
    return f"{root.rstrip('/')}/commits"


def new_id() -> str:
    return uuid.uuid4().hex


def entries(spark: SparkSession, root: str) -> DataFrame:
    """All records. Folding may leave a record twice for a moment; it is one here."""
    records = spark.read.schema(COMMITS).option("recursiveFileLookup", "true")
    return records.parquet(commits_path(root)).dropDuplicates(
        ["commit_id", "src_hour", "kind", "event_date"]
    )


def live(spark: SparkSession, root: str) -> DataFrame:
    """The records that count: of every hour those of its newest load's newest commit."""
    records = entries(spark, root)
    good = records.filter((F.col("kind") == HOURS) & (F.col("status") == PROCESSED))
    order = F.struct("loaded_at", "load_id", "committed_at", "commit_id")
    newest = good.groupBy("src_hour").agg(F.max_by("commit_id", order).alias("commit_id"))
    return records.join(newest, ["src_hour", "commit_id"], "left_semi")


def append(spark: SparkSession, root: str, records: Iterable[Record]) -> None:
    """Make records count, all at once. There are as many as partitions, not as rows."""
    names = COMMITS.fieldNames()
    rows = [tuple(record.get(name) for name in names) for record in records]
    if rows:
        frame = spark.createDataFrame(rows, COMMITS).coalesce(1)
        frame.write.parquet(f"{commits_path(root)}/{rows[0][0]}-{new_id()}")


def load_records(
    partitions: Iterable[Record], load_id: str, run_id: str, at: datetime | None = None
) -> list[Record]:
    """Records of a load from what it has written and the outcomes of its hours.

    ``partitions`` holds a record per partition and hour, see ``store.written``. The
    partitions of an hour that has no good outcome are left out.
    """
    at = at or params.now()
    partitions = list(partitions)
    good = {p["src_hour"] for p in partitions if p["kind"] == HOURS and p["status"] == PROCESSED}
    common = {"commit_id": load_id, "load_id": load_id, "run_id": run_id}
    common |= {"loaded_at": at, "committed_at": at}
    return [
        {"folder": load_id, "clustered": False} | p | common
        for p in partitions
        if p["kind"] == HOURS or p["src_hour"] in good
    ]


def layout_records(records: Iterable[Record]) -> list[Record]:
    """The same records as a new commit of the same loads."""
    ids = {"commit_id": new_id(), "committed_at": params.now()}
    return [record | ids for record in records]
