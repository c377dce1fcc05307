"""Retention and layout of the stored tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filltape import params
from filltape.schema import PARTITION_COLUMNS
from filltape.sources import commits, files, store

#: Rows of a file, about, when days are laid out anew.
TARGET_ROWS = 1 << 20


def _records(spark: SparkSession, root: str) -> list[commits.Record]:
    return [row.asDict() for row in commits.live(spark, root).collect()]


def purge_before(spark: SparkSession, root: str, before_day: str) -> int:
    """Drop all days strictly before ``before_day`` from fills and quarantine; the number dropped.

    A day that is gone already is fine. The days are out of the tables with one commit;
    their files are deleted afterwards, and what a crash leaves there is left to ``vacuum``.
    """
    before = params.day(before_day, "before_date")
    records = _records(spark, root)

    def due(record: commits.Record) -> bool:
        return record["kind"] != store.HOURS and record["event_date"] < before

    old = [record for record in records if due(record)]
    if not old:
        return 0
    hours = {record["src_hour"] for record in old}
    kept = [record for record in records if record["src_hour"] in hours and not due(record)]
    commits.append(spark, root, commits.layout_records(kept))
    for record in old:
        files.delete(spark, store.partition_path(root, record))
    return len({(record["kind"], record["event_date"]) for record in old})


def purge_expired(
    spark: SparkSession, root: str, ttl_days: int, as_of: datetime | None = None
) -> int:
    """Drop days older than ``ttl_days``; 0 keeps everything."""
    if ttl_days <= 0:
        return 0
    now = params.utc(as_of) if as_of else params.now()
    return purge_before(spark, root, (now - timedelta(days=ttl_days)).strftime("%Y%m%d"))


def clustered(df: DataFrame, partitions: int) -> DataFrame:
    """Rows by partition, coin and time.

    The range covers the clustering columns too, so a day or coin that holds
    most of the rows is cut into many tasks.
    """
    keys = [*PARTITION_COLUMNS, *store.CLUSTERING]
    return df.repartitionByRange(partitions, *keys)


def recluster(spark: SparkSession, root: str, from_day: str, to_day: str) -> int:
    """Put the fills of an inclusive day range in clustered order; the number of days rewritten.

    Only partitions that were written since they were last laid out are touched. The new
    files count from one commit on; until then, and if anything fails, the old ones do, and
    they stay for frames that still read them until ``vacuum``. If one of the hours is
    loaded meanwhile, the load counts.
    """
    first, last = params.day_range(from_day, to_day)
    records = _records(spark, root)

    def due(record: commits.Record) -> bool:
        return (
            record["kind"] == store.FILLS
            and first <= record["event_date"] <= last
            and not record["clustered"]
        )

    chosen = [record for record in records if due(record)]
    if not chosen:
        return 0
    paths = sorted(store.partition_path(root, record) for record in chosen)
    rows = store.read_paths(spark, root, store.FILLS, paths).drop("load_id")
    total, folder = sum(record["rows"] for record in chosen), commits.new_id()
    ordered = clustered(rows, total // TARGET_ROWS + 1).withColumn("kind", F.lit(store.FILLS))
    store.write_ordered(ordered, root, folder)
    fresh = {(p["event_date"], p["src_hour"]): p["rows"] for p in store.written(spark, root, folder)}
    if fresh != {(r["event_date"], r["src_hour"]): r["rows"] for r in chosen}:
        raise RuntimeError("the new layout does not hold the rows of the old one")
    hours = {record["src_hour"] for record in chosen}
    commits.append(
        spark,
        root,
        commits.layout_records(
            record | {"folder": folder, "clustered": True} if due(record) else record
            for record in records
            if record["src_hour"] in hours
        ),
    )
    return len({record["event_date"] for record in chosen})


def vacuum(
    spark: SparkSession,
    root: str,
    older_than: timedelta = timedelta(days=1),
    as_of: datetime | None = None,
) -> int:
    """Delete folders that no commit names, and were not changed lately; their number.

    These are replaced and rejected hours, and what a load that failed has left behind.
    ``older_than`` spares loads that have not committed yet, and frames that still read
    folders which were replaced a moment ago: it must be longer than either may take.
    """
    limit = (params.utc(as_of) if as_of else params.now()) - older_than
    named = {
        store.partition_path("", record)
        for record in _records(spark, root)
        if record["kind"] != store.HOURS
    }
    whole = {path.split("/kind=")[0] for path in named}
    tables, deleted = store.tables_path(root), 0
    for folder, changed in files.modified(spark, f"{tables}/load_id=*").items():
        if "/tables/" + folder.rsplit("/", 1)[1] not in whole:
            deleted += changed < limit and files.delete(spark, folder)
            continue
        for path, at in files.modified(spark, f"{folder}/kind=*/event_date=*/src_hour=*").items():
            if "/tables/" + path.split("/tables/")[-1] not in named:
                deleted += at < limit and files.delete(spark, path)
    return deleted


def fold_commits(spark: SparkSession, root: str) -> int:
    """Put all commit records into one file; the number of files there were.

    Records are never changed: the file is written first and the old ones are deleted
    afterwards, so a crash leaves records twice, which readers take as one.
    """
    old = files.matching(spark, f"{commits.commits_path(root)}/*")
    if len(old) > 1:
        records = commits.entries(spark, root).coalesce(1)
        records.write.parquet(f"{commits.commits_path(root)}/folded-{commits.new_id()}")
        for path in old:
            files.delete(spark, path)
    return len(old)
