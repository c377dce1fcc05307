"""The stored tables.

``<root>/tables/load_id=…/kind=…/event_date=…/src_hour=…`` holds Parquet files: ``fills``,
``quarantine`` and one outcome row per object in ``hours``. One folder tree for all three
lets a load write them in a single pass. ``event_date`` is the day of a row's time,
``src_hour`` the hour of the object it came from. A folder is written once; which folders
make up a table is said by the commit records (``sources/commits.py``), and a frame keeps
to the records there were when it was made.
``<root>/runs`` is the log of load runs.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filltape import params
from filltape.functions import day_label, hour_label
from filltape.schema import PARTITION_COLUMNS, PARTITIONS, RUNS, STORED_FILLS, STORED_QUARANTINE
from filltape.sources import archive, commits, files

FILLS, QUARANTINE, HOURS = "fills", "quarantine", commits.HOURS

_LOAD_ID = T.StructField("load_id", T.StringType(), True)
_KIND = T.StructField("kind", T.StringType(), True)
_STATUS = T.StructField("status", T.StringType(), True)
_SCHEMAS = {
    FILLS: T.StructType(STORED_FILLS.fields + [_LOAD_ID]),
    QUARANTINE: T.StructType(STORED_QUARANTINE.fields + [_LOAD_ID]),
}
_WRITTEN = T.StructType(STORED_QUARANTINE.fields + [_STATUS, _KIND])

# Rows of a file lie by coin and time, so row groups can be skipped for a coin;
# bloom filters do the same for the columns looked up by value.
CLUSTERING = ["coin", "time", "block_number", "event_pos"]
_PARQUET_OPTIONS = {"parquet.bloom.filter.adaptive.enabled": "true"} | {
    f"parquet.bloom.filter.enabled#{name}": "true" for name in ("hash", "oid", "address")
}


def tables_path(root: str) -> str:
    return f"{root.rstrip('/')}/tables"


def folder_path(root: str, folder: str) -> str:
    return f"{tables_path(root)}/load_id={folder}"


def partition_path(root: str, record: commits.Record) -> str:
    day, hour = record["event_date"].isoformat(), record["src_hour"]
    folder = folder_path(root, record["folder"])
    return f"{folder}/kind={record['kind']}/event_date={day}/src_hour={hour}"


def runs_path(root: str) -> str:
    return f"{root.rstrip('/')}/runs"


def ensure_tables(spark: SparkSession, root: str) -> None:
    """Create what is missing. The schemas are constants, so a table may start without files."""
    for path in (tables_path(root), commits.commits_path(root), runs_path(root)):
        files.make_dirs(spark, path)


def _partitions(
    spark: SparkSession, root: str, kind: str, first: date | None = None, last: date | None = None
) -> DataFrame:
    """Records of the partitions of a table, of the days ``first`` to ``last`` if given."""
    records = commits.live(spark, root).filter(F.col("kind") == kind)
    if first is not None:
        records = records.filter(F.col("event_date") >= F.lit(first))
    if last is not None:
        records = records.filter(F.col("event_date") <= F.lit(last))
    return records


def stored_days(spark: SparkSession, root: str, kind: str) -> dict[date, list[str]]:
    """Days of a table and their folders, in order."""
    days: dict[date, list[str]] = {}
    records = _partitions(spark, root, kind).select("event_date", "src_hour", "folder", "kind")
    for record in sorted(records.collect()):
        days.setdefault(record["event_date"], []).append(partition_path(root, record.asDict()))
    return days


def read_paths(spark: SparkSession, root: str, kind: str, paths: list[str]) -> DataFrame:
    """The rows of some partitions; nothing else is listed."""
    schema = _SCHEMAS[kind]
    if not paths:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("basePath", tables_path(root))
    return reader.parquet(*paths).select(*schema.fieldNames())


def read_table(
    spark: SparkSession, root: str, kind: str, first: date | None = None, last: date | None = None
) -> DataFrame:
    """One stored table, or some of its days. Only names of partitions reach the driver."""
    records = _partitions(spark, root, kind, first, last)
    records = records.select("event_date", "src_hour", "folder", "kind").collect()
    paths = [partition_path(root, record.asDict()) for record in sorted(records)]
    return read_paths(spark, root, kind, paths)


def fills(
    spark: SparkSession, root: str, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """Stored fills. A window keeps Spark from listing the days outside of it."""
    if start is None and end is None:
        return read_table(spark, root, FILLS)
    start, end = params.time_range(start, end)
    last = (end - timedelta(microseconds=1)).date()
    return read_table(spark, root, FILLS, start.date(), last)


def quarantine(spark: SparkSession, root: str) -> DataFrame:
    """Stored rejected rows."""
    return read_table(spark, root, QUARANTINE)


def newest_fill(spark: SparkSession, root: str) -> DataFrame:
    """``max_time`` of the fills, in one row, from the records."""
    return _partitions(spark, root, FILLS).agg(F.max("max_time").alias("max_time"))


def db_stats(spark: SparkSession, root: str) -> DataFrame:
    """``stats.db_stats`` of the stored tables, from the records."""
    is_fills = F.col("kind") == FILLS

    def rows(chosen: Column) -> Column:
        return F.coalesce(F.sum(F.when(chosen, F.col("rows"))), F.lit(0).cast("bigint"))

    return commits.live(spark, root).agg(
        rows(is_fills).alias("fills_count"),
        rows(F.col("kind") == QUARANTINE).alias("quarantine_count"),
        F.min(F.when(is_fills, F.col("min_time"))).alias("min_time"),
        F.max(F.when(is_fills, F.col("max_time"))).alias("max_time"),
    )


def partition_counts(spark: SparkSession, root: str, kind: str = FILLS) -> DataFrame:
    """``stats.partition_counts`` of a stored table, from the records."""
    counts = _partitions(spark, root, kind).groupBy("event_date")
    return (
        counts.agg(F.sum("rows").alias("row_count"))
        .select(day_label(F.col("event_date")).alias("date"), "row_count")
        .orderBy("date")
    )


def quarantine_reasons(spark: SparkSession, root: str) -> DataFrame:
    """``validate.quarantine_reasons`` of the stored rejected rows, from the records."""
    reasons = _partitions(spark, root, QUARANTINE).select(F.explode("reasons").alias("reason", "n"))
    return reasons.groupBy("reason").agg(F.sum("n").alias("n"))


def hours(spark: SparkSession, root: str) -> DataFrame:
    """``src_hour, src_key, status`` of every hour that is in the tables."""
    return _partitions(spark, root, HOURS).select("src_hour", "src_key", "status")


def register(spark: SparkSession, root: str) -> None:
    """Make the tables, as they are now, available to SQL as ``fills`` and ``fills_quarantine``."""
    fills(spark, root).createOrReplaceTempView("fills")
    quarantine(spark, root).createOrReplaceTempView("fills_quarantine")


def runs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(RUNS).parquet(runs_path(root))


def write_rows(rows: DataFrame, root: str, folder: str) -> None:
    """Write rows of any ``kind`` to a new folder, where nobody reads them before a commit.

    Rows are gathered by partition first, so a small hour is one file; adaptive execution
    splits a large one.
    """
    write_ordered(rows.hint("rebalance", "kind", *PARTITION_COLUMNS), root, folder)


def write_ordered(rows: DataFrame, root: str, folder: str) -> None:
    """The same for rows that lie where they should, but for their order inside a task."""
    keys = ["kind", *PARTITION_COLUMNS]
    (
        rows.sortWithinPartitions(*keys, *[name for name in CLUSTERING if name in rows.columns])
        .write.options(**_PARQUET_OPTIONS)
        .partitionBy(*keys)
        .parquet(folder_path(root, folder))
    )


def written(spark: SparkSession, root: str, folder: str) -> list[commits.Record]:
    """A record of every partition of a folder, and of every hour that has an outcome there.

    Reads the times and reasons of what was just written, once; whoever wants to know
    later asks the records.
    """
    path = folder_path(root, folder)
    rows = spark.read.schema(_WRITTEN).option("basePath", path).parquet(path)
    hour_key = F.when(F.col("kind") == HOURS, F.col("src_key")).alias("hour_key")
    groups = rows.groupBy("kind", *PARTITION_COLUMNS, "reason", hour_key).agg(
        F.count("*").alias("rows"),
        F.min("time").alias("min_time"),
        F.max("time").alias("max_time"),
        F.max("status").alias("status"),
        F.max("src_key").alias("src_key"),
    )
    found: dict[tuple, commits.Record] = {}
    for group in groups.collect():
        own = group.asDict()
        reason, hour_key = own.pop("reason"), own.pop("hour_key")
        is_hour = own["kind"] == HOURS
        if is_hour:
            own |= dict.fromkeys(("event_date", "rows", "min_time", "max_time"))
            own["src_hour"] = archive.hour_of(hour_key)
        key = own["kind"], own["event_date"], own["src_hour"]
        if key in found and not is_hour:
            have = found[key]
            have["rows"] += own["rows"]
            have["min_time"] = min(have["min_time"], own["min_time"])
            have["max_time"] = max(have["max_time"], own["max_time"])
        else:
            found[key] = own | {"reasons": {}}
        if reason is not None and not is_hour:
            found[key]["reasons"][reason] = own["rows"]
    return list(found.values())


def _with_partitions(df: DataFrame) -> DataFrame:
    """Add the partition columns where a frame lacks them, taking its own time as the hour."""
    if "event_date" not in df.columns:
        df = df.withColumn("event_date", F.col("time").cast("date"))
    if "src_hour" not in df.columns:
        df = df.withColumn("src_hour", hour_label(F.col("time")))
    return df


def _replace(df: DataFrame, root: str, kind: str) -> None:
    """Put rows in the place of the partitions they touch; the rest of their hours stays."""
    spark, folder = df.sparkSession, commits.new_id()
    ensure_tables(spark, root)
    rows = _with_partitions(df).withColumn("kind", F.lit(kind)).drop("load_id")
    write_rows(rows, root, folder)
    new = written(spark, root, folder)
    touched = {(p["kind"], p["event_date"], p["src_hour"]) for p in new}
    by_hour = {p["src_hour"]: {"kind": HOURS, "src_hour": p["src_hour"]} for p in new}
    for record in commits.live(spark, root).collect():
        if record["src_hour"] in by_hour:
            own = record.asDict()
            if record["kind"] == HOURS:
                by_hour[record["src_hour"]] = own
            elif (record["kind"], record["event_date"], record["src_hour"]) not in touched:
                new.append(own)
    new += [hour | {"status": commits.PROCESSED} for hour in by_hour.values()]
    commits.append(spark, root, commits.load_records(new, folder, folder))


def write_fills(df: DataFrame, root: str) -> None:
    """Replace the days of hours of ``df`` in the fills table."""
    _replace(df, root, FILLS)


def write_quarantine(df: DataFrame, root: str) -> None:
    """Replace the days of hours of ``df`` in the quarantine table."""
    _replace(df, root, QUARANTINE)


def append_run(spark: SparkSession, root: str, entry: dict) -> None:
    """Add one line to the log of load runs."""
    row = tuple(entry.get(name) for name in RUNS.fieldNames())
    spark.createDataFrame([row], RUNS).coalesce(1).write.mode("append").parquet(runs_path(root))


def export(df: DataFrame, path: str) -> None:
    """Write a result as Parquet or CSV, by the suffix of ``path``."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        df.write.mode("overwrite").parquet(path)
    elif suffix == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"cannot tell the format of {path!r}: use the suffix .parquet or .csv")
