"""Loading hours: archive objects to stored tables.

A load goes in waves, each one Spark job over its hours. Every hour stands alone: one that
is missing or broken is counted and skipped, and what is stored for it stays as it is. An
hour that decodes replaces everything an earlier load of it stored. Files are written
first and count from the commit of their wave on, so a load that stops anywhere leaves
every hour as it was or as it is to be.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filltape import params
from filltape.functions import hour_label
from filltape.operators import decode, validate
from filltape.plans import runs, sync
from filltape.schema import QUARANTINE_COLUMNS
from filltape.sources import archive, commits, files, store
from filltape.sources.hours import hour_keys_between, key_hour_start

#: Hours of a wave, at least; one object is one task, so a large cluster takes more at once.
WAVE_HOURS = 24

# Hour outcomes that are found out without decoding.
_UNREADABLE = "failed_download"


def table_rows(
    lines: DataFrame,
    as_of: datetime | None = None,
    min_time: datetime = validate.FIRST_HOUR,
) -> DataFrame:
    """Decoded lines to the rows of all stored tables, told apart by ``kind``."""
    parsed = decode.explode_fills(decode.decode_blocks(lines), "key", "line_no", "status")
    routed = validate.route(validate.validate(parsed, as_of, min_time))
    outcome = F.col("line_no").isNull()
    kind = (
        F.when(outcome, store.HOURS)
        .when(F.col("reason").isNull(), store.FILLS)
        .otherwise(store.QUARANTINE)
    )
    return routed.select(
        *[
            F.when(~outcome, F.col(name)).alias(name) if name in ("hash", "reason") else name
            for name in QUARANTINE_COLUMNS
        ],
        F.col("key").alias("src_key"),
        "line_no",
        "event_pos",
        F.when(outcome, F.col("status")).alias("status"),
        kind.alias("kind"),
        # Outcomes of all objects lie together: a row each is not worth a file.
        F.when(~outcome, F.col("time").cast("date")).alias("event_date"),
        F.when(~outcome, hour_label(F.col("hour_start"))).alias("src_hour"),
    )


def _unread(spark: SparkSession, one: archive.Object) -> str:
    """The outcome of an object that did not reach its decoder, found by opening it."""
    if one.length > archive.largest(spark):
        return _UNREADABLE
    fault = files.fault(spark, one.path)
    if fault == files.DENIED:
        return fault
    return runs.MISSING if fault == files.MISSING else _UNREADABLE


def _load_wave(
    spark: SparkSession,
    root: str,
    objects: list[archive.Object],
    load_id: str,
    run_id: str,
    as_of: datetime | None,
    min_time: datetime,
) -> list[commits.Record]:
    """Load some objects and commit them; the records of the commit.

    Raises ``PermissionError`` if access to any of them is denied, after the commit of
    those that could be read.
    """
    records: list[commits.Record] = []
    readable = [one for one in objects if one.length <= archive.largest(spark)]
    if readable:
        lines = archive.decode_lines(archive.read_hours(spark, readable))
        store.write_rows(table_rows(lines, as_of, min_time), root, load_id)
        records = store.written(spark, root, load_id)
    decoded = {record["src_key"] for record in records if record["kind"] == store.HOURS}
    denied = []
    for one in objects:
        if one.key in decoded:
            continue
        outcome = _unread(spark, one)
        if outcome == files.DENIED:
            denied.append(one.path)
        else:
            hour = archive.hour_of(one.key)
            own = {"kind": store.HOURS, "src_hour": hour, "src_key": one.key, "status": outcome}
            records.append(own)
    records = commits.load_records(records, load_id, run_id)
    commits.append(spark, root, records)
    if denied:
        raise PermissionError(f"no access to {denied[0]}")
    return records


def load_between(
    spark: SparkSession,
    source: str,
    prefix: str,
    root: str,
    start: datetime,
    end: datetime,
    as_of: datetime | None = None,
    min_time: datetime = validate.FIRST_HOUR,
    wave_hours: int | None = None,
) -> DataFrame:
    """Load the hours of ``[start, end)`` and return their status, one row per hour.

    The status comes from the records of this run and stays the same whatever is loaded
    later. After every wave the run log tells how far the load has come.
    """
    expected = hour_keys_between(spark, prefix, start, end)
    first, total = params.utc(start), (params.utc(end) - params.utc(start)) // timedelta(hours=1)
    log = _log_entry(total)
    run_id, began = log["run_id"], log["started_at"]
    size = wave_hours or max(WAVE_HOURS, 2 * spark.sparkContext.defaultParallelism)
    try:
        store.ensure_tables(spark, root)
        store.append_run(spark, root, log | {"state": runs.RUNNING, "last_updated_at": began})
        objects = archive.existing_objects(spark, source, prefix, start, end)
        for done in range(0, total, size):
            ends = min(done + size, total)
            bounds = [first + timedelta(hours=hours) for hours in (done, ends)]
            low, high = (f"{bound:%Y%m%d%H}" for bound in bounds)
            wave = [one for one in objects if low <= archive.hour_of(one.key) < high]
            load_id = f"{run_id}-{done // size}"
            records = _load_wave(spark, root, wave, load_id, run_id, as_of, min_time)
            _count(log, records, ends - done, len(wave))
            log["current_hour"] = f"{bounds[1] - timedelta(hours=1):%Y%m%d/%H}"
            if ends < total:
                now = {"state": runs.RUNNING, "last_updated_at": params.now()}
                store.append_run(spark, root, log | now)
        status = _status(spark, root, expected, run_id)
    except Exception:
        store.append_run(spark, root, log | _ended(runs.FAILED_RUN))
        raise
    store.append_run(spark, root, log | _ended(runs.SUCCEEDED))
    return status


def _count(log: dict, records: list[commits.Record], hours: int, objects: int) -> None:
    """Add a wave to the counters of its run."""
    outcomes = [record["status"] for record in records if record["kind"] == store.HOURS]
    log["hours_done"] += hours
    log["files_missing"] += hours - objects + outcomes.count(runs.MISSING)
    log["files_failed"] += sum(outcomes.count(status) for status in runs.FAILED)
    for kind, name in ((store.FILLS, "rows_inserted"), (store.QUARANTINE, "rows_quarantined")):
        log[name] += sum(record["rows"] for record in records if record["kind"] == kind)


def _log_entry(hours_total: int) -> dict:
    """A new run's line of the log, with nothing done yet."""
    counters = ("hours_done", "rows_inserted", "rows_quarantined", "files_missing", "files_failed")
    new = {"run_id": uuid.uuid4().hex, "started_at": params.now(), "hours_total": hours_total}
    return new | dict.fromkeys(counters, 0)


def _ended(state: str) -> dict:
    ended = params.now()
    return {"state": state, "last_updated_at": ended, "finished_at": ended}


def _status(spark: SparkSession, root: str, expected: DataFrame, run_id: str) -> DataFrame:
    """Hour status from the records of a run's own loads."""
    own = commits.entries(spark, root).filter(
        (F.col("run_id") == run_id) & (F.col("commit_id") == F.col("load_id"))
    )
    is_hour = F.col("kind") == store.HOURS
    attempts = own.filter(is_hour).select(F.col("src_key").alias("key"), "status")

    def rows(kind: str):
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rows"))), F.lit(0))

    broken = F.coalesce(F.col("reasons")[validate.PARSE_ERROR], F.lit(0))
    counts = own.filter(~is_hour).groupBy("src_key").agg(
        rows(store.FILLS).alias("rows_inserted"),
        rows(store.QUARANTINE).alias("rows_quarantined"),
        F.sum(broken).alias("parse_errors"),
    )
    return runs.hour_status(expected, attempts, counts)


def load_range(
    spark: SparkSession,
    source: str,
    prefix: str,
    root: str,
    from_day: str,
    to_day: str,
    as_of: datetime | None = None,
    min_time: datetime = validate.FIRST_HOUR,
    wave_hours: int | None = None,
) -> DataFrame:
    """Load every hour of an inclusive UTC day range."""
    first, last = params.day_range(from_day, to_day)
    midnight = datetime.min.time()
    start = datetime.combine(first, midnight)
    end = datetime.combine(last + timedelta(days=1), midnight)
    return load_between(spark, source, prefix, root, start, end, as_of, min_time, wave_hours)


def load_new(
    spark: SparkSession,
    source: str,
    prefix: str,
    root: str,
    as_of: datetime | None = None,
    first_hour: datetime = validate.FIRST_HOUR,
) -> DataFrame | None:
    """Load from the newest stored fill to the last full hour; ``None`` when up to date.

    Having nothing to load is logged as a run of 0 hours, not finding out as a failed one.
    """
    log = _log_entry(0)
    try:
        store.ensure_tables(spark, root)
        window = sync.sync_window(store.newest_fill(spark, root), as_of, first_hour).first()
    except Exception:
        store.append_run(spark, root, log | _ended(runs.FAILED_RUN))
        raise
    if window is None:
        store.append_run(spark, root, log | _ended(runs.SUCCEEDED))
        return None
    return load_between(
        spark, source, prefix, root, window["start"], window["end"], as_of, first_hour
    )


def report(status: DataFrame) -> DataFrame:
    """Run report of a load, with the day range taken from its hours."""
    day = hour_label(key_hour_start(F.col("key")))
    bounds = status.agg(F.min(day).alias("first"), F.max(day).alias("last")).first()
    return runs.run_report(status, (bounds["first"] or "")[:8], (bounds["last"] or "")[:8])
