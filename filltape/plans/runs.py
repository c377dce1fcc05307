"""Bookkeeping of load runs: hour status, run report and the status of the latest run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filltape.functions import hour_label
from filltape.schema import HOUR_STATUS, RUNS

# Outcomes of an hour and states of a run.
PROCESSED = "processed"
MISSING = "missing"
FAILED = ["failed_download", "failed_decompress", "failed_dedup", "failed_ingest"]
IDLE, RUNNING, FAILED_RUN, SUCCEEDED = "idle", "running", "failed", "succeeded"

_COUNTERS = ["rows_inserted", "rows_quarantined", "parse_errors"]


def hour_status(expected: DataFrame, attempts: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per expected hour.

    ``expected`` holds ``key, hour_start``, ``attempts`` the ``key, status`` of the
    hours a load has touched, ``counts`` the ``src_key`` and counters of what it
    stored. Hours without an attempt are missing.
    """
    status = F.coalesce("status", F.lit(MISSING))
    return (
        expected.join(attempts.select("key", "status"), "key", "left")
        .join(counts.withColumnRenamed("src_key", "key"), "key", "left")
        .withColumn("status", status)
        .withColumns(
            {
                name: F.when(F.col("status") == PROCESSED, F.coalesce(name, F.lit(0))).otherwise(0)
                for name in _COUNTERS
            }
        )
        .select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in HOUR_STATUS.fields])
    )


def run_report(hours: DataFrame, from_day: str, to_day: str) -> DataFrame:
    """Summary of a load in one row, from its hour status."""

    def counted(*status: str):
        return F.count_if(F.col("status").isin(*status))

    return hours.agg(
        F.lit(from_day).alias("from"),
        F.lit(to_day).alias("to"),
        F.count("*").alias("hours_total"),
        counted(PROCESSED).alias("hours_processed"),
        counted(MISSING, *FAILED).alias("hours_skipped"),
        counted(MISSING).alias("hours_missing"),
        counted(*FAILED).alias("failed_hours"),
        *[counted(name).alias(name) for name in FAILED],
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in _COUNTERS],
    )


def run_progress(hours: DataFrame) -> DataFrame:
    """The progress counters of a run, in one row. Missing and failed hours count as done."""
    return hours.agg(
        F.max(hour_label(F.col("hour_start"), "/")).alias("current_hour"),
        F.count("*").alias("hours_done"),
        F.count("*").alias("hours_total"),
        F.coalesce(F.sum("rows_inserted"), F.lit(0)).alias("rows_inserted"),
        F.coalesce(F.sum("rows_quarantined"), F.lit(0)).alias("rows_quarantined"),
        F.count_if(F.col("status") == MISSING).alias("files_missing"),
        F.count_if(F.col("status").isin(FAILED)).alias("files_failed"),
    )


def ingest_status(runs: DataFrame) -> DataFrame:
    """The latest entry of the run log in one row; ``idle`` when there is none."""
    names = [name for name in RUNS.fieldNames() if name != "run_id"]
    numbers = {"hours_done", "hours_total", "rows_inserted", "rows_quarantined"}
    numbers |= {"files_missing", "files_failed"}
    # Of one instant, the entry that ends a run is the later one.
    order = F.struct("last_updated_at", F.col("finished_at").isNotNull(), "started_at", "run_id")
    latest = runs.agg(F.max_by(F.struct(*names), order).alias("latest"))

    def field(name: str):
        value = F.col(f"latest.{name}")
        if name == "state":
            return F.coalesce(value, F.lit(IDLE)).alias(name)
        return (F.coalesce(value, F.lit(0)) if name in numbers else value).alias(name)

    return latest.select(*[field(name) for name in names])
