"""Directory listing and deletion through the file system Spark itself uses. Names only, never data."""

from __future__ import annotations

from datetime import datetime, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _resolve(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def matching(spark: SparkSession, pattern: str) -> dict[str, int]:
    """Full paths that match a glob pattern and their length in bytes."""
    fs, where = _resolve(spark, pattern)
    found = fs.globStatus(where) or []
    return {status.getPath().toString(): status.getLen() for status in found}


# Why a file cannot be read.
DENIED, MISSING, OTHER = "denied", "missing", "other"


def fault(spark: SparkSession, path: str) -> str:
    """Why a file could not be read, found by opening it: access, gone, or anything else."""
    fs, where = _resolve(spark, path)
    try:
        fs.open(where).close()
    except Py4JJavaError as error:
        name = error.java_exception.getClass().getName().rsplit(".", 1)[-1]
        text = error.java_exception.getMessage() or ""
        # The local file system has no exception of its own for denied access.
        if name.startswith("Access") or text.endswith("(Permission denied)"):
            return DENIED
        return MISSING if name == "FileNotFoundException" else OTHER
    return OTHER


def modified(spark: SparkSession, pattern: str) -> dict[str, datetime]:
    """Full paths that match a glob pattern and when they were changed last, in UTC."""
    fs, where = _resolve(spark, pattern)
    return {
        status.getPath().toString(): datetime(1970, 1, 1)
        + timedelta(milliseconds=status.getModificationTime())
        for status in fs.globStatus(where) or []
    }


def make_dirs(spark: SparkSession, path: str) -> None:
    fs, where = _resolve(spark, path)
    fs.mkdirs(where)


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a directory with its content; false when it is gone already."""
    fs, where = _resolve(spark, path)
    return fs.delete(where, True)
