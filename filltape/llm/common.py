"""What several operators share: words, inline bindings, stored intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything between two runs of it is a word.
SPACE_CHARS = " \t\n\x0b\f\r"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda word: word != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it.

    Inside a higher-order function Spark evaluates a captured expression again
    for every element; a lambda variable is evaluated once.
    """
    return F.transform(F.array(value), body)[0]


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame written to the cluster's shared checkpoint folder and read again.

    This cuts the lineage, so that a later step does not repeat an expensive one,
    and it survives the loss of any executor.
    """
    spark = frame.sparkSession
    path = shared_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder that the driver and all executors share.

    The folder is the session's ``spark.checkpoint.dir``. A session without one that runs
    in this process alone gets a temporary folder; on a cluster, where every machine would
    write to its own disk, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="filltape-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
