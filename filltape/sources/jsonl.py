"""Plain newline-delimited block files, read in splits of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """``key, line_no, line`` of every non-blank line below ``path``.

    ``key`` is the file name with its folder. Lines are numbered over the whole
    file although a file is read in many splits: a first pass counts the lines of
    each split, and their running sum is the offset of the next one. No file has
    to fit into one task.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    rows = text.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row_id"),
    )
    counted = rows.groupBy("file", "split").agg(
        F.min("row_id").alias("first_id"), F.count("*").alias("n")
    )
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select(
        "file",
        "split",
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first_id") + 1).alias("shift"),
    )
    return (
        rows.join(offsets, ["file", "split"])
        .select(
            F.substring_index("file", "/", -2).alias("key"),
            (F.col("row_id") + F.col("shift")).alias("line_no"),
            F.col("value").alias("line"),
        )
        .filter(F.col("line").rlike(r"(?U)\S"))
    )
