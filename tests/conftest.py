from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("filltape-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        # A zone with daylight saving: no result may depend on it.
        .config("spark.sql.session.timeZone", "America/New_York")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="filltape-"))
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="filltape-shared-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    return session()
