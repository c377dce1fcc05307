from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from filltape.operators import decode, validate
from tests.blocks import block, fill, lines

AS_OF = datetime(2025, 8, 1)
HOUR = datetime(2025, 7, 27, 8)
LAST_MS = 1754092800000  # 24 hours after AS_OF
FIRST_MS = 1753574100000  # 5 minutes before the first hour


def validated(spark, *texts: str, key: str = "a/20250727/08.lz4"):
    return validate.validate(decode.parse_lines(lines(spark, *texts, key=key)), AS_OF)


CASES = [
    ({}, None),
    ({"px": "NaN"}, "px_not_finite"),
    ({"px": "inf", "sz": "0"}, "px_not_finite"),
    ({"px": "0"}, "px<=0"),
    ({"px": "-1", "sz": "nan"}, "px<=0"),
    ({"sz": "inf"}, "sz_not_finite"),
    ({"sz": "0"}, "sz<=0"),
    ({"startPosition": "nan"}, "start_position_not_finite"),
    ({"closedPnl": "-inf"}, "closed_pnl_not_finite"),
    ({"fee": "nan"}, "fee_not_finite"),
    ({"fee": "nan", "time": 0}, "fee_not_finite"),
    ({"fee": "-5"}, None),
    ({"time": FIRST_MS}, None),
    ({"time": FIRST_MS - 1}, "bad_time"),
    ({"time": LAST_MS}, None),
    ({"time": LAST_MS + 1}, "bad_time"),
    ({"time": 2**63 - 1}, "bad_time"),
    ({"time": -(2**63)}, "bad_time"),
]


def test_first_broken_rule_wins(spark):
    rows = validated(spark, block(*[fill(**changes) for changes, _ in CASES]))
    found = [row["reason"] for row in rows.orderBy("event_pos").collect()]
    assert found == [reason for _, reason in CASES]


def test_routing_and_counters(spark):
    rows = validated(spark, block(fill(), fill(px="0")), "{not json}", block())
    assert validate.valid_fills(rows).count() == 1
    reasons = {tuple(r) for r in validate.quarantine_reasons(validate.quarantined(rows)).collect()}
    assert reasons == {("px<=0", 1), ("parse_error", 1)}
    (counts,) = validate.ingest_counts(rows).collect()
    assert counts.asDict() == {
        "src_key": "a/20250727/08.lz4",
        "rows_inserted": 1,
        "rows_quarantined": 2,
        "parse_errors": 1,
    }


def test_quarantined_rows(spark):
    own = datetime(2025, 7, 27, 8, 41, 7, 625000)
    rows = validated(
        spark,
        block(
            fill(px="NaN", hash="nan"),
            fill(px="0", hash="zero"),
            fill(time=9_000_000_000_000_000, hash="late"),
            fill(px="0", time=9_223_372_036_855, hash="both"),
        ),
        "{",
    )
    stored = {row["hash"]: row for row in validate.quarantined(rows).collect()}
    assert stored["nan"]["px"] is None and stored["nan"]["time"] == own
    assert stored["zero"]["px"] == 0.0 and stored["zero"]["time"] == own
    assert stored["late"]["time"] == HOUR and stored["late"]["reason"] == "bad_time"
    assert stored["both"]["time"] == HOUR and stored["both"]["reason"] == "px<=0"
    lost = stored["parse_error:20250727/08:2"].asDict()
    assert lost["time"] == HOUR and lost["reason"] == "parse_error"
    kept = {"time", "hash", "reason", "src_key", "line_no"}
    assert {name for name, value in lost.items() if value is not None} == kept


def test_parse_error_hash(spark):
    expected = {
        "node/hourly/20250727/09.lz4": "parse_error:20250727/09:3",
        "20250727/09": "parse_error:20250727/09:3",
        "09.lz4": "parse_error:unknown/09:3",
    }
    frame = spark.createDataFrame([(key,) for key in expected], "key string")
    made = frame.select("key", validate.parse_error_hash(F.col("key"), F.lit(3)).alias("hash"))
    assert {tuple(row) for row in made.collect()} == set(expected.items())


def test_bounds_follow_the_arguments(spark):
    parsed = decode.parse_lines(lines(spark, block(fill())))
    early = validate.validate(parsed, datetime(2025, 7, 26, 8, 41, 7), datetime(2020, 1, 1))
    assert early.first()["reason"] == "bad_time"
    later = validate.validate(parsed, AS_OF, datetime(2025, 7, 27, 9) + timedelta(days=1))
    assert later.first()["reason"] == "bad_time"
