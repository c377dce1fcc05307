"""Every registered query against SQL in another engine, and the properties behind them."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as contract
from filltape import fixtures, params
from filltape.functions import normalize_date
from filltape.operators import bars, coins, lookup, stats, wallets
from filltape.plans import runs, sync
from filltape.schema import FILL_COLUMNS, RUNS, TIME_BARS, VWAP, WALLET_PER_COIN, WALLET_SUMMARY
from filltape.sources import hours
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
FIRST, LAST = datetime(2000, 1, 1), datetime(2100, 1, 1)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def fills(spark):
    return fixtures.fills_from_events(fixtures.events(spark, SF)).cache()


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    compare(spark, con, SF, name)


def test_every_query_has_sql_and_entry_runs(spark):
    training_text = set(contract._llm_queries())
    assert set(contract.queries()) - training_text == set(contract.oracle_sql()) - training_text
    assert contract.entry(spark).count() > 0


def test_result_columns_are_fixed_also_when_empty(fills):
    none = fills.limit(0)
    assert lookup.get_fills(none, FIRST, LAST).columns == FILL_COLUMNS
    names = [(bars.vwap, VWAP), (bars.time_bars, TIME_BARS)]
    for query, schema in names:
        empty = query(none, "BTC", "1h", FIRST, LAST)
        assert empty.columns == schema.fieldNames() and empty.count() == 0
        assert [f.dataType for f in empty.schema] == [f.dataType for f in schema]
    both = wallets.wallet_summary(none, "w", FIRST, LAST)
    assert both["per_coin"].columns == WALLET_PER_COIN.fieldNames()
    assert [f.dataType for f in both["summary"].schema] == [f.dataType for f in WALLET_SUMMARY]
    assert tuple(both["summary"].first()) == (0, 0, 0.0, 0.0, 0, 0, 0.0, None, None)
    assert tuple(bars.bars_totals(bars.time_bars(none, "x", "1d", FIRST, LAST)).first()) == (0, 0.0)
    with pytest.raises(Exception, match="no coins available"):
        coins.top_coin(none).collect()


def rows(frame) -> list[str]:
    return sorted(str(row) for row in frame.collect())


def test_results_do_not_depend_on_partitioning(spark, fills):
    # Many fills of one instant, so that only the tie-break decides open and close.
    tied = fills.withColumn("time", F.date_trunc("DAY", "time").cast("timestamp_ntz")).withColumn(
        "block_number", F.col("block_number") % 50
    )
    expected = None
    for count in (1, 2, 8):
        spread = tied.repartition(count, F.rand(count))
        found = rows(bars.time_bars_by_coin(spread, "1d")), rows(bars.vwap_by_coin(spread, "4h"))
        expected = expected or found
        assert found == expected


def test_sums_of_inexact_values_agree_up_to_rounding(fills):
    tenths = fills.withColumns(
        {"px": F.round("px", 1), "sz": (F.col("event_pos") % 97 + 1) / F.lit(10.0)}
    )

    def bars_of(count: int) -> list:
        found = bars.time_bars_by_coin(tenths.repartition(count, F.rand(count)), "1d")
        return found.orderBy("coin", "time").collect()

    one = bars_of(1)
    for count in (3, 8):
        for mine, theirs in zip(one, bars_of(count), strict=True):
            assert mine[:-6] == theirs[:-6] and mine["trade_count"] == theirs["trade_count"]
            for name in ("base_volume", "notional_volume", "buy_volume", "sell_volume"):
                assert mine[name] == pytest.approx(theirs[name], rel=1e-12)


def test_bars_add_up(fills):
    def total(width: str):
        return bars.time_bars_by_coin(fills, width).agg(
            F.sum("base_volume"), F.sum("notional_volume"), F.sum("trade_count")
        )

    assert len({tuple(total(width).first()) for width in params.INTERVALS}) == 1
    one = bars.time_bars_by_coin(fills, "1h")
    odd = one.filter(
        (F.col("base_volume") != F.col("buy_volume") + F.col("sell_volume"))
        | (F.col("low") > F.least("open", "close"))
        | (F.col("high") < F.greatest("open", "close"))
    )
    assert odd.count() == 0


@settings(
    max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(start=st.integers(0, 600), length=st.integers(1, 100))
def test_replacing_an_hour_twice_changes_nothing(fills, start, length):
    first = datetime(2024, 1, 1) + timedelta(hours=start)
    last = first + timedelta(hours=length)
    incoming = lookup.between(fills, first, last)
    once = stats.replace_hour(fills, incoming, first, last)
    twice = stats.replace_hour(once, incoming, first, last)
    assert once.count() == twice.count() == fills.count()


def test_many_keys_at_once(spark, fills):
    keys = spark.createDataFrame([("0xh1",), ("0xh2",), ("0xh1",), ("none",)], "hash string")
    single = [lookup.get_fill_by_hash(fills, name) for name in (" 0xh1 ", "0xh2")]
    expected = rows(single[0].union(single[1]))
    assert rows(lookup.fills_matching(fills, keys, "hash")) == expected


def test_vwap_guards_zero_volume(fills):
    none = bars.vwap_by_coin(fills.withColumn("sz", F.lit(0.0)), "1d")
    assert none.filter("vwap != 0 or volume != 0").count() == 0
    makers = wallets.wallet_coins(fills.withColumn("crossed", F.lit(False)))
    assert makers.filter("maker_taker_ratio != 0").count() == 0


def test_normalize_date(spark):
    cases = {
        "2025-07-27": "20250727",
        "20250727": "20250727",
        " 2025-07-27T00:00:00Z ": "20250727",
        "2025-07-27T23:30:00-01:00": "20250728",
        "2025-07-27T00:30:00.5+01:00": "20250726",
        "2025-07-27T10:00:00": "20250727",
        "2025-07-27 10:00:00.123456789": "20250727",
        "2025-02-30": "2025-02-30",
        "20251301": "20251301",
        "2025-07-27T25:00:00": "2025-07-27T25:00:00",
        " partition-xyz ": "partition-xyz",
        "": "",
    }
    frame = spark.createDataFrame([(text,) for text in cases], "raw string")
    found = frame.select("raw", normalize_date(F.col("raw"))).collect()
    assert {tuple(row) for row in found} == set(cases.items())


def test_sync_window(spark):
    def window(now: datetime, newest: datetime | None):
        frame = spark.createDataFrame([(newest,)], "max_time timestamp_ntz")
        row = sync.sync_window(frame, now).first()
        return tuple(row) if row else None

    first = datetime(2025, 7, 27)
    assert window(datetime(2025, 7, 28, 5, 15), None) == (first, datetime(2025, 7, 28, 5))
    assert window(datetime(2025, 7, 28, 12, 45), datetime(2025, 7, 28, 11, 59)) == (
        datetime(2025, 7, 28, 10),
        datetime(2025, 7, 28, 12),
    )
    assert window(datetime(2025, 7, 27, 3, 30), datetime(2025, 7, 27, 0, 5)) == (
        first,
        datetime(2025, 7, 27, 3),
    )
    assert window(datetime(2025, 7, 27, 0, 30), None) is None


def test_status_of_an_empty_log_is_idle(spark):
    status = runs.ingest_status(spark.createDataFrame([], RUNS)).first().asDict()
    assert status["state"] == "idle" and status["hours_done"] == 0
    assert status["started_at"] is None and status["current_hour"] is None


def test_hour_keys(spark):
    keys = [tuple(r) for r in hours.hour_keys(spark, "/p/q/", "20250727", "20250728").collect()]
    assert len(keys) == 48
    assert keys[0] == ("p/q/20250727/00.lz4", datetime(2025, 7, 27))
    assert keys[-1] == ("p/q/20250728/23.lz4", datetime(2025, 7, 28, 23))
    bare = hours.hour_keys_between(spark, "", datetime(2025, 1, 1, 5), datetime(2025, 1, 1, 6))
    assert [r["key"] for r in bare.collect()] == ["20250101/05.lz4"]
    leap = hours.hour_keys(spark, "p", "20240228", "20240301")
    assert leap.count() == 72
    same = datetime(2025, 1, 1)
    assert hours.hour_keys_between(spark, "p", same, same).count() == 0
    bad = [
        (datetime(2025, 1, 2), same, "run backwards"),
        (datetime(2025, 1, 1, 0, 1), datetime(2025, 1, 2), "full hour"),
        (same, datetime(2025, 1, 2, 0, 0, 1), "full hour"),
    ]
    for start, end, message in bad:
        with pytest.raises(ValueError, match=message):
            hours.hour_keys_between(spark, "p", start, end)
    for days in (("20250728", "20250727"), ("2025-07-27", "20250728"), ("20250727", "20250732")):
        with pytest.raises(ValueError, match="backwards|not a day"):
            hours.hour_keys(spark, "p", *days)


def test_hour_window_of_a_key(spark):
    cases = {
        "a/b/20250727/08.lz4": datetime(2025, 7, 27, 8),
        "20250727/23": datetime(2025, 7, 27, 23),
        "a/20250727/24.lz4": None,
        "a/20250732/01.lz4": None,
        "a/2025-07-27/01.lz4": None,
        "a/20250727/xx.lz4": None,
        "08.lz4": None,
        "": None,
    }
    frame = spark.createDataFrame([(key,) for key in cases], "key string")
    for row in frame.select("key", hours.hour_window(F.col("key")).alias("w")).collect():
        start = cases[row["key"]]
        assert (row["w"] and tuple(row["w"])) == (
            (start, start + timedelta(hours=1)) if start else None
        )


def test_plans_keep_to_the_needed_columns_and_one_shuffle(spark):
    # Another table than the cached one, or the plan would read the cache.
    source = fixtures.events(spark, "/root/testdata/sf0.01")
    plan = bars.vwap_by_coin(fixtures.fills_from_events(source), "1h")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and text.count("HashAggregate") == 2
    assert "partial_sum" in text
    assert "user_id" not in text.split("ReadSchema", 1)[1]


def test_params():
    east = datetime(2025, 1, 1, tzinfo=timezone(timedelta(hours=-8)))
    assert params.utc(east) == datetime(2025, 1, 1, 8)
    assert params.time_range(east, datetime(2025, 1, 2)) == (
        datetime(2025, 1, 1, 8),
        datetime(2025, 1, 2),
    )
    assert params.from_unix(1, 999_999_999, "x") == datetime(1970, 1, 1, 0, 0, 1, 999999)
    assert params.parse_datetime("2026-01-01T00:00:00Z") == datetime(2026, 1, 1)
    assert params.window(hours=2, as_of=datetime(2025, 1, 1, 3)) == (
        datetime(2025, 1, 1, 1),
        datetime(2025, 1, 1, 3),
    )
    assert params.window("2025-01-01", "2025-01-02T01:00:00+01:00")[1] == datetime(2025, 1, 2)
    assert params.text(" BTC ", "coin") == "BTC"
    assert params.text(None, "coin", may_be_absent=True) is None
    assert params.text(" x ", "coin", may_be_absent=True) == "x"
    assert [params.side_is_buy(s) for s in (None, " BUY ", "sell", "unspecified")] == [
        None,
        True,
        False,
        None,
    ]
    assert params.interval(" 1H ") == "1h"
    assert params.positive(1, "oid") == 1


@pytest.mark.parametrize(
    ("call", "message"),
    [
        (lambda: params.time_range(None, LAST), "start: a time is needed"),
        (lambda: params.time_range(FIRST, None), "end: a time is needed"),
        (lambda: params.time_range(datetime(1970, 1, 1), LAST), "start: the epoch"),
        (lambda: params.time_range(FIRST, FIRST), "does not lie before"),
        (lambda: params.time_range(LAST, FIRST), "does not lie before"),
        (lambda: params.from_unix(0, -1, "t"), "nanoseconds"),
        (lambda: params.from_unix(0, 10**9, "t"), "nanoseconds"),
        (lambda: params.from_unix(2**62, 0, "t"), "beyond the calendar"),
        (lambda: params.text("  ", "coin"), "coin: a text"),
        (lambda: params.text(None, "coin"), "coin: a text"),
        (lambda: params.text(" ", "coin", may_be_absent=True), "coin: a text"),
        (lambda: params.positive(0, "oid"), "oid: at least 1"),
        (lambda: params.side_is_buy("both"), "neither buy nor sell"),
        (lambda: params.interval("2h"), "interval: .* unknown"),
        (lambda: params.interval(""), "interval: a text"),
        (lambda: params.window("2025-01-01"), "together"),
        (lambda: params.window(hours=0), "hours"),
        (lambda: params.day("2025-1-1", "from"), "YYYYMMDD"),
    ],
)
def test_bad_arguments(call, message):
    with pytest.raises(ValueError, match=message):
        call()
