from __future__ import annotations

import json
from datetime import datetime

from filltape.operators import decode
from tests.blocks import BASE_FILL, block, fill, lines


def parse(spark, *texts: str) -> list[dict]:
    rows = decode.parse_lines(lines(spark, *texts)).orderBy("line_no", "event_pos").collect()
    return [row.asDict() for row in rows]


def test_two_fills_with_all_columns(spark):
    text = block(
        fill(cloid="0xc1", builderFee="0.0625", builder="0xbb"),
        fill(coin="@FIG/USDC", side="A", crossed=False),
    )
    first, second = parse(spark, text)
    assert first["address"] == "0x1" and second["address"] == "0x2"
    assert (first["px"], first["sz"], first["start_position"]) == (2048.75, 0.5, -1.5)
    assert (first["closed_pnl"], first["fee"]) == (-0.25, -0.125)
    assert first["time"] == datetime(2025, 7, 27, 8, 41, 7, 625000)
    assert first["block_time"] == datetime(2025, 7, 27, 8, 41, 7, 500250)
    assert first["local_time"] == datetime(2025, 7, 27, 8, 41, 8, 125375)
    assert first["block_number"] == 31415926
    assert (first["oid"], first["tid"]) == (4400123, 77001234567)
    assert (first["cloid"], first["builder_fee"], first["builder"]) == ("0xc1", "0.0625", "0xbb")
    assert second["cloid"] is None and second["builder"] is None
    assert (first["type"], second["type"]) == ("PERP", "SPOT")
    assert (first["is_buy"], second["is_buy"]) == (True, False)
    assert (first["event_pos"], second["event_pos"]) == (0, 1)


def test_derived_columns(spark):
    rows = parse(
        spark,
        block(
            fill(startPosition="-1.0", sz="0.1", side="B"),
            fill(startPosition="-1.0", sz="0.1", side="A"),
            fill(startPosition="1.0", sz="0.1", side="B"),
            fill(startPosition="1.0", sz="0.1", side="A"),
            fill(coin="@FIG/USDC"),
            fill(coin="@FIG/USDC", type="perp"),
            fill(coin="@1", type="  straße "),
            fill(type="  "),
        ),
    )
    assert [r["is_gaining_inventory"] for r in rows[:4]] == [False, True, True, False]
    assert [r["type"] for r in rows[4:]] == ["SPOT", "PERP", "STRAßE", "PERP"]


def test_gaining_needs_more_than_the_epsilon(spark):
    small = fill(startPosition="1.0", sz="0.0000000000005")
    large = fill(startPosition="1.0", sz="0.000000000002")
    rows = parse(spark, block(small, large, fill(sz="NaN"), fill(startPosition="nan")))
    assert [r["is_gaining_inventory"] for r in rows] == [False, True, False, False]


NUMBERS = ["1", "1.", ".5", "+1e5", "-1E-2", "inf", "-Infinity", "nan", "+NaN", "-nan", "007"]
NOT_NUMBERS = ["", " 1", "1 ", "1d", "1f", "0x1p3", ".", "e5", "1e", "1_0", "1\n"]


def test_number_texts(spark):
    rows = parse(spark, block(*[fill(fee=text) for text in NUMBERS]))
    for row, expected in zip(rows, map(float, NUMBERS), strict=True):
        both_nan = row["fee"] != row["fee"] and expected != expected
        assert row["fee"] == expected or both_nan


def test_other_texts_reject_the_block(spark):
    rows = parse(spark, *[block(fill(), fill(fee=text)) for text in NOT_NUMBERS])
    assert [r["parse_error"] for r in rows] == [True] * len(NOT_NUMBERS)


def test_unknown_keys_are_ignored_and_counted(spark):
    good = block(fill(newField="x"), fill(newField=1, other={"px": 2}), version=2)
    bad = block(fill(newField="x", tid=None), version=2)
    source = lines(spark, good, bad, "{not json}")
    rows = decode.parse_lines(source).filter("not parse_error").collect()
    assert len(rows) == 2
    found = {tuple(r) for r in decode.unknown_keys(source).collect()}
    assert found == {("envelope", "version", 1), ("fill", "newField", 2), ("fill", "other", 1)}


def test_empty_block_has_no_rows(spark):
    assert parse(spark, block()) == []


BROKEN = {
    "not json": "{not json}",
    "cut": block(fill())[:40],
    "trailing text": block(fill()) + " x",
    "two blocks": block(fill()) + block(fill()),
    "member behind": block(fill()) + ',"x":1',
    "member with a list behind": block(fill()) + ',"more":{"a":[1]}',
    "block again": block(fill()) + ',"block":' + block(fill()),
    "value before": '5,"block":' + block(fill()),
    "closed list": block(fill()) + "],[1",
    "closing brace": block(fill()) + "}",
    "array": f"[{block(fill())}]",
    "number": "5",
    "single quotes": block(fill()).replace('"', "'"),
    "no events": block(events=None),
    "events object": block(events={}),
    "null event": block(events=[None]),
    "text event": block(events=["x"]),
    "short pair": block(events=[["0x1"]]),
    "long pair": block(events=[["0x1", BASE_FILL, 1]]),
    "number address": block(events=[[1, BASE_FILL]]),
    "null address": block(events=[[None, BASE_FILL]]),
    "fill as text": block(events=[["0x1", json.dumps(BASE_FILL)]]),
    "fill as list": block(events=[["0x1", [BASE_FILL]]]),
    "text block number": block(fill(), block_number="7"),
    "fractional block number": block(fill(), block_number=7.0),
    "number local time": block(fill(), local_time=1),
    "null block time": block(fill(), block_time=None),
    "escaped key": block(fill(px=1)).replace('"px"', '"p\\u0078"'),
    "bare NaN": block(fill()).replace('"2048.75"', "NaN"),
    "block number again": block(fill())[:-1] + ',"block_number":1}',
    "events again": block(fill())[:-1] + ',"events":[]}',
    "coin again": block(fill()).replace('"coin":', '"coin": "x", "coin":'),
    "escaped coin again": block(fill()).replace('"coin":', '"co\\u0069n": "x", "coin":'),
    "optional key again": block(fill(dir="x")).replace('"dir":', '"dir": "y", "dir":'),
    "empty optional key again": block(fill(dir="x")).replace('"dir":', '"dir": null, "dir":'),
    "first half": block(fill()).replace("BTC", "\\ud83d"),
    "second half": block(fill()).replace("BTC", "\\uDE00"),
    "halves in the wrong order": block(fill()).replace("BTC", "\\ude00\\ud83d"),
    "half before a backslash": block(fill()).replace("BTC", "\\ud83d\\\\\\ude00"),
    "half in an unknown key": block(fill(), more="x").replace("more", "\\ud800"),
    "blank before colon": block(fill(px=1)).replace('"px":', '"px" :'),
}


def test_broken_lines_become_one_row(spark):
    rows = parse(spark, *BROKEN.values())
    assert [r["line_no"] for r in rows] == list(range(1, len(BROKEN) + 1))
    accepted = [name for name, r in zip(BROKEN, rows, strict=True) if not r["parse_error"]]
    assert accepted == []
    assert all(r["px"] is None and r["block_number"] is None for r in rows)


def test_missing_or_mistyped_key_rejects_the_block(spark):
    cases = []
    for key, value in BASE_FILL.items():
        wrong = 1 if isinstance(value, (str, bool)) else str(value)
        cases += [fill(**{key: None}), BASE_FILL | {key: None}, fill(**{key: wrong})]
        cases += [fill(**{key: {"a": 1}})]
    rows = parse(spark, *[block(fill(), case) for case in cases])
    assert [r["parse_error"] for r in rows] == [True] * len(cases)


def test_optional_keys(spark):
    good, bad = [], []
    for key in ("type", "dir", "cloid", "builderFee", "builder"):
        good += [block(BASE_FILL | {key: None}), block(fill(**{key: "x"}))]
        bad += [block(fill(**{key: 1})), block(fill(**{key: ["x"]}))]
    rows = parse(spark, *good, *bad)
    assert [r["parse_error"] for r in rows] == [False] * len(good) + [True] * len(bad)


def test_unusual_but_valid_lines(spark):
    spaced = json.dumps(json.loads(block(fill())), indent=1).replace("\n", "\t").replace(":", " : ")
    spaced = spaced.replace("T08 : 41 : 0", "T08:41:0")
    escaped = block(fill(coin='a"px":1\\', hash="é\n"))
    nested = block(fill(extra={"px": 1, "fee": [1]}), more=[[1], {"coin": 2}])
    rows = parse(spark, spaced, escaped, nested, block(fill()) + "\r")
    assert [r["parse_error"] for r in rows] == [False] * 4
    pair = block(fill(coin="\U0001f600", hash="\\ud800", feeToken="\\\\ud800"))
    unknown = block(fill(), x=1)[:-1] + ',"x":{"a":1,"a":2}}'
    again = block(fill(more=1)).replace('"more": 1', '"more": 1, "more": 2')
    token = block(fill(coin='":')) + " "
    more = parse(spark, pair, unknown, again, token)
    assert [r["parse_error"] for r in more] == [False] * 4
    assert [more[0][name] for name in ("coin", "hash")] == ["\U0001f600", "\\ud800"]
    assert rows[0]["px"] == 2048.75 and rows[1]["coin"] == 'a"px":1\\'


def test_huge_time_is_kept_raw(spark):
    (row,) = parse(spark, block(fill(time=9_000_000_000_000_000)))
    assert row["time"] is None and row["time_ms"] == 9_000_000_000_000_000


def test_long_block(spark):
    rows = decode.parse_lines(lines(spark, block(*[fill()] * 5000)))
    assert rows.count() == 5000 and rows.filter("parse_error").count() == 0
