"""Block lines to fills.

A line is one JSON block: ``local_time``, ``block_time``, ``block_number`` and
``events``, a list of ``[address, fill]`` pairs. A block is taken whole or not
at all: one unreadable fill rejects its line, and the rejected line stays as
one row with ``parse_error`` set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filltape.functions import (
    ascii_upper,
    double_sql,
    epoch_ms_to_time,
    iso_to_time,
    trim_white,
)
from filltape.sources.hours import key_hour_start

# JSON keys of a block and of a fill.
TEXT_KEYS = ["coin", "px", "sz", "side", "startPosition", "closedPnl", "hash", "fee", "feeToken"]
OPTIONAL_KEYS = ["type", "dir", "cloid", "builderFee", "builder"]
WHOLE_KEYS = ["time", "oid", "tid"]
FLAG_KEYS = ["crossed"]
NUMBER_KEYS = ["px", "sz", "startPosition", "closedPnl", "fee"]
ENVELOPE_TEXT_KEYS = ["local_time", "block_time"]
ENVELOPE_KEYS = [*ENVELOPE_TEXT_KEYS, "block_number", "events"]
FILL_KEYS = [*TEXT_KEYS, *OPTIONAL_KEYS, *WHOLE_KEYS, *FLAG_KEYS]

# Fixed value: a position has to grow by more than this to count as growing.
GAINING_EPSILON = 1e-12

_JSON = {"allowNonNumericNumbers": "false", "allowSingleQuotes": "false"}
_FILL_TYPE = ", ".join(
    [f"`{k}` string" for k in TEXT_KEYS + OPTIONAL_KEYS]
    + [f"`{k}` bigint" for k in WHOLE_KEYS]
    + [f"`{k}` boolean" for k in FLAG_KEYS]
)
_BLOCK_TYPE = (
    "block struct<local_time: string, block_time: string, block_number: bigint,"
    " events: array<array<string>>>, tail int"
)


def _parse_block(line: Column) -> Column:
    # from_json stops after the first value. Putting the line inside an object
    # and asking for a key behind it exposes anything that trails the block.
    wrapped = F.concat(F.lit('{"block":'), line, F.lit(',"tail":1}'))
    return F.from_json(wrapped, _BLOCK_TYPE, _JSON)


def _one_value(line: Column) -> Column:
    """Whether a line is one JSON value, and not a list of them or the inside of an object."""
    inside = F.json_array_length(F.concat(F.lit("["), line, F.lit("]")))
    return F.coalesce(inside == 1, F.lit(False))


def _maybe_mistyped(line: Column) -> Column:
    """Whether a text key might hold something other than text.

    ``from_json`` reads any value into a string, so a bare ``"px":1`` would pass.
    One regular expression over the line proves the usual block clean; an escape
    could hide a key from it, so a line with a backslash is never proven.
    """
    keys = "|".join(TEXT_KEYS + OPTIONAL_KEYS + ENVELOPE_TEXT_KEYS)
    # One scan over the line that stops at three characters only and looks around there.
    bare_value = rf'(?<=:)(?=\s*+[^"\sn])(?<="(?:{keys})":)'
    blank_before_colon = r"(?<=\s:)"
    bare_address = r'(?<=\[)(?=\s*+[^"\s\[\]])'
    escape = r"(?<=\\)"
    return line.rlike(rf"[:\[\\](?:{bare_value}|{blank_before_colon}|{bare_address}|{escape})")


def _kind(value: str, path: str) -> str:
    return f"schema_of_variant(try_variant_get({value}, '{path}', 'variant'))"


def _typed_exactly() -> Column:
    """The exact check behind :func:`_maybe_mistyped`, on the JSON types of each value."""
    pair = [f"{_kind('pair', '$[0]')} = 'STRING'", f"startswith({_kind('pair', '$[1]')}, 'OBJECT')"]
    pair += [f"{_kind('pair', f'$[1].{key}')} = 'STRING'" for key in TEXT_KEYS]
    pair += [
        f"coalesce({_kind('pair', f'$[1].{key}')}, 'VOID') IN ('STRING', 'VOID')"
        for key in OPTIONAL_KEYS
    ]
    block = "try_parse_json(line)"
    events = f"try_variant_get({block}, '$.events', 'array<variant>')"
    whole = [f"forall({events}, pair -> coalesce({' AND '.join(pair)}, false))"]
    whole += [f"{_kind(block, f'$.{key}')} = 'STRING'" for key in ENVELOPE_TEXT_KEYS]
    return F.expr(f"coalesce({' AND '.join(whole)}, false)")


def _read_events() -> Column:
    """The pairs of a block as structs ``address, raw, width``."""
    options = ", ".join(f"'{key}', '{value}'" for key, value in _JSON.items())
    raw = f"from_json(get(pair, 1), '{_FILL_TYPE}', map({options}))"
    pair = f"named_struct('address', get(pair, 0), 'raw', {raw}, 'width', size(pair))"
    return F.expr(f"transform(parsed.block.events, pair -> {pair})")


def _read_numbers() -> Column:
    """The same structs, with the number texts as numbers."""
    fields = [f"'{name}', fill.{name}" for name in ("address", "raw", "width")]
    fields += [f"'{key}', {double_sql(f'fill.raw.{key}')}" for key in NUMBER_KEYS]
    return F.expr(f"transform(fills, fill -> named_struct({', '.join(fields)}))")


def _complete() -> Column:
    """Whether the envelope and every fill have all they need."""
    needed = [f"fill.raw.{key}" for key in TEXT_KEYS + WHOLE_KEYS + FLAG_KEYS]
    needed += [f"fill.{key}" for key in ["address", *NUMBER_KEYS]]
    fill = " AND ".join(["fill.width = 2"] + [f"{name} IS NOT NULL" for name in needed])
    envelope = ["tail", "block.local_time", "block.block_time", "block.block_number"]
    whole = [f"parsed.{name} IS NOT NULL" for name in envelope]
    whole.append(f"forall(fills, fill -> coalesce({fill}, false))")
    return F.expr(f"coalesce({' AND '.join(whole)}, false)")


def _lone_surrogate(line: Column) -> Column:
    """Whether an escape stands for one half of a character without the other.

    Escaped backslashes and whole pairs are taken out first; only lines with such an
    escape go through that.
    """
    half = r"\\u[dD][89a-fA-F]"
    pair = r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}"
    rest = F.regexp_replace(F.regexp_replace(line, r"\\\\", "_"), pair, "_")
    escaped = F.contains(line, F.lit("\\u")) & line.rlike(half)
    return F.when(escaped, rest.rlike(half)).otherwise(F.lit(False))


def _all_keys() -> Column:
    """Keys of the envelope and of every fill, null if they are exactly those that were read.

    Every member of an object has one ``":`` in the text (a blank between the two is found
    by :func:`_maybe_mistyped`). If there are no more of them than values read, no key can
    occur twice and none is unknown, and nothing is parsed again. A block that lacks a
    required value is rejected anyway, so only the optional ones are counted.
    """
    colons = """octet_length(line) - octet_length(replace(line, '":', '"'))"""
    read = " + ".join(f"if(fill.raw.{key} IS NULL, 0, 1)" for key in OPTIONAL_KEYS)
    required = len(FILL_KEYS) - len(OPTIONAL_KEYS)
    read = f"{len(ENVELOPE_KEYS)} + aggregate(fills, 0, (n, fill) -> n + {required} + {read})"
    keys = (
        "named_struct('envelope', json_object_keys(line), 'fills', "
        "transform(parsed.block.events, pair -> json_object_keys(get(pair, 1))))"
    )
    return F.expr(f"CASE WHEN coalesce({colons} = {read}, false) THEN NULL ELSE {keys} END")


def _repeated(keys: str) -> Column:
    """Whether a key of the format comes twice in the envelope or in one fill."""

    def twice(found: str, known: list[str]) -> str:
        listed = f"array({', '.join(map(repr, known))})"
        return (
            f"size(filter({found}, key -> array_contains({listed}, key)))"
            f" <> size(array_intersect({found}, {listed}))"
        )

    fills = f"exists({keys}.fills, fill -> {twice('fill', FILL_KEYS)})"
    envelope = twice(f"{keys}.envelope", ENVELOPE_KEYS)
    return F.expr(f"CASE WHEN {keys} IS NULL THEN false ELSE coalesce({envelope} OR {fills}, false) END")


def decode_blocks(lines: DataFrame) -> DataFrame:
    """Replace ``line`` by ``block``, ``fills``, ``parse_error`` and ``keys`` in a frame ``(key, line)``.

    ``fills`` is an array, so the whole-block rule is one ``forall`` before the
    rows fan out and nothing has to be shuffled. What all fills of a block share
    is worked out once per block. ``keys`` holds all keys of the envelope and of each fill
    where there may be others than those of the format.
    """
    line = F.col("line")
    block = F.struct(
        iso_to_time(F.col("parsed.block.block_time")).alias("block_time"),
        F.col("parsed.block.block_number").alias("block_number"),
        iso_to_time(F.col("parsed.block.local_time")).alias("local_time"),
    )
    typed = F.when(_maybe_mistyped(line), _typed_exactly()).otherwise(F.lit(True))
    kept = [name for name in lines.columns if name != "line"]
    return (
        lines.withColumn("parsed", _parse_block(line))
        .withColumn("fills", _read_events())
        .withColumn("fills", _read_numbers())
        .withColumn("keys", _all_keys())
        .select(
            *kept,
            "fills",
            "keys",
            (
                ~(_complete() & typed & _one_value(line))
                | _repeated("keys")
                | _lone_surrogate(line)
            ).alias("parse_error"),
            block.alias("block"),
            key_hour_start(F.col("key")).alias("hour_start"),
        )
    )


def is_buy(side: Column) -> Column:
    return side == "B"


def fill_type(explicit: Column, coin: Column) -> Column:
    """The given market type in capitals, else ``SPOT`` for an ``@`` coin and ``PERP`` otherwise."""
    given = F.nullif(ascii_upper(trim_white(explicit)), F.lit(""))
    return F.coalesce(given, F.when(F.startswith(coin, F.lit("@")), "SPOT").otherwise("PERP"))


def is_gaining_inventory(start_position: Column, sz: Column, buy: Column) -> Column:
    """Whether the fill moves the position away from zero. False for NaN."""
    after = start_position + F.when(buy, sz).otherwise(-sz)
    grows = F.abs(after) > F.abs(start_position) + F.lit(GAINING_EPSILON)
    return grows & ~F.isnan(start_position) & ~F.isnan(after)


# Times outside this range cannot be stored; they are never valid either.
_STORABLE_MS = 9_223_372_036_854


def explode_fills(blocks: DataFrame, *keep: str) -> DataFrame:
    """One row per fill of every block, plus one row per rejected line.

    ``keep`` names columns to carry along. ``time_ms`` is the raw instant; ``time``
    is NULL where it cannot be stored. ``hour_start`` is the hour of the source object.
    """
    good = F.when(~F.col("parse_error"), F.col("fills"))
    # A rejected line keeps one row, an empty block keeps none.
    rows = blocks.select(
        *keep,
        "hour_start",
        "parse_error",
        F.when(~F.col("parse_error"), F.col("block")).alias("block"),
        F.posexplode_outer(good).alias("event_pos", "event"),
    ).filter(F.col("parse_error") | F.col("event").isNotNull())

    raw = {key: F.col(f"event.raw.{key}") for key in ("coin", "side", "time", "type")}
    start, sz, buy = F.col("event.startPosition"), F.col("event.sz"), is_buy(raw["side"])
    kind = F.when(raw["coin"].isNotNull(), fill_type(raw["type"], raw["coin"]))
    storable = raw["time"].between(-_STORABLE_MS, _STORABLE_MS)
    return rows.select(
        *keep,
        "hour_start",
        "parse_error",
        raw["time"].alias("time_ms"),
        F.when(storable, epoch_ms_to_time(raw["time"])).alias("time"),
        "block.block_time",
        "block.block_number",
        "event.address",
        "event.raw.coin",
        kind.alias("type"),
        "event.px",
        "event.sz",
        buy.alias("is_buy"),
        start.alias("start_position"),
        is_gaining_inventory(start, sz, buy).alias("is_gaining_inventory"),
        F.col("event.closedPnl").alias("closed_pnl"),
        "event.raw.hash",
        "event.raw.oid",
        "event.raw.crossed",
        "event.fee",
        "event.raw.tid",
        F.col("event.raw.feeToken").alias("fee_token"),
        "event.raw.cloid",
        F.col("event.raw.builderFee").alias("builder_fee"),
        "event.raw.builder",
        "block.local_time",
        F.col("event_pos").cast("bigint").alias("event_pos"),
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """Fills and rejected lines of a frame ``(key, line_no, line)``."""
    return explode_fills(decode_blocks(lines), "key", "line_no")


def unknown_keys(lines: DataFrame) -> DataFrame:
    """How many accepted blocks and fills carry each key that is not part of the format.

    The keys come from the parse that decides on the block; there is no other.
    """
    blocks = decode_blocks(lines).filter(~F.col("parse_error") & F.col("keys").isNotNull())
    extra = blocks.select(
        F.array_except("keys.envelope", F.lit(ENVELOPE_KEYS)).alias("envelope"),
        F.flatten(
            F.transform("keys.fills", lambda fill: F.array_except(fill, F.lit(FILL_KEYS)))
        ).alias("fill"),
    )
    return (
        extra.select(F.explode(F.create_map(F.lit("envelope"), "envelope", F.lit("fill"), "fill")))
        .select(F.col("key").alias("kind"), F.explode("value").alias("key"))
        .groupBy("kind", "key")
        .agg(F.count("*").alias("n"))
    )
