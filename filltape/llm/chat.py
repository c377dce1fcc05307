"""Chat conversations as one training text, from typed content parts.

A turn is a list of parts (text, image, audio, document). A visitor turns each part
into a piece of text: text is escaped, anything else becomes a placeholder whose
attachment reference and expanded token count are recorded. Pieces become turns,
turns become conversations; the loss mask covers the text pieces of the trained role.

``<|turn|>role<|text|>piece piece ...<|end|>`` is one turn. A control string inside a
role or text gets a backslash after its first character (one more if it has some), so
no text can end a turn, and taking one backslash away restores it. Texts that follow one
another are kept apart by ``<|part|>``, so no control string can be put together from
several of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from filltape.llm.common import let

TURN, TEXT, END, NEXT = "<|turn|>", "<|text|>", "<|end|>", "<|part|>"
KINDS = ("image", "audio", "document")
OTHER = "other"
#: Part type of ``format_turns``.
PARTS = (
    "array<struct<kind: string, text: string, ref: string, "
    "width: int, height: int, seconds: double, pages: int>>"
)
#: Own control strings, and those of a common template that must stay harmless too.
_CONTROL = r"(\||/?s>|/?INST\])"
_PATCH, _TOKENS_PER_SECOND, _TOKENS_PER_PAGE = 28, 25, 512


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, "$1$2$3")


def text_part(text: Column) -> Column:
    """A list with one text part."""
    fields = {"kind": F.lit("text"), "text": text}
    others = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    fields |= {name: F.lit(None).cast(kind) for name, kind in others.items()}
    return F.array(F.struct(*(value.alias(name) for name, value in fields.items())))


def _expanded(part: Column) -> Column:
    """Tokens that an attachment stands for; unknown sizes count as 0."""
    image = F.ceil(part["width"] / _PATCH) * F.ceil(part["height"] / _PATCH)
    audio = F.ceil(part["seconds"] * _TOKENS_PER_SECOND)
    pages = part["pages"].cast("long") * _TOKENS_PER_PAGE
    tokens = (
        F.when(part["kind"] == "image", image)
        .when(part["kind"] == "audio", audio)
        .when(part["kind"] == "document", pages)
    )
    return F.greatest(F.coalesce(tokens, F.lit(0)), F.lit(0)).cast("long")


def _visited(part: Column) -> Column:
    """One part as a piece: what is written, and what is recorded beside it."""
    is_text = F.coalesce(part["kind"] == "text", F.lit(False))
    kind = F.when(part["kind"].isin(*KINDS), part["kind"]).otherwise(OTHER)
    piece = F.when(is_text, escaped(F.coalesce(part["text"], F.lit("")))).otherwise(
        F.concat(F.lit("<|"), kind, F.lit("|>"))
    )
    return F.struct(
        piece.alias("piece"),
        F.length(piece).alias("chars"),
        is_text.alias("is_text"),
        F.lit(0).alias("lead"),
        F.when(~is_text, kind).alias("kind"),
        F.when(~is_text, part["ref"]).alias("ref"),
        F.when(~is_text, _expanded(part)).otherwise(F.lit(0).cast("long")).alias("tokens"),
    )


def _parted(pieces: Column) -> Column:
    """Pieces with a mark in front of every text that follows another text."""

    def mark(p: Column, i: Column) -> Column:
        follows = p["is_text"] & F.coalesce(F.get(pieces, i - 1)["is_text"], F.lit(False))
        marked = p.withField("piece", F.concat(F.lit(NEXT), p["piece"])).withField(
            "lead", F.lit(len(NEXT))
        )
        return F.when(follows, marked).otherwise(p)

    return F.transform(pieces, mark)


def _placed(pieces: Column, start: Column) -> Column:
    """Pieces with their first code point, counted from the start of the turn."""
    before = lambda i: F.aggregate(
        F.slice(pieces, 1, i),
        start.cast("long"),
        lambda total, p: total + p["lead"] + p["chars"],
    )
    return F.transform(pieces, lambda p, i: p.withField("at", before(i) + p["lead"]))


def format_turns(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row per conversation from rows ``conv_id, turn, role, parts`` (see ``PARTS``).

    Returns ``conv_id, n_turns, formatted, loss_spans`` (start and length in code points,
    each a text part of the trained role), ``attachments`` (kind, reference, position of
    the placeholder, expanded tokens; in order) and ``attached_tokens``.

    Turns are ordered by number; equal numbers by role and content, so repeated rows stay
    and are ordered the same way everywhere. Defined results: a null role or text is
    empty, null parts are an empty list, parts of unknown kind become ``<|other|>``, a null
    turn comes first, and rows with a null ``conv_id`` form one conversation; other columns
    are ignored; no rows give no conversations. One conversation is one example and must
    fit into a task.
    """
    none = F.array().cast(PARTS)
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        let(
            F.transform(
                F.filter(F.coalesce(F.col("parts").cast(PARTS), none), lambda p: p.isNotNull()),
                _visited,
            ),
            _parted,
        ).alias("pieces"),
    )
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT))
    body = F.array_join(F.transform("pieces", lambda p: p["piece"]), "")
    rows = rows.select(
        "conv_id",
        "turn",
        "role",
        F.concat(head, body, F.lit(END)).alias("chunk"),
        let(F.col("pieces"), lambda pieces: _placed(pieces, F.length(head))).alias("pieces"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "chunk")
    rows = rows.select(
        "conv_id",
        F.row_number().over(order).alias("place"),
        F.coalesce(
            F.sum(F.length("chunk")).over(order.rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("offset"),
        "role",
        "chunk",
        "pieces",
    )
    spans = F.transform(
        F.filter("pieces", lambda p: p["is_text"] & (F.col("role") == trained)),
        lambda p: F.struct(
            (F.col("offset") + p["at"]).alias("start"), p["chars"].cast("long").alias("length")
        ),
    )
    attached = F.transform(
        F.filter("pieces", lambda p: ~p["is_text"]),
        lambda p: F.struct(
            p["kind"].alias("kind"),
            p["ref"].alias("ref"),
            (F.col("offset") + p["at"]).alias("position"),
            p["tokens"].alias("tokens"),
        ),
    )
    turn = F.struct("place", "chunk", spans.alias("spans"), attached.alias("attached"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    flat = lambda field: F.flatten(F.transform("turns", lambda t: t[field]))
    return whole.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["chunk"]), "").alias("formatted"),
        flat("spans").alias("loss_spans"),
        flat("attached").alias("attachments"),
    ).withColumn(
        "attached_tokens",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda total, a: total + a["tokens"]),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: role, and the texts between placeholders and marks."""
    chunks = F.filter(F.split(formatted, r"<\|turn\|>"), lambda chunk: chunk != "")
    placeholder = r"<\|(?:" + "|".join((*KINDS, OTHER, "part")) + r")\|>"
    return F.transform(
        chunks,
        lambda chunk: F.struct(
            unescaped(F.substring_index(chunk, TEXT, 1)).alias("role"),
            F.transform(
                F.split(
                    F.substring_index(F.substring_index(chunk, TEXT, -1), END, 1), placeholder
                ),
                unescaped,
            ).alias("texts"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: unescaped(
                F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))
            ),
        ),
        "",
    )
