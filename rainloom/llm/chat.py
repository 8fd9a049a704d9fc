r"""Relational chat formatting: one string per conversation, with a loss mask, readable back without loss.

Template. A block is ``<turn:ROLE>`` text ``</turn>`` and a line feed; adjacent turns of one role share a block,
with ``<part>`` between their texts. Inside texts and roles a backslash is written ``\s`` and ``<`` is written
``\l`` (``>`` in roles ``\g``), so no control string can come out of a text and every escape is reversible.

All of it is DataFrame functions: turns are collected as structs, sorted, merged and concatenated by array
expressions. The text of a conversation is one value of the result, so its turns do meet in one task.

Defined cases: null text and null role count as empty, null turns sort first, equal turns are ordered by role
and text, rows with a null conv_id make one conversation, an empty table gives an empty result, further columns
are ignored. Escaping and reading back are exact for any text, very long ones included. Work is in proportion to
a conversation's length: places come from sums over runs of RUN turns, texts under the mask are read by bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The role whose texts are under the loss mask.
LOSS_ROLE = "assistant"
#: Turns whose places are summed together.
RUN = 128


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def _role_escaped(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(">"), F.lit("\\g"))


def _role_unescaped(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\g"), F.lit(">")))


def format_conversations(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """conv_id, formatted, loss_spans array<struct<start, size, first_byte, bytes>> in code points and in UTF-8 bytes of formatted."""
    rows = turns.select(
        "conv_id",
        F.struct(
            "turn",
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("said"),
    )
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))

    def piece(one: Column, at: Column) -> Column:
        role = _role_escaped(one["role"])
        same = (at > 0) & F.coalesce(F.get(F.col("said"), at - 1)["role"] == one["role"], F.lit(False))
        head = (
            F.when(same, F.lit("<part>"))
            .when(at > 0, F.concat(F.lit("</turn>\n<turn:"), role, F.lit(">")))
            .otherwise(F.concat(F.lit("<turn:"), role, F.lit(">")))
        )
        return F.struct(head.alias("head"), escaped(one["text"]).alias("body"), (one["role"] == loss_role).alias("loss"))

    def measured(p: Column) -> Column:
        return F.struct(
            F.length(p["head"]).cast("long").alias("head"),
            F.length(p["body"]).cast("long").alias("body"),
            F.octet_length(p["head"]).cast("long").alias("head_bytes"),
            F.octet_length(p["body"]).cast("long").alias("body_bytes"),
            p["loss"].alias("loss"),
        )

    pieces = talks.select("conv_id", F.transform("said", piece).alias("pieces"))
    done = pieces.select(
        "conv_id",
        F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), ""), F.lit("</turn>\n")).alias("formatted"),
        F.transform("pieces", measured).alias("sizes"),
    )
    return done.select("conv_id", "formatted", _spans("sizes").alias("loss_spans"))


def _spans(sizes: str) -> Column:
    """Spans of the bodies under the mask: places within each run of RUN pieces, then moved by the sums of the runs before."""
    place = "struct<at: bigint, at_byte: bigint, spans: array<struct<start: bigint, size: bigint, first_byte: bigint, bytes: bigint>>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("at_byte"), F.array().alias("spans")).cast(place)

    def step(seen: Column, p: Column) -> Column:
        at, at_byte = seen["at"] + p["head"], seen["at_byte"] + p["head_bytes"]
        span = F.struct(at.alias("start"), p["body"].alias("size"), at_byte.alias("first_byte"), p["body_bytes"].alias("bytes"))
        return F.struct(
            (at + p["body"]).alias("at"),
            (at_byte + p["body_bytes"]).alias("at_byte"),
            F.when(p["loss"], F.array_append(seen["spans"], span)).otherwise(seen["spans"]).alias("spans"),
        )

    starts = F.sequence(F.lit(1), F.size(sizes), F.lit(RUN))
    runs = F.transform(starts, lambda k: F.aggregate(F.slice(sizes, k, F.lit(RUN)), start, step))

    def moved(seen: Column, run: Column) -> Column:
        shifted = F.transform(
            run["spans"],
            lambda s: F.struct(
                (s["start"] + seen["at"]).alias("start"), s["size"].alias("size"), (s["first_byte"] + seen["at_byte"]).alias("first_byte"), s["bytes"].alias("bytes")
            ),
        )
        return F.struct(
            (seen["at"] + run["at"]).alias("at"),
            (seen["at_byte"] + run["at_byte"]).alias("at_byte"),
            F.array_append(seen["runs"], shifted).alias("runs"),
        )

    nested = "struct<at: bigint, at_byte: bigint, runs: array<array<struct<start: bigint, size: bigint, first_byte: bigint, bytes: bigint>>>>"
    none = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("at_byte"), F.array().alias("runs")).cast(nested)
    return F.flatten(F.aggregate(runs, none, moved, lambda seen: seen["runs"]))


def parse_formatted(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>, one for each original turn."""
    blocks = F.filter(F.split(formatted, "</turn>\n"), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        role = _role_unescaped(F.substring_index(F.substring_index(block, ">", 1), "<turn:", -1))
        body = F.substr(block, F.instr(block, F.lit(">")) + 1)
        return F.transform(F.split(body, "<part>"), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns_of))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    # The one-element array makes the bytes a bound variable, so that they are taken once and not for each span.
    masked = F.transform(
        F.array(formatted.cast("binary")),
        lambda raw: F.array_join(
            F.transform(spans, lambda s: unescaped(F.substring(raw, (s["first_byte"] + 1).cast("int"), s["bytes"].cast("int")).cast("string"))), ""
        ),
    )
    return masked[0]
