"""Chat formatting: typed content parts, a reversible template and a loss mask.

A message is (conversation, turn, role, parts); a part is ``struct<kind, text, ref, units>``.
:func:`flatten_parts` visits the parts in order: text passes through escaped, images, audio and
documents become one numbered placeholder each, their references are recorded with the number
of tokens the placeholder expands to. :func:`format_conversations` lays the messages out with
control strings and records which code points carry loss. :func:`read_turns` and
:func:`read_loss` read both back from the output.

Everything here is DataFrame functions. Defined results: a null role or text is empty; a null
or empty list of parts is an empty message; equal turns are ordered by role, then text, so
repeated rows all stay; rows with a null conversation form one conversation.

A conversation is one output string, so its size bounds the task that builds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Strings with a meaning in the template. Inside texts they get one backslash more in front.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<image>", "<audio>", "<document>")
OPEN, HEAD, TAIL = "<s>[INST] ", " [/INST] ", " </s>"
#: Tokens that one unit of a part expands to: image tile, audio second, document page.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}

_ANY = "|".join(c.replace("[", r"\[").replace("]", r"\]") for c in CONTROL)
_ESCAPE = rf"(\\*(?:{_ANY}))"
_UNESCAPE = rf"\\(\\*(?:{_ANY}))"
_OPEN_AT = r"(?<!\\)<s>\[INST\] "
_HEAD_AT = r" \[/INST\] "

PART = "struct<kind:string,text:string,ref:string,units:bigint>"


def escape(text: Column) -> Column:
    """Control strings, with any backslashes before them, get one backslash more."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _ESCAPE, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1")


def text_parts(text: Column) -> Column:
    """A plain message: one text part."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"),
            F.coalesce(text, F.lit("")).alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("bigint").alias("units"),
        )
    )


def flatten_parts(parts: Column) -> Column:
    """``struct<body, attachments>``: the escaped text with placeholders, and what they stand for.

    The visitor keeps the order of parts. A part of an unknown kind counts as text; a missing
    number of units counts as one. Parts are joined by a newline, which keeps the end of one and
    the start of the next from forming a control string. An attachment is ``struct<index, kind, ref, tokens>``.
    """
    parts = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    kinds = tuple(TOKENS_PER_UNIT)

    def visit(p: Column) -> Column:
        spoken = escape(p["text"])
        return F.when(p["kind"].isin(*kinds), F.concat(F.lit("<"), p["kind"], F.lit(">"))).otherwise(
            spoken
        )

    def tokens(p: Column) -> Column:
        per = F.coalesce(*[F.when(p["kind"] == k, F.lit(n)) for k, n in TOKENS_PER_UNIT.items()])
        return F.greatest(F.coalesce(p["units"], F.lit(1)), F.lit(0)) * per

    attached = F.filter(parts, lambda p: p["kind"].isin(*kinds))
    return F.struct(
        F.array_join(F.transform(parts, visit), "\n").alias("body"),
        F.transform(
            attached,
            lambda p, i: F.struct(
                i.cast("bigint").alias("index"),
                p["kind"].alias("kind"),
                p["ref"].alias("ref"),
                tokens(p).cast("bigint").alias("tokens"),
            ),
        ).alias("attachments"),
    )


def format_conversations(
    messages: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    parts: str = "parts",
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: ``formatted``, its ``loss`` spans and its attachments.

    A span is ``struct<start, end>`` in code points of ``formatted``, end exclusive, one for each
    message of ``loss_role``. Starts are running sums over the conversation, so each message
    is laid out on its own and the fold over turns is a sort by start.
    """
    rows = messages.select(
        F.col(conversation).alias("id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        flatten_parts(F.col(parts)).alias("flat"),
    ).select(
        "id",
        "turn",
        "role",
        "flat.*",
        F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(HEAD)).alias("lead"),
    )
    chars = F.length("lead") + F.length("body") + len(TAIL)
    order = Window.partitionBy("id").orderBy("turn", "role", "body")
    upto = F.sum(chars.cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    laid = rows.withColumn("start", upto - chars)
    turns = F.array_sort(
        F.collect_list(F.struct("start", "role", "lead", "body", "attachments"))
    ).alias("turns")

    def span(t: Column) -> Column:
        begin = t["start"] + F.length(t["lead"])
        return F.struct(begin.alias("start"), (begin + F.length(t["body"])).alias("end"))

    return (
        laid.groupBy("id")
        .agg(turns)
        .select(
            F.col("id").alias(conversation),
            F.array_join(
                F.transform("turns", lambda t: F.concat(t["lead"], t["body"], F.lit(TAIL))), ""
            ).alias("formatted"),
            F.transform(F.filter("turns", lambda t: t["role"] == loss_role), span).alias("loss"),
            F.flatten(
                F.transform(
                    "turns",
                    lambda t, i: F.transform(
                        t["attachments"], lambda a: a.withField("message", i.cast("bigint"))
                    ),
                )
            ).alias("attachments"),
        )
    )


def read_turns(formatted: Column) -> Column:
    """``array<struct<role, text>>`` read back from the formatted string alone."""
    turns = F.filter(F.split(formatted, _OPEN_AT), lambda x: x != "")

    def parse(x: Column) -> Column:
        halves = F.split(x, _HEAD_AT, 2)
        body = halves[1]
        return F.struct(
            unescape(halves[0]).alias("role"),
            unescape(F.left(body, F.length(body) - len(TAIL))).alias("text"),
        )

    return F.transform(turns, parse)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss spans, unescaped, in order.

    They are cut from the UTF-32 form, where a code point has four bytes and a cut costs its
    own length only.
    """
    wide = F.encode(formatted, "UTF-32")

    def cut(s: Column) -> Column:
        at, chars = s["start"] * 4 + 1, (s["end"] - s["start"]) * 4
        return unescape(F.decode(F.substring(wide, at.cast("int"), chars.cast("int")), "UTF-32"))

    return F.transform(spans, cut)
