"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted by (turn, role, text); neighbours of one
role become one block of parts. A block reads ``### role``, a line end, its parts with ``</part>`` between, ``</turn>``,
a line end. Inside texts and roles a backslash is doubled and the control strings become ``\\h``, ``\\t``, ``\\p``; a
line end in a role becomes ``\\n``. So no control string stands in a text, and ``read_back`` returns the turns as they were.

``segments`` are the pieces of the formatted text in order, each with its loss mark: true for the texts of
``loss_role`` only, not for roles, separators or ends.

Null text and null role are empty; a null turn sorts first; rows of a null conv_id are one conversation; repeated rows are turns of their own.
A conversation is one row of the result, so it must fit in a row; work grows in proportion to its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, END, PART = "### ", "</turn>\n", "</part>"
#: What stands for each control string inside a text.
ESCAPES = (("###", "\\h"), ("</turn>", "\\t"), ("</part>", "\\p"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "\\n"))


def escape(text: Column, escapes=ESCAPES) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, code in escapes:
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def unescape(text: Column, escapes=ESCAPES) -> Column:
    """Between doubled backslashes each backslash begins a code."""

    def codes(piece: Column) -> Column:
        for plain, code in escapes:
            piece = F.replace(piece, F.lit(code), F.lit(plain))
        return piece

    return F.array_join(F.transform(F.split(text, r"\\\\"), codes), "\\")


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, text) -> one row (conv_id, formatted, segments array<struct<piece, loss>>) per conversation."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("t"))
    begins = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i)["role"] != F.get("t", i - 1)["role"]))
    convs = convs.withColumn("begins", begins)
    blocks = F.transform(
        "begins",
        lambda s, j: F.struct(
            F.get("t", s)["role"].alias("role"),
            F.transform(F.slice("t", s + 1, F.coalesce(F.get("begins", j + 1), F.size("t")) - s), lambda x: x["text"]).alias("parts"),
        ),
    )
    convs = convs.select("conv_id", blocks.alias("blocks"))

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("piece"), loss.alias("loss"))

    def pieces(block: Column) -> Column:
        learned = block["role"] == loss_role
        head = F.array(piece(F.concat(F.lit(HEAD), escape(block["role"], ROLE_ESCAPES), F.lit("\n")), F.lit(False)))
        parts = F.flatten(
            F.transform(
                block["parts"],
                lambda p, i: F.when(i == 0, F.array(piece(escape(p), learned))).otherwise(F.array(piece(F.lit(PART), F.lit(False)), piece(escape(p), learned))),
            )
        )
        return F.concat(head, parts, F.array(piece(F.lit(END), F.lit(False))))

    convs = convs.select("conv_id", F.flatten(F.transform("blocks", pieces)).alias("segments"))
    return convs.select("conv_id", F.array_join(F.transform("segments", lambda s: s["piece"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns in a formatted conversation."""

    def block(b: Column) -> Column:
        cut = F.instr(b, "\n")
        role = unescape(F.substring(b, F.lit(len(HEAD) + 1), cut - len(HEAD) - 1), ROLE_ESCAPES)
        body = F.substring(b, cut + 1, F.length(b))
        return F.transform(F.split(body, PART), lambda p: F.struct(role.alias("role"), unescape(p).alias("text")))

    return F.flatten(F.transform(F.filter(F.split(formatted, END), lambda b: b != ""), block))


def loss_text(segments: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["piece"])), "")
