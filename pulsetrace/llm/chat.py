"""Chat formatting: one training example per assistant turn, with all earlier turns as context.

A turn is rendered ``<|role|>text</s>``. Inside roles and texts ``&``, ``<``, ``[`` and ``|``
are written as entities, so no control string (``</s>``, ``[INST]``, ``<|user|>``) of a text
is ever one of the template, and ``unescape`` gives the text back.

Only the escaped reply of an example's own turn lies under the loss mask. A conversation
that does not end with an assistant turn also gives one example without a mask, so
that the output holds every turn.

Defined cases: null or empty text and role read back as empty; a null ``conv_id`` is one
conversation; rows of one turn number are ordered by role, then text; repeated rows stay repeated;
a table without rows gives no examples; other columns are ignored.

Scale: a conversation is gathered into one row because an example is one string that holds all
of it. The prefixes of a conversation grow with the square of its turns; they are made one
after the other from the gathered row and never shuffled.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("|", "&#124;"))
OPEN, SHUT, END = "<|", "|>", "</s>"
TRAINABLE = "assistant"


def escape(text: Column) -> Column:
    for raw, entity in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for raw, entity in reversed(ESCAPES):
        text = F.replace(text, F.lit(entity), F.lit(raw))
    return text


def format_examples(conversations: DataFrame, trainable: str = TRAINABLE) -> DataFrame:
    """(conv_id, target, formatted, loss_start, loss_end): offsets in code points, end exclusive.

    ``target`` is the position of the trainable turn; an example without one has the number
    of turns there and an empty mask.
    """
    role, text = (escape(F.coalesce(c, F.lit(""))) for c in ("role", "text"))
    turns = conversations.select(
        "conv_id",
        F.struct(
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            text.alias("body"),
            F.concat(F.lit(OPEN), role, F.lit(SHUT), text, F.lit(END)).alias("rendered"),
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    places = F.sequence(F.lit(0), F.size("turns") - 1)
    targets = F.filter(places, lambda i: F.get("turns", i)["role"] == trainable)
    rest = F.when(F.element_at("turns", -1)["role"] != trainable, F.array(F.size("turns")))
    each = whole.select(
        "conv_id", "turns",
        F.explode(F.concat(targets, F.coalesce(rest, F.expr("array()")))).alias("target"),
    )
    shown = F.slice("turns", F.lit(1), F.least(F.col("target") + 1, F.size("turns")))
    reply = F.coalesce(F.length(F.get("turns", F.col("target"))["body"]), F.lit(0))
    made = each.select(
        "conv_id", "target",
        F.array_join(F.transform(shown, lambda t: t["rendered"]), "").alias("formatted"),
        reply.alias("reply"),
        (F.col("target") < F.size("turns")).alias("trained"),
    )
    end = F.when(F.col("trained"), F.length("formatted") - len(END)).otherwise(0)
    return made.select(
        "conv_id", "target", "formatted",
        (end - F.col("reply")).alias("loss_start"), end.alias("loss_end"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted example."""
    pieces = F.split(formatted, END)
    return F.transform(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), SHUT, 1)).alias("role"),
            unescape(
                F.substr(p, F.locate(SHUT, p) + len(SHUT))
            ).alias("text"),
        ),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation, read from the examples alone.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars (of all examples).
    """
    span = F.substr("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    per_conversation = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "target").alias("last"),
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("target", unescape(span).alias("loss")))),
                lambda x: x["loss"],
            ),
            "",
        ).alias("loss"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    turns = read_turns(F.col("last"))
    lines = F.array_join(
        F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return per_conversation.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
