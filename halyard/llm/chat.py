"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes one example: all turns before it are the context
and only its own text is trainable. Turns that no assistant turn follows would
be in no example, so a conversation that ends in them gets one more example,
without a target.

The template is ChatML. Inside texts each ``<``, ``[`` and backslash gets a
backslash after it, so no control string that starts with ``<`` or ``[`` can be
spelled by a text, and dropping those backslashes gives the text back.

Defined results
    null text: empty; null role: empty; null turn: before all others; equal
    turns: by role, then text, repeated rows kept; null conv_id: a conversation
    of its own; an empty table: no rows; further columns: left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def escape_role(role: Column) -> Column:
    """As for texts; a line feed, which ends the role, becomes ``<n``."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<n"), F.lit("\n")))


def format_examples(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per example: conv_id, example, is_last, formatted, loss_start, loss_chars.

    formatted is the whole example; its characters from loss_start (from 0),
    loss_chars of them, are the trainable reply. loss_start is null in an
    example without a target.
    """
    head = F.concat(F.lit(START), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    body = escape(F.coalesce("text", F.lit("")))
    one = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
            head.alias("head"),
            body.alias("body"),
        ).alias("t"),
    )
    conv = one.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    n = F.size("ts")
    targets = F.filter(
        F.sequence(F.lit(1), n), lambda i: (F.element_at("ts", i)["role"] == TRAINED_ROLE) | (i == n)
    )
    ex = conv.select("conv_id", "ts", F.posexplode(targets).alias("example", "k"))
    last = F.element_at("ts", F.col("k"))
    whole = lambda t: F.concat(t["head"], t["body"], F.lit(END))
    context = F.array_join(F.transform(F.slice("ts", F.lit(1), F.col("k") - 1), whole), "")
    trained = last["role"] == TRAINED_ROLE
    ex = ex.select(
        "conv_id", "example", (F.col("k") == F.size("ts")).alias("is_last"),
        F.concat(context, last["head"]).alias("context"),
        last["body"].alias("body"), trained.alias("trained"),
    )
    return ex.select(
        "conv_id", "example", "is_last",
        F.concat("context", "body", F.lit(END)).alias("formatted"),
        F.when(F.col("trained"), F.char_length("context")).alias("loss_start"),
        F.when(F.col("trained"), F.char_length("body")).otherwise(0).alias("loss_chars"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of an example as array<struct<role, text>>, unescaped."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")

    def turn(p: Column) -> Column:
        cut = F.instr(p, "\n")
        text = F.substring(p, cut + 1, F.char_length(p) - cut - len(END))
        return F.struct(unescape_role(F.substring(p, F.lit(1), cut - 1)).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def read_loss(formatted: Column, start: Column, chars: Column) -> Column:
    """The text under an example's loss mask, unescaped; empty without a target."""
    return F.when(start.isNull(), F.lit("")).otherwise(unescape(F.substring(formatted, start + 1, chars)))


def digest(examples: DataFrame) -> DataFrame:
    """What the examples hold, read back from them: one row per conversation."""
    read = examples.select(
        "conv_id", "example", F.char_length("formatted").cast("long").alias("chars"),
        read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("loss"),
        F.when(F.col("is_last"), read_turns(F.col("formatted"))).alias("turns"),
    )
    read = read.select(
        "conv_id", "example", "chars", "loss", F.size("turns").cast("long").alias("n"),
        F.sha2(
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
            .cast("binary"), 256,
        ).alias("sha"),
    )
    out = read.groupBy("conv_id").agg(
        F.max("n").alias("n_turns"),
        F.max("sha").alias("turns_sha256"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda s: s["loss"]), ""
        ).alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return out.select(
        "conv_id", "n_turns", "turns_sha256",
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
