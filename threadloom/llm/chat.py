"""Chat formatting by prefix-target expansion, with DataFrame functions alone.

Each turn is written as `<|role|>text</s>`, where role and text have their control characters escaped, so that no
control string of the template (or of another one, such as `[INST]`) is left inside them.  Every assistant turn becomes
an example of its own: all the turns before it are its context, and only its text is trainable.  Turns after the last
assistant turn, or a conversation without any, form a closing example with nothing to train on, so no turn is lost.

The examples of a conversation are prefixes of one string.  They are exploded as offsets into it and cut out row by
row, so that a long conversation never holds all its examples at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Escapes, applied in this order and undone in the reverse one.
ESCAPES = [("\\", "\\s"), ("<", "\\l"), ("[", "\\b"), ("|", "\\p")]
OPEN, BAR, END = "<|", "|>", "</s>"
TRAINABLE = "assistant"


def escape(c: Column) -> Column:
    for raw, code in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def prefix_target_examples(turns: DataFrame) -> DataFrame:
    """Per assistant turn of turns(conv_id, turn, role, text): conv_id, example, is_last, formatted, loss_start, loss_end.

    formatted holds the preceding turns and this one; the code points loss_start..loss_end (from 0, end exclusive) are
    trainable.  is_last marks the example that holds the whole conversation; it has an empty loss where it closes
    turns without a reply.  Turns are ordered by turn, then role and text; repeated rows stay.  Null texts and roles
    are empty, rows without a conv_id form one conversation.  Other columns are ignored.  Texts of any length are written
    whole; a conversation is one row until its examples are cut out of it.  An empty table gives an empty result.
    """
    turn = turns.select(
        "conv_id",
        F.struct(
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    whole = (
        turn.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("t")).alias("ts"))
        .select(
            "conv_id",
            F.transform(
                "ts",
                lambda t: F.struct(
                    (t["role"] == TRAINABLE).alias("reply"),
                    F.concat(F.lit(OPEN), escape(t["role"]), F.lit(BAR), escape(t["text"]), F.lit(END)).alias("out"),
                    F.length(escape(t["text"])).alias("n_text"),
                ),
            ).alias("ts"),
        )
        .select("conv_id", "ts", F.array_join(F.transform("ts", lambda t: t["out"]), "").alias("whole"))
    )
    first = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<end:int,n:int>>").alias("at"))
    ends = F.aggregate(
        "ts",
        first,
        lambda a, t: F.struct(
            (a["end"] + F.length(t["out"])).alias("end"),
            F.when(t["reply"], F.concat(a["at"], F.array(F.struct((a["end"] + F.length(t["out"])).alias("end"), t["n_text"].alias("n"))))).otherwise(a["at"]).alias("at"),
        ),
    )
    listed = whole.select("conv_id", "whole", ends.alias("e")).select(
        "conv_id",
        "whole",
        F.col("e.end").alias("total"),
        F.when(
            (F.size("e.at") > 0) & (F.try_element_at("e.at", F.lit(-1))["end"] == F.col("e.end")),
            F.col("e.at"),
        )
        .otherwise(F.concat("e.at", F.array(F.struct(F.col("e.end").alias("end"), F.lit(-1).alias("n")))))
        .alias("at"),
    )
    return listed.select("conv_id", "whole", "total", F.posexplode("at").alias("example", "x")).select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        (F.col("x.end") == F.col("total")).alias("is_last"),
        F.left("whole", F.col("x.end")).alias("formatted"),
        F.when(F.col("x.n") < 0, F.col("x.end")).otherwise(F.col("x.end") - len(END) - F.col("x.n")).cast("long").alias("loss_start"),
        F.when(F.col("x.n") < 0, F.col("x.end")).otherwise(F.col("x.end") - len(END)).cast("long").alias("loss_end"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    parts = F.split(formatted, END)
    body = F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - 1))
    return F.transform(
        body,
        lambda p: F.struct(
            unescape(F.substring_index(F.substring(p, len(OPEN) + 1, 2147483647), BAR, 1)).alias("role"),
            unescape(F.substring(p, F.locate(BAR, p) + len(BAR), F.lit(2147483647))).alias("text"),
        ),
    )


def conversation_digest(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The texts are reduced to the replies and the last example's turns before anything is gathered per conversation.
    """
    turns = F.when(F.col("is_last"), read_turns(F.col("formatted")))
    seen = examples.select(
        "conv_id",
        "example",
        F.length("formatted").cast("long").alias("chars"),
        unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))).alias("loss"),
        F.size(turns).cast("long").alias("n_turns"),
        F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
    )
    loss = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    return (
        seen.groupBy("conv_id")
        .agg(
            F.max(F.when(F.col("turns").isNotNull(), F.col("n_turns"))).alias("n_turns"),
            F.max("turns").alias("turns"),
            loss.alias("loss"),
            F.sum("chars").alias("formatted_chars"),
        )
        .select(
            "conv_id",
            "n_turns",
            F.sha2("turns", 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
