"""Chat formatting by prefix-target expansion (native).

A conversation is formatted once; every assistant turn then becomes an example of its own, whose
text is the formatted conversation up to and including that reply and whose loss mask covers the
reply alone. Turns after the last reply make one more example without trainable text, so that the
examples of a conversation hold all of it.

The template marks a turn as ``<|role|>\\n text <|end|>\\n``. Inside texts and roles the backslash
becomes ``\\s`` and every control string, of this template or a common other one, is broken by ``\\k``
after its first character; ``\\n`` inside a role becomes ``\\n``. ``unescape`` reverses all of it.

Defined results: null texts and roles count as empty; turns are ordered by turn, then role, then
text, nulls first, so ties and repeated rows have a fixed order and all stay; a null conversation id
is one conversation; an empty table gives no examples; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings of chat templates, split after the first character.
CONTROL = "(<)(\\||/?s>|</?SYS>>|</SYS>>)|(\\[)(/?INST\\])"
END = "<|end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\s")), CONTROL, "$1$3\\\\k$2$4")


def unescape(text: Column) -> Column:
    """No token of ``escape`` overlaps another, so each can be reversed in turn, the backslash last."""
    return F.replace(F.replace(F.replace(text, F.lit("\\k"), F.lit("")), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, example, text, loss_start, loss_end, is_last: one row per assistant turn, and one for turns after the last.

    ``loss_start`` and ``loss_end`` are code points of ``text``, the end exclusive. One shuffle brings
    a conversation's turns together; offsets are running sums, and the generator emits one prefix at a
    time, so a task never holds more than one formatted conversation.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("body"),
    )
    head = F.concat(F.lit("<|"), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("|>\n"))
    rows = rows.select("*", head.alias("head"), escape(F.col("body")).alias("escaped"))
    rows = rows.withColumn("piece", F.concat("head", "escaped", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    rows = rows.select(
        "conv_id",
        "piece",
        F.row_number().over(order).alias("n"),
        F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("stop"),
        F.length("head").alias("head_chars"),
        F.length("piece").alias("chars"),
        (F.col("role") == "assistant").alias("reply"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "piece", "stop", "head_chars", "chars", "reply"))).alias("t"))
    replies = F.filter(F.col("t"), lambda x: x["reply"])
    last = F.element_at("t", -1)
    marks = F.transform(
        replies,
        lambda x: F.struct(x["stop"].alias("stop"), (x["stop"] - x["chars"] + x["head_chars"]).alias("loss_start"), (x["stop"] - len(END)).alias("loss_end")),
    )
    tail = F.when(last["reply"], F.slice(marks, 1, 0)).otherwise(F.array(F.struct(last["stop"].alias("stop"), last["stop"].alias("loss_start"), last["stop"].alias("loss_end"))))
    formatted = whole.select("conv_id", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), F.concat(marks, tail).alias("marks"))
    each = formatted.select("conv_id", "formatted", F.size("marks").alias("n"), F.posexplode("marks").alias("example", "m"))
    return each.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.substring(F.col("formatted"), F.lit(1), F.col("m.stop").cast("int")).alias("text"),
        F.col("m.loss_start").alias("loss_start"),
        F.col("m.loss_end").alias("loss_end"),
        (F.col("example") == F.col("n") - 1).alias("is_last"),
    )


def read_back(examples_df: DataFrame) -> DataFrame:
    """What the examples of each conversation say: its turns (role, text) and all trainable text, unescaped.

    The last example holds every turn. The turns of a conversation stay in the partition that made
    them, so nothing is shuffled again.
    """
    loss = unescape(F.substring(F.col("text"), (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")))
    parts = examples_df.select(
        "conv_id", "example", loss.alias("loss"), F.when(F.col("is_last"), F.col("text")).alias("whole"), F.length("text").cast("long").alias("chars")
    )
    per = parts.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"), F.element_at(F.collect_list("whole"), 1).alias("whole"), F.sum("chars").alias("formatted_chars")
    )
    # Every turn ends with END and no escaped text contains it; the piece after the last one is empty.
    pieces = F.split(F.col("whole"), "<\\|end\\|>\n", -1)
    turns = F.transform(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        lambda p: F.struct(
            unescape(F.substring_index(F.substring(p, F.lit(3), F.length(p)), "|>\n", 1)).alias("role"),
            unescape(F.substring(p, F.length(F.substring_index(p, "|>\n", 1)) + 4, F.length(p))).alias("text"),
        ),
    )
    return per.select("conv_id", turns.alias("turns"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss_text"), "formatted_chars")


def digests(read: DataFrame) -> DataFrame:
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
