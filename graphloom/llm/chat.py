"""Chat formatting by prefix-target expansion.

Each assistant turn becomes an example of its own: all turns before it as context, and only its
reply under the loss mask.  Turns after the last reply (or a conversation without one) become one
more example without trainable text, so that the output holds every turn.

The template is ``<turn>ROLE`` line end ``TEXT</turn>`` line end.  Inside roles and texts a
backslash, the template's two marks and (in roles) the line end are written as escapes, so marks in
a text never read as marks, and unescaping gives the text back exactly.

The mask is a span of code points, [loss_start, loss_end), of the example's text.  A conversation is
put together once in one row (at most 2 GB of text); its examples are prefixes of it, cut row by row
after the explode, so one example at a time is in memory; their total length grows with the number
of replies times the length, as the method has it.  Reading back is by conv_id again and keeps the
rows where they are: no second shuffle.

Null roles and texts are empty.  Turns stand by number, null first, then role, then text; repeated
rows are turns each.  A null conv_id is one conversation.  An empty table has no examples.  Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>\n"
#: What is escaped, and as what; the backslash goes first.
ESCAPES = [("\\", "\\\\"), ("<turn", "\\o"), ("</turn", "\\c")]
TARGET = "assistant"


def escaped(text: Column, line: bool = False) -> Column:
    """The text without the template's marks; with line, without line ends too."""
    for raw, code in [*ESCAPES, *([("\n", "\\n")] if line else [])]:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescaped(text: Column, line: bool = False) -> Column:
    """The inverse: between pairs of backslashes, each backslash begins an escape."""

    def plain(piece: Column) -> Column:
        for raw, code in [*ESCAPES[1:], *([("\n", "\\n")] if line else [])]:
            piece = F.replace(piece, F.lit(code), F.lit(raw))
        return piece

    return F.when(F.instr(text, "\\") > 0, F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")).otherwise(text)


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), text, loss_start, loss_end, last (holds every turn): all examples of all conversations."""
    turns = conversations.select("conv_id", F.struct("turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))).alias("_t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("_t")).alias("_turns"))
    marked = F.transform("_turns", lambda t: F.struct((t["role"] == TARGET).alias("target"), F.concat(F.lit(OPEN), escaped(t["role"], line=True), F.lit("\n")).alias("head"), escaped(t["text"]).alias("body")))
    whole = whole.select("conv_id", marked.alias("_marked"))
    sized = F.transform("_marked", lambda t, k: F.struct(t["target"].alias("target"), F.length(t["body"]).alias("body"), (k + 1).alias("turns"), (k + 1 == F.size("_marked")).alias("last")))
    whole = whole.select("conv_id", F.array_join(F.transform("_marked", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("_whole"), F.filter(sized, lambda t: t["target"] | t["last"]).alias("_ends"))
    each = whole.select("conv_id", "_whole", F.posexplode("_ends").alias("example", "_e"))
    # The closing mark is nowhere but after a turn, so the first so many turns end at its so-manieth place.
    each = each.select("conv_id", "example", "_e", F.concat(F.call_function("substring_index", F.col("_whole"), F.lit(CLOSE), F.col("_e.turns")), F.lit(CLOSE)).alias("text"))
    end = F.length("text")
    return each.select(
        "conv_id", "example", "text",
        F.when(F.col("_e.target"), end - len(CLOSE) - F.col("_e.body")).otherwise(end).alias("loss_start"),
        F.when(F.col("_e.target"), end - len(CLOSE)).otherwise(end).alias("loss_end"),
        F.col("_e.last").alias("last"),
    )


def parsed(text: Column) -> Column:
    """The turns (role, text) of an example's text."""

    def turn(t: Column) -> Column:
        head = F.substring_index(t, "\n", 1)
        return F.struct(unescaped(F.substring(head, F.lit(len(OPEN) + 1), F.length(head)), line=True).alias("role"), unescaped(F.substring(t, F.length(head) + 2, F.length(t))).alias("text"))

    return F.transform(F.filter(F.split(text, CLOSE, -1), lambda t: t != ""), turn)


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    loss = unescaped(F.substring("text", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")))
    turns = F.when(F.col("last"), parsed(F.col("text")))
    read = examples.select("conv_id", "example", loss.alias("_loss"), F.length("text").alias("_chars"), turns.alias("_turns"))
    said = F.sha2(F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    read = read.select("conv_id", "example", "_loss", "_chars", F.size("_turns").alias("_n"), said.alias("_said"))
    whole = read.groupBy("conv_id").agg(F.max("_n").cast("bigint").alias("n_turns"), F.max("_said").alias("turns_sha256"), F.sum("_chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("example", "_loss"))).alias("_l"))
    whole = whole.withColumn("_l", F.array_join(F.col("_l._loss"), ""))
    return whole.select("conv_id", "n_turns", "turns_sha256", F.length("_l").cast("bigint").alias("loss_chars"), F.sha2("_l", 256).alias("loss_sha256"), "formatted_chars")


def probe(spark) -> DataFrame:
    """Conversation -7: a user's and an assistant's row whose texts look like the marks of templates."""
    text = F.lit("\\### Assistant: </turn> ok")
    return spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(TARGET).alias("role"), text.alias("text"))
