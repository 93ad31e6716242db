r"""Chat formatting: prefix-target expansion of conversations, with a template that can be read back.

Template of a turn: ``<turn ROLE>\nTEXT\n</turn>\n``. In texts and roles ``\`` is written ``\0``, ``<`` is ``\1`` and
``>`` is ``\2``; in roles a line feed is ``\3``. A ``<`` therefore stands only in marks, and every text comes back.

Every assistant turn becomes an example of its own: all preceding turns are context and only that reply is trainable.
Contexts overlap, so ``examples`` holds only what each adds: ``segment``, the formatted turns after the previous reply up to
and with its own; its context is the segments of the examples before it and its own segment up to ``loss_start``, and
``context_chars`` is the length of those earlier segments. What is shuffled is thus in proportion to the input;
``materialise`` then builds the whole examples, and ``read_back`` reads turns and losses from these. Turns after the last
reply form a last row without a loss span. All work is DataFrame operations.

Defined results: a null text is empty, a null role is empty; turns are ordered by turn (null last), then role, then
text; rows that repeat each other are turns of their own. A null conv_id is a conversation. A conversation without a
reply is one row without loss. An empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What each control character is written as, in the order of writing.
CODES = [("\\", "\\0"), ("<", "\\1"), (">", "\\2")]
ROLE_CODES = [*CODES, ("\n", "\\3")]
CLOSE = "\n</turn>\n"


def escaped(text: Column, codes: list[tuple[str, str]] = CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, codes: list[tuple[str, str]] = CODES) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def examples(conversations: DataFrame, trainable: str = "assistant") -> DataFrame:
    """conv_id, example, segment, context_chars, loss_start, loss_end: spans in code points from the segment's start."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    reply = F.col("role") == trainable
    head = F.concat(F.lit("<turn "), escaped(F.col("role"), ROLE_CODES), F.lit(">\n"))
    rows = turns.select(
        "conv_id",
        F.coalesce(F.sum(reply.cast("int")).over(order), F.lit(0)).cast("long").alias("example"),
        F.count("*").over(order).alias("place"),
        F.concat(head, escaped(F.col("text")), F.lit(CLOSE)).alias("formatted"),
        F.when(reply, F.length(escaped(F.col("text")))).alias("reply_chars"),
    )
    grouped = rows.groupBy("conv_id", "example").agg(
        F.sort_array(F.collect_list(F.struct("place", "formatted"))).alias("turns"), F.max("reply_chars").alias("reply_chars")
    )
    segment = F.array_join(F.transform("turns", lambda t: t["formatted"]), "")
    out = grouped.select("conv_id", "example", segment.alias("segment"), "reply_chars")
    end = F.when(F.col("reply_chars").isNotNull(), F.length("segment") - len(CLOSE))
    earlier = Window.partitionBy("conv_id").orderBy("example").rowsBetween(Window.unboundedPreceding, -1)
    return out.select(
        "conv_id", "example", "segment",
        F.coalesce(F.sum(F.length("segment")).over(earlier), F.lit(0)).alias("context_chars"),
        (end - F.col("reply_chars")).cast("int").alias("loss_start"), end.cast("int").alias("loss_end"),
    )


def _whole(rows: DataFrame) -> DataFrame:
    """Every row with all its context: conv_id, example, text, loss_start, loss_end. Segments are shuffled, whole texts are not."""
    so_far = Window.partitionBy("conv_id").orderBy("example").rowsBetween(Window.unboundedPreceding, 0)
    text = F.array_join(F.collect_list("segment").over(so_far), "")
    start, end = (F.col("context_chars") + F.col(c) for c in ("loss_start", "loss_end"))
    return rows.select("conv_id", "example", text.alias("text"), start.alias("loss_start"), end.alias("loss_end"))


def materialise(rows: DataFrame) -> DataFrame:
    """Whole training examples: conv_id, example, text, loss_start, loss_end. Its size is the sum of all contexts."""
    return _whole(rows).where("loss_start is not null")


def read_back(rows: DataFrame) -> DataFrame:
    """One row per conversation from its whole examples alone: conv_id, turns (role, text), losses (text), formatted_chars.

    Each loss is read at its span in its own example. turns is null if an example does not begin with the one before it.
    """
    loss = unescaped(F.substr("text", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")))
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("example"))
    read = _whole(rows).select("conv_id", "example", "text", loss.alias("loss"), F.startswith("text", before).alias("goes_on"))
    whole = read.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("parts"),
        F.max_by("text", "example").alias("formatted"), F.coalesce(F.bool_and("goes_on"), F.lit(True)).alias("goes_on"),
    )
    pieces = F.filter(F.split("formatted", CLOSE, -1), lambda x: x != "")
    role = lambda x: F.substring_index(x, ">\n", 1)
    turns = F.transform(
        pieces,
        lambda x: F.struct(
            unescaped(F.substr(role(x), F.lit(len("<turn ") + 1)), ROLE_CODES).alias("role"),
            unescaped(F.substr(x, F.length(role(x)) + 3)).alias("text"),
        ),
    )
    losses = F.transform(F.filter("parts", lambda p: p["loss"].isNotNull()), lambda p: p["loss"])
    turns = F.when(F.col("goes_on"), turns)
    return whole.select("conv_id", turns.alias("turns"), losses.alias("losses"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(rows: DataFrame) -> DataFrame:
    """One row per conversation, read back from its examples: counts and digests of all turns and of all text under the loss mask."""
    back = read_back(rows)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), told.alias("told"), F.array_join("losses", "").alias("loss"), "formatted_chars")
    return back.select(
        "conv_id", "n_turns", F.sha2("told", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
