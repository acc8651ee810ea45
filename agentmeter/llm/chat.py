"""Chat formatting: keep the longest snapshot of every logged conversation, then render it.

A conversation that is logged after each turn appears again and again as a prefix of its
longer forms. Every turn gets two 64-bit hashes of its position, role and text, and the hash of
a prefix is the exclusive or of those of its turns: it rolls along a window, and parts of a
conversation can be hashed apart and put together. A conversation is dropped if its whole hash, with its
length, is among the proper-prefix hashes of the others: one anti-join. Long
conversations are worked on in chunks of ``CHUNK`` turn numbers, so no task gets one whole.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentmeter.llm.common import land

CHUNK = 1024
#: Fixed values of the rendered form.
START, END = "<|im_start|>", "<|im_end|>"


def _turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    rows = conversations.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.col(role).cast("string").alias("role"),
        F.col(text).cast("string").alias("text"),
    ).where(F.col("conv").isNotNull())
    # A hash skips nulls, so whether something is null goes in by itself.
    said = [F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    return rows.select(
        "*",
        F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-1)).alias("chunk"),
        F.xxhash64(F.lit(1), *said).alias("h1"),
        F.xxhash64(F.lit(2), *said).alias("h2"),
    )


def _xor(a: str, b: str) -> Column:
    return F.coalesce(F.col(a), F.lit(0).cast("long")).bitwiseXOR(F.col(b))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, length, n, p1, p2): the hash of the first ``length`` of a conversation's ``n`` turns."""
    slim = turns.select("conv", "chunk", "turn", "h1", "h2").distinct()
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv")
    sizes = (
        slim.groupBy("conv", "chunk")
        .count()
        .select(
            "conv",
            "chunk",
            F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier"),
            F.sum("count").over(whole).alias("n"),
        )
    )
    inside = Window.partitionBy("conv", "chunk")
    numbered = slim.join(sizes, ["conv", "chunk"]).select(
        "conv",
        "chunk",
        "n",
        (F.col("earlier") + F.row_number().over(inside.orderBy(F.asc_nulls_first("turn"), "h1", "h2"))).alias("length"),
        "h1",
        "h2",
    )
    terms = numbered.select(
        "conv",
        "chunk",
        "n",
        "length",
        F.xxhash64(F.lit(1), "length", "h1", "h2").alias("t1"),
        F.xxhash64(F.lit(2), "length", "h1", "h2").alias("t2"),
    )
    rolling = inside.orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = terms.select(
        "*", F.bit_xor("t1").over(rolling).alias("r1"), F.bit_xor("t2").over(rolling).alias("r2")
    )
    bases = (
        terms.groupBy("conv", "chunk")
        .agg(F.bit_xor("t1").alias("c1"), F.bit_xor("t2").alias("c2"))
        .select("conv", "chunk", F.bit_xor("c1").over(before).alias("b1"), F.bit_xor("c2").over(before).alias("b2"))
    )
    return rolled.join(bases, ["conv", "chunk"]).select(
        "conv", "length", "n", _xor("b1", "r1").alias("p1"), _xor("b2", "r2").alias("p2")
    )


def maximal(turns: DataFrame) -> DataFrame:
    """(conv, n_turns, copies) of the conversations that are no proper prefix of another.

    Of equal conversations the one with the smallest id stays; copies counts them all.
    """
    hashed = land(prefixes(turns), "prefixes")
    proper = hashed.where("length < n").select(F.col("length").alias("n"), "p1", "p2").distinct()
    whole = (
        hashed.where("length = n")
        .groupBy("n", "p1", "p2")
        .agg(F.min("conv").alias("conv"), F.count("*").alias("copies"))
    )
    return whole.join(proper, ["n", "p1", "p2"], "left_anti").select("conv", F.col("n").alias("n_turns"), "copies")


def collapse(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv, segment, n_turns, copies, rendered) of the maximal conversations.

    A conversation is rendered in segments of ``CHUNK`` turn numbers. Turns go by number, null numbers first, and those
    of one number by hash; turns that repeat in number, role and text count once. Rows
    without a conversation are left out. A null role is rendered as ``unknown`` and a null text as an
    empty one, but neither equals its rendered form when prefixes are compared. Marks inside a text
    are broken by a blank, so that no text can feign a turn.
    """
    turns = _turns(conversations, conv, turn, role, text)
    kept = maximal(turns)
    safe = lambda c: F.replace(c, F.lit("<|im_"), F.lit("<| im_"))
    line = F.concat(
        F.lit(START),
        safe(F.coalesce("role", F.lit("unknown"))),
        F.lit("\n"),
        safe(F.coalesce("text", F.lit(""))),
        F.lit(END + "\n"),
    )
    spoken = turns.join(kept, "conv").select(
        "conv", "n_turns", "copies", "chunk", F.struct("turn", "h1", "h2", line.alias("line")).alias("said")
    )
    lines = F.transform(F.array_sort(F.collect_set("said")), lambda s: s["line"])
    return (
        spoken.groupBy("conv", "n_turns", "copies", "chunk")
        .agg(F.array_join(lines, "").alias("rendered"))
        .select(F.col("conv").alias(conv), F.col("chunk").alias("segment"), "n_turns", "copies", "rendered")
    )
