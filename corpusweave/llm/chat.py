"""Logged conversations: snapshots collapsed to the longest log, then rendered as chat texts.

A conversation that was logged after each of its turns appears many times, each log a prefix
of the next.  Every turn gets the hash of the turns up to it: the exclusive or of hashes that
contain each turn's position, role and text (128 bits).  A log whose last hash is an inner
hash of a longer log is a prefix of that one and goes (an anti-join); of equal logs that with
the smallest id stays.  Only hashes move until the logs that stay are rendered.

A log with very many turns is no hot key: turns are placed by a range partitioning over id
and turn, running hashes are made in blocks of turns and joined with those of the blocks
before, and a log is rendered in parts of a fixed number of turns.

Defined cases: a null id is an id like any other (first in order); a null role is written as
"unknown", a null text is an empty text, and each equals what it is written as; turns of equal
number follow each other by a hash of role and text, turns without a number come first;
repeated rows are repeated turns.  Other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.plans.ordering import with_row_index
from corpusweave.plans.staging import stage

#: Turns whose running hash is made together, and turns of a rendered part.
BLOCK_TURNS, PART_TURNS = 1024, 256
# The marks around a turn; a text cannot contain them, as "<|" gets a space.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def render_turn(role: Column, text: Column) -> Column:
    def plain(c: Column) -> Column:
        return F.replace(c, F.lit("<|"), F.lit("< |"))

    return F.concat(F.lit(OPEN), plain(role), F.lit("\n"), plain(text), F.lit(f"{CLOSE}\n"))


def _logs(placed: DataFrame) -> DataFrame:
    """``conv, first, turns``: where each log begins in the overall order, and its length."""
    return placed.groupBy("conv").agg(F.min("at").alias("first"), F.count("*").alias("turns"))


def prefix_hashes(placed: DataFrame) -> DataFrame:
    """``first, turns, k, x0, x1``: the hash of the first ``k`` turns of each log, for each k."""
    logs = _logs(placed)
    turns = (
        placed.select("conv", "at", "h0", "h1")
        .join(logs.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c")))
        .select(
            "first", "turns", (F.col("at") - F.col("first") + 1).alias("k"),
            *[F.xxhash64(F.lit(i), F.col("at") - F.col("first"), "h0", "h1").alias(f"t{i}") for i in (0, 1)],
        )
        .withColumn("block", F.floor((F.col("k") - 1) / BLOCK_TURNS))
    )
    within = Window.partitionBy("first", "block").orderBy("k")
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = turns.select(
        "first", "turns", "k", "block", *[F.bit_xor(f"t{i}").over(upto).alias(f"r{i}") for i in (0, 1)]
    )
    # One row per block of a log.
    earlier = Window.partitionBy("first").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = turns.groupBy("first", "block").agg(*[F.bit_xor(f"t{i}").alias(f"b{i}") for i in (0, 1)])
    before = before.select(
        "first", "block",
        *[F.coalesce(F.bit_xor(f"b{i}").over(earlier), F.lit(0)).alias(f"b{i}") for i in (0, 1)],
    )
    return inner.join(before, ["first", "block"]).select(
        "first", "turns", "k",
        *[F.col(f"r{i}").bitwiseXOR(F.col(f"b{i}")).alias(f"x{i}") for i in (0, 1)],
    )


def maximal_logs(prefixes: DataFrame) -> DataFrame:
    """``first, turns, logged`` of the logs that stay, and how often each was logged."""
    key = ["k", "x0", "x1"]
    inner = prefixes.where(F.col("k") < F.col("turns")).select(*key).distinct()
    whole = (
        prefixes.where(F.col("k") == F.col("turns"))
        .groupBy(*key)
        .agg(F.min("first").alias("first"), F.count("*").alias("logged"))
    )
    return whole.join(inner, key, "left_anti").select("first", F.col("k").alias("turns"), "logged")


def render_conversations(
    conversations: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    part_turns: int = PART_TURNS,
) -> DataFrame:
    """``id, part, turns, logged, text``: the maximal logs, rendered in parts from 0."""
    role = F.coalesce(F.col(role_col), F.lit("unknown")).alias("role")
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    rows = conversations.select(
        F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), role, text
    ).withColumns({f"h{i}": F.xxhash64(F.lit(i), "role", "text") for i in (0, 1)})
    placed = stage(with_row_index(rows, ["conv", "turn", "h0", "h1"], "at"), "turns")
    kept = stage(maximal_logs(stage(prefix_hashes(placed), "prefixes")), "logs")
    named = kept.join(_logs(placed).select("conv", "first"), "first").withColumnRenamed("conv", "c")
    turns = placed.select("conv", "at", "role", "text").join(
        named, F.col("conv").eqNullSafe(F.col("c"))
    )
    place = F.col("at") - F.col("first")
    return (
        turns.select(
            F.col("conv").alias("id"), "first", "turns", "logged",
            F.floor(place / part_turns).cast("int").alias("part"),
            F.struct(place.alias("k"), render_turn(F.col("role"), F.col("text")).alias("s")).alias("t"),
        )
        .groupBy("first", "id", "turns", "logged", "part")
        .agg(F.array_sort(F.collect_list("t")).alias("t"))
        .select("id", "part", "turns", "logged", F.array_join("t.s", "").alias("text"))
    )
