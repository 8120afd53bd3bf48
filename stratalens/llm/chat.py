"""Cumulative-snapshot collapse of logged conversations, then rendering; DataFrame functions only.

A logger that writes a conversation anew at each turn leaves snapshots that are prefixes of longer ones.
Every turn gets a rolling hash of the turns up to it, in two halves of 64 bits; prefixes of equal length and hash count as equal. A conversation whose whole hash is a proper turn prefix
of another is dropped by an anti-join, of identical ones the smallest conv_id stays, and what remains is
rendered. The rolling hash is an exclusive-or of hashes of (position, role, text), so it is summed up per
block of turns first and a conversation of any length is spread over many tasks.

Defined results: null role or text counts as empty; rows that repeat (conv_id, turn, role, text) count once;
turns with equal numbers are ordered by role and text; a null turn comes first; rows of a null conv_id form
one conversation; other columns are not read. A rendered conversation is one row, so it must fit a row; of
one conversation, turns whose numbers lie within the same BLOCK, null ones or any number of equal ones together, are ordered in one task, which
spills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

BLOCK = 256
START, END = "<|", "|>"


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, position (from 1), n_turns and the two halves of the rolling hash, for rows conv_id, turn, role, text."""
    key = ["conv_key", "block"]
    keyed = turns.select(
        "conv_id",
        conv_key(F.col("conv_id")).alias("conv_key"),
        "turn",
        F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 40))).alias("block"),
        "role",
        "text",
        F.xxhash64("role", "text").alias("a"),
        F.xxhash64(F.lit("second"), "text", "role").alias("b"),
    )
    # dealt once: the same deal serves the rows that repeat and the order within a block
    once = keyed.repartition(*key).dropDuplicates([*key, "turn", "role", "text"])
    inside = W.partitionBy(*key).orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    running = W.partitionBy("conv_key").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("conv_key")
    ranked = materialize(once.withColumn("rank", F.row_number().over(inside)).select(*key, "conv_id", "rank", "a", "b"), "ranked-turns")  # without texts from here on
    sizes = ranked.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select(*key, F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("n_turns"))
    placed = ranked.join(sizes, key).withColumn("position", F.col("before") + F.col("rank"))
    placed = placed.withColumn("x", F.xxhash64("position", "a", "b")).withColumn("y", F.xxhash64(F.lit("second"), "b", "position", "a"))
    placed = materialize(placed.select(*key, "conv_id", "position", "n_turns", "x", "y"), "placed-turns")  # read three times
    blocks = placed.groupBy(*key).agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    blocks = blocks.select(*key, *(F.coalesce(F.bit_xor(c).over(running), F.lit(0)).alias(f"{c}_before") for c in "xy"))
    so_far = W.partitionBy(*key).orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    return placed.join(blocks, key).select("conv_id", "position", "n_turns", *(F.bit_xor(c).over(so_far).bitwiseXOR(F.col(f"{c}_before")).alias(c) for c in "xy"))


def conv_key(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit("null"))


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id of each conversation that is no turn prefix of another; of identical ones the smallest."""
    hashes = prefix_hashes(conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    whole = hashes.filter("position = n_turns").groupBy("position", "x", "y").agg(F.min("conv_id").alias("conv_id"))
    longer = hashes.filter("position < n_turns").select("position", "x", "y").distinct()
    return whole.join(longer, ["position", "x", "y"], "left_anti").select("conv_id")


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, text: the turns in order, each with its role's tag."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_set(turn)).alias("turns"))
    line = lambda t: F.concat(F.lit(START), t["role"], F.lit(END + "\n"), t["text"], F.lit(f"\n{START}end{END}\n"))
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.concat_ws("", F.transform("turns", line)).alias("text"))


def collapse_and_render(conversations: DataFrame) -> DataFrame:
    """The maximal conversations, rendered."""
    keep = maximal_conversations(conversations).select(conv_key(F.col("conv_id")).alias("__key"))
    turns = conversations.select(conv_key(F.col("conv_id")).alias("__key"), "conv_id", "turn", "role", "text")
    return render(turns.join(keep, "__key", "left_semi"))
