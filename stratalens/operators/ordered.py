"""Orders that many tasks share: positions, prefix sums and frames of the last rows, without one sort in one task.

Rows are dealt by ranges of the order and sorted within them; a range is a block. Sums of blocks give what lies ahead of each
block, and a window within the block does the rest, so a key of any number of rows fills as many tasks as it has blocks. The sorted rows are
written to the shared folder once, so that their places stay when executors are lost.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.operators.reach import settled


def placed(df: DataFrame, order: list[str], blocks: int | None = None) -> DataFrame:
    """df with `at`, a long that grows along the columns of `order` (ascending, nulls first), and `block`, the run of rows that were sorted together."""
    dealt = df.repartitionByRange(blocks, *order) if blocks else df.repartitionByRange(*order)
    return settled(dealt.sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())).withColumn("block", F.shiftright("at", 33))


def running_sums(df: DataFrame, key: list[str], order: list[str], sums: dict[str, Column], blocks: int | None = None) -> DataFrame:
    """df with `at` (see placed) and, for each name of `sums`, the sum of its column up to and including the row, within the key, along the order.

    Rows must differ in key and order, or the order among equals is any. Null keys are a key.
    """
    rows = placed(df.select("*", *(c.alias(f"__{n}") for n, c in sums.items())), [*key, *order], blocks)
    per_block = rows.groupBy(*key, "block").agg(*(F.sum(f"__{n}").alias(f"__{n}") for n in sums))
    ahead = W.partitionBy(*(key or [F.lit(0)])).orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # of blocks, not of rows
    before = per_block.select(*(F.col(k).alias(f"__key{i}") for i, k in enumerate([*key, "block"])), *(F.coalesce(F.sum(f"__{n}").over(ahead), F.lit(0)).alias(f"__ahead_{n}") for n in sums))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate([*key, "block"])))
    inside = W.partitionBy(*key, "block").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    summed = rows.select("*", *(F.sum(f"__{n}").over(inside).alias(f"__so_far_{n}") for n in sums))
    return summed.join(before, same).select(*df.columns, "at", *((F.col(f"__so_far_{n}") + F.col(f"__ahead_{n}")).alias(n) for n in sums))


def sums_of_span(rows: DataFrame, key: list[str], span: int, sums: dict[str, Column], tasks: int | None = None) -> DataFrame:
    """key, ts and, for each name of `sums`, the sum of its column over the rows of the key whose ts is at most `span` before this one, itself included.

    Time is cut into periods of a span, so a key of any number of rows fills many tasks. A moment counts in its period and the next, and is taken off there
    when the span is over: one running sum, where a sliding frame would add up all of its rows for each row.
    """
    deal = lambda df, *by: df.repartition(tasks, *by) if tasks else df
    moments = deal(rows.select(*key, "ts", *(c.alias(n) for n, c in sums.items())), *key, "ts").groupBy(*key, "ts").agg(*(F.sum(n).alias(n) for n in sums))
    own, put = F.floor(F.col("ts") / span), lambda period, at, sign, real: F.struct(period.alias("period"), at.alias("at"), F.lit(sign).alias("sign"), F.lit(real).alias("real"))
    ts = F.col("ts")
    placed_at = moments.select(*key, *sums, F.explode(F.array(put(own, ts, 1, True), put(own + 1, ts, 1, False), put(own + 1, ts + span + 1, -1, False))).alias("e")).select(*key, *sums, "e.*")
    order = W.partitionBy(*key, "period").orderBy("at").rangeBetween(W.unboundedPreceding, 0)
    running = deal(placed_at, *key, "period").select(*key, "at", "real", *(F.sum(F.col(n) * F.col("sign")).over(order).alias(n) for n in sums))
    return running.filter("real").select(*key, F.col("at").alias("ts"), *sums)


def last_frames(df: DataFrame, position: str, most: int, value: Column, name: str, chunk: int = 1 << 14) -> DataFrame:
    """df with `name`: the non-null values of the rows whose position (a long from 1) is at most `most` - 1 before the row's own, itself included; an array.

    Positions are cut into chunks; what a chunk's first rows look back to is copied into it.
    """
    chunk = max(chunk, most)
    own = F.floor(F.col(position) / chunk)
    near = df.withColumn("__value", value).withColumn("__own", own)
    both = near.withColumn("__chunk", F.explode(F.when(F.col(position) % chunk > chunk - most, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))))
    frame = W.partitionBy("__chunk").orderBy(position).rangeBetween(1 - most, 0)
    return both.withColumn(name, F.collect_list("__value").over(frame)).filter("__chunk = __own").select(*df.columns, name)
