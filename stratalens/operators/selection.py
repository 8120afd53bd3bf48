"""Exact order statistics by distributed selection: counts of value ranges lead to the one range that holds a rank.

A round takes bounds of equal depth within the range that is still open for a rank, from a mergeable sketch of bounded size, and counts the rows
below, between and above the two bounds around the rank. The counts are exact, so whatever the sketch says the part that holds the rank is known; that part,
from its least to its greatest value, is the next range, with a few hundredths of the rows. A range of one value, or of MOST rows or fewer, is
closed; only rows of closed ranges are sorted, each range by itself. A key's rows are never in one buffer, and the number of rounds grows with the logarithm
of their number, however the values are spread.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.operators.reach import settled

GRID, ACCURACY, MOST, SMALL_SIDE = 50, 1000, 4096, 20_000


def nth(percent: int) -> str:
    """The nearest rank (from 1) of a percentage among n, as an expression."""
    return f"greatest(1, (n * {percent} + 99) div 100)"


#: The two ranks, equal where n is odd, whose mean is the median.
MIDDLE = {"low": "(n + 1) div 2", "high": "n div 2 + 1"}


def alike(names: list[str], *more: Column) -> Column:
    """Equality, null-safe, of each column with the one that has two underscores before its name."""
    return reduce(Column.__and__, (*(F.col(c).eqNullSafe(F.col(f"__{c}")) for c in names), *more), F.lit(True))


def renamed(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"__{c}" for c in names})


def within(rows: DataFrame, ranges: DataFrame, key: list[str]) -> DataFrame:
    """rows (key, v) with each of the ranges (key, lo, hi and what else they have) that they lie in; ranges of few keys are broadcast, after their number is known."""
    few = ranges.limit(SMALL_SIDE + 1).count() <= SMALL_SIDE
    named = renamed(ranges, key)
    return rows.join(F.broadcast(named) if few else named, alike(key, (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))).drop(*(f"__{k}" for k in key))


def order_statistics(df: DataFrame, key: list[str], value: str, ranks: dict[str, str], most: int = MOST) -> DataFrame:
    """One row per key with a value: n (its non-null values) and, under each name, the value of that rank (from 1, an expression over n). Null keys are a key; NaN counts as the greatest."""
    rows = settled(df.select(*key, F.col(value).cast("double").alias("v")).filter("v is not null"))
    total = settled(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.expr(rank).cast("long").alias("rank")) for name, rank in ranks.items()))).alias("w")
    targets = total.select(*key, wanted, F.col("n").alias("rows"), "lo", "hi").select(*key, "w.name", "w.rank", "rows", "lo", "hi").withColumn("stuck", F.lit(False))
    targets, span = settled(targets), [*key, "lo", "hi"]
    open_ = F.col("lo").eqNullSafe(F.col("hi")) | (F.col("rows") <= most) | F.col("stuck")
    grid = F.percentile_approx("v", [i / GRID for i in range(GRID + 1)], ACCURACY).alias("grid")
    while not (todo := targets.filter(~open_)).isEmpty():
        sketch = renamed(within(rows, todo.select(*span).distinct(), key).groupBy(*span).agg(grid), span)
        at = (F.col("rank") - 1) / F.col("rows") * GRID
        bounds = todo.join(sketch, alike(span)).select(*span, "name", "rank", "rows", F.col("grid")[F.greatest(F.lit(0), F.floor(at) - 1).cast("int")].alias("a"), F.col("grid")[F.least(F.lit(GRID), F.ceil(at) + 1).cast("int")].alias("b"))
        bounds = settled(bounds)
        v, cut = F.col("v"), [*span, "a", "b"]
        below, above = v < F.col("a"), v > F.col("b")
        part = lambda keep: (F.count_if(keep), F.min(F.when(keep, v)), F.max(F.when(keep, v)))
        counted = within(rows, bounds.select(*cut).distinct(), key).groupBy(*cut).agg(F.array(*(F.struct(F.lit(i).alias("i"), n.alias("rows"), lo.alias("lo"), hi.alias("hi")) for i, (n, lo, hi) in enumerate(map(part, (below, ~below & ~above, above))))).alias("parts"))
        p = F.col("parts")
        ahead = F.when(F.col("rank") <= p[0]["rows"], F.lit(0)).when(F.col("rank") <= p[0]["rows"] + p[1]["rows"], p[0]["rows"]).otherwise(p[0]["rows"] + p[1]["rows"])
        which = F.when(F.col("rank") <= p[0]["rows"], p[0]).when(F.col("rank") <= p[0]["rows"] + p[1]["rows"], p[1]).otherwise(p[2])
        narrowed = bounds.join(renamed(counted, cut), alike(cut)).select(*key, "name", (F.col("rank") - ahead).alias("rank"), which["rows"].alias("rows"), which["lo"].alias("lo"), which["hi"].alias("hi"), (which["rows"] == F.col("rows")).alias("stuck"))
        targets = settled(targets.filter(open_).union(narrowed))  # stuck: values that no bounds part are sorted as they are
    many = ~F.col("lo").eqNullSafe(F.col("hi"))
    ranges = settled(targets.filter(many).select(*span).distinct())
    placed = within(rows, ranges, key).withColumn("rank", F.row_number().over(W.partitionBy(*span).orderBy("v")).cast("long"))
    sought = renamed(targets.filter(many).select(*span, "rank", "name"), [*span, "rank"])
    found = placed.join(sought, alike([*span, "rank"])).select(*key, "name", "v").union(targets.filter(~many).select(*key, "name", F.col("lo").alias("v")))
    each = renamed(found.groupBy(*key).agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks)), key)
    return total.join(each, alike(key)).select(*key, "n", *ranks)
