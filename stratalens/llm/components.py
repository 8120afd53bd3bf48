"""Connected components by contraction, on tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of links (a long, b long): the same root for all nodes that links connect.

    Each round joins every node to its smallest neighbour and contracts the links; the nodes that are left at
    least halve. The joins back through the rounds give the roots. Nothing is collected.
    """
    links = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links")
    rounds: list[DataFrame] = []
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        parent = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("parent")), "parents")
        rounds.append(parent)
        one, two = (parent.select(F.col("node").alias(c), F.col("parent").alias(f"p{c}")) for c in "ab")
        moved = links.join(one, "a").join(two, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        links = materialize(moved.filter("a < b").distinct(), "links")
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = rounds.pop().select("node", F.col("parent").alias("root"))
    while rounds:
        later = roots.select(F.col("node").alias("parent"), "root")
        roots = materialize(rounds.pop().join(later, "parent", "left").select("node", F.coalesce("root", "parent").alias("root")), "roots")
    return roots
