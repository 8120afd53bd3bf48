"""Walks over edges (src, dst): breadth-first levels, closures, strongly connected groups and depths.

Each round is written to the shared folder, so plans stay short and lost executors cost one round. Loops end
when nothing changes. Where only what reaches what matters, steps double: a label jumps on to the label of the node that it
names, and chains are contracted by pointers that double, so that their length costs its logarithm in rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.shared import written


def settled(df: DataFrame) -> DataFrame:
    """df computed and kept as a table in the shared folder. Unlike a checkpoint it has the size of its files; estimates would multiply from round to round."""
    return written(df, "settled")[0]


def distances(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node, distance: breadth-first levels along edges from seeds (node)."""
    level = settled(seeds.select("node").distinct().withColumn("distance", F.lit(0).cast("long")))
    reached, n = level, 0
    while True:
        n += 1
        ahead = level.join(edges, level["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        level = settled(ahead.join(reached, "node", "left_anti").withColumn("distance", F.lit(n).cast("long")))
        if level.isEmpty():
            return reached
        reached = reached.union(level)


def first_reached(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node, distance, via, label: a breadth-first walk along edges (src, dst, label) from seeds (node), as one queue would take it.

    via is the node of the level before that came first in the queue, and label that of its edge (the least, of several).
    The queue is never one sort: a level is dealt by ranges of (rank of via, node) and its new ranks only grow along them.
    """

    def queued(level: DataFrame) -> DataFrame:
        dealt = level.repartitionByRange("rank", "node").sortWithinPartitions("rank", "node")
        return settled(dealt.withColumn("rank", F.monotonically_increasing_id()))

    start = seeds.select("node").filter("node is not null").distinct()
    level = queued(start.select("node", F.lit(0).cast("long").alias("distance"), F.lit(None).cast(edges.schema["src"].dataType).alias("via"), F.lit(None).cast(edges.schema["label"].dataType).alias("label"), F.lit(0).cast("long").alias("rank")))
    reached = level.drop("rank")
    while True:
        met = level.select(F.col("node").alias("src"), "rank", "distance").join(edges, "src").join(reached.select(F.col("node").alias("dst")), "dst", "left_anti")
        first = met.groupBy("dst").agg(F.min(F.struct("rank", "label", "src")).alias("f"), F.first("distance").alias("d"))
        level = queued(first.select(F.col("dst").alias("node"), (F.col("d") + 1).alias("distance"), F.col("f.src").alias("via"), F.col("f.label").alias("label"), F.col("f.rank").alias("rank")))
        if level.isEmpty():
            return reached
        reached = reached.union(level.drop("rank"))


def joined_groups(links: DataFrame) -> DataFrame:
    """node, root for every end of links (a, b): the least node of its connected group. Each round every node joins its least neighbour, and what has become one is contracted."""
    links = settled(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    rounds = []
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        parent = settled(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up")))
        rounds.append(parent)
        one, two = (parent.select(F.col("node").alias(c), F.col("up").alias(f"u{c}")) for c in "ab")
        moved = links.join(one, "a").join(two, "b").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b"))
        links = settled(moved.filter("a < b").distinct())
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = rounds.pop().select("node", F.col("up").alias("root"))
    while rounds:
        later = roots.select(F.col("node").alias("up"), "root")
        roots = settled(rounds.pop().join(later, "up", "left").select("node", F.coalesce("root", "up").alias("root")))
    return roots


def closure(edges: DataFrame) -> DataFrame:
    """src, dst: pairs with a path of one edge or more; lengths double each round. For results that are all pairs themselves."""
    known = settled(edges.select("src", "dst").distinct())
    n = known.count()
    while True:
        longer = known.alias("a").join(known.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
        known = settled(known.union(longer).distinct())
        if (more := known.count()) == n:
            return known
        n = more


def ends(edges: DataFrame) -> DataFrame:
    """node: all ends of edges."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (node)."""
    one, two = nodes.select(F.col("node").alias("src")), nodes.select(F.col("node").alias("dst"))
    return edges.join(one, "src", "left_semi").join(two, "dst", "left_semi").select("src", "dst")


RAKES = 8  # layers taken off before chains are contracted


def raked(edges: DataFrame) -> DataFrame:
    """Edges left when nodes without an edge to them or from them are taken away once."""
    return settled(among(edges, edges.select(F.col("dst").alias("node")).intersect(edges.select("src"))))


def contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chains made one edge each; edges: distinct, without loops.

    Gives the edges left, the inner nodes of chains (node, a, b: the chain's ends) and those of cycles of inner nodes only (node, scc). A node is inner if it has one
    edge to it and one from it. Pointers to the next and the last node that isn't inner double in each round; what still points to an inner
    node when they are longer than all inner nodes together is on such a cycle, and has met all of it.
    """
    ahead = edges.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("b"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    behind = edges.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("a"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    inner = settled(ahead.join(behind, "node").select("node", "a", "b", F.col("node").alias("low")))
    names = inner.select("node")
    total, length = inner.count(), 1
    p = inner
    while length <= 2 * total:
        to = p.select(F.col("node").alias("b"), F.col("b").alias("b2"), F.col("low").alias("low2"))
        back = p.select(F.col("node").alias("a"), F.col("a").alias("a2"))
        p = settled(p.join(to, "b", "left").join(back, "a", "left").select("node", F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b"), F.least("low", F.coalesce("low2", "low")).alias("low")))
        length *= 2
        if p.join(names.withColumnRenamed("node", "b"), "b", "left_semi").isEmpty():
            break
    round_ = p.join(names.withColumnRenamed("node", "b"), "b", "left_semi").select("node", F.col("low").alias("scc"))
    chains = settled(p.join(round_, "node", "left_anti").select("node", "a", "b"))
    one, two = names.withColumnRenamed("node", "src"), names.withColumnRenamed("node", "dst")
    rest = edges.join(one, "src", "left_anti").join(two, "dst", "left_anti").select("src", "dst")
    return settled(rest.union(chains.select("a", "b")).filter("src <> dst").distinct()), chains, settled(round_)


def least_reaching(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """node, c: the least label (labels: node, c, a structure that ends in the node) of the nodes that reach each node, itself included.

    As a label names a node that reaches its holder, that node's own label does too: each round takes the least of the neighbours' labels and jumps once.
    """
    colour = settled(labels)
    while True:
        heard = edges.join(colour, edges["src"] == colour["node"]).groupBy("dst").agg(F.min("c").alias("heard")).withColumnRenamed("dst", "node")
        step = colour.join(heard, "node", "left").select("node", F.col("c").alias("old"), F.least("c", F.coalesce("heard", "c")).alias("c"))
        jump = colour.select(F.col("node").alias("via"), F.col("c").alias("further"))
        after = step.withColumn("via", F.col("c.node")).join(jump, "via").select("node", F.least("c", "further").alias("c"), "old")
        after = settled(after.select("node", "c", (F.col("c") < F.col("old")).alias("moved")))
        colour = after.drop("moved")
        if after.filter("moved").isEmpty():
            return colour


def connected_groups(edges: DataFrame) -> DataFrame:
    """node, scc: the least member of each node's strongly connected group, for all ends of edges.

    Nodes that no cycle holds are raked off, and chains contracted if there are many layers of them. Of the rest each takes the least of the nodes that reach it; those that
    reach the node of that name in turn, within its colour, are its group, and leave. That repeats until no edge is left. Inner nodes of a chain belong
    to the group of its ends, if that is one.
    """
    everyone = ends(edges)
    live = settled(edges.select("src", "dst").filter("src <> dst").distinct())
    groups, chains, n, layers = None, [], live.count(), 0
    add = lambda found: found if groups is None else groups.union(found)
    while n:
        live = raked(live)
        if (after := live.count()) == n:
            label = ends(live).select("node", F.struct("node").alias("c"))
            colour = least_reaching(live, label).select("node", F.col("c.node").alias("c"))
            one, two = (colour.select(F.col("node").alias(c), F.col("c").alias(f"c_{c}")) for c in ("src", "dst"))
            inside = settled(live.join(one, "src").join(two, "dst").filter("c_src = c_dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
            back = least_reaching(inside, label).select("node", F.col("c.node").alias("d"))
            found = settled(colour.join(back, "node").filter("c = d").select("node", F.col("c").alias("scc")))
            groups, live, layers = add(found), settled(among(live, ends(live).join(found, "node", "left_anti"))), 0
            after = live.count()
        elif (layers := layers + 1) % RAKES == 0 and after:
            live, held, cycles = contracted(live)
            chains.append(held)
            groups, after = add(cycles), live.count()
        n = after
    if groups is None and not chains:
        return everyone.select("node", F.col("node").alias("scc"))
    groups = edges.select(F.col("src").alias("node"), F.col("dst").alias("scc")).limit(0) if groups is None else groups
    for held in reversed(chains):
        one, two = (groups.select(F.col("node").alias(c), F.col("scc").alias(f"s_{c}")) for c in "ab")
        both = held.join(one, "a", "left").join(two, "b", "left").select("node", "a", F.coalesce("s_a", "a").alias("s_a"), F.coalesce("s_b", "b").alias("s_b")).filter("s_a = s_b")
        groups = settled(groups.union(both.select("node", F.col("s_a").alias("scc"))).union(both.filter("s_a = a").select(F.col("a").alias("node"), F.col("a").alias("scc"))).distinct())
    least = groups.groupBy("scc").agg(F.min("node").alias("least"))
    named = groups.join(least, "scc").select("node", "least")
    return everyone.join(named, "node", "left").select("node", F.coalesce("least", "node").alias("scc"))


def stuck(edges: DataFrame) -> DataFrame:
    """node: what no topological order from the sources on can take: nodes on cycles and all that these reach."""
    edges = settled(edges.select("src", "dst").distinct())
    groups = settled(connected_groups(edges))
    cyclic = groups.groupBy("scc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").join(groups, "scc").select("node").union(edges.filter("src = dst").select("src")).distinct()
    marked = groups.select("node").join(settled(cyclic).withColumn("on", F.lit(0)), "node", "left")
    reached = least_reaching(edges, marked.select("node", F.struct(F.coalesce("on", F.lit(1)).alias("late"), F.col("node")).alias("c")))
    return reached.filter("c.late = 0").select("node")


def condensed(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """src, dst: edges between different groups (node, scc)."""
    one, two = (groups.select(F.col("node").alias(c), F.col("scc").alias(f"s_{c}")) for c in ("src", "dst"))
    return edges.join(one, "src").join(two, "dst").select(F.col("s_src").alias("src"), F.col("s_dst").alias("dst")).filter("src <> dst").distinct()


def chain_depths(edges: DataFrame, most: int = 99) -> DataFrame:
    """node, depth: the longest chain of groups below each end of edges, the same for a whole group; `most` is the greatest value given."""
    groups = settled(connected_groups(edges))
    acyclic = settled(condensed(edges, groups))
    level = settled(groups.select(F.col("scc").alias("node")).distinct().withColumn("depth", F.lit(0).cast("long")))
    depth, n = level, 0
    while True:
        n += 1
        if n > most:
            break
        level = settled(acyclic.join(level, acyclic["dst"] == level["node"]).select(F.col("src").alias("node")).distinct().withColumn("depth", F.lit(n).cast("long")))
        if level.isEmpty():
            break
        depth = depth.union(level)
    longest = depth.groupBy(F.col("node").alias("scc")).agg(F.least(F.max("depth"), F.lit(most)).cast("long").alias("depth"))
    return groups.join(longest, "scc").select("node", "depth")
