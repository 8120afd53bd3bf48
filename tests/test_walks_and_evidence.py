"""Operators against brute force, and on edge cases that the tables don't have."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from stratalens.operators import evidence, reach
from stratalens.operators.joins import co_changes
from stratalens.sources import files


def reached(edges, nodes):
    """All pairs with a path of one edge or more."""
    pairs = set(edges)
    while more := {(a, d) for a, b in pairs for c, d in edges if b == c} - pairs:
        pairs |= more
    return pairs


@pytest.mark.parametrize(("seed", "n", "m"), [(1, 14, 12), (2, 14, 18), (3, 12, 30), (4, 5, 0)])
def test_walks_against_brute_force(spark, seed, n, m):
    rng = random.Random(seed)
    names = [f"n{i:02}" for i in range(n)]
    edges = sorted({(rng.choice(names), rng.choice(names)) for _ in range(m)} | {("n00", "n00")})
    df = reach.settled(spark.createDataFrame(edges, "src string, dst string"))
    nodes, paths = {x for e in edges for x in e}, reached(edges, names)
    group = {x: min([x, *(y for y in nodes if (x, y) in paths and (y, x) in paths)]) for x in nodes}
    assert {(r.node, r.scc) for r in reach.connected_groups(df).collect()} == set(group.items())
    assert {(r.src, r.dst) for r in reach.closure(df).collect()} == paths

    def depth(g, seen=()):
        return max((1 + depth(h) for a, b in edges if group[a] == g and (h := group[b]) != g), default=0)

    assert {(r.node, r.depth) for r in reach.chain_depths(df).collect()} == {(x, depth(group[x])) for x in nodes}
    stuck = {x for x in nodes if any((y, y) in paths and (y == x or (y, x) in paths) for y in nodes)}
    assert {r["node"] for r in reach.stuck(df).collect()} == stuck
    start = min(nodes)
    far = {start: 0}
    for d in itertools.count(1):
        new = {b for a, b in edges if far.get(a) == d - 1} - set(far)
        if not new:
            break
        far |= dict.fromkeys(new, d)
    assert {(r.node, r.distance) for r in reach.distances(df, spark.createDataFrame([(start,)], "node string")).collect()} == set(far.items())


def long_graph(n):
    """A chain, a cycle, a chain that leads from one cycle to another, and a spine with a leaf at each node; names in an order of their own."""
    name = lambda kind, i: f"{kind}{i * 7919 % 10007:05}"
    chain = [(name("a", i), name("a", i + 1)) for i in range(n)]
    cycle = [(name("b", i), name("b", (i + 1) % n)) for i in range(n)]
    bridge = [(name("b", 3), name("c", 0))] + [(name("c", i), name("c", i + 1)) for i in range(n)] + [(name("c", n), "d1"), ("d1", "d2"), ("d2", "d1")]
    spine = [(name("e", i), name("e", i + 1)) for i in range(n)] + [(name("e", i), f"leaf{i}") for i in range(n)]
    return chain + cycle + bridge + spine


def test_long_chains_cost_few_rounds(spark, monkeypatch):
    rounds, plain = [], reach.settled
    monkeypatch.setattr(reach, "settled", lambda df: rounds.append(1) or plain(df))
    took = {}
    for n in (40, 400):
        edges = long_graph(n)
        df = spark.createDataFrame(edges, "src string, dst string").coalesce(2)
        rounds.clear()
        found = {r["node"]: r["scc"] for r in reach.connected_groups(df).collect()}
        took[n] = len(rounds)
        cycle = {a for a, _ in edges if a.startswith("b")}
        want = {x: x for e in edges for x in e} | dict.fromkeys(cycle, min(cycle)) | {"d2": "d1"}
        assert found == want
        if n == 400:
            rounds.clear()
            left = {r["node"] for r in reach.stuck(df).collect()}
            assert left == cycle | {x for e in edges for x in e if x[0] in "cd"}
            assert len(rounds) < 90
    assert took[400] < took[40] + 25 and took[400] < 70


def test_depth_is_capped_and_shared_in_a_cycle(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(6)] + [("n002", "n001")]
    df = spark.createDataFrame(chain, "src string, dst string")
    assert {r.node: r.depth for r in reach.chain_depths(df, most=3).collect()} == {"n000": 3, "n001": 3, "n002": 3, "n003": 3, "n004": 2, "n005": 1, "n006": 0}


def test_wide_commits_are_left_out(spark, tmp_path):
    """A commit of over 50 files joins no pairs; narrow ones do."""
    lines = [(1, i, 1) for i in range(60)] + [(o, p, 1) for o in (2, 3, 4) for p in (0, 1)]
    parts = [(i, f"part {i}", f"Brand#{i}", "PROMO", 1, 1.0) for i in range(60)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    from stratalens.plans.registry import Tables

    assert [tuple(r) for r in co_changes(Tables(spark, str(tmp_path))).collect()] == [("brand_0/promo", "brand_1/promo", 3, 4)]


def test_directory_scan(spark, tmp_path):
    for name, text in (("a.txt", "one"), ("deep/er/b.rs", "fn x() {}"), (".git/config", "no"), ("deep/.git/HEAD", "no"), ("deep/.github/c.yml", "yes")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = {(r.path, r.length) for r in files.listing(spark, str(tmp_path)).collect()}
    assert found == {("a.txt", 3), ("deep/er/b.rs", 9)}  # Spark's listing leaves all hidden names out


def test_rule_values(spark):
    text = '# top\nlost = 1\n[[rule]] # first\nname = "a # b" # c\nmax = -3\n\n[[rule]]\non = true\nratio = 0.5\nbad line\n'
    rows = evidence.rule_values(spark.createDataFrame([(1, text), (2, ""), (3, None)], "k long, text string")).collect()
    assert sorted(map(tuple, rows)) == [(1, 1, "rule", "max", "-3", "integer"), (1, 1, "rule", "name", "a # b", "string"), (1, 2, "rule", "on", "true", "boolean"), (1, 2, "rule", "ratio", "0.5", "other")]


def test_disjoint_raises(spark):
    one, two = spark.range(5).withColumnRenamed("id", "k"), spark.range(5, 8).withColumnRenamed("id", "k")
    assert evidence.disjoint(one, two, "k").count() == 5
    with pytest.raises(Exception, match="in both sets: 4"):
        evidence.disjoint(one, spark.createDataFrame([(4,)], "k long"), "k").select(F.sum("k")).collect()


def test_cochange_is_not_empty(spark, sf_dir):
    from stratalens.plans.registry import Tables

    assert co_changes(Tables(spark, sf_dir)).count() > 0
