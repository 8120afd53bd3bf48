"""Turns of equal number, near copies of few words, wide buckets, and scratch tables of several threads."""

import os
import random
import threading

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratalens.llm import common, queries, simhash
from stratalens.llm.chat import collapse_and_render


def test_chat_ties_against_sql(spark):
    """Random conversations of few turns and texts, many of them prefixes, with equal, null and negative numbers."""
    rng, rows = random.Random(11), []
    for c in range(160):
        n = rng.randint(1, 5)
        turns = sorted((rng.choice([None, -300, -1, 0, 1, 1, 2, 700]) for _ in range(n)), key=lambda t: (t is not None, t or 0))
        rows += [(c if c % 40 else None, t, rng.choice(["user", "bot", None]), rng.choice(["hi", "yo", "", None])) for t in turns]
        if c % 3 == 0:  # a snapshot of its first turns in the order of turn, role, text
            own = sorted(set(rows[-n:]), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
            rows += [(1000 + c, *r[1:]) for r in own[: rng.randint(1, len(own))]]
    rows += [(3000 + i, 1, "user", t) for i in range(8) for t in ("a", "b")[: 1 + i % 2]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("raw", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    con.execute("CREATE VIEW conversations AS SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM raw")
    want = sorted(con.execute(queries.OP2_SQL).fetchall(), key=repr)
    for parts in (1, 6):
        assert sorted((tuple(r) for r in collapse_and_render(df.repartition(parts)).collect()), key=repr) == want


def test_chat_equal_numbers_in_prefixes(spark):
    """Two turns numbered 1 of which the snapshot holds the first by role and text: the longer conversation alone stays."""
    rows = [r for i in range(8) for r in ((2 * i, 1, "a", f"x{i}"), (2 * i + 1, 1, "a", f"x{i}"), (2 * i + 1, 1, "b", f"y{i}"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(r["conv_id"] for r in collapse_and_render(df).collect()) == [1, 3, 5, 7, 9, 11, 13, 15]


def found_ids(spark, rows):
    return {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}


def keys_of(text):
    return set(enumerate(simhash.partition_keys(simhash.least_words(np.unique(simhash.shingle_hashes(text.encode(), simhash.SHINGLE))))))


def test_short_near_copies(spark):
    """Sets of 4 to 40 shingles at a similarity of 0.8 or little more: every pair that shares a partition is found."""
    rng, rows, want, pairs = np.random.default_rng(12), [], set(), 0
    words = lambda n: [f"t{x}" for x in rng.integers(0, 500_000, n)]
    for size in range(4, 41):
        for _ in range(6):
            w, extra = words(size + 4), size // 4  # size of size + extra shingles: 0.8 or more
            a, b = 2 * pairs, 2 * pairs + 1
            one, two = " ".join(w), " ".join(w + words(extra))
            rows += [(a, one), (b, two)]
            pairs += 1
            want.add(a)
            if not keys_of(one) & keys_of(two):
                want.add(b)
    assert found_ids(spark, rows) == want and len(want) <= pairs * 1.02


def test_sizes_alone_rule_pairs_out(spark):
    nodes = spark.createDataFrame([(0, [0] * simhash.WIDE, 4), (1, [0] * simhash.WIDE, 5), (2, [0] * simhash.WIDE, 6), (3, [-1] * simhash.WIDE, 40), (4, [0] * simhash.WIDE, 40)], "node long, fp array<long>, n int")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (3, 4)], "a long, b long")
    assert sorted(map(tuple, simhash.likely_pairs(pairs, nodes, 0.7, 0.8).collect())) == [(0, 1), (1, 2)]


def test_wide_buckets_are_split(spark, monkeypatch):
    """Texts of one template share buckets without being near copies: where these are too wide, two shared buckets still find the planted pairs."""
    rng = np.random.default_rng(13)
    words = lambda n: [f"t{x}" for x in rng.integers(0, 50_000, n)]
    template, rows = words(200), []
    for i in range(240):
        w = template + words(160)
        rows.append((i, " ".join(w)))
        if i % 4 == 0:
            rows.append((1000 + i, " ".join(w[:-12] + words(12))))  # similarity 0.93
    monkeypatch.setattr(simhash, "MOST_OUTSIDE", 8)
    made, plain = [], simhash.split_wide
    squares = lambda members: members.groupBy("key").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0
    monkeypatch.setattr(simhash, "split_wide", lambda members, most: made.append((squares(members), squares(out := plain(members, most)))) or out)
    assert found_ids(spark, rows) == set(range(240))
    assert made[0][0] > 10_000 and made[0][1] < 0.4 * made[0][0]


def test_scratch_of_two_threads(spark):
    """Each takes away its own tables only, and what is kept stays."""
    ready, out = threading.Barrier(2), {}

    def work(i):
        with common.scratch(spark) as keep:
            own = common.materialize(spark.range(i + 1), f"own-{i}")
            ready.wait()
            with common.scratch(spark) as inner:
                common.materialize(spark.range(2), "deep")
                given = inner(spark.range(5), "given")
            kept = keep(spark.range(10 + i), f"kept-{i}")
            ready.wait()
            out[i] = (own.count(), given.count(), kept, [f.removeprefix("file:") for f in own.inputFiles()])

    threads = [threading.Thread(target=work, args=(i,)) for i in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    for i in range(2):
        assert out[i][:2] == (i + 1, 5) and out[i][2].count() == 10 + i
        assert not any(os.path.exists(f) for f in out[i][3])
    outside = common.materialize(spark.range(3), "outside")
    assert outside.agg(F.count("id")).first()[0] == 3


@pytest.mark.parametrize("most", [2, 5])
def test_checked_broadcast(spark, most):
    table = spark.range(4)
    plan = table.join(common.checked_broadcast(table, most), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == (most >= 4)


def test_query_blocks_travel_small(spark, monkeypatch):
    """Of evenly spread vectors, whose blocks rule little out: a query takes four bytes a component and some for its ids and floor; the result is that of brute force."""
    from stratalens.llm import topk

    rng, sizes = np.random.default_rng(14), []
    x = rng.normal(0, 0.3, (600, 16))
    table = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    plain = topk.materialize

    def counted(df, name):
        out = plain(df, name)
        if name == "blocks":
            sizes.append(out.agg(F.count("block"), F.sum(F.length("matrix") + F.length("table") + F.length("rows") + F.length("ids") + F.length("floors")), F.sum(F.length("rows") / 8)).first())
        return out

    monkeypatch.setattr(topk, "materialize", counted)
    got = topk.top_k(table, every=10, vector_block=100, query_block=5)
    v = np.floor(256 * x).astype(np.int64)
    want = [(i, r + 1, j, s) for i in range(0, len(v), 10) for r, (s, j) in enumerate(sorted(((int(v[i] @ v[j]), j) for j in range(len(v)) if j != i), key=lambda p: (-p[0], p[1]))[:5])]
    assert sorted(map(tuple, got.collect())) == want
    (n_stored, stored_bytes, vectors), (n_asked, asked_bytes, queries) = sizes
    assert (vectors, queries) == (600, 60) and asked_bytes == queries * (16 * 4 + 24)
    # every query block to every stored block, and each stored block once, is far below a stored block for every pair
    assert n_stored * asked_bytes + stored_bytes < 0.3 * n_asked * stored_bytes
    big = np.array([[2.0**40, -1.0], [3.0, 4.0]])
    assert (topk.unpacked(topk.packed(big), 2, 2) == big).all() and len(topk.packed(big[1:])) == 8
