"""Order statistics by selection against sorting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stratalens.operators import selection


def values(kind, n, rng):
    return {
        "even": lambda: rng.random(), "few": lambda: rng.choice([1.0, 2.0, 2.0, 3.5]), "one": lambda: 7.0, "long": lambda: rng.lognormvariate(0, 6), "negative": lambda: rng.randint(-50, 50) * 1.0,
        "odd": lambda: rng.choice([math.inf, -math.inf, 0.0, 1e308, -1e308, 5e-324]),
    }[kind]


@pytest.mark.parametrize("kind", ["even", "few", "one", "long", "negative", "odd"])
@pytest.mark.parametrize("most", [8, 4096])
def test_order_statistics(spark, monkeypatch, kind, most):
    rng = random.Random(len(kind) + most)
    draw = values(kind, 0, rng)
    rows = [(k, draw()) for k in ["a"] * 700 + ["b"] * 9 + [None] * 40 + ["c"]] + [("d", None), ("a", None)]
    sorted_rows, plain = [], selection.within

    def watched(df, ranges, key):
        out = plain(df, ranges, key)
        sorted_rows.append(out.groupBy(*key, "lo", "hi").count().agg(F.max("count")).first()[0] or 0)  # the last call is of the ranges that are sorted
        return out

    monkeypatch.setattr(selection, "within", watched)
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    ranks = {"p1": selection.nth(1), "p50": selection.nth(50), "p95": selection.nth(95), "p100": selection.nth(100), **selection.MIDDLE}
    got = {r["k"]: tuple(r)[1:] for r in selection.order_statistics(df, ["k"], "v", ranks, most).collect()}
    want = {}
    for k in ("a", "b", None, "c"):
        own = sorted(v for x, v in rows if x == k and v is not None)
        n = len(own)
        want[k] = (n, *(own[max(1, math.ceil(p * n / 100)) - 1] for p in (1, 50, 95, 100)), own[(n + 1) // 2 - 1], own[n // 2])
    assert got == want
    if kind in ("even", "negative", "long", "few", "one"):
        assert sorted_rows[-1] <= most  # no task sorts more than one closed range


def test_a_single_group_and_none(spark):
    df = spark.range(1, 10_001).select(F.col("id").cast("double").alias("v"))
    assert [tuple(r) for r in selection.order_statistics(df, [], "v", {"p": selection.nth(90)}, 50).collect()] == [(10_000, 9000.0)]
    assert selection.order_statistics(df.filter("v < 0"), [], "v", {"p": selection.nth(90)}).collect() in ([], [(0, None)])
