"""Queues, prefix sums, budget admission, moving baselines and review units against plain Python."""

import random
import re
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from stratalens.operators import ordered, reach
from stratalens.operators.windows import admitted
from stratalens.plans.compositions import against_history, review_units
from stratalens.sources.bindings import DAY


@pytest.mark.parametrize(("seed", "n", "m"), [(1, 30, 60), (2, 40, 60), (3, 12, 90), (4, 60, 70), (5, 5, 0)])
def test_first_reached_is_a_queue(spark, seed, n, m):
    rng = random.Random(seed)
    names = [f"n{i:02}" for i in range(n)]
    edges = [(rng.choice(names), rng.choice(names), rng.choice(["high", "medium"])) for _ in range(m)] + [("n00", "n00", "high"), (None, "n01", "high")]
    seeds = rng.sample(names, min(3, n)) + [None, names[0], names[0]]
    out = defaultdict(dict)
    for a, b, label in edges:
        out[a][b] = min(label, out[a].get(b, label))
    want, queue = {s: (0, None, None) for s in sorted({s for s in seeds if s})}, deque(sorted({s for s in seeds if s}))
    while queue:
        at = queue.popleft()
        for b in sorted(out[at]):
            if b not in want:
                want[b] = (want[at][0] + 1, at, out[at][b])
                queue.append(b)
    df = spark.createDataFrame(edges, "src string, dst string, label string")
    got = reach.first_reached(df, spark.createDataFrame([(s,) for s in seeds], "node string")).collect()
    assert {r["node"]: (r["distance"], r["via"], r["label"]) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("blocks", [1, 7, None])
def test_running_sums(spark, blocks):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randint(-5, 9), rng.random() < 0.5) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, v long, flag boolean")
    got = ordered.running_sums(df, ["k"], ["i"], {"total": F.col("v"), "n": F.col("flag").cast("long")}, blocks)
    want, sums = {}, defaultdict(lambda: [0, 0])
    for k, i, v, flag in sorted(rows, key=lambda r: r[1]):
        sums[k][0] += v
        sums[k][1] += flag
        want[i] = tuple(sums[k])
    assert {r["i"]: (r["total"], r["n"]) for r in got.collect()} == want
    assert ordered.running_sums(df, [], ["i"], {"n": F.lit(1)}, blocks).filter("n = i + 1").count() == 500
    if blocks == 7:  # a key of most rows lies in several blocks
        assert ordered.placed(df, ["k", "i"], 7).filter("k = 'a'").select("block").distinct().count() > 2


@pytest.mark.parametrize(("most", "chunk"), [(5, 1), (5, 6), (50, 64), (1, 4)])
def test_last_frames(spark, most, chunk):
    rows = [(i, i // 2 if i < 40 else i - 20, i % 3) for i in range(1, 200)]  # positions repeat
    df = spark.createDataFrame(rows, "i long, p long, v long")
    got = ordered.last_frames(df, "p", most, F.when(F.col("v") > 0, F.col("i")), "seen", chunk)
    want = {i: sorted(j for j, q, v in rows if v > 0 and p - most < q <= p) for i, p, _ in rows}
    assert {r["i"]: sorted(r["seen"]) for r in got.collect()} == want


@pytest.mark.parametrize("tasks", [None, 7])
def test_sums_of_span(spark, tasks):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(0, 90)]), rng.randint(0, 4)) for _ in range(400)] + [("c", 9, 2), ("c", 19, 1), ("c", 20, 1)]
    got = ordered.sums_of_span(spark.createDataFrame(rows, "k string, ts long, v long"), ["k"], 10, {"total": F.col("v"), "n": F.lit(1)}, tasks).collect()
    near = lambda a, b: a == b if a is None or b is None else b - 10 <= a <= b
    seen = {(k, ts): [v for q, at, v in rows if q == k and near(at, ts)] for k, ts, _ in rows}
    assert {tuple(r) for r in got} == {(*at, sum(v), len(v)) for at, v in seen.items()} and len(got) == len(seen)


def test_units_add_no_frame_up_again_for_each_row(spark):
    """A frame with a lower bound is added up anew for every row, so that a file or pair of n rows in a year costs n * n."""
    df = spark.createDataFrame([(1, "a", 1, 0, True), (1, "b", 1, 0, True), (2, "a", 3, DAY, False)], "hash long, file string, lines long, ts long, fix boolean")
    plan = review_units(df, 1, 100, 8)._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame, unboundedpreceding" in plan and "RangeFrame, -" not in plan


def dispatched(items, wall, limit, percent):
    """The loop itself: batches in turn, each accepted as a whole before it runs."""
    out, stopped = {}, {}
    for run in {r[0] for r in items}:
        own = sorted(r for r in items if r[0] == run)
        used_s = used_b = 0
        for batch in sorted({r[1] for r in own}):
            accepted, asked_s, asked_b = [], used_s, used_b
            for _, _, item, secs, took, size in [r for r in own if r[1] == batch]:
                if run in stopped:
                    out[run, batch, item] = "not_dispatched"
                elif limit > 0 and size * 100 >= percent * limit:
                    out[run, batch, item] = "skipped_oversize"
                elif asked_s + secs > wall or asked_b + size > limit:
                    stopped[run] = item
                    out[run, batch, item] = "not_dispatched"
                    out |= dict.fromkeys([(run, batch, i) for i, _, _ in accepted], "not_dispatched")
                else:
                    asked_s, asked_b = asked_s + secs, asked_b + size
                    accepted.append((item, took, size))
                    out[run, batch, item] = "dispatched"
            if run not in stopped:
                used_s, used_b = used_s + sum(max(took, 1) for _, took, _ in accepted), used_b + sum(b for _, _, b in accepted)
    return {(*k, v, stopped.get(k[0])) for k, v in out.items()}


@pytest.mark.parametrize(("wall", "limit", "percent"), [(300, 2000, 20), (120, 10_000, 80), (10_000, 900, 50), (500, 0, 80), (10**9, 10**9, 80)])
def test_budget_admission(spark, wall, limit, percent):
    rng = random.Random(wall)
    items = [(run, b, 100 * b + i, rng.randint(0, 20), rng.randint(0, 25), rng.choice([0, 5, 60, 200, 450])) for run in range(4) for b in range(6) for i in range(rng.randint(1, 9))]
    items += [(9, 0, i, 1, 1, 1) for i in range(400)]  # one long batch
    df = spark.createDataFrame(items, "run long, batch long, item long, secs long, took long, bytes long")
    for blocks in (None, 9):
        assert {tuple(r) for r in admitted(df, wall, limit, percent, blocks).collect()} == dispatched(items, wall, limit, percent)


def test_risk_against_a_moving_history(spark):
    rng = random.Random(8)
    commits = [(i, rng.randint(0, 60), rng.random() < 0.2, rng.choice([None, *range(8)])) for i in range(300)]
    order = sorted(commits, key=lambda c: (c[1], c[0]))
    want = {}
    for at, (h, _, _, score) in enumerate(order):
        if score is None:
            continue
        last = [c for c in order[: at + 1] if not c[2]][-7:]
        rest = [c[3] for c in last if c[0] != h and c[3] is not None]
        p = int(100 * sum(x <= score for x in rest) / len(rest) + 0.5) if rest else 0
        want[h] = (float(score), len(rest), p, "high" if p >= 90 else "medium" if p >= 60 else "low")
    df = spark.createDataFrame([(h, ts, m, None if s is None else float(s)) for h, ts, m, s in commits], "hash long, ts long, merge boolean, score double")
    for blocks, chunk in ((None, 1 << 14), (5, 8)):
        assert {r["hash"]: tuple(r)[1:] for r in against_history(df, 7, blocks, chunk).collect()} == want


def test_review_units(spark):
    """Units by union-find over co-change of the year before, scores by the formula; one change is wide, and makes no history itself."""
    rng, rows = random.Random(9), []
    names = [f"m{i}/{k}" for i in range(4) for k in ("promo", "small", "large")]
    for h in range(120):
        wide = h == 100
        for f in names if wide else rng.sample(names[:6] if h % 2 else names[6:], rng.randint(1, 4)):
            rows.append((h, f, rng.randint(1, 300), (h * 9 + rng.choice([0, 0])) * DAY, h % 4 == 0))
    least, days, most = 2, 100, 8
    by = defaultdict(dict)
    for h, f, lines, ts, fix in rows:
        by[h][f] = (lines, ts, fix)
    want = set()
    for h, files in by.items():
        ts = next(iter(files.values()))[1]
        past = [o for o in by if o != h and ts - days * DAY <= next(iter(by[o].values()))[1] <= ts and len(by[o]) <= most]
        edges = [(a, b) for a in files for b in files if a < b and sum(a in by[o] and b in by[o] for o in past) >= least]
        root = {f: f for f in files}
        for a, b in edges:
            low, high = sorted((root[a], root[b]))
            root = {f: low if r == high else r for f, r in root.items()}
        units = []
        for first in set(root.values()):
            own = sorted(f for f in files if root[f] == first)
            lines = [files[f][0] for f in own]
            seen = lambda f, d, fixes, h=h, ts=ts: sum(o != h and f in by[o] and ts - d * DAY <= by[o][f][1] <= ts and (by[o][f][2] or not fixes) for o in by)
            shape = (min(len(own) / 20, 1) + min(sum(lines) / 600, 1) + max(lines) / sum(lines)) / 3
            bare = any(not f.endswith("/small") for f in own) and not any(f.endswith("/small") for f in own)
            score = 30 * shape + 25 * bare + 25 * min(sum(seen(f, 180, True) for f in own) / 6, 1) + 20 * min(sum(seen(f, 90, False) for f in own) / 20, 1)
            units.append((-round(score + 1e-9, 4), first, ",".join(own), len(own), sum(a in own for a, _ in edges)))
        want |= {(h, place, members, n, e, -score) for place, (score, _, members, n, e) in enumerate(sorted(units), 1)}
    df = spark.createDataFrame(rows, "hash long, file string, lines long, ts long, fix boolean")
    got = {tuple(r) for r in review_units(df, least, days, most).collect()}
    assert got == want and max(r[3] for r in got) > 3 and any(r[0] == 100 and r[4] > 0 for r in got)


def test_coupling_details_read_the_lines_once_a_purpose(spark, sf_dir, monkeypatch):
    """Edges come from the imports and churn from the commits' files; each was worked out several times."""
    from stratalens.operators import aggregates
    from stratalens.registry import queries

    asked = []
    for name in ("imports", "commit_files"):
        monkeypatch.setattr(aggregates, name, lambda t, f=getattr(aggregates, name), name=name: asked.append(name) or f(t))
    queries()["l05_coupling_details"](spark, sf_dir)
    assert sorted(asked) == ["commit_files", "imports"]


@pytest.mark.parametrize("name", ["d13_diff_shape", "c06_two_way_suffix", "c15_cochange_pairs", "e06_merge_ranges", "c01_import_resolution", "c01_import_candidates", "l06_bus_factor_details"])
def test_tasks_grow_with_the_table(spark, sf_dir, monkeypatch, name):
    """A task's share of rows is bounded: more rows make more tasks, not larger ones."""
    from stratalens import shared
    from stratalens.registry import queries

    tasks = lambda: max(map(int, re.findall(r"RepartitionByExpression \[[^\]]*\], (\d+)", queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString())), default=0)
    few = tasks()
    monkeypatch.setattr(shared, "ROWS", 10)
    assert tasks() >= 4 * few > 0
