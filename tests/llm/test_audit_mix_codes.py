"""Source divergence, source mixing and vector codes against brute force, on edge cases and on the small tables."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratalens.llm import divergence, mixing, queries, vector_codes

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
CLASHING = "term string, n long, block int, rank int, size long, h long, code string, error long, r int"


def with_clashes(spark, rows, schema):
    return spark.createDataFrame([(*r, "t", 1, 2, 3, 4, 5, "c", 6, 7) for r in rows], f"{schema}, {CLASHING}")


def lower(data):
    return data.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))


# --- divergence


def divergences(rows, least, best):
    """(lang, source, text) -> the contract's rows, by whole numbers of Python."""
    docs = [((lang or ""), (source or ""), TERM.findall(lower((text or "").encode()))) for lang, source, text in rows]
    out = []
    for lang in {x[0] for x in docs}:
        own = [x for x in docs if x[0] == lang]
        seen = Counter(t for x in own for t in set(x[2]))
        kept = sorted(t for t, n in seen.items() if n >= least)
        counts = {s: Counter() for s in {x[1] for x in own}}
        for _, s, terms in own:
            counts[s].update(t for t in terms if seen[t] >= least)
        whole = sum(counts.values(), Counter())
        p = lambda c: {t: 1 + (10**9 * (c[t] + 5)) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        shares, q = {s: p(c) for s, c in counts.items()}, p(whole)
        for s in counts:
            far = [(-sum(abs(shares[s][t] - shares[o][t]) for t in kept), o.encode()) for o in counts if o != s]
            more = [(q[t] - shares[s][t], t) for t in kept if counts[s][t] and shares[s][t] > q[t]]
            for part, items, most in (("pair", far, None), ("term", more, best)):
                out += [(lang, s, part, i.decode(), -v, r) for r, (v, i) in enumerate(sorted(items)[:most], 1)]
    return sorted(out)


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "Ärger", "ärger", "don't", "naïve", "日本", "x1y", "MIXED", "mixed", "\x1cctrl", "zeta-eta"] + [f"w{chr(97 + i)}" for i in range(20)]
    pick = lambda: " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randint(0, 60)))
    rows = [(rng.choice(["en", "de", "", None]), rng.choice(["a", "b", "ü", None, "", "c"]), pick()) for _ in range(n)]
    return rows + [("fr", "lone", "un deux"), ("xx", "p", "rare"), ("xx", "q", "words"), ("en", "empty", None), ("en", "empty", ""), ("en", "long", "alpha beta " * 200_000), *[("en", "a", "same same text")] * 9]


@pytest.mark.parametrize("cells", [4096, 7])
def test_divergence(spark, monkeypatch, cells):
    monkeypatch.setattr(divergence, "BLOCK_CELLS", cells)
    monkeypatch.setattr(divergence, "MOST_CELLS", cells)
    rows = corpus(300, 3)
    docs = with_clashes(spark, rows, "lang string, source string, text string").repartition(5)
    got = sorted(tuple(r) for r in divergence.source_divergence(docs, least_docs=12, best=6).collect())
    assert got == divergences(rows, 12, 6)
    assert {r[2] for r in got} == {"pair", "term"} and not [r for r in got if r[0] == "fr"]


def test_divergence_of_an_empty_table(spark):
    docs = with_clashes(spark, [], "lang string, source string, text string")
    assert divergence.source_divergence(docs).collect() == []


def test_equal_hashes_of_different_bytes_are_told_apart():
    texts = ["ab cd ab", "abc ab", "", "ef"]
    data, offsets = divergence.joined(pa.array([*texts, None]))
    folded, starts, ends = divergence.boundaries(data, offsets)
    words = [folded[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert words == [b"ab", b"cd", b"ab", b"abc", b"ab", b"ef"]
    for digest in (lambda x: 7, lambda x: len(x), divergence.xxhash.xxh64_intdigest):
        code, models = divergence.grouped(folded, starts, ends, digest)
        assert [words[models[c]] for c in code] == words and len({words[m] for m in models}) == len(models) == 4


def test_shares_are_exact():
    rng = random.Random(1)
    count = [rng.randrange(10**k + 1) for k in range(15)] + [1, 0]
    of = 10**15 - 1
    assert divergence.shares(np.array(count), of).tolist() == [1 + 10**9 * c // of for c in count]


# --- mixing


def water_filled(sizes, weights, budget, most):
    """Targets by repeated sharing out, as fractions."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w, fixed, left = {s: weights[i % len(weights)] for i, s in enumerate(order)}, {}, Fraction(budget)
    while True:
        free = [s for s in order if s not in fixed]
        given = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if given[s] > most * sizes[s]]
        if not over:
            return fixed | given
        for s in over:
            fixed[s] = Fraction(most * sizes[s])
        left = Fraction(budget) - sum(fixed.values())


def test_targets(spark):
    rng = random.Random(2)
    for some in ([(f"s{i}", rng.choice([0, 1, 5, rng.randrange(10**9)])) for i in range(23)] + [(None, 400), ("", 7)], [("a", 0), (None, 0)], [("only", 10)]):
        sizes = dict(some)
        want = water_filled(sizes, (5, 2, 1), Fraction(3 * sum(sizes.values()), 2), 2)
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(some, "source string, source_size long")).collect()}
        assert got == {s: pytest.approx(float(t), rel=1e-15) for s, t in want.items()}


def test_splitting_tree_deals_disjoint_places():
    quotas, shards = [1000, 3, 0, 257], 13
    walks = [mixing.shard_places(quotas, i, shards, 5) for i in range(shards)]
    for s, q in enumerate(quotas):
        assert sorted(p for w in walks for p in range(*w[s])) == list(range(q))
    totals = [sum(b - a for a, b in w) for w in walks]
    assert max(totals) - min(totals) <= 4 and walks == [mixing.shard_places(quotas, i, shards, 5) for i in range(shards)]
    share = [sum(mixing.draw(np.array(quotas), 630, [i])[0] for i in range(300)) / 300]
    assert share[0] == pytest.approx(500, rel=0.02)


def documents(n, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b", "b", "c", None]), " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 80)))) for i in range(n)]
    return rows + [(n, "a", "long\ttext\n" * 30_000), (n + 1, "z", None), (n + 2, "z", "  "), (None, "b", "no id"), (None, None, None), *[(n + 3, "b", "many copies of one row")] * 300]


def test_mix(spark):
    rows = documents(400, 4)
    docs = with_clashes(spark, rows, "doc_id long, source string, text string")
    mixed = mixing.mix(docs.repartition(7), block_words=500, shard_blocks=4)
    got = mixed.collect()
    count = lambda t: len(SPACE.findall((t or "").encode()))
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((i, s, count(t)) for i, s, t in rows)
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += count(t)
    want = water_filled(sizes, (5, 2, 1), Fraction(3 * sum(sizes.values()), 2), 2)
    taken = Counter()
    for r in got:
        words = [c["words"] for c in r["copies"]]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(float(want[r["source"]]), rel=1e-15)
        assert len(words) <= 2 and all(0 <= w <= r["size"] for w in words)
        taken[r["source"]] += sum(words)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    shards = Counter()
    for r in got:
        for c in r["copies"]:
            shards[c["shard"]] += c["words"]
    assert len(shards) > 10 and set(shards) == set(range(len(shards)))
    again = mixing.mix(docs.repartition(2), block_words=500, shard_blocks=4).collect()
    plain = lambda some: Counter((r["doc_id"], r["h"], r["size"], tuple(map(tuple, r["copies"]))) for r in some)
    assert plain(again) == plain(got)
    assert plain(mixing.mix(docs, block_words=500, shard_blocks=4, seed=1).collect()) != plain(got)


def test_mix_of_an_empty_table_and_shards_as_files(spark, tmp_path):
    none = with_clashes(spark, [], "doc_id long, source string, text string")
    assert mixing.mix(none).collect() == []
    docs = spark.createDataFrame(documents(60, 8), "doc_id long, source string, text string")
    mixed = mixing.mix(docs, block_words=300, shard_blocks=6)
    mixing.write_shards(mixed, f"{tmp_path}/shards")
    written = spark.read.parquet(f"{tmp_path}/shards")
    assert written.agg(F.sum("words")).first()[0] == sum(c["words"] for r in mixed.collect() for c in r["copies"])
    place = [r["place"] for r in written.filter("shard = 1").select("place").collect()]
    assert place == sorted(place)


def test_op12_on_the_tables(spark, sf_dir):
    rows = queries.op12_source_mix(spark, sf_dir).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sizes, taken = Counter(), Counter()
    for r in docs.values():
        sizes[r["source"]] += len(SPACE.findall((r["text"] or "").encode()))
    want = water_filled(sizes, (5, 2, 1), Fraction(3 * sum(sizes.values()), 2), 2)
    assert len(rows) == len(docs)
    for r in rows:
        source = docs[r["doc_id"]]["source"]
        assert (r["source_size"], r["target"]) == (sizes[source], float(want[source])) and 0 <= r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


# --- vector codes


def coded(rows, parts, entries, rounds, scale=4096):
    """(vec_id, vector, label) -> codes by plain comparison with every entry, in whole numbers of Python."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = -(-len(kept[0][1]) // parts)
    piece = lambda v, p: (v + [0] * parts)[p * width : (p + 1) * width] if len(v) % parts else v[p * width : (p + 1) * width]
    books = [[piece(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (square(x, book[e]), e))
    for _ in range(rounds):
        for p, book in enumerate(books):
            members = [[] for _ in book]
            for _, v, _ in kept:
                members[nearest(piece(v, p), book)].append(piece(v, p))
            books[p] = [[sum(c) // len(own) for c in zip(*own, strict=True)] if own else book[e] for e, own in enumerate(members)]
    out, per_label = [], Counter()
    for i, v, label in kept:
        code = [nearest(piece(v, p), books[p]) for p in range(parts)]
        error = sum(square(piece(v, p), books[p][c]) for p, c in enumerate(code))
        out.append([i, "".join(f"{c:02x}" for c in code), error, label])
        per_label[label] += error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, c, e, per_label[label], digest) for i, c, e, label in out)


def vectors(n, dim, seed, grid=None):
    rng = random.Random(seed)
    f32 = lambda x: float(np.float32(x))
    draw = lambda: f32(rng.choice(grid) if grid else rng.gauss(0, 0.3))
    rows = [(i * 3 % n, [draw() for _ in range(dim)], rng.choice([1, 1, 2, None])) for i in range(n)]
    odd = [(5, None, 1), (6, [None] * dim, 1), (7, [math.nan] * dim, 2), (8, [math.inf] + [0.0] * (dim - 1), 2), (9, [0.5] * (dim + 1), 1), (10, [], 1), (None, [f32(0.25)] * dim, None)]
    return rows + [odd[k] for k in range(len(odd))] + rows[:9]


@pytest.mark.parametrize(("n", "dim", "parts", "grid"), [(150, 16, 8, None), (120, 8, 4, [-0.5, 0.0, 0.5]), (60, 11, 4, None), (7, 16, 8, None), (80, 8, 8, [0.25])])
def test_vector_codes(spark, n, dim, parts, grid):
    rows = vectors(n, dim, n, grid)
    df = with_clashes(spark, rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = Counter(tuple(r) for r in vector_codes.vector_codes(df, parts=parts).collect())
    assert got == coded(rows, parts, 16, 6)


def test_vector_codes_of_no_vectors_and_far_components(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.vector_codes(with_clashes(spark, [], schema)).collect() == []
    assert vector_codes.vector_codes(with_clashes(spark, [(1, None, 1), (2, [None], 2)], schema)).collect() == []
    far = vector_codes.vector_codes(spark.createDataFrame([(1, [3e38, -3e38] * 8, 1), (2, [0.0] * 16, 1)], schema), entries=1).collect()
    assert {r["vec_id"]: r["code"] for r in far} == {1: "00" * 8, 2: "00" * 8} and min(r["error"] for r in far) > 0
    assert [r["code"] for r in vector_codes.vector_codes(spark.createDataFrame([(1, [], 1)], schema)).collect()] == ["00" * 8]


def test_filter_bounds_hold_and_leave_few():
    rng = np.random.default_rng(3)
    for entries in (rng.integers(-900, 900, (16, 8)), rng.integers(-2, 2, (16, 4)), np.zeros((3, 2), np.int64)):
        f, x = vector_codes.Filter(entries), rng.integers(-1000, 1000, (400, entries.shape[1]))
        exact = ((x[:, None] - entries[None]) ** 2).sum(2)
        lower, upper = f.bounds(x)
        assert (lower <= exact).all() and (exact <= upper).all()
        best, distance, worked = f.nearest(x)
        assert (best == exact.argmin(1)).all() and (distance == exact.min(1)).all()
        if entries.shape == (16, 8):
            assert worked < 0.35 * exact.size


def test_far_components_do_not_overflow():
    """The farthest vectors that are kept, against whole numbers of Python."""
    rows, x = vector_codes.integer_vectors(pa.array([[3e38] * 64, [-3e38] * 64], pa.list_(pa.float32())), 64)
    f = vector_codes.Filter(x)
    best, distance, _ = f.nearest(x)
    assert best.tolist() == [0, 1] and distance.tolist() == [0, 0]
    _, across, _ = vector_codes.Filter(x[1:]).nearest(x[:1])
    assert across.tolist() == [sum((a - b) ** 2 for a, b in zip(x[0].tolist(), x[1].tolist(), strict=True))] and across[0] > 0
