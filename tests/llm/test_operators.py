"""The corpus operators against brute force, on edge cases and on the small tables."""

import hashlib
import itertools
import math
import re
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratalens.llm import bpe, common, exact_dedup, lattice_lm, licenses, packing, queries, simhash, substring_dedup, topk, toxicity
from stratalens.llm.chat import collapse_and_render

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
CLASHING = "key string, row int, name string, h long, n int, text_sha256 string, node long"
PASSAGE = " ".join(f"word{i}" for i in range(60))


def texts():
    """(doc_id, text) with nulls, empties, ties, repeated rows, a very long text and odd characters."""
    longest = " ".join(f"w{i % 997}x{i % 31}" for i in range(60_000))
    return [
        (1, "The Quick brown fox, don't stop."), (2, "The Quick brown fox, don't stop."), (2, "The Quick brown fox, don't stop."), (3, None), (4, ""), (5, "   \t\n "), (None, "no id at all"), (None, None),
        (6, longest), (7, "intro " + PASSAGE + " end of seven"), (8, "other start " + PASSAGE + " tail"), (9, "a " * 80), (10, "naïve ÉCOLE déjà vu \x1c ctrl\t  tabs\n\n\nlines  <|endoftext|> and <|startoftext|>"),
        (11, "MIT License and mit license; Apache License, Version 2.0. CC BY 4.0 GNU General Public License v3 or later"), (12, "日本語 текст Σίσυφος ΣΑΣ ١٢٣ é ﬁ"), (13, "x"), (14, "x y"), (15, "'s't're aaaa aaaaa a"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "c", 1, "n", 2, 3, "s", 4) for i, t in texts()]
    return spark.createDataFrame(rows, f"doc_id long, text string, {CLASHING}")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("doc_id = -1")


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def lower(data):
    return data.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))


def test_lattice_sums_all_segmentations():
    inner, final = {b"a": 0, b"ab": 1, b"b": 2}, {b"b": 3, b"ab": 4, b"a": 5}
    pieces = lattice_lm.Pieces(inner, final, np.log(np.array([0.1, 0.2, 0.15, 0.25, 0.05, 0.25])))
    word, total = b"abab", 0.0
    for cut in itertools.product([0, 1], repeat=len(word) - 1):
        ends = [i + 1 for i, c in enumerate(cut) if c] + [len(word)]
        parts = [word[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        p = 1.0
        for part in parts[:-1]:
            p *= math.exp(pieces.inner[part]) if part in inner else 0.0
        total += p * (math.exp(pieces.final[parts[-1]]) if parts[-1] in final else 0.0)
    assert pieces.forward_one(word) == pytest.approx(math.log(total))
    assert pieces.forward([word] * 20 + [b"ab"]) == pytest.approx([math.log(total)] * 20 + [pieces.forward_one(b"ab")])
    counts = np.zeros(6)
    pieces.expect([b"ab" * 700], counts)
    assert sum(c * n for c, n in zip(counts, (1, 2, 1, 1, 2, 1), strict=True)) == pytest.approx(1400)


def test_lattice_blocks_equal_single_words():
    """Words of equal length together, of the installed vocabulary, give what each gives by itself."""
    rng = np.random.default_rng(5)
    pieces = lattice_lm.Pieces.load(public_tokenizers.path(lattice_lm.VOCABULARY))
    words = [bytes(rng.choice(np.frombuffer(b"abcdefghijklmnopqrstuvwxyz\xc3\xa9-.", np.uint8), n).tolist()) for n in rng.integers(1, 24, 900)] + [b"internationalization"] * 20 + [b"x" * 3000]
    assert pieces.forward(words) == pytest.approx([pieces.forward_one(w) for w in words])
    together, apart = np.zeros(len(pieces.log_p)), np.zeros(len(pieces.log_p))
    pieces.expect(words, together)
    for w in words:
        pieces.expect_one(w, apart)
    assert together == pytest.approx(apart)


def test_lattice_score_is_the_models_probability(spark, docs):
    """score and lattice_score of whole texts, by a sum over all segmentations of each word that is written here anew."""
    rows = docs.select("doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7).cast("int").alias("fold"), "text")
    model = lattice_lm.learn(rows, lattice_lm.word_counts(rows))
    p, (inner, final) = np.exp(model.pieces.log_p), model.pieces.number
    seen = {}
    for i, t in texts():
        if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2:
            for w in SPACE.findall(lower((t or "").encode())):
                seen[w] = seen.get(w, 0) + 1

    def spelled(word):
        ways = [1.0] + [0.0] * len(word)
        for b in range(1, len(word) + 1):
            for a in range(max(0, b - 40), b):
                i = (final if b == len(word) else inner).get(word[a:b])
                ways[b] += ways[a] * p[i] if i is not None else 0.0
        return ways[-1]

    end = (model.ends + 1) / (model.tokens + model.distinct + 1)
    want = []
    for i, t in texts():
        words = SPACE.findall(lower((t or "").encode()))
        if len(words) < 1000:
            arc = lambda w: model.weights[seen[w]] if seen.get(w, 0) <= lattice_lm.MOST_COUNT else model.weights[-1] * seen[w]
            both = sum(math.log10((arc(w) if w in seen else 0.0) + model.enter * spelled(w)) for w in words)
            tail = len(words) * math.log10(1 - end) + math.log10(end)
            want.append((i, round(both + tail, 5), round(sum(math.log10(spelled(w)) for w in words) + tail, 5)))
    found = lattice_lm.lattice_scores(docs)
    got = [(r["doc_id"], round(r["score"], 5), round(r["lattice_score"], 5)) for r in found.filter("n_tokens <= 1000").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_lattice_scores(docs, empty):
    n, seen, rows = 0, {}, texts()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    tokens = [SPACE.findall(lower((t or "").encode())) + [b""] for _, t in rows]
    for (i, _), words in zip(rows, tokens, strict=True):
        for w in words if not held(i) else ():
            seen[w], n = seen.get(w, 0) + 1, n + 1
    want = []
    for (i, _), words in zip(rows, tokens, strict=True):
        base = sum(math.log10((seen.get(w, 0) + 1) / (n + len(seen) + 1)) for w in words)
        want.append((i, held(i), len(words), sum(w in seen for w in words), n, round(base, 4)))
    found = lattice_lm.lattice_scores(docs)
    got = by_row(found.withColumn("base", F.round("base_score", 4)), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base")
    assert got == sorted(want, key=repr)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found.collect())
    assert lattice_lm.lattice_scores(empty).count() == 0


def test_chat(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 1, "assistant", "yo"), (4, 0, "user", None), (4, 1, None, ""), (5, None, "user", "first"), (5, 3, "user", "later"),
        (None, 0, "user", "lost"), (6, 0, "user", "hi"), (6, 1, "assistant", "no"), *((7, i, "user", f"turn {i}") for i in range(700)), *((8, i, "user", f"turn {i}") for i in range(699)),
    ]
    conv = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, position string, x int")
    got = {r["conv_id"]: (r["n_turns"], r["text"]) for r in collapse_and_render(conv).collect()}
    assert set(got) == {1, 4, 5, None, 6, 7}
    assert got[1] == (2, "<|user|>\nhi\n<|end|>\n<|assistant|>\nyo\n<|end|>\n") and got[7][0] == 700
    assert collapse_and_render(conv.filter("conv_id = -1")).count() == 0


def test_exact_duplicates(docs, empty):
    rows = texts()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    top = lambda ids: max((x for x in ids if x is not None), default=None)
    want = sorted(((i, top(groups[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=repr)
    found = exact_dedup.exact_duplicates(docs)
    assert by_row(found, "doc_id", "keep_id", "group_size", "text_sha256") == want
    kept = found.filter("kept").collect()
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.drop_exact_duplicates(empty).count() == 0


def test_chunks_follow_content():
    data = np.random.default_rng(1).integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    chunks = lambda d: {d[a:b] for a, b in zip([0, *exact_dedup.cuts(d)[:-1]], exact_dedup.cuts(d), strict=True)}
    assert b"".join(data[a:b] for a, b in zip([0, *exact_dedup.cuts(data)[:-1]], exact_dedup.cuts(data), strict=True)) == data
    assert len(chunks(b"some words in front" + data) & chunks(data)) > len(chunks(data)) * 0.8
    assert max(map(len, chunks(data))) <= exact_dedup.LONGEST


def brute_substrings(rows, window=35):
    words = [SPACE.findall((t or "").encode()) for _, t in rows]
    seen = {}
    for w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {p for s in range(len(w) - window + 1) if seen[tuple(w[s : s + window])] > 1 for p in range(s, s + window)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    return sorted(out, key=repr)


def test_substrings(docs, empty):
    assert by_row(substring_dedup.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings(texts())
    left = substring_dedup.drop_repeats(docs)
    assert left.columns == docs.columns and left.count() == docs.count()
    text = {r["doc_id"]: r["text"] for r in left.collect()}
    assert text[7] == "intro end of seven" and text[10] == texts()[12][1] and text[9] == ""
    assert substring_dedup.remove_repeats(empty).count() == 0 and substring_dedup.drop_repeats(empty).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_substrings_random(spark, seed):
    rng = np.random.default_rng(seed)
    pool = [" ".join(f"v{x}" for x in rng.integers(0, 3, 50)) for _ in range(8)]
    rows = [(i, " ".join([f"u{i}", *(pool[p] for p in rng.integers(0, 8, rng.integers(0, 4))), *(f"v{x}" for x in rng.integers(0, 40, 45))])) for i in range(40)]
    found = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert by_row(found, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings(rows)


def test_substrings_that_begin_in_a_branching_piece(spark):
    """A passage up to the end of two texts, with other words before it, and texts that begin inside the passage."""
    passage = [f"p{i}" for i in range(120)]
    rows = [(i, " ".join([*(f"u{i}x{k}" for k in range(20 + i)), *passage])) for i in range(4)]
    rows += [(10 + i, " ".join([*passage[i : 60 + i], *(f"w{i}x{k}" for k in range(50))])) for i in range(4)]
    found = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert by_row(found, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings(rows)


def check_packing(rows, pieces):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = sorted((tuple([*tok.encode(t or "", add_special_tokens=False).ids, 1]) for _, t in rows), key=repr)
    windows = {}
    for p in pieces:
        windows.setdefault(p["sequence_id"], []).append(p)
    padding = 0
    for w in windows.values():
        at = 0
        for p in sorted(w, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= 2048 and w[0]["sequence_tokens"] == at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0
    assert sum(p["length"] for p in pieces) == sum(map(len, ids))
    return ids


def test_packing(docs, empty, spark):
    rows = [(i, t) for i, (_, t) in enumerate(texts())]
    pieces = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_packing(rows, pieces)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, t in rows:
        ids, at = [*tok.encode(t or "", add_special_tokens=False).ids, 1], 0
        for p in sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"]):
            part = ids[at : at + p["length"]]
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += p["length"]
        assert at == len(ids)
    assert packing.pack_documents(docs).agg(F.sum("length")).first()[0] == sum(p["length"] for p in pieces)
    assert packing.pack_documents(empty).count() == 0


def test_packing_tiers_and_steps():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 5000, 300).tolist()
    windows = packing.pack(lengths)
    sizes = [sum(n for _, _, n in w) for w in windows]
    assert sum(sizes) == sum(lengths) and all(s & (s - 1) == 0 for s in sizes)
    assert {2048, 1024} <= set(sizes)
    steps, totals = packing.StepGroups(7, packing.STEP_TOKENS), {}
    dealt = [full for s in sizes if (full := steps.full(s, s))]
    assert sum(len(v) for v in steps.waiting.values()) < 2 * packing.STEP_TOKENS  # what waits does not grow
    for group, some in [*dealt, *steps.rest()]:
        totals[group] = totals.get(group, 0) + sum(some)
    assert sorted(totals) == list(range(7, 7 + len(totals))) and sum(totals.values()) == sum(sizes)
    assert [totals[g] for g in sorted(totals)][:-1] == [packing.STEP_TOKENS] * (len(totals) - 1)


def test_step_groups_of_a_task(spark):
    """However many slices a task has, one of its groups is short."""
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 900, int(rng.integers(1, 900))))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    pieces = packing.pack_documents(docs, slice_bytes=1 << 16).collect()
    check_packing(rows, pieces)
    totals = {}
    for p in pieces:
        totals[p["step_group"]] = totals.get(p["step_group"], 0) + p["length"]
    assert len(totals) > 20 and sorted(totals.values())[1:] == [packing.STEP_TOKENS] * (len(totals) - 1)


def test_bpe(docs, empty):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in texts():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), struct.pack(f"<{len(ids)}I", *ids), tok.decode(ids, skip_special_tokens=False)))
    got = sorted(((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in bpe.bpe_round_trip(docs).collect()), key=repr)
    assert got == sorted(want, key=repr)
    assert bpe.bpe_round_trip(empty).count() == 0


def test_licenses(docs, empty):
    want, word = [], re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in texts():
        words, places, labels = word.findall(lower((t or "").encode()).decode()), [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            at = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        want.append((i, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    found = licenses.license_scan(docs)
    assert by_row(found, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)
    row = found.filter("doc_id = 11").first()
    assert row["labels"] == "apache,apache-2.0,cc-by,cc-by-4.0,gpl,gpl-3,mit" and 0.9 < row["score"] <= 1
    assert len(licenses.rules()) > 200 and licenses.license_scan(empty).count() == 0


@pytest.mark.parametrize(("name", "known"), [("gpl", "123"), ("lgpl", "23"), ("agpl", "13")])
def test_license_version_in_one_word(name, known):
    for version in "123":
        got = licenses.scan(f"licensed under {name.upper()}v{version}".encode())
        tag = f"{name}-{version}" if version in known else name
        assert got[:5] == (3, 0, None, None, "") and got[5] == tag and got[6] == 0.95
    assert licenses.scan(f"{name}v3.0 or later".encode())[5] == f"{name}-3"
    assert licenses.scan(f"x{name}v3 {name}v3x".encode())[5:] == ("", 0.0)


def test_license_common_notices():
    want = {
        "This is GPLv3 code": ("gpl-3", 0.7),
        "licensed under AGPLv3 only": ("agpl-3", 0.95),
        "SPDX-License-Identifier: LGPLv2": ("lgpl-2", 0.99),
        "SPDX-License-Identifier: MIT": ("mit", 0.99),
        "SPDX-License-Identifier: Apache-2.0": ("apache-2.0", 0.99),
        "the apache 2.0 license": ("apache-2.0", 0.7),
        "SPDX-License-Identifier: BSD-3-Clause": ("bsd-3-clause", 0.99),
        "under the terms of the GNU Lesser General Public License, version 2.1": ("lgpl-2.1", 0.9),
        "the commit was submitted to a gplx summit": ("", 0.0),
    }
    assert {t: licenses.scan(t.encode())[5:] for t in want} == want


def sample(parsed, rng):
    """A string that a parsed regular expression matches, look-arounds left out."""
    out = b""
    for op, arg in parsed:
        kind = str(op)
        if kind == "LITERAL":
            out += bytes([arg])
        elif kind == "IN":
            out += sample([arg[int(rng.integers(len(arg)))]], rng)
        elif kind == "RANGE":
            out += bytes([int(rng.integers(arg[0], arg[1] + 1))])
        elif kind == "CATEGORY":
            out += b"7"
        elif kind == "BRANCH":
            out += sample(arg[1][int(rng.integers(len(arg[1])))], rng)
        elif kind == "SUBPATTERN":
            out += sample(arg[3], rng)
        elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
            for _ in range(int(rng.integers(arg[0], min(int(arg[1]), arg[0] + 2) + 1))):
                out += sample(arg[2], rng)
        else:
            assert kind in ("ASSERT", "ASSERT_NOT"), kind
    return out


def test_license_gate_loses_nothing(spark, sf_dir):
    """Searching for every rule gives what the gate lets through: on strings made from each rule, and on the documents."""
    import re._parser as parser

    rng = np.random.default_rng(4)
    for rule in licenses.rules():
        for _ in range(12):
            made = sample(parser.parse(rule.pattern.pattern), rng)
            got = licenses.scan(b"so " + made + b" it is")
            assert got == licenses.scan(b"so " + made + b" it is", gated=False) and got[5], (rule, made)
    read = lambda r: (r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"])
    got = {read(r) for r in queries.op7_license_scan(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert got == {(i, *licenses.scan((t or "").encode(), gated=False)) for i, t in rows} and len(licenses.rules()) > 200


def test_license_suppression():
    found = [licenses.Detection(*x) for x in ((40, 0, 30, "gpl-2", 0.9), (10, 5, 20, "gpl", 0.7), (10, 40, 50, "mit", 0.7), (10, 40, 50, "isc", 0.7), (10, 0, 60, "long", 0.5), (45, 41, 45, "inner", 0.9))]
    assert {d.label for d in licenses.resolve(found)} == {"gpl-2", "long", "inner"}
    rng = np.random.default_rng(2)
    for _ in range(200):
        some = [licenses.Detection(int(p) * 10, int(a), int(a + n), str(k), 0.5) for k, (p, a, n) in enumerate(rng.integers([1, 0, 1], [4, 12, 9], (12, 3)))]
        ranked, kept = sorted(some, key=lambda d: (-d.priority, d.start - d.end, d.start, d.label)), []
        for d in ranked:
            if not any(k.start <= d.start and d.end <= k.end for k in kept):
                kept.append(d)
        assert sorted(licenses.resolve(some)) == sorted(kept)


def test_license_time_is_linear():
    import time

    def took(n):
        text = b"licensed under the mit license or gpl version 2 and the apache license " * n
        best = []
        for _ in range(3):
            began = time.perf_counter()
            licenses.scan(text)
            best.append(time.perf_counter() - began)
        return min(best)

    assert took(4000) < 8 * took(1000)


@pytest.mark.parametrize("n", [0, 3, 900])
def test_topk(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, 6) / 4]) for i in range(n)]
    rows += [(50, None), (100, []), (150, [1.0, None, 0.0]), (200, [math.inf] * 6), (250, [math.nan] * 6), (None, [1.0] * 6), (1, [0.5] * 6), (0, [1.0, 2.0])] if n else []
    table = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "vec_id long, embedding array<double>, score double, rank int")
    want, good = [], [(k, i, [math.floor(256 * x) for x in v]) for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    for k, i, v in good:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for m, j, w in good if m != k and len(w) == len(v))
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:5])]
    assert by_row(topk.top_k(table), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


def test_topk_ships_few_blocks(spark, monkeypatch):
    """Of clustered vectors most block pairs are ruled out by their distances to the pivots, and the result is that of brute force."""
    rng, seen = np.random.default_rng(12), []
    centres = rng.normal(0, 20, (10, 6))
    centres *= 40 / np.linalg.norm(centres, axis=1)[:, None]
    x = np.concatenate([c + rng.normal(0, 0.05, (100, 6)) for c in centres])
    table = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    pairs = topk.block_pairs
    monkeypatch.setattr(topk, "block_pairs", lambda s, q, *rest: seen.append((s.count() * q.count(), (out := pairs(s, q, *rest)).count())) or out)
    monkeypatch.setattr(topk, "LEAST_BLOCK", 8)
    got = topk.top_k(table, every=10, n_pivots=64, vector_block=50, query_block=5)
    v = np.floor(256 * x).astype(np.int64)
    want = [(i, r + 1, j, s) for i in range(0, len(v), 10) for r, (s, j) in enumerate(sorted(((int(v[i] @ v[j]), j) for j in range(len(v)) if j != i), key=lambda p: (-p[0], p[1]))[:5])]
    assert by_row(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    every, shipped = seen[0]
    assert every >= 200 and shipped < every / 3


def test_simhash(docs, empty):
    prints = []
    for i, t in texts():
        w = SPACE.findall(lower((t or "").encode()))
        shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append((i, sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))))
    root = {f: f for _, f in prints}
    for a, b in itertools.combinations(root, 2):
        if (a ^ b).bit_count() <= 3:
            ra, rb = root[a], root[b]
            root = {k: (ra if v == rb else v) for k, v in root.items()}
    low = {}
    for i, f in prints:
        low[root[f]] = min((x for x in (low.get(root[f]), i) if x is not None), default=None)
    want = sorted(((i, f - (1 << 64) if f >> 63 else f, low[root[f]]) for i, f in prints), key=repr)
    assert by_row(simhash.near_duplicates(docs), "doc_id", "fp", "component_id") == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("counts", [(2,), (3,), (4,)])
def test_pigeonhole_loses_no_link(spark, counts, monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.integers(-(2**63), 2**63 - 1, 60)
    near = [int(np.int64(np.uint64(int(b) & (2**64 - 1)) ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, k, replace=False))))) for b in base for k in (1, 2, 3, 4)]
    fps = sorted({*map(int, base), *near})
    monkeypatch.setattr(simhash.plan_probes, "__defaults__", (counts,))
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {(min(r), max(r)) for r in simhash.links_of(nodes, 3).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(fps, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}


def test_allocation_is_least():
    cost = [[0, 5, 9, 30, 60], [0, 1, 50, 90, 200], [0, 7, 8, 20, 70]]
    value, ts = simhash.allocate(cost, 3)
    choices = [(sum(cost[i][t] for i, t in enumerate(c)), [t - 1 for t in c]) for c in itertools.product(range(5), repeat=3) if sum(c) == 4]
    assert value == min(choices)[0] and sum(t + 1 for t in ts) == 4


def test_near_copies(spark):
    rng = np.random.default_rng(3)
    words = lambda n: [f"t{x}" for x in rng.integers(0, 5000, n)]
    rows, near = [], 0
    for i in range(30):
        w = words(300)
        rows.append((3 * i, " ".join(w)))
        w2 = [*w]
        w2[100], w2[200] = "edit", "edits"  # 10 of 296 shingles: similarity above 0.9
        rows.append((3 * i + 1, " ".join(w2)))
        rows.append((3 * i + 2, " ".join(w[:150] + words(150))))  # about a third shared
    docs = spark.createDataFrame([(*r, 1) for r in rows] + [(900, None, 1), (901, "", 1)], "doc_id long, text string, node int")
    left = simhash.drop_near_duplicates(docs)
    ids = {r["doc_id"] for r in left.collect()}
    assert left.columns == docs.columns and ids == {r[0] for r in rows if r[0] % 3 != 1} | {900, 901}
    assert near == 0 and simhash.drop_near_duplicates(docs.filter("doc_id < 0")).count() == 0


def shingle_sets(rows):
    return {i: set(simhash.shingle_hashes(t.encode(), simhash.SHINGLE).tolist()) for i, t in rows}


def first_of_groups(rows, similarity=simhash.SIMILARITY):
    """The smallest id of each group that links of this similarity join, by brute force."""
    sets, root = shingle_sets(rows), {i: i for i, _ in rows}
    for a, b in itertools.combinations(sorted(sets), 2):
        if root[a] != root[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    return set(root.values())


def test_near_copies_among_template_texts(spark):
    """All share three fifths with each other, and so their buckets; only the pairs planted are near copies."""
    rng = np.random.default_rng(5)
    words = lambda n: [f"t{x}" for x in rng.integers(0, 50_000, n)]
    template, rows = words(225), []
    for i in range(500):
        w = template + words(75)
        rows.append((i, " ".join(w)))
        if i % 5 == 0:
            rows.append((1000 + i, " ".join(w[:-24] + words(24))))  # similarity 0.85
    want = first_of_groups(rows)
    assert len(want) == 500
    left = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in left.select("doc_id").collect()} == want


def test_recall_of_partitions():
    """Pairs of similarity 0.8 that share a partition: the number of texts plays no part."""
    rng, found = np.random.default_rng(6), 0
    for _ in range(400):
        h = rng.integers(0, 1 << 64, 300, dtype=np.uint64, endpoint=False)
        one, two = (np.array(simhash.partition_keys(simhash.least_words(x))) for x in (h[:270], h[30:]))  # 240 of 300 shared
        found += bool((one == two).any())
    assert found >= 0.95 * 400


def test_near_copies_close_to_the_threshold(spark):
    """Pairs of similarity 0.80 to 0.85 against brute force."""
    rng = np.random.default_rng(7)
    words = lambda n: [f"t{x}" for x in rng.integers(0, 50_000, n)]
    rows = []
    for i in range(100):
        w, k = words(300), int(rng.integers(24, 33))
        rows += [(i, " ".join(w)), (1000 + i, " ".join(w[:-k] + words(k)))]
    want = first_of_groups(rows)
    assert len(want) == 100
    left = {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    assert want <= left and len(left - want) <= 8


def test_near_copies_hot_group(spark):
    """One text with many near copies, each a little different: one group, and strangers stay."""
    rng = np.random.default_rng(8)
    words = lambda n: [f"t{x}" for x in rng.integers(0, 50_000, n)]
    base, rows = words(300), []
    for i in range(400):
        w = [*base]
        for at in rng.integers(0, 300, 4):
            w[at] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(words(40))) for i in range(20)] + [(2000, "..."), (2001, " "), (2002, "\n")]
    want = first_of_groups([r for r in rows if r[1].strip()])
    left = {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    assert left == want | {2001, 2002} and len(want) < 40


def test_rows_apart_by_keys(spark):
    """Rows whose key is sought are all in the first part; few others are."""
    df, keys = spark.range(20_000), spark.range(0, 20_000, 40)
    maybe, surely = common.apart(df, F.col("id"), keys, F.col("id"))
    found = {r[0] for r in maybe.collect()}
    assert {r[0] for r in keys.collect()} <= found and len(found) < 600 and surely.count() == 20_000 - len(found)
    assert common.without_keys(df, ["id"], keys).count() == 19_500 and common.without_keys(df, ["id"], keys.limit(0)).count() == 20_000


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(1500):
        bad = i % 5 == 0
        w = [f"n{x}" for x in rng.integers(0, 300, 40)] + (["vileword"] if bad else [])
        if i % 5 in (0, 1) and i % 10 < 8:
            w.append("women" if bad else "men")
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(d, y)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_documents(d, model).collect()}
    assert all((scores[i] >= 0.5) == bool(t) for i, t in labels)
    weight = lambda w: model[0].get(w, 0.0)
    free = toxicity.fit.__defaults__
    assert abs(weight(b"women") - weight(b"men")) < 0.5 and free
    edge = toxicity.score_documents(docs, model).collect()
    assert len(edge) == docs.count() and all(0 <= r["score"] <= 1 for r in edge)
    assert toxicity.score_documents(empty, model).count() == 0
    assert toxicity.train(docs, y.filter("doc_id < 0")) == ({}, -1.0)
    assert toxicity.keep_clean(docs, y.filter("doc_id < 0")).count() == docs.count()


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    """A labelled doc_id that repeats in the documents teaches once, and no more than the bound reach the fit."""
    fits, fit = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda plain, *rest, **more: fits.append(len(plain)) or fit(plain, *rest, **more))
    docs = spark.createDataFrame([(i, "stupid idiot go away" if i % 2 else "a kind word for all") for i in range(200)] + [(1, f"stupid idiot {k}") for k in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(1, 0), (1, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    taught = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(200))
    assert fits == [taught]
    score = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, model).collect()}
    assert all((score[i] > 0.5) == bool(i % 2) for i in range(200))
    toxicity.train(docs, labels, most_rows=50)
    assert fits[1] == 50


def test_swap_penalty_pulls_terms_together():
    plain, swapped = [[0, 1], [1], [2, 1], [1]] * 50, [[2, 1], None, [0, 1], None] * 50
    toxic = [1, 0, 0, 0] * 50
    loose, tight = (toxicity.fit(plain, swapped, toxic, 3, penalty) for penalty in (0.0, 1.0))
    assert abs(tight[0] - tight[2]) < 0.3 * abs(loose[0] - loose[2])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert by_row(queries.QUERIES[name](spark, sf_dir), *sorted(names)) == sorted((tuple(dict(zip(names, r, strict=True))[c] for c in sorted(names)) for r in found.fetchall()), key=repr)


def test_substring_query_on_tables(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert by_row(queries.op4_substring_dedup(spark, sf_dir), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings(rows)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(spark, docs, sf_dir)
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        if name == "exact_dedup":
            assert len(after) == len(set(before.values())) and set(after.values()) == set(before.values())
        if name == "substring_dedup":
            assert set(after) == set(before) and not brute_substrings([(i, t) for i, t in after.items()]) == []
        sizes.append(len(after))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    check_packing([(r["doc_id"], r["text"]) for r in docs.collect()], pieces)
    assert corpus_pipeline.run(spark, sf_dir).count() == len(pieces)
