"""The op queries over the given tables against brute force, and the pipeline's stages on edge cases."""

import hashlib
import re
import struct
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratalens.llm import queries, simhash

SPACE, WORD = re.compile(rb"[^\x20\x09-\x0D]+"), re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(data):
    return data.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def library(vocabulary):
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def test_op1(spark, sf_dir, texts):
    import math

    tokens = {i: [*SPACE.findall(lower(t)), None] for i, t in texts.items()}
    seen, n = {}, 0
    for i, words in tokens.items():
        for w in words if remainder(i, 7) != 2 else ():
            seen[w], n = seen.get(w, 0) + 1, n + 1
    found = {r["doc_id"]: r for r in queries.op1_lattice_lm(spark, sf_dir).collect()}
    assert set(found) == set(texts)
    for i, words in tokens.items():
        r = found[i]
        base = sum(math.log10((seen.get(w, 0) + 1) / (n + len(seen) + 1)) for w in words)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (remainder(i, 7) == 2, len(words), sum(w in seen for w in words), n)
        assert r["base_score"] == pytest.approx(base) and math.isfinite(r["score"]) and r["score"] < 0
    held = [r for r in found.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["lattice_score"] for r in held)


def test_op5(spark, sf_dir, texts):
    tokenizer, rows = library("word_bpe_49k.json"), queries.op5_packing(spark, sf_dir).collect()
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for i, t in texts.items():
        ids, at = [*tokenizer.encode(t.decode(), add_special_tokens=False).ids, 1], 0
        for r in sorted(by.pop(i), key=lambda r: r["start"]):
            piece = ids[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(piece)}I", *piece)))
            at += r["length"]
        assert at == len(ids)
    assert not by
    total = padded = 0
    for some in sequences.values():
        at = 0
        for r in sorted(some, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        total, padded = total + at, padded + (0 if at & (at - 1) == 0 else 2048 - at)
    assert padded < 0.01 * total


def test_op6(spark, sf_dir, texts):
    tokenizer = library("byte_bpe_50k.json")
    found = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op6_bpe(spark, sf_dir).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for i, t in texts.items():
        ids = tokenizer.encode(t.decode(), add_special_tokens=False).ids
        assert found[i] == (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(tokenizer.decode(ids, skip_special_tokens=False).encode()))
    assert set(found) == set(texts)


def test_op7_base(spark, sf_dir, texts):
    phrases = {b"gnu general public license": "gpl", b"apache license": "apache", b"cc by": "cc-by", b"mit license": "mit"}
    found = {r["doc_id"]: r for r in queries.op7_license_scan(spark, sf_dir).collect()}
    for i, t in texts.items():
        words, places, labels = WORD.findall(lower(t)), [], set()
        for phrase, label in phrases.items():
            p = phrase.split()
            at = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
            places, labels = places + at, labels | ({label} if at else set())
        r = found[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1


def test_op9(spark, sf_dir, texts):
    prints = {}
    for i, t in texts.items():
        w = SPACE.findall(lower(t))
        shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[i] = sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))
    root = {f: f for f in prints.values()}
    for a in list(root):
        for b in list(root):
            if a < b and root[a] != root[b] and (a ^ b).bit_count() <= 3:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    least = {}
    for i, f in prints.items():
        least[root[f]] = min(i, least.get(root[f], i))
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.op9_simhash(spark, sf_dir).collect()} == {(i, f"{f:016x}", least[root[f]]) for i, f in prints.items()}


def test_op10(spark, sf_dir, texts):
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    found = {r["doc_id"]: r for r in queries.op10_toxicity(spark, sf_dir).collect()}
    assert set(found) == set(texts)
    for i, r in found.items():
        assert r["held_out"] == (remainder(i, 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [i for i in toxic if i in found and found[i]["held_out"] and toxic[i] is not None]
    assert sum(found[i]["predicted"] == toxic[i] for i in held) >= 0.9 * len(held)


CLASHING = "key string, check int, row int, name string, h long, n int, node long, doc_hash string, kept boolean, __hit string"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


OWN = {k: " ".join(f"own{k}x{i}" for i in range(80)) for k in (7, 8)}


def documents():
    long = " ".join(f"w{i % 997}x{i % 31}" for i in range(20_000))
    passage = " ".join(f"p{i}" for i in range(60))
    some = [(1, None), (2, ""), (3, " \n"), (None, "no id at all"), (None, None), (4, long), (5, long), (5, long), (6, "a b c"), (7, OWN[7] + " " + passage), (8, passage + "  " + OWN[8]), (6, "a b c"), (6, "another text of six")]
    return [(i, t, "en", "s", None, "k", 1, 2, "n", 3, 4, 5, "d", True, "hit") for i, t in some]


@pytest.mark.parametrize("rows", [documents(), []], ids=["edges", "empty"])
def test_stages_on_edges(spark, tmp_path, rows):
    """Nulls, empty and long texts, repeated rows, an empty table and columns with clashing names, stage by stage as written tables."""
    import corpus_pipeline

    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(1, 9)] if rows else [], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        if not rows:
            assert docs.count() == 0
        elif name == "exact_dedup":
            texts = [r["text"] or "" for r in before.collect()]
            assert sorted(r["text"] or "" for r in docs.collect()) == sorted(set(texts))
            assert {r["doc_id"] for r in docs.filter(F.length("text") > 1000).collect()} == {5}
        elif name == "near_dedup":
            assert docs.count() == before.count()
        elif name == "substring_dedup":
            left = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert {k: left[k] for k in OWN} == OWN and left[6] in ("a b c", "another text of six")
        elif name == "packing":
            assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_near_dedup_is_by_the_links_of_op9(spark, sf_dir):
    """Of each group of SimHash links the smallest doc_id stays; wordless texts all stay."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id is not null").dropDuplicates(["doc_id"])
    worded = docs.filter(F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    want = {r["component_id"] for r in simhash.near_duplicates(worded).collect()} | {r["doc_id"] for r in docs.join(worded.select("doc_id"), "doc_id", "left_anti").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()} == want
    assert len(want) < docs.count()
