"""Bounded retrieval and keyword look-up against plain Python."""

import random
import re
from collections import Counter

import pytest

from stratalens.operators import retrieval
from stratalens.plans.compositions import k16_retrieval_eval, passage_hits
from stratalens.plans.registry import Tables

TERM = re.compile(r"[a-z0-9_]+")


def terms(text):
    return [x for x in TERM.findall((text or "").lower()) if len(x) >= 3]


def corpus(n, seed, words=3000):
    """Zipf words, so that few are in most documents and most in few."""
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(words)]
    return [(i, " ".join(f"w{x:04}" for x in rng.choices(range(words), weights, k=rng.randint(1, 120)))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_best_documents(spark, monkeypatch, seed):
    docs = corpus(1500, seed) + [(9000, ""), (9001, None), (9002, "no ab of it")]
    rng = random.Random(seed)
    asked = [(q, " ".join(docs[rng.randrange(1500)][1].split()[: rng.choice([1, 4, 40, 80])])) for q in range(30)] + [(50, "unheard words alone"), (51, ""), (52, None)]
    want = set()
    for q, text in asked:
        own = set(terms(text))
        scored = sorted((-len(own & set(terms(d))), i) for i, d in docs if own & set(terms(d)))[:10]
        want |= {(q, i, -s, k) for k, (s, i) in enumerate(scored, 1)}
    met, plain = [], retrieval.settled

    def counted(df):
        out = plain(df)
        if df.columns == ["item_id", "doc_id"]:
            met.append(out.count())
        return out

    monkeypatch.setattr(retrieval, "settled", counted)
    monkeypatch.setattr(retrieval, "BLOCK_DOCS", 64)
    got = retrieval.best_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string"))
    assert {tuple(r) for r in got.collect()} == want
    shared = [len(set(terms(t)) & set(terms(d))) for _, t in asked for _, d in docs]
    # a join of all terms would make and shuffle sum(shared) rows for as many pairs as share any
    assert sum(met) < 0.15 * sum(shared) and sum(met) < 0.6 * sum(map(bool, shared))


def test_no_documents_or_questions(spark):
    docs, asked = spark.createDataFrame([(1, "some words")], "doc_id long, text string"), spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert retrieval.best_documents(docs.limit(0), asked).collect() == [] and retrieval.best_documents(docs, asked.limit(0)).collect() == []


def test_keyword_hits(spark):
    docs = [(1, "alpha beta\nALPHABET alphalpha\n\nbeta"), (2, "al pha\nxbetax betabeta"), (3, ""), (4, None)]
    asked = [(1, "alpha"), (1, "beta"), (2, "zzz"), (3, "bet")]
    got = retrieval.keyword_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, keyword string")).collect()
    want = Counter()
    for d, text in docs:
        for no, line in enumerate((text or "").split("\n"), 1):
            for item, word in asked:
                if n := line.lower().count(word):
                    want[item, d, no, word] = n
    assert {(r["item_id"], r["doc_id"], r["no"], r["keyword"]): r["times"] for r in got} == want


def test_short_passages_and_arms(spark, tmp_path):
    docs = [(1, "head line\nsome text with alphabeta gamma inside\nmore\nx\ny\nlast gamma line"), (2, "gamma gamma gamma delta\nomega delta"), (3, "of no use"), (4, "head alphabeta gamma")]
    items = [(1, "beta gam"), (2, "gamma delta\nomega"), (3, "zz y"), (4, "missing passage here"), (5, "gamma inside"), (6, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    t = Tables(spark, str(tmp_path))
    assert {tuple(r) for r in passage_hits(t).collect()} == {(1, 1), (1, 4), (2, 2), (5, 1)}
    arms = {r["item_id"]: r.asDict() for r in k16_retrieval_eval(t).collect()}
    heads, every = sum(len(d.split("\n")[0]) for _, d in docs), sum(len(x) for _, d in docs for x in d.split("\n"))
    # first lines hold both words of item 1 in document 4 alone, so arm A stops there and misses the first document with the passage
    assert arms[1]["covered_a"] is False and arms[1]["bytes_a"] == heads + len(docs[3][1]) + 1 and arms[1]["covered_b"] is True
    # a wider keyword set: found in no first line, so all lines are read, and two lines around the pointer
    assert arms[5]["covered_a"] and arms[5]["bytes_a"] == heads + every + sum(len(x) + 1 for x in docs[0][1].split("\n")[:4])
    assert (arms[2]["golden"], arms[2]["covered_a"], arms[2]["covered_b"]) == (2, True, True) and arms[2]["winner"] == ("a" if arms[2]["bytes_a"] < arms[2]["bytes_b"] else "b")
    assert [arms[i]["winner"] for i in (3, 4, 6)] == ["neither"] * 3 and arms[4]["golden"] is None
