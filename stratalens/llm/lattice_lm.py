"""Language-model scoring by the subword lattice of each word.

A public vocabulary's pieces, word ends marked, form a unigram model: a word's probability is the sum over all
its segmentations, by forward recursion in log space over its bytes, for all words of one length at once. None of the
installed vocabularies has unigram scores, so they start from the vocabulary's
own rank order and are re-estimated from the expected counts that the same lattices give over the distinct
training words (expectation maximisation, one Spark aggregation a round). That model alone gives lattice_score.

score departs from it in one way: a training word is besides one arc
over its whole lattice. The weights of these arcs by training count, and that of entering the pieces, are
estimated on one of the training folds from the counts of the others (held-out estimation), and all words
together have probability one at most. For words of the training rows that arc counts most; the pieces spell the
others. A text is its words and one end token.

Work is done once per distinct word of the corpus: a table of words holds counts and scores.
The words of the highest counts in all rows (HEAD_WORDS and HEAD_BYTES at most together, each LONG_WORD bytes at most)
are sent to all tasks; a document's other words are joined to the table.

Defined results: null text counts as empty, whose only token is the end; repeated rows are scored each, and each
counts in training; a null doc_id is hashed as the empty text; with no training rows every count is zero; a
word of any length is scored whole; other columns are not read.
"""

from __future__ import annotations

import json
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_characters, slices
from .common import batches, materialize, remainder, small_batches, texts_of

VOCABULARY, END_MARK = "word_bpe_49k.json", "</w>"
FOLDS, HELD_OUT, WEIGHING = 7, 2, 3  # the fold that teaches nothing, and the training fold on which arcs are weighed
HEAD_WORDS, HEAD_BYTES, LONG_WORD, ROUNDS, PRIOR_WEIGHT, MOST_COUNT = 100_000, 4 << 20, 4096, 2, 0.1, 40
LN10 = math.log(10)


class Pieces:
    """Pieces of the vocabulary with log-probabilities."""

    def __init__(self, inner: dict[bytes, int], final: dict[bytes, int], log_p: np.ndarray) -> None:
        self.log_p = log_p
        self.number = inner, final
        self.inner, self.final = ({w: float(log_p[i]) for w, i in d.items()} for d in (inner, final))
        self.share = tuple({w: (math.exp(log_p[i]), i) for w, i in d.items()} for d in (inner, final))
        self.longest = max(map(len, [*inner, *final]))
        self.sorted: dict[bool, list[tuple[int, np.ndarray, np.ndarray]]] = {}

    @classmethod
    def load(cls, path: str) -> Pieces:
        """Scores by rank: a piece's share falls with its place in the vocabulary."""
        with open(path, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        chars, inner, final = byte_characters(), {}, {}
        for token, i in vocab.items():
            body = token.removesuffix(END_MARK)
            if body and all(c in chars for c in body):
                (final if body != token else inner)[bytes(chars[c] for c in body)] = i
        share = 1 / (np.arange(max(vocab.values()) + 1) + 100.0)
        return cls(inner, final, np.log(share / share.sum()))

    def forward_one(self, word: bytes) -> float:
        """Log-probability of the word, over all segmentations."""
        n, longest, known = len(word), self.longest, self.inner.get
        alpha = [0.0]
        for j in range(1, n + 1):
            if j == n:
                known = self.final.get
            terms = []
            for i in range(j - longest if j > longest else 0, j):
                if (p := known(word[i:j])) is not None:
                    terms.append(alpha[i] + p)
            alpha.append(log_sum(terms))
        return alpha[n]

    def expect_one(self, word: bytes, counts: np.ndarray) -> None:
        """Add the expected number of each piece in one occurrence of word; sums are scaled at each position, so no word underflows."""
        n, longest, known = len(word), self.longest, self.share[0].get
        alpha, arcs = [1.0], []
        for j in range(1, n + 1):
            if j == n:
                known = self.share[1].get
            here, total = [], 0.0
            for i in range(j - longest if j > longest else 0, j):
                if (x := known(word[i:j])) is not None:
                    share = alpha[i] * x[0]
                    here.append((i, x[1], share))
                    total += share
            arcs.append((here, total))
            alpha.append(total)
            if total < 1e-200:  # once in dozens of bytes: lift what is still to be read
                alpha[-longest:] = [a * 1e150 for a in alpha[-longest:]]
        weight = [0.0] * n + [1.0]  # expected visits of each position
        for j in range(n, 0, -1):
            if visits := weight[j]:
                here, total = arcs[j - 1]
                scale = visits / total
                for i, k, share in here:
                    x = share * scale
                    weight[i] += x
                    counts[k] += x

    def tables(self, final: bool) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For each length of pieces that has some: the length, the pieces' sorted keys and their numbers."""
        if final not in self.sorted:
            by: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for piece, i in self.number[final].items():
                by[len(piece)].append((int(window_keys(np.frombuffer(piece, np.uint8)[None, :], 0, len(piece))[0]), i))
            self.sorted[final] = [(n, *(np.array(x, t) for x, t in zip(zip(*sorted(some), strict=True), (np.uint64, np.int64), strict=True))) for n, some in sorted(by.items())]
        return self.sorted[final]

    def arcs(self, block: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """start, end, rows, piece numbers: which words of a block of equal length (bytes as rows) have a piece from start to end, by end and start."""
        length = block.shape[1]
        for end in range(1, length + 1):
            for n, keys, numbers in reversed(self.tables(end == length)):
                if n <= end:
                    wanted = window_keys(block, end - n, n)
                    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                    rows = np.flatnonzero(keys[at] == wanted)
                    if len(rows):
                        yield end - n, end, rows, numbers[at[rows]]

    def forward(self, words: list[bytes]) -> np.ndarray:
        """Log-probability of each word, over all segmentations; few or very long words of a length go one by one."""
        out = np.zeros(len(words))
        for which, block in blocks(words):
            if len(which) < FEW_WORDS:
                out[which] = [self.forward_one(words[i]) for i in which.tolist()]
                continue
            alpha = np.full((block.shape[1] + 1, len(which)), -np.inf)
            alpha[0] = 0
            for start, end, rows, pieces in self.arcs(block):
                alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[start, rows] + self.log_p[pieces])
            out[which] = alpha[-1]
        return out

    def expect(self, words: list[bytes], counts: np.ndarray) -> None:
        """Add the expected number of each piece in one occurrence of each word."""
        for which, block in blocks(words):
            if len(which) < FEW_WORDS:
                for i in which.tolist():
                    self.expect_one(words[i], counts)
                continue
            length = block.shape[1]
            alpha, beta = (np.full((length + 1, len(which)), -np.inf) for _ in range(2))
            alpha[0] = beta[-1] = 0
            arcs = list(self.arcs(block))
            for start, end, rows, pieces in arcs:
                alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[start, rows] + self.log_p[pieces])
            for start, end, rows, pieces in reversed(arcs):
                ahead = beta[end, rows] + self.log_p[pieces]
                share = np.exp(alpha[start, rows] + ahead - alpha[-1, rows])
                counts += np.bincount(pieces, weights=share, minlength=len(counts)) if len(pieces) > len(counts) // 8 else 0
                if len(pieces) <= len(counts) // 8:
                    np.add.at(counts, pieces, share)
                beta[start, rows] = np.logaddexp(beta[start, rows], ahead)


def log_sum(terms: list[float]) -> float:
    if len(terms) == 1:
        return terms[0]
    if not terms:
        return -math.inf
    top = max(terms)
    return top + math.log(sum([math.exp(t - top) for t in terms])) if top > -math.inf else top


BLOCK_BYTES, FEW_WORDS = 1 << 18, 16


def blocks(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and bytes (a row each) of the words of each length, in blocks of about BLOCK_BYTES."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    edges = [0, *(np.flatnonzero(np.diff(sizes[order])) + 1).tolist(), len(words)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a < b:
            length = int(sizes[order[a]])
            step = max(1, BLOCK_BYTES // length)
            for at in range(a, b, step):
                which = order[at : min(at + step, b)]
                yield which, np.frombuffer(b"".join([words[i] for i in which.tolist()]), np.uint8).reshape(len(which), length)


def window_keys(block: np.ndarray, start: int, n: int) -> np.ndarray:
    """A number for the n bytes of each row from start on: the bytes themselves up to eight, else a hash of them."""
    out = np.zeros(len(block), np.uint64)
    for at in range(start, start + n, 8):
        part = np.zeros(len(block), np.uint64)
        for k, c in enumerate(range(at, min(at + 8, start + n))):
            part |= block[:, c].astype(np.uint64) << np.uint64(8 * k)
        out = part if at == start else (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + part
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), c, d, e: every distinct word of the corpus with its count in the training rows, in those of the weighing fold and in all; docs: fold, text."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(frames):
            parts: dict[int, Counter] = {HELD_OUT: Counter(), WEIGHING: Counter(), -1: Counter()}
            for fold, text in zip(table.column(0).to_pylist(), texts_of(table.column(1)), strict=True):
                parts[fold if fold in parts else -1].update(text.lower().split())
            for fold, count in parts.items():
                words, times = [*count], [*count.values()]
                c, d = (0 if fold == HELD_OUT else 1), (1 if fold == WEIGHING else 0)
                for at in range(0, len(words), 20_000):
                    n = pa.array(times[at : at + 20_000], pa.int64())
                    yield pa.record_batch([pa.array(words[at : at + 20_000], pa.binary()), pc.multiply(n, c), pc.multiply(n, d), n], ["word", "c", "d", "e"])

    return docs.select("fold", "text").mapInArrow(run, "word binary, c long, d long, e long").groupBy("word").agg(*(F.sum(x).alias(x) for x in "cde"))


def arc_weights(counted: DataFrame) -> tuple[list[float], float]:
    """Probability of one word of each training count, MOST_COUNT + 1: per unit of count above it; and of entering the pieces."""
    top = MOST_COUNT + 1
    by = lambda c: {r["k"]: r for r in counted.groupBy(F.least(c, F.lit(top)).alias("k")).agg(F.count(F.lit(1)).alias("types"), F.sum(c).alias("tokens"), F.sum("d").alias("weighed")).collect()}  # noqa: E731  # top + 1 rows
    rest, full = by(F.col("c") - F.col("d")), by(F.col("c"))
    seen, others = sum(r["weighed"] for r in rest.values()), sum(r["tokens"] for r in rest.values())
    if not seen or not others:
        tokens = sum(r["tokens"] for r in full.values())
        enter = 0.5 if tokens else 1.0
        return [0.0, *((1 - enter) * k / tokens if tokens else 0.0 for k in range(1, top)), (1 - enter) / tokens if tokens else 0.0], enter
    enter = min(max(rest[0]["weighed"] / seen if 0 in rest else 0.0, 1e-4), 0.9)
    weight = [0.0]
    for k in range(1, top):
        r = rest.get(k)
        weight.append(max(r["weighed"] / seen * others / r["types"], 1e-3 * k) if r else float(k))
    weight.append(max(rest[top]["weighed"] / seen * others / rest[top]["tokens"], 1e-3) if top in rest else 1.0)
    total = sum(weight[k] * (r["tokens"] if k == top else r["types"]) for k, r in full.items() if k)
    return [(1 - enter) * w / total for w in weight], enter


def fitted(words: DataFrame, pieces: Pieces, rounds: int = ROUNDS) -> Pieces:
    """Pieces whose scores are re-estimated from all training words; words: word, c."""
    prior = np.exp(pieces.log_p)
    for _ in range(rounds):
        now = pieces

        def run(frames: Iterator[pa.RecordBatch], now: Pieces = now) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(len(now.log_p))
            for table in slices(frames, 1 << 20):
                now.expect(table.column(0).to_pylist(), counts)
            some = np.flatnonzero(counts)
            yield pa.record_batch([pa.array(some, pa.int64()), pa.array(counts[some], pa.float64())], ["piece", "n"])

        sums = words.filter("c > 0").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # of the vocabulary's size at most
        counts = prior * len(prior) * PRIOR_WEIGHT
        for r in sums:
            counts[r["piece"]] += r["n"]
        pieces = Pieces(*pieces.number, np.log(counts / counts.sum()))
    return pieces


class Model(NamedTuple):
    """Training tokens and distinct ones (ends included), ends, weights of whole-word arcs by count, weight of entering the pieces, and these."""

    tokens: int
    distinct: int
    ends: int
    weights: list[float]
    enter: float
    pieces: Pieces


def learn(rows: DataFrame, counted: DataFrame, vocabulary: str = VOCABULARY) -> Model:
    """The model of the training rows; rows: fold; counted: word_counts of them."""
    ends = rows.filter(F.col("fold") != HELD_OUT).count()
    n, distinct = counted.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    weights, enter = arc_weights(counted)
    return Model(n + ends, distinct + (ends > 0), ends, weights, enter, fitted(counted, Pieces.load(public_tokenizers.path(vocabulary))))


def lattice_scores(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score (log10; the last by the pieces alone)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), remainder(F.col(id_col), FOLDS).cast("int").alias("fold"), F.col(text_col).alias("text"))
    counted = materialize(word_counts(rows), "word-counts")
    model = learn(rows, counted, vocabulary)
    arcs, log_enter = np.log(np.maximum(model.weights, 1e-300)), math.log(model.enter)

    def score(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(frames, 1 << 20):
            spelled = model.pieces.forward(table.column(0).to_pylist())
            c = table.column(1).to_numpy()
            arc = np.where(c <= MOST_COUNT, arcs[np.minimum(c, MOST_COUNT)], arcs[-1] + np.log(np.maximum(c, 1)))
            mixed = np.where(c > 0, np.logaddexp(arc, log_enter + spelled), log_enter + spelled) / LN10
            yield from pa.table([table.column(0), table.column(1), table.column(2), pa.array(mixed), pa.array(spelled / LN10)], ["word", "c", "e", "mixed", "spelled"]).to_batches()

    words = materialize(counted.select("word", "c", "e").mapInArrow(score, "word binary, c long, e long, mixed double, spelled double"), "words")
    # the head: the least count of which at most HEAD_WORDS words of HEAD_BYTES in all have as many, in all rows
    short = words.filter(F.length("word") <= LONG_WORD)
    level = F.floor(F.log2("e") * 8).cast("int")
    held, size, least = 0, 0, None
    for r in sorted(short.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("word")).alias("bytes")).collect(), key=lambda r: -r["level"]):  # at most 8 rows per power of two
        held, size = held + r["n"], size + r["bytes"]
        if held > HEAD_WORDS or size > HEAD_BYTES:
            break
        least = r["level"]
    head = {} if least is None else {bytes(r["word"]): (math.log10(r["c"] + 1), r["mixed"], r["spelled"], r["c"] > 0) for r in short.filter(level >= least).collect()}
    shared = spark.sparkContext.broadcast(head)

    def split(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches(frames, 2 << 20):
            sums: dict[str, list] = defaultdict(list)
            for text in texts_of(batch.column(2)):
                count = Counter(text.lower().split())
                tail, base, mixed, spelled, found = [], 0.0, 0.0, 0.0, 0
                for word, times in count.items():
                    if (x := known.get(word)) is None:
                        tail.append({"word": word, "times": times})
                    else:
                        base, mixed, spelled, found = base + times * x[0], mixed + times * x[1], spelled + times * x[2], found + times * x[3]
                for name, value in (("n_words", sum(count.values())), ("known", found), ("base", base), ("mixed", mixed), ("spelled", spelled), ("tail", tail or None)):
                    sums[name].append(value)
            kinds = {"n_words": pa.int64(), "known": pa.int64(), "base": pa.float64(), "mixed": pa.float64(), "spelled": pa.float64(), "tail": pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))}
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(sums[k], t) for k, t in kinds.items())], ["row_id", "doc_id", *kinds])

    parts = materialize(rows.select("row_id", "doc_id", "text").mapInArrow(split, "row_id long, doc_id long, n_words long, known long, base double, mixed double, spelled double, tail array<struct<word:binary,times:long>>"), "parts")
    tail = parts.select("row_id", F.explode("tail").alias("t")).select("row_id", "t.word", "t.times")
    rest = tail.join(words, "word").groupBy("row_id").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known_2"),
        F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("base_2"),
        *(F.sum(F.col("times") * F.col(x)).alias(f"{x}_2") for x in ("mixed", "spelled")),
    )
    size = math.log10(model.tokens + model.distinct + 1)
    end = (model.ends + 1) / (model.tokens + model.distinct + 1)
    ends = F.col("n_words") * (math.log10(1 - end) if end < 1 else 0.0) + math.log10(end)
    whole = lambda c: F.col(c) + F.coalesce(f"{c}_2", F.lit(0))
    return parts.join(rest, "row_id", "left").select(
        "doc_id",
        (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        (F.col("n_words") + 1).alias("n_tokens"),
        (whole("known") + int(model.ends > 0)).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (whole("base") + math.log10(model.ends + 1) - (F.col("n_words") + 1) * size).alias("base_score"),
        (whole("mixed") + ends).alias("score"),
        (whole("spelled") + ends).alias("lattice_score"),
    )
