"""Toxicity classifier with counterfactual regularisation.

A logistic model over the words of a text and their beginnings is fitted to labelled rows. For each labelled
text that holds an identity term, a copy with the term swapped for another of its kind is made; the squared
change of the text's logit between the two is penalised, so a mention of a group by itself moves no score.
Feature counts come from a Spark aggregation over the labelled sample, an L1 penalty leaves few weights, and
every whole text is scored by them.

The sample: at most MOST_ROWS labelled documents outside the held-out fold, by smallest hash of doc_id, one row of
each (of rows that repeat a doc_id the greatest text). Only the fit uses it. Of its features those that at least
LEAST_ROWS examples hold take part, and of these the MOST_FEATURES that tell the labels apart best. Labels, lang, source and doc_id are no inputs of a score.

Defined results: null text counts as empty and gets the score of no features; rows with null labels teach
nothing; a doc_id labelled twice counts as toxic if any label is; without labels the score is 0.5 or below for
all; repeated rows are scored each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, materialize, remainder, small_batches, texts_of

MOST_ROWS, MOST_FEATURES, LEAST_ROWS = 20_000, 6_000, 5
HEADS = (4, 5, 6)
FOLDS, HELD_OUT = 5, 0
LAMBDA_1, LAMBDA_2, LAMBDA_SWAP, ROUNDS = 4e-4, 1e-5, 1.0, 300

# Identity terms by kind; a term is swapped for the next one of its kind.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender", "nonbinary"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("black", "white", "asian", "latino", "hispanic"),
    ("african", "european", "american", "mexican", "chinese", "indian", "arab"),
    ("immigrant", "citizen", "refugee", "foreigner"),
    ("immigrants", "citizens", "refugees", "foreigners"),
    ("disabled", "blind", "deaf", "autistic"),
    ("old", "young", "elderly", "teenage"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos"),
)
SWAP = {a.encode(): b.encode() for kind in IDENTITY for a, b in zip(kind, kind[1:] + kind[:1], strict=True)}
#: Lower-cases A-Z and turns ASCII that is no letter or digit into spaces.
NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(data: bytes) -> set[bytes]:
    return set(data.translate(NORMAL).split())


def features(found: set[bytes]) -> set[bytes]:
    """The words, and the beginnings of the longer ones."""
    return found | {b"%d:%b" % (n, w[:n]) for w in found for n in HEADS if len(w) > n}


def _examples(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(frames):
        plain, swapped = [], []
        for data in texts_of(batch.column(1)):
            found = words(data)
            plain.append(list(features(found)))
            swapped.append(list(features({SWAP.get(w, w) for w in found})) if not found.isdisjoint(SWAP) else None)
        yield pa.record_batch([batch.column(0), pa.array(plain, pa.list_(pa.binary())), pa.array(swapped, pa.list_(pa.binary()))], ["toxic", "plain", "swapped"])


class Rows:
    """Sparse binary rows."""

    def __init__(self, rows: list[list[int]], width: int) -> None:
        self.at = np.array([i for r in rows for i in r], dtype=np.int64)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.n, self.width = len(rows), width

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.at], minlength=self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=r[self.row], minlength=self.width)


def fit(plain: list[list[int]], swapped: list[list[int] | None], toxic: list[int], width: int, lambda_swap: float = LAMBDA_SWAP) -> np.ndarray:
    """Weights, the last one the constant, by accelerated proximal gradient descent."""
    y, n = np.array(toxic, dtype=float), max(1, len(toxic))
    x = Rows([[*r, width] for r in plain], width + 1)
    both = [(i, s) for i, s in enumerate(swapped) if s is not None]
    before, after = Rows([plain[i] for i, _ in both], width + 1), Rows([s for _, s in both], width + 1)
    w = np.zeros(width + 1)
    rate = (y.sum() + 1) / (n + 2)
    w[-1] = np.log(rate / (1 - rate))
    # a step per weight: rows that hold a feature bound the curvature along it
    spread = np.bincount(x.row, minlength=x.n).astype(float)
    bound = x.back(spread) / (4 * n) + LAMBDA_2
    if both:
        change = np.bincount(before.row, minlength=before.n) + np.bincount(after.row, minlength=after.n)
        bound += lambda_swap * 2 * (before.back(change.astype(float)) + after.back(change.astype(float))) / n
    step, shrink = 1 / np.maximum(bound, 1e-9), np.full(width + 1, LAMBDA_1)
    shrink[-1] = 0
    old, ahead, t = w.copy(), w.copy(), 1.0
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x.times(ahead), -50, 50)))
        slope = x.back(p - y) / n + LAMBDA_2 * ahead
        if both:
            d = after.times(ahead) - before.times(ahead)
            slope += lambda_swap * 2 * (after.back(d) - before.back(d)) / n
        w = ahead - step * slope
        w = np.sign(w) * np.maximum(np.abs(w) - step * shrink, 0)
        t, before_t = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, old = w + (before_t - 1) / t * (w - old), w
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = MOST_ROWS) -> tuple[dict[bytes, float], float]:
    """Weight of each feature that has one, and the constant."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("__toxic")).filter("__id is not null and __toxic is not null").filter(remainder(F.col("__id"), FOLDS) != HELD_OUT)
    sample = known.groupBy("__id").agg(F.max("__toxic").alias("__toxic")).orderBy(F.xxhash64("__id"), "__id").limit(most_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    # at most most_rows ids, and one row of each
    picked = texts.join(F.broadcast(sample), "__id").groupBy("__id").agg(F.max("__toxic").alias("toxic"), F.max(F.coalesce("__text", F.lit(""))).alias("text")).select("toxic", "text")
    examples = materialize(picked.mapInArrow(_examples, "toxic int, plain array<binary>, swapped array<binary>"), "labelled")
    n, positive = examples.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n:
        return {}, -1.0
    rate = min(max((positive or 0) / n, 1e-6), 1 - 1e-6)
    counts = examples.select("toxic", F.explode("plain").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).filter(F.col("n") >= LEAST_ROWS)
    gain = F.pow(F.col("t") - rate * F.col("n"), 2) / (F.col("n") * rate * (1 - rate))
    names = [bytes(r[0]) for r in counts.orderBy(F.desc(gain), "f").limit(MOST_FEATURES).select("f").collect()]
    index = {f: i for i, f in enumerate(names)}

    def numbered(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pick = lambda c: [None if r is None else sorted(index[f] for f in r if f in index) for r in c.to_pylist()]
        for b in frames:
            yield pa.record_batch([b.column(0), *(pa.array(pick(b.column(i)), pa.list_(pa.int32())) for i in (1, 2))], ["toxic", "plain", "swapped"])

    rows = examples.mapInArrow(numbered, "toxic int, plain array<int>, swapped array<int>").toPandas()  # most_rows rows of feature numbers
    as_list = lambda c: [None if r is None else np.asarray(r).tolist() for r in rows[c]]
    w = fit(as_list("plain"), as_list("swapped"), rows["toxic"].tolist(), len(names))
    return {f: float(x) for f, x in zip(names, w, strict=False) if x}, float(w[-1])


def score_text(data: bytes, weights: dict[bytes, float], constant: float, starts: frozenset[bytes]) -> float:
    hot = {w for w in words(data) if w[:4] in starts}
    total = constant + sum(weights[f] for f in sorted(features(hot)) if f in weights)
    return float(1 / (1 + np.exp(-min(max(total, -50.0), 50.0))))


def starts_of(weights: dict[bytes, float]) -> frozenset[bytes]:
    """First four bytes of all words that can carry a weight."""
    return frozenset((f[2:] if f[1:2] == b":" else f)[:4] for f in weights)


def score_documents(docs: DataFrame, model: tuple[dict[bytes, float], float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every whole text."""
    weights, constant = model
    starts = starts_of(weights)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            yield pa.record_batch([batch.column(0), pa.array([score_text(t, weights, constant, starts) for t in texts_of(batch.column(1))], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def toxic_udf(model: tuple[dict[bytes, float], float]):  # noqa: ANN201
    """A column function that scores texts."""
    weights, constant = model
    starts = starts_of(weights)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array([score_text(t, weights, constant, starts) for t in texts_of(column)], pa.float64())

    return score


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents whose score is below the threshold, with all their columns."""
    score: Column = toxic_udf(train(docs, labels, text_col=text_col))(F.col(text_col))
    return docs.filter(score < threshold)
