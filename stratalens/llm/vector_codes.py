"""Vector code compression: a codebook for each part of a vector, and the nearest entries found by VA-file filtering.

Components become integers, vectors are cut into parts, and each part position has a codebook that is improved in rounds: every
part goes to its nearest entry, every entry to the floor of the mean of its parts. A round is one pass over the vectors:
each task gives sums and counts of its parts, Spark adds them up, and only the codebooks (entries x components) reach the driver.

The nearest entry is searched as in a VA-file. The coordinates of the entries are quantised into 2^BITS cells a dimension; for each
part and dimension a look-up table has the least and the greatest squared distance to any place in each cell; their
sums over an entry's cells bound the entry's distance from both sides. Entries whose lower bound exceeds the least upper bound
are out; only for the others the integer distance is worked out. A bound is never on the wrong side, so the result is exact, ties included.

Defined results: vectors that are null or hold null or non-finite components take no part; the length that counts is that of the
smallest kept vec_id, vectors of another length take no part either, and a length that can't be cut equally is filled up
with zeros; a null vec_id comes last, repeated vec_ids are ordered by their integer vectors, and repeated rows count each;
with fewer vectors than entries each starts an entry; an empty table gives an empty result; components beyond
+-2^30 / sqrt(length) / scale are cut there, so that distances stay exact in 64 bits; other columns are read only where named in `keep`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, fresh_task, materialize, small_batches

PARTS, ENTRIES, ROUNDS, SCALE, BITS = 8, 16, 6, 4096, 3
FAR = np.iinfo(np.int64).max


def integer_vectors(vectors: pa.Array, dim: int, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are kept (finite, of this length), and floor(scale * x) of their components."""
    right = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False))
    flat = vectors.filter(pa.array(right)).flatten()
    x = np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64).reshape(int(right.sum()), dim)
    finite = np.isfinite(x).all(axis=1)
    most = int(2**30 / max(dim, 1) ** 0.5)
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(scale * x[finite]), -most, most).astype(np.int64)
    return np.flatnonzero(right)[finite], whole


@dataclass
class Filter:
    """The VA-file of one part's codebook: cells of the entries' coordinates, and the edges of the cells."""

    entries: np.ndarray

    def __post_init__(self) -> None:
        cells, low, high = 1 << BITS, self.entries.min(axis=0), self.entries.max(axis=0)
        self.edges = low[:, None] + ((high - low + 1)[:, None] * np.arange(cells + 1)[None, :]) // cells  # of whole numbers: a cell ends before the next edge
        self.cell = (self.edges[None, :, :] <= self.entries[:, :, None]).sum(axis=2).clip(1, cells) - 1
        self.place = np.arange(len(low))[None, :] * cells + self.cell

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of the squared distance of each row of x to each entry, by look-up tables of the rows."""
        below, above = self.edges[None, :, :-1] - x[:, :, None], x[:, :, None] - (self.edges[None, :, 1:] - 1)
        near, far = np.maximum(np.maximum(below, above), 0), np.maximum(np.abs(below), np.abs(above))
        return tuple((t * t).reshape(len(x), -1)[:, self.place].sum(axis=2) for t in (near, far))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest entry of each row (the first of equals), its squared distance, and how many distances were worked out."""
        lower, upper = self.bounds(x)
        row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])
        gap = x[row] - self.entries[entry]
        exact = np.full(lower.shape, FAR, np.int64)
        exact[row, entry] = (gap * gap).sum(axis=1)
        best = exact.argmin(axis=1)
        return best, exact[np.arange(len(x)), best], len(row)


def cut(x: np.ndarray, parts: int) -> np.ndarray:
    """rows x parts x components of a part; filled up with zeros where the length isn't a multiple."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % parts))).reshape(len(x), parts, -1)


def smallest(vectors: DataFrame, n: int, scale: int) -> list[tuple]:
    """(vec_id, integer vector) of the n smallest ids of the length that counts; each task gives n of each length at most."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {}
        for batch in frames:
            for dim in pc.unique(pc.list_value_length(batch.column(1)).drop_null()).to_pylist():
                rows, x = integer_vectors(batch.column(1), dim, scale)
                ids = batch.column(0).take(pa.array(rows)).to_pylist()
                best[dim] = sorted([*best.get(dim, []), *((i is None, i or 0, v) for i, v in zip(ids, x.tolist(), strict=True))])[:n]
        rows = [(dim, none, i, v) for dim, some in best.items() for none, i, v in some]
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64())))], ["dim", "none", "i", "v"])

    found = vectors.mapInArrow(run, "dim long, none boolean, i long, v array<long>").orderBy("none", "i", "v", "dim")
    first = found.select("dim").first()
    return [] if first is None else found.filter(F.col("dim") == first["dim"]).limit(n).select("i", "v").collect()


def improved(vectors: DataFrame, books: list[np.ndarray], dim: int, scale: int) -> list[np.ndarray]:
    """The codebooks after one round: entries x components for each part."""
    parts = len(books)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [Filter(b) for b in books]
        sums = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]  # and the count, last
        for batch in frames:
            x = cut(integer_vectors(batch.column(1), dim, scale)[1], parts)
            for p in range(parts):
                own = np.append(x[:, p], np.ones((len(x), 1), np.int64), axis=1)
                best = filters[p].nearest(x[:, p])[0]
                order = np.argsort(best, kind="stable")
                used, at = np.unique(best[order], return_index=True)
                if len(used):
                    sums[p][used] += np.add.reduceat(own[order], at, axis=0)
        rows = [(p, e, row.tolist()) for p in range(parts) for e, row in enumerate(sums[p]) if row[-1]]
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.list_(pa.int64())))], ["part", "entry", "sums"])

    found = vectors.mapInArrow(run, "part int, entry int, sums array<long>").select("part", "entry", F.posexplode("sums")).groupBy("part", "entry", "pos").agg(F.sum("col").alias("n"))
    after, total = [b.copy() for b in books], {}
    for r in found.collect():  # parts x entries x (components + 1) rows
        total[r["part"], r["entry"], r["pos"]] = r["n"]
    for p, book in enumerate(after):
        for e in range(len(book)):
            if count := total.get((p, e, book.shape[1])):
                book[e] = [total[p, e, j] // count for j in range(book.shape[1])]
    return after


def codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[list[np.ndarray], int]:
    """The codebook of each part, and the length of vectors that they are for; vectors: id, vector."""
    first = smallest(vectors, entries, scale)
    if not first:
        return [], 0
    start = np.array([r["v"] for r in first], np.int64).reshape(len(first), -1)
    books = list(cut(start, parts).transpose(1, 0, 2))
    for _ in range(rounds if start.shape[1] else 0):
        books = improved(vectors, books, start.shape[1], scale)
    return books, start.shape[1]


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in order of part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, books: list[np.ndarray], dim: int, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, code (two hex digits a part), error (squared distance) and the columns `keep` of each vector of length `dim`."""
    parts, digits = len(books), np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), np.uint8).reshape(256, 2)
    columns = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), *keep)
    schema = ", ".join(["vec_id long", "code string", "error long", *(f"`{c}` {columns.schema[c].dataType.simpleString()}" for c in keep)])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_task("vector codes")
        filters = [Filter(b) for b in books] if dim else []
        for batch in frames:
            rows, x = integer_vectors(batch.column(1), dim, scale)
            x, rows = cut(x, max(parts, 1)), pa.array(rows)
            codes, error = np.zeros((len(x), parts), np.int64), np.zeros(len(x), np.int64)
            for p, f in enumerate(filters):
                codes[:, p], d, _ = f.nearest(x[:, p])
                error += d
            text = [s.decode() for s in np.ascontiguousarray(digits[codes]).reshape(len(x), 2 * parts).view(f"S{max(1, 2 * parts)}").ravel()] if len(x) else []
            yield pa.record_batch([batch.column(0).take(rows), pa.array(text, pa.string()), pa.array(error, pa.int64()), *(batch.column(2 + i).take(rows) for i in range(len(keep)))], ["vec_id", "code", "error", *keep])

    return columns.mapInArrow(run, schema) if books else columns.limit(0).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), *keep)


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error (sum of the errors of a label), codebooks_sha256. The input is read in every round: give a table, not a dear plan."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    small_batches(vectors.sparkSession, rows=4096)
    books, dim = codebooks(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")), parts, entries, rounds, scale)
    labelled = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    codes = materialize(encode(labelled, books, dim, scale, keep=("label",)), "codes")
    errors = checked_broadcast(materialize(codes.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error")), "label-errors"))
    return codes.join(errors, F.col("label").eqNullSafe(F.col("__label"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
