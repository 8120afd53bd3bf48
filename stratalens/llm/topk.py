"""Exact top-k inner product search by pivot-table elimination.

Vectors become integers floor(256 x). Giving every stored vector one more component that brings it to a common
norm M turns the inner product into a distance: |q-x|^2 = |q|^2 + M^2 - 2 q.x. Distances from each stored
vector to many pivots are computed once; |d(q,p) - d(x,p)|, at its largest over the pivots, bounds d(q,x) from
below. Vectors and queries are sorted by their nearest pivot and the distance from it and cut into blocks, which keep
the least and the greatest distance to each pivot. A query's k-th best score among the pivots and the vectors of the block that it lies in itself is its first floor. Only
block pairs whose intervals let some query of the block reach its floor are joined; within one, candidates are
evaluated in order of their bounds until the next bound exceeds the k-th distance so far. Blocks of queries travel to the stored blocks, as 32-bit
integers (as doubles where a component needs more) without their distances to pivots, which are worked out anew there; a stored block is shuffled once, however many query blocks it meets.

What decides which blocks meet is a join of the intervals alone, spread over groups of stored blocks. Nothing that
grows is broadcast and no pair of vectors becomes a row; only the k best of each block pair do.

Defined results: vectors that are null, empty, without vec_id or that hold a null or non-finite component take no part; a query meets vectors of
its own length; rows that repeat a vec_id are rows of their own, and a query row leaves out itself only; ties
go to the smaller vec_id. Scores are exact while they stay below 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, small_batches

PIVOTS, VECTOR_BLOCK, QUERY_BLOCK, LEAST_BLOCK, GROUP = 32, 4096, 1024, 256, 1024
VECTORS = "row_id long, vec_id long, dim int, v array<double>"
PLACED = "row_id long, vec_id long, dim int, v array<double>, floor double, cell int, near double"
BLOCKS = "dim int, block long, rows binary, ids binary, matrix binary, table binary, floors binary, radius double, lo array<double>, hi array<double>, own_rows array<long>, own_floors array<double>"
BEST = "query_row long, query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """row_id, vec_id, dim, v: the vectors that take part, as integers held in doubles."""
    v = F.col(vector_col)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    return rows.select("row_id", "vec_id", F.size("v").alias("dim"), F.transform("v", lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("v"))


def distances(x: np.ndarray, x_rest: np.ndarray, p: np.ndarray, p_rest: np.ndarray) -> np.ndarray:
    """From each row of x to each row of p; rest: the added component."""
    square = ((x * x).sum(1) + x_rest**2)[:, None] + ((p * p).sum(1) + p_rest**2)[None, :] - 2 * (x @ p.T + x_rest[:, None] * p_rest[None, :])
    return np.sqrt(np.maximum(square, 0))


def best_in_block(q: np.ndarray, own: int, x: np.ndarray, rows: np.ndarray, ids: np.ndarray, bounds: np.ndarray, floor: float, norm: float, k: int) -> list[tuple[int, int]]:
    """(vec_id, score) of the k best of a block for one query, among those that can reach the score `floor`."""
    square = float(q @ q) + norm * norm
    slack = 1e-6 * (1 + norm + np.sqrt(float(q @ q)))  # of rounding: a bound is exceeded only for sure
    radius = lambda score: np.sqrt(max(square - 2 * score, 0)) + slack
    near = np.flatnonzero(bounds <= radius(floor)) if floor > -np.inf else np.arange(len(bounds))
    near = near[np.argsort(bounds[near], kind="stable")]
    found_ids, found_scores, at, step = np.zeros(0, np.int64), np.zeros(0), 0, 64
    while at < len(near) and (floor == -np.inf or bounds[near[at]] <= radius(floor)):
        part = near[at : at + step]
        at, step = at + step, step * 2
        scores, part_ids = x[part] @ q, ids[part]
        keep = rows[part] != own
        found_ids, found_scores = np.concatenate([found_ids, part_ids[keep]]), np.concatenate([found_scores, scores[keep]])
        order = np.lexsort((found_ids, -found_scores))[:k]
        found_ids, found_scores = found_ids[order], found_scores[order]
        if len(found_scores) == k:
            floor = max(floor, float(found_scores[-1]))
    good = found_scores >= floor
    return list(zip(found_ids[good].tolist(), found_scores[good].astype(np.int64).tolist(), strict=True))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, n_pivots: int = PIVOTS, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best for each row whose id is divisible by `every`, against all rows."""
    small_batches(vectors.sparkSession)
    table = materialize(quantised(vectors, id_col, vector_col), "vectors")
    asks = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    total, n_queries, square = table.agg(F.count(F.lit(1)), F.count_if(asks), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
    norm = float(np.sqrt(square or 0.0)) + 1.0
    first = W.partitionBy("dim").orderBy(F.xxhash64("row_id"), "row_id")
    chosen: dict[int, list] = {}
    for r in table.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= n_pivots).select("dim", "row_id", "v").collect():  # n_pivots for each dimension
        chosen.setdefault(r["dim"], []).append((r["row_id"], r["v"]))
    pivots = {dim: (np.array([r for r, _ in ps]), np.array([v for _, v in ps])) for dim, ps in chosen.items()}
    rest = lambda m: np.sqrt(np.maximum(norm * norm - (m * m).sum(1), 0))

    def to_pivots(m: np.ndarray, dim: int, stored: bool) -> np.ndarray:
        p = pivots[dim][1]
        return distances(m, rest(m) if stored else np.zeros(len(m)), p, rest(p))

    def place(frames: Iterator[pd.DataFrame], stored: bool) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for dim, part in pdf.groupby("dim"):
                d = to_pivots(np.array(part["v"].tolist(), dtype=np.float64), dim, stored)
                yield part.assign(cell=d.argmin(axis=1).astype(np.int32), near=d.min(axis=1))

    def blocked(rows: DataFrame, n: int, most: int, least: int, stored: bool) -> DataFrame:
        """Blocks of `most` rows at most, in order of nearest pivot; a block of `least` rows ends where another pivot is nearest."""

        def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []

            def emit() -> pd.DataFrame:
                part = pd.concat(held)
                held.clear()
                dim = int(part["dim"].iloc[0])
                m, own = np.array(part["v"].tolist(), dtype=np.float64), part["row_id"].to_numpy()
                d = to_pivots(m, dim, stored)
                floors, asking = np.zeros(0), np.zeros(0, np.int64)
                own_floors = np.zeros(0)
                if stored:  # what queries find in their own block
                    asking = np.flatnonzero(part["vec_id"].to_numpy() % every == 0)
                    scores = m[asking] @ m.T
                    scores[np.arange(len(asking)), asking] = -np.inf
                    own_floors = np.partition(scores, -k, axis=1)[:, -k] if len(m) > k else np.full(len(asking), -np.inf)
                if not stored:
                    p_rows, p = pivots[dim]
                    seeds = m @ p.T
                    seeds[own[:, None] == p_rows[None, :]] = -np.inf
                    floors = np.maximum(np.sort(seeds, axis=1)[:, -k] if len(p) >= k else -np.inf, part["floor"].to_numpy(dtype=np.float64))
                radius = np.inf if stored or not np.isfinite(floors).all() else float(np.sqrt(np.maximum((m * m).sum(1) + norm * norm - 2 * floors, 0)).max()) + 1e-6 * (1 + 2 * norm)
                return pd.DataFrame({"dim": [dim], "block": [int(own[0])], "rows": [own.tobytes()], "ids": [part["vec_id"].to_numpy().tobytes()], "matrix": [m.tobytes() if stored else packed(m)], "table": [d.tobytes() if stored else b""], "floors": [floors.tobytes()], "radius": [radius], "lo": [d.min(axis=0)], "hi": [d.max(axis=0)], "own_rows": [own[asking]], "own_floors": [own_floors]})

            for pdf in frames:
                for (dim, cell), part in pdf.groupby(["dim", "cell"], sort=False):
                    if held and (int(held[0]["dim"].iloc[0]) != dim or int(held[-1]["cell"].iloc[0]) != cell and sum(map(len, held)) >= least):
                        yield emit()
                    at = 0
                    while at < len(part):
                        take = most - sum(map(len, held))
                        held.append(part.iloc[at : at + take])
                        at += take
                        if sum(map(len, held)) >= most:
                            yield emit()
            if held:
                yield emit()

        order = ["dim", "cell", "near"]
        placed = materialize(rows.mapInPandas(lambda frames: place(frames, stored), PLACED), "placed")
        return materialize(placed.repartitionByRange(max(1, -(-n // (4 * most))), *order).sortWithinPartitions(*order).mapInPandas(cut, BLOCKS), "blocks")

    def matrix(data: bytes, width: int) -> np.ndarray:
        return np.frombuffer(data, dtype=np.float64).reshape(-1, width)

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                n_p = len(pivots[r.dim][0])
                x, q = matrix(r.matrix, r.dim), unpacked(r.q_matrix, r.dim, len(r.q_rows) // 8)
                dx, dq, floors = matrix(r.table, n_p), to_pivots(q, r.dim, False), np.frombuffer(r.q_floors, dtype=np.float64)
                rows, ids, q_rows, q_ids = (np.frombuffer(b, dtype=np.int64) for b in (r.rows, r.ids, r.q_rows, r.q_ids))
                out = []
                for at in range(0, len(q), 32):
                    part = dq[at : at + 32]
                    bounds = np.zeros((len(part), len(x)))
                    for j in range(n_p):
                        np.maximum(bounds, np.abs(part[:, j, None] - dx[None, :, j]), out=bounds)
                    for i in range(len(part)):
                        n = at + i
                        out += [(int(q_rows[n]), int(q_ids[n]), v, s) for v, s in best_in_block(q[n], q_rows[n], x, rows, ids, bounds[i], floors[n], norm, k)]
                yield pd.DataFrame(out, columns=["query_row", "query_id", "vec_id", "score"])

    no_floor = F.lit(float("-inf")).alias("floor")
    stored = blocked(table.select("*", no_floor), total, vector_block, min(LEAST_BLOCK, vector_block), True)
    first = stored.select(F.explode(F.arrays_zip("own_rows", "own_floors")).alias("x")).select(F.col("x.own_rows").alias("row_id"), F.col("x.own_floors").alias("first"))
    queries = table.filter(asks).join(first, "row_id", "left").select(*table.columns, F.coalesce("first", no_floor).alias("floor"))
    asked = blocked(queries, n_queries, query_block, query_block, False).select("dim", F.col("block").alias("q_block"), F.col("rows").alias("q_rows"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.col("floors").alias("q_floors"), "radius", F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi"))
    met = materialize(block_pairs(stored.select("dim", "block", "lo", "hi"), asked.select("dim", "q_block", "radius", "q_lo", "q_hi"), n_pivots, -(-total // (vector_block * GROUP))), "block-pairs")
    shipped = met.join(asked.drop("radius", "q_lo", "q_hi"), ["dim", "q_block"]).join(stored.select("dim", "block", "rows", "ids", "matrix", "table"), ["dim", "block"])
    found = shipped.mapInPandas(search, BEST)
    best = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def packed(m: np.ndarray) -> bytes:
    """Whole numbers as 32-bit integers, or as doubles where one needs more."""
    small = bool((np.abs(m) < 2**31).all())
    return m.astype("<i4" if small else "<f8").tobytes()


def unpacked(data: bytes, width: int, rows: int) -> np.ndarray:
    return np.frombuffer(data, "<i4" if len(data) == 4 * width * rows else "<f8").reshape(rows, width).astype(np.float64)


def block_pairs(stored: DataFrame, asked: DataFrame, n_pivots: int, n_groups: int) -> DataFrame:
    """dim, block, q_block: the pairs in which some stored vector can lie within the radius of some query.

    The intervals of all query blocks are sent to each group of stored blocks: a few hundred bytes a block.
    """
    n_groups = max(1, n_groups)
    gap = lambda i: F.greatest(F.coalesce(F.get("lo", F.lit(i)) - F.get("q_hi", F.lit(i)), F.lit(0.0)), F.coalesce(F.get("q_lo", F.lit(i)) - F.get("hi", F.lit(i)), F.lit(0.0)))
    bound = gap(0) if n_pivots < 2 else F.greatest(*(gap(i) for i in range(n_pivots)))
    one = stored.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(n_groups)))
    two = asked.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long"))))
    return one.join(two, ["dim", "g"]).filter(bound <= F.col("radius")).select("dim", "block", "q_block")
