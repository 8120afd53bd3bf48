"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source has a target number of words: shares of a budget by weight, none above `most` times the source's own size; what
is above is shared out anew among the others, found in one sorted pass over the sources. Documents are put in an order by the hash of their rows, and
runs of hash values are blocks of about BLOCK_WORDS words, or of BLOCK_DOCS documents where these are short. A source is passed over as often as its target asks for; in each pass
its blocks have an order of their own, and the blocks before the point where the target is met are its quota. The block at that point
is taken in part, its last document by its first words, so a source gives its target to the word.

A binary tree deals the quotas out to the output shards: a node holds how many blocks of each source its shards get together and draws its
left half's counts from the multivariate hypergeometric distribution, seeded by the node. Every shard walks down from the root on its own and ends
with an interval of each source's permuted blocks; intervals of different shards are disjoint and cover the quota. Within
a shard documents are shuffled by a hash. Nothing depends on tasks or partitions, so reruns agree.

Defined results: null text has no words; a null source is a source of its own, the last; a null doc_id takes part; rows equal in all
that is read are interchangeable, and of a block of them as many are taken as the quota holds; sources of no words have a target of 0; an empty table gives an
empty result; a text of any length is one document; other columns are not read. Over MOST_SOURCES sources raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checked_broadcast, materialize

WEIGHTS, SHARE, MOST = (5, 2, 1), (3, 2), 2  # the budget is 3/2 of all sizes
BLOCK_WORDS, BLOCK_DOCS, SHARD_BLOCKS, MOST_BLOCKS, MOST_SOURCES = 1 << 16, 512, 64, 500_000_000, 100_000
WORD = "[^\\x20\\x09-\\x0D]+"
PLACES = "source_no int, place long, shard long"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """sizes (one row a source: source, source_size and what else) with source_no and target.

    In ascending order of size over weight, the sources that are at their limit come first; what is left of the budget goes
    to the others by weight. All sums are of whole numbers; the target is one division.
    """
    up, down = share
    numbered = sizes.withColumn("source_no", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")).cast("long")
    product = int(np.prod(weights))
    order = W.orderBy((F.col("source_size") * product / F.col("w")).cast("long"), "source_no")
    before, rest, everything = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing), W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    x = numbered.withColumn("w", weight)
    left = F.lit(up) * F.sum("source_size").over(everything) - F.lit(down * most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))  # of the budget, times `down`
    x = x.withColumn("left", left).withColumn("rest", F.sum("w").over(rest))
    full = F.col("left") * F.col("w") > F.lit(down * most) * F.col("source_size") * F.col("rest")
    x = x.withColumn("full", full)
    open_left, open_rest = (F.max(F.when(~F.col("full"), F.col(c))).over(everything) for c in ("left", "rest"))  # both fall along the order: those of the first that isn't full
    target = F.when(F.col("full"), F.col("source_size").cast("double") * most).otherwise((open_left * F.col("w")).cast("double") / (open_rest * down).cast("double"))
    return x.select(*sizes.columns, "source_no", target.alias("target"))


def draw(counts: np.ndarray, n: int, seed: list[int]) -> np.ndarray:
    """How many of each kind are among n drawn without putting back."""
    return np.random.Generator(np.random.PCG64(seed)).multivariate_hypergeometric(counts, n, method="marginals")


def shard_places(quotas: list[int], shard: int, shards: int, seed: int = 0) -> list[tuple[int, int]]:
    """For each source the first and behind the last of the blocks that the shard gets; the walk from the root to its leaf."""
    counts, first = np.array(quotas, np.int64), np.zeros(len(quotas), np.int64)
    low, high = 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        left = draw(counts, int(counts.sum()) * (middle - low) // (high - low), [seed, low, high])
        if shard < middle:
            counts, high = left, middle
        else:
            counts, first, low = counts - left, first + left, middle
    return list(zip(first.tolist(), (first + counts).tolist(), strict=True))


def running(rows: DataFrame, key: str, part: str, order: list[str], value: str) -> DataFrame:
    """rows with `rank` (from 0) and `before` (sum of value of those ahead) along (part, order) within key; sums of parts first, so a key fills many tasks."""
    ahead = W.partitionBy(key).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    parts = rows.groupBy(key, part).agg(F.sum(value).alias("__sum"), F.count(F.lit(1)).alias("__n"))
    parts = parts.select(key, part, *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c) for c in ("__sum", "__n")))
    inside = W.partitionBy(key, part).orderBy(*order)
    so_far = F.coalesce(F.sum(value).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = rows.withColumn("rank", F.row_number().over(inside) - 1).withColumn("before", so_far)
    joined = ranked.join(parts, [key, part])
    return joined.withColumn("rank", F.col("rank") + F.col("__n")).withColumn("before", F.col("before") + F.col("__sum")).drop("__sum", "__n")


def share_of(h: Column, n: Column) -> Column:
    """A 64-bit hash's place among n equal runs of hash values."""
    return F.floor((F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))) * n).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, h (its row's hash), source, size, source_size, target, copies (array of shard, place in its shuffle, words from the start)."""
    spark = docs.sparkSession
    text, source = F.coalesce(F.col(text_col), F.lit("")), F.col(source_col).cast("string")
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), source.alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), source, text).alias("h"))
    rows = materialize(rows, "sized")
    goal = materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")), weights, share, most), "targets")
    n_sources, words, n_docs = goal.agg(F.count(F.lit(1)), F.sum("source_size"), F.sum("docs")).first()
    if n_sources > MOST_SOURCES:
        raise ValueError(f"{n_sources} sources: a node of the splitting tree holds {MOST_SOURCES} at most")
    per_block, docs_per_block = max(block_words, (words or 0) * most // MOST_BLOCKS), max(BLOCK_DOCS, (n_docs or 0) * most // MOST_BLOCKS)
    blocks_of = F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(per_block)), F.ceil(F.col("docs") / F.lit(docs_per_block))).cast("long")
    goal = checked_broadcast(goal.withColumn("blocks", blocks_of).withColumn("quota", F.round("target").cast("long")), MOST_SOURCES)
    placed = rows.join(goal.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).withColumn("block", share_of(F.col("h"), F.col("blocks")))
    # rows that are equal in all that is read are one row with a number of copies
    alike = placed.groupBy("source_no", "block", "h", "doc_id", "size").agg(F.count(F.lit(1)).alias("rows"))
    in_order = W.partitionBy("source_no", "block").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    alike = materialize(alike.withColumn("ahead", F.coalesce(F.sum(F.col("size") * F.col("rows")).over(in_order), F.lit(0))), "documents-in-blocks")

    blocks = alike.groupBy("source_no", "block").agg(F.sum(F.col("size") * F.col("rows")).alias("words"))
    known = goal.select("source_no", "source", "source_size", "target", "quota", "blocks")
    passes = blocks.join(known.select("source_no", "source_size", "quota", "blocks"), "source_no").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    passes = passes.withColumn("left", F.greatest(F.lit(0), F.least("source_size", F.col("quota") - F.col("turn") * F.col("source_size")))).filter("left > 0")
    shuffled = F.xxhash64(F.lit(seed), F.lit("pass"), "source_no", "turn", "block")
    passes = passes.withColumn("p", shuffled).withColumn("key", F.col("source_no").cast("long") * most + F.col("turn")).withColumn("part", share_of(F.col("p"), F.ceil(F.sqrt("blocks"))))
    units = running(passes, "key", "part", ["p", "block"], "words")
    units = units.withColumn("most", F.least("words", F.col("left") - F.col("before"))).filter("most > 0")
    units = materialize(units.select("source_no", "turn", "block", "rank", "most"), "units")
    counted = materialize(units.groupBy("source_no", "turn").agg(F.count(F.lit(1)).alias("n")), "unit-counts")
    quotas = [[0] * most for _ in range(n_sources)]
    for r in counted.collect():  # `most` rows a source
        quotas[r["source_no"]][r["turn"]] = r["n"]
    ahead = [[sum(q[:t]) for t in range(most)] for q in quotas]
    total = [sum(q) for q in quotas]
    shards = max(1, -(-sum(total) // shard_blocks))

    def deal(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for shard in batch.column(0).to_pylist():
                got = [(s, at) for s, (first, end) in enumerate(shard_places(total, shard, shards, seed)) for at in range(first, end)]
                yield pa.record_batch([pa.array([s for s, _ in got], pa.int32()), pa.array([a for _, a in got], pa.int64()), pa.array([shard] * len(got), pa.int64())], ["source_no", "place", "shard"])

    places = spark.range(shards).mapInArrow(deal, PLACES)
    offsets = spark.createDataFrame([(s, t, n) for s, some in enumerate(ahead) for t, n in enumerate(some)], "source_no int, turn int, offset long")
    offsets = checked_broadcast(materialize(offsets, "offsets"), MOST_SOURCES * most)
    dealt = units.join(offsets, ["source_no", "turn"]).withColumn("place", F.col("rank") + F.col("offset")).join(places, ["source_no", "place"])
    taken = dealt.groupBy("source_no", "block").agg(F.array_sort(F.collect_list(F.struct("turn", "shard", "most"))).alias("units"))  # `most` at most

    row = F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))
    each = alike.join(taken, ["source_no", "block"], "left").withColumn("nth", row).withColumn("at", F.col("ahead") + F.col("nth") * F.col("size"))
    words_of = lambda u: F.greatest(F.lit(0), F.least(F.col("size"), u["most"] - F.col("at")))
    within = lambda u: (u["most"] > F.col("at")) | ((F.col("size") == 0) & (u["most"] == F.col("at")))
    copy = lambda u: F.struct(u["shard"].alias("shard"), F.xxhash64(F.lit(seed), F.lit("shuffle"), u["turn"], F.col("h"), F.col("nth")).alias("place"), words_of(u).alias("words"))
    empty = F.lit([]).cast("array<struct<shard:bigint,place:bigint,words:bigint>>")
    copies = F.coalesce(F.transform(F.filter("units", within), copy), empty)
    return each.withColumn("copies", copies).join(known.select("source_no", "source", "source_size", "target"), "source_no").select("doc_id", "h", "source", "size", "source_size", "target", "copies")


def write_shards(mixed: DataFrame, path: str) -> None:
    """The mix as a table partitioned by shard, each shard's documents in shuffled order; texts can be joined by doc_id and h."""
    rows = mixed.select("doc_id", "h", "source", F.explode("copies").alias("c")).select("doc_id", "h", "source", "c.*")
    rows.repartition("shard").sortWithinPartitions("shard", "place", "doc_id").write.partitionBy("shard").parquet(path)
