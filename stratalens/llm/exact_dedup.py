"""Exact deduplication by content-defined chunk recipes.

Each text is cut where a rolling hash of its own bytes says so. A chunk's identifier is issued by the
table of repeated chunks, keyed by SHA-256, length and an independent 128-bit hash together, so that a
collision of one hash merges nothing; the chunks' bytes themselves are not compared. A document is then the ordered list of its chunks' identifiers, and
equal lists mean equal texts: the texts themselves are read once and never shuffled. A document holding a
chunk that occurs once in the corpus has no copy and leaves before any list is built.

Defined results: null text counts as empty, and empty texts equal each other; of equal texts the row with
the largest doc_id stays (a null doc_id is the smallest), and of rows that repeat both doc_id and text just
one is kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, batches, materialize, scratch, small_batches, texts_of

SHORTEST, MEAN_BITS, LONGEST = 2048, 12, 16384
#: One 32-bit value per byte, from a rule: the low half of XXH64 of the byte.
GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), 0) & 0xFFFFFFFF for b in range(256)], dtype=np.uint32)
RECIPE = "row_id long, doc_id long, text_sha256 string, chunks array<struct<a:long,b:long,c:long,d:long,e:long,f:long,size:int>>"


def cuts(data: bytes, shortest: int = SHORTEST, mean_bits: int = MEAN_BITS, longest: int = LONGEST) -> list[int]:
    """End offsets of the chunks of data; depends on nothing but the bytes."""
    n = len(data)
    if n <= shortest:
        return [n]
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    for s in (1, 2, 4, 8, 16):  # h[i] comes to cover the 32 bytes that end at i
        older = h[:-s] << np.uint32(s)
        h[s:] += older
    marks = np.flatnonzero((h >> np.uint32(32 - mean_bits)) == 0) + 1
    out, last = [], 0
    for mark in [*marks.tolist(), n]:
        while mark - last > longest:
            last += longest
            out.append(last)
        if mark - last >= shortest or mark == n and mark > last:
            last = mark
            out.append(last)
    return out


def _recipes(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([(c, pa.int64()) for c in "abcdef"] + [("size", pa.int32())])
    for batch in batches(frames):
        hexes, recipes = [], []
        for data in texts_of(batch.column(2)):
            start, recipe = 0, []
            for end in cuts(data):
                chunk = data[start:end]
                start = end
                digest = hashlib.sha256(chunk).digest() + xxhash.xxh3_128_digest(chunk)
                recipe.append(dict(zip("abcdef", np.frombuffer(digest, dtype="<i8").tolist(), strict=True)) | {"size": len(chunk)})
            recipes.append(recipe)
            hexes.append(hashlib.sha256(data).hexdigest())
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(hexes, pa.string()), pa.array(recipes, pa.list_(kind))], ["row_id", "doc_id", "text_sha256", "chunks"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    recipes = materialize(rows.mapInArrow(_recipes, RECIPE), "recipes")
    key = [*"abcdef", "size"]
    chunks = recipes.select("row_id", "doc_id", F.size("chunks").alias("n"), F.posexplode("chunks").alias("ordinal", "chunk")).select("row_id", "doc_id", "n", "ordinal", "chunk.*")
    repeated = chunks.groupBy(*key).agg(F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    dictionary = materialize(repeated.withColumn("chunk_id", F.monotonically_increasing_id()), "chunk-ids")
    # a list with a chunk missing from the dictionary is no copy of anything
    lists = materialize(
        chunks.join(dictionary, key)
        .groupBy("row_id")
        .agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("ordinal", "chunk_id"))).alias("ids"))
        .filter(F.size("ids") == F.col("n"))
        .select("row_id", "doc_id", F.col("ids.chunk_id").alias("ids")),
        "recipe-lists",
    )
    groups = materialize(
        lists.groupBy("ids").agg(F.max(F.struct("doc_id", "row_id")).alias("keep"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1").select("ids", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row_id").alias("keep_row"), "group_size"),
        "copy-groups",
    )
    copies = lists.join(groups, "ids").select("row_id", "keep_id", "keep_row", "group_size")
    alone = F.col("keep_row").isNull()
    return recipes.select("row_id", "doc_id", "text_sha256", F.size("chunks").alias("n_chunks")).join(copies, "row_id", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("keep_row") == F.col("row_id"))).alias("kept"),
        "text_sha256",
        "n_chunks",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; repeated rows leave one. Only rows whose doc_id has a lost copy are shuffled."""
    as_key = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    # rows that repeat doc_id and text share a key: the key is lost only if another doc_id stays, else one row of it stays
    with scratch(docs.sparkSession) as keep:
        copies = exact_duplicates(docs, id_col, text_col).filter(~F.col("kept"))
        lost = keep(copies.select(as_key(F.col("doc_id")).alias("__id"), F.col("text_sha256").alias("__hash"), (~F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("__lost")), "dropped")
    rows = docs.select(as_key(F.col(id_col).cast("long")).alias("__id"), F.struct(*docs.columns).alias("row"))  # so that no column's name can clash
    maybe, surely = apart(rows, F.col("__id"), lost, F.col("__id"))
    marked = maybe.withColumn("__hash", F.sha2(F.coalesce(F.col(f"row.{text_col}"), F.lit("")), 256))
    left = marked.join(lost.filter("__lost").drop("__lost"), ["__id", "__hash"], "left_anti").dropDuplicates(["__id", "__hash"])
    return left.select("row").unionByName(surely.select("row")).select("row.*")
