"""Corpus pipeline: toxic documents go, exact copies go, one of each group of near copies stays, passages that
repeat are cut out, and what is left is packed.

Each stage takes (spark, docs, sf_dir) and gives the next one's documents; the last gives packed pieces.

Defined results: a null text counts as empty and is never toxic; of equal texts (null and empty are equal) the row with the largest
doc_id stays, a null doc_id being the smallest, and rows that repeat doc_id and text leave one; of near copies (SimHash
fingerprints within three bits, directly or through others) the smallest doc_id stays, and texts without words are like no other; passages are cut out of every
document that has them, and a null text comes out empty; documents whose text is cut to nothing stay; other columns, whatever their
names, pass through the first four stages unchanged but for n_chars; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm.common import materialize, read
from stratalens.llm.exact_dedup import drop_exact_duplicates
from stratalens.llm.packing import pack_documents
from stratalens.llm.simhash import drop_near_copies
from stratalens.llm.substring_dedup import drop_repeats
from stratalens.llm.toxicity import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, read(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """By op9's links: 64-bit SimHash of three-word shingles at three differing bits or fewer, found by the generalised pigeonhole."""
    return drop_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; n_chars follows the text."""
    return drop_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, slice_bytes=1 << 20)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]
ORACLE_SQL = None  # learning, linking and cutting are beyond SQL; tests/llm holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is a Parquet table that the next one reads."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
