"""Shared helpers: table reading, durable intermediate tables, held-out split."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.match(r"local(\[[^,\]]*(,\d+)?\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="stratalens-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


#: The tables written inside the innermost scratch of this thread; None outside.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    return spark.read.schema(schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that materialize writes inside go at the end, but for those written by the function given: what is returned must read no others."""
    outer, own = _WRITTEN.get(), []
    token = _WRITTEN.set(own)

    def keep(df: DataFrame, name: str) -> DataFrame:
        inner = _WRITTEN.set(outer)
        try:
            return materialize(df, name)
        finally:
            _WRITTEN.reset(inner)

    try:
        yield keep
    finally:
        _WRITTEN.reset(token)
        for path in own:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def checked_broadcast(table: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """A written table of narrow rows: broadcast if it has `most_rows` rows at most, else joined like any other."""
    return F.broadcast(table) if table.limit(most_rows + 1).count() <= most_rows else table


BITMAP_BITS = 1 << 23  # of all a filter's bitmaps together: 1 MB


def apart(df: DataFrame, key: Column, keys: DataFrame, keys_key: Column) -> tuple[DataFrame, DataFrame]:
    """df's rows whose key may be among those of `keys`, and those whose key surely is not.

    The hashes of keys are bits of 256 rows of 4 KB at most, whatever the number of keys, so they can be broadcast;
    the second part need not be shuffled to be joined. Only the size of the first part depends on the number of keys.
    """
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(BITMAP_BITS)).cast("long")
    bits = keys.select(place(keys_key).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("__bits"))
    bits = materialize(bits, "key-bits")
    marked = df.withColumn("__at", place(key)).withColumn("__bucket", F.bitmap_bucket_number("__at")).join(F.broadcast(bits), "__bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(bitmap_bit_position(__at) div 8 + 1 as int), 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, F.expr("cast(bitmap_bit_position(__at) % 8 as int)")) == 1, F.lit(False))
    marked = marked.withColumn("__hit", hit).drop("__at", "__bucket", "__bits")
    return marked.filter("__hit").drop("__hit"), marked.filter("not __hit").drop("__hit")


def without_keys(df: DataFrame, names: list[str], keys: DataFrame) -> DataFrame:
    """df's rows whose columns `names` equal no row of `keys` (distinct, no nulls); rows whose first of them is not among the keys are not shuffled."""
    maybe, surely = apart(df, F.col(names[0]), keys, F.col(names[0]))
    return maybe.join(keys, names, "left_anti").unionByName(surely)


def small_batches(spark: SparkSession, rows: int = 1024, most_bytes: int = 4 << 20) -> None:
    """Bound an Arrow batch, so that long texts or large blocks don't add up in a Python worker; holds for the session from here on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of doc_id as text, modulo divisor; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % divisor


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def batches(frames: Iterator[pa.RecordBatch], most: int = 8 << 20, owner: str = "") -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes at most; a longer single text stays whole. owner: whose worker_cache goes on."""
    fresh_task(owner)
    for batch in frames:
        if batch.nbytes <= most or batch.num_rows <= 1:
            yield batch
            continue
        step = max(1, int(batch.num_rows * most / batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    give_back()


_CACHE: dict[str, dict] = {}
_TASK: list[int] = []


def fresh_task(owner: str) -> None:
    """At a task's start, let go of what the Python worker kept for another operator."""
    context = TaskContext.get()
    if context is None or _TASK[-1:] == [context.taskAttemptId()]:
        return
    _TASK[:] = [context.taskAttemptId()]
    for other in [x for x in _CACHE if x.split()[0] != owner]:
        del _CACHE[other]
    give_back()


def give_back() -> None:
    """Free memory goes back to the system, where the C library can trim its heap; Arrow's own pool would keep it."""
    if pa.default_memory_pool().backend_name != "system":
        pa.set_memory_pool(pa.system_memory_pool())
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def worker_cache(owner: str) -> dict:
    """What a Python worker keeps from task to task; owner: an operator's name, and what it is for behind a blank."""
    return _CACHE.setdefault(owner, {})


def forget_unused(kept: dict, used: Iterable, most: int) -> None:
    """Above `most` entries keep those that are in use, which a skewed corpus asks for again."""
    if len(kept) > most:
        still = {k: kept[k] for k in used if k in kept}
        kept.clear()
        kept.update(still)
