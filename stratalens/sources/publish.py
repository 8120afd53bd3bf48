"""Content-addressed, committed tables: staged write, rename that replaces nothing, marker last."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.operators.reach import settled
from stratalens.plans.registry import Tables, query
from stratalens.sources.bindings import commits, with_views


def content_digest(df: DataFrame) -> str:
    """Digest of a table's rows, whatever their order: counts and sums of two row hashes."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in df.columns]
    row = df.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.xxhash64(F.lit(i), *cells).cast("decimal(38,0)")).alias(f"s{i}") for i in range(2))).first()
    return f"{row['n']:x}-{int(row['s0'] or 0) % 2**128:032x}{int(row['s1'] or 0) % 2**128:032x}"


def publish(df: DataFrame, root: str) -> str:
    """Write df under its digest and return the folder; a folder that is already committed is left as it is."""
    spark: SparkSession = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    folder = f"{root}/{content_digest(df)}"
    if not committed(spark, folder):
        staging = f"{root}/_staging/{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(staging)
        if fs.exists(path(folder)):  # an earlier attempt that never got its marker
            fs.delete(path(folder), True)
        if not fs.rename(path(staging), path(folder)):
            raise FileExistsError(folder)
        fs.create(path(f"{folder}/_COMMITTED"), False).close()
    return folder


def committed(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(f"{folder}/_COMMITTED"))


def load(spark: SparkSession, folder: str) -> DataFrame:
    """A committed table; one without its marker is not read."""
    if not committed(spark, folder):
        raise FileNotFoundError(f"{folder} is not committed")
    return spark.read.parquet(folder)


@query(with_views("commits") + " SELECT hash, ts, author, subject FROM commits")
def a17_publish_round_trip(t: Tables) -> DataFrame:
    """A table published, published again without effect, and read back (also a12, a16, a18)."""
    settled(t.spark.range(1))  # sets a shared folder where none is set
    root = (t.spark.conf.get("spark.checkpoint.dir", None) or t.spark.sparkContext.getConf().get("spark.checkpoint.dir")) + f"/published-{uuid.uuid4().hex}"
    folder = publish(commits(t), root)
    assert publish(commits(t), root) == folder
    return load(t.spark, folder)
