"""Event counts as a stream: an extension, not an operator of the reference's own list."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.operators.reach import settled
from stratalens.plans.registry import Tables, query


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def s01_daily_events_stream(t: Tables) -> DataFrame:
    """Daily counts and sums per event type by Structured Streaming over the files that are there, with a watermark.

    In update mode a micro-batch gives the days it has changed and state older than the watermark goes; of each day the last batch's row counts.
    """
    schema = t.events.schema
    settled(t.spark.range(1))  # sets a shared folder where none is set
    root = (t.spark.conf.get("spark.checkpoint.dir", None) or t.spark.sparkContext.getConf().get("spark.checkpoint.dir")) + f"/stream-{uuid.uuid4().hex}"
    stream = t.spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{t.folder}/events.parquet*")
    at = F.col("ts").cast("timestamp")
    daily = stream.withColumn("at", at).withWatermark("at", "7 days").groupBy(F.window("at", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    rows = daily.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("v", 4).alias("total"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/batches/{number}")

    rows.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    found = t.spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/batches")
    return found.groupBy("day", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("x")).select("day", "event_type", "x.*")
