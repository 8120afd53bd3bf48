"""Folders of files as relations: texts with a bound on their size, and JSON traces under a schema.

A file is a row, whatever becomes of it: what is too large or no UTF-8 text, and traces that don't parse or break a rule, are named by a
status; only empty and hidden files, which Spark's listing leaves out, are none. The bound is pushed into the scan, so the bytes of a file above it are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST_TEXT, MOST_TRACE = 8 << 20, 128 << 20
# Limits of a trace.
MOST_EVENTS, MOST_TARGETS = 1_000_000, 10_000
TRACE = "version long, session struct<id:string,harness:string,cwd:string>, events array<struct<seq:long,action:string,tool:string,isError:boolean,targets:array<struct<path:string,touch:string>>,outside:array<string>>>, _broken string"


def relative(root: str, path: Column) -> Column:
    """The part of a path behind root, whatever the scheme in front of it."""
    top = root.rstrip("/").split("://")[-1].removeprefix("file:") + "/"
    return F.substr(path, F.locate(top, path) + F.lit(len(top)))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path (relative, forward slashes), length of every file below root but for .git; Spark's listing leaves hidden names out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return found.select(relative(root, F.col("path")).alias("path"), "length").filter(~F.concat(F.lit("/"), "path").contains("/.git/"))


def texts(spark: SparkSession, root: str, most: int = MOST_TEXT) -> DataFrame:
    """path, length, status (ok, oversized, not_utf8), text (null unless ok) of every file below root."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    decoded = F.expr("if(is_valid_utf8(content), cast(content as string), null)")
    small = found.filter(F.col("length") <= most).select("path", "length", decoded.alias("text"))
    small = small.select("path", "length", F.when(F.col("text").isNull(), "not_utf8").otherwise("ok").alias("status"), "text")
    large = found.filter(F.col("length") > most).select("path", "length", F.lit("oversized").alias("status"), F.lit(None).cast("string").alias("text"))
    return small.union(large).withColumn("path", relative(root, F.col("path"))).filter(~F.concat(F.lit("/"), "path").contains("/.git/"))


def traces(files: DataFrame, schema: str = TRACE) -> DataFrame:
    """path, status, trace of texts (path, status, text); broken, unsupported_version, no_session, event_count, invalid_event, invalid_target, duplicate_seq or ok; a trace is null where its events can't be told."""
    parsed = F.from_json("text", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    x = files.withColumn("trace", F.when(F.col("status") == "ok", parsed))
    seq = F.transform("trace.events", lambda e: e["seq"])
    invalid = lambda e: e["seq"].isNull() | (e["seq"] < 0) | e["action"].isNull() | e["tool"].isNull() | e["isError"].isNull() | e["targets"].isNull() | (F.size(e["targets"]) > MOST_TARGETS)
    status = (
        F.when(F.col("status") != "ok", F.col("status"))
        .when(F.col("trace").isNull() | F.col("trace._broken").isNotNull(), "broken")
        .when(F.coalesce(F.col("trace.version"), F.lit(0)) != 1, "unsupported_version")
        .when((F.coalesce(F.col("trace.session.id"), F.lit("")) == "") | (F.coalesce(F.col("trace.session.harness"), F.lit("")) == ""), "no_session")
        .when(~F.coalesce(F.size("trace.events"), F.lit(0)).between(1, MOST_EVENTS), "event_count")
        .when(F.exists("trace.events", invalid), "invalid_event")
        .when(F.exists("trace.events", lambda e: F.exists(e["targets"], lambda x: (F.coalesce(x["path"], F.lit("")) == "") | x["touch"].isNull())), "invalid_target")
        .when(F.size(F.array_distinct(seq)) < F.size(seq), "duplicate_seq")
        .otherwise("ok")
    )
    return x.select("path", status.alias("status"), F.when(status.isin("ok", "duplicate_seq"), F.col("trace").dropFields("_broken")).alias("trace"))


def trace_events(found: DataFrame) -> DataFrame:
    """path, session, seq, place (from 1, by seq), action, tool, is_error, target of the events of good traces; an event without targets has one row, without a target."""
    e = found.filter("status = 'ok'").select("path", F.col("trace.session.id").alias("session"), F.explode("trace.events").alias("e"))
    e = e.withColumn("place", F.row_number().over(W.partitionBy("path").orderBy("e.seq")).cast("long"))  # before targets make more rows
    e = e.select("path", "session", "e.seq", "place", "e.action", "e.tool", F.col("e.isError").alias("is_error"), F.explode_outer("e.targets").alias("t"))
    return e.select("path", "session", "seq", "place", "action", "tool", "is_error", F.col("t.path").alias("target"))


def write_tree(rows: DataFrame, root: str) -> None:
    """Texts (path, text) as files below root, one per path: a folder named by the path holds it."""
    rows.select(F.concat(F.lit("f="), "path").alias("file"), "text").write.mode("error").option("lineSep", "\u0000").partitionBy("file").text(root)


def tree_texts(spark: SparkSession, root: str, most: int = MOST_TEXT) -> DataFrame:
    """What write_tree wrote, read back by texts: path, length (of the text), status, text."""
    name = F.url_decode(F.replace(F.regexp_extract("path", "(?:^|/)file=([^/]*)/[^/]*$", 1), F.lit("+"), F.lit("%2B")))
    found = texts(spark, root, most + 1).withColumn("path", F.expr("substring(path, 1)"))
    end = F.regexp_replace("text", "\u0000$", "")  # the writer's mark of the end
    return found.filter(F.col("path").contains("file=")).select(F.regexp_replace(name, "^f=", "").alias("path"), (F.col("length") - 1).alias("length"), "status", end.alias("text"))
