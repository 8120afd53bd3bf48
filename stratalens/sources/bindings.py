"""Software-engineering relations as views over the star-schema tables, and the same views as SQL.

An order is a commit, an order line's part a file, a brand a module, consecutive parts of an order an import,
a user's events a session, documents the artifacts and source texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.plans.registry import Tables
from stratalens.shared import tasks_of

DAY = 86_400


def day_seconds(c: str):  # noqa: ANN201
    """Epoch seconds of a timestamp's day."""
    return F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long") * DAY


def commits(t: Tables) -> DataFrame:
    """hash, ts, author, subject."""
    kind = F.when(F.col("o_orderpriority").startswith("1-"), F.lit("fix: ")).otherwise(F.lit("feat: "))
    return t.orders.select(F.col("o_orderkey").alias("hash"), day_seconds("o_orderdate").alias("ts"), F.col("o_custkey").alias("author"), F.concat(kind, "o_orderpriority").alias("subject"))


def files(t: Tables) -> DataFrame:
    """partkey, module, path: one file per part; every seventh size is a test."""
    module = F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_")))
    key = F.col("p_partkey").cast("string")
    path = F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("crates/"), module, F.lit("/tests/"), key, F.lit("_test.rs"))).otherwise(F.concat(F.lit("crates/"), module, F.lit("/src/"), key, F.lit(".rs")))
    return t.part.select(F.col("p_partkey").alias("partkey"), module.alias("module"), path.alias("path"), F.col("p_size").cast("long").alias("size"), "p_type")


def commit_lines(t: Tables) -> DataFrame:
    """lineitem's hash, partkey, quantity and number, a commit's together, dealt to as many tasks as there are rows for: shares do not grow with the table."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("hash"), F.col("l_partkey").alias("partkey"), "l_quantity", "l_linenumber")
    return lines.repartition(tasks_of(t.lineitem), "hash")


def dealt_files(t: Tables) -> DataFrame:
    """files dealt by partkey for a join with lines, which takes as many tasks as the lines have."""
    return files(t).repartition(tasks_of(t.lineitem), "partkey")


def commit_files(t: Tables) -> DataFrame:
    """hash, path, module, ins, del: each file of a commit once."""
    lines = commit_lines(t).groupBy("hash", "partkey").agg(F.sum("l_quantity").cast("long").alias("ins"), F.sum("l_linenumber").cast("long").alias("del"))
    return lines.join(dealt_files(t), "partkey").select("hash", "path", "module", "ins", "del")


def imports(t: Tables) -> DataFrame:
    """hash, importer, target, line: consecutive distinct files of a commit, at module/type level."""
    lines = commit_lines(t).groupBy("hash", "partkey").agg(F.min("l_linenumber").alias("line"))
    named = lines.join(dealt_files(t), "partkey").select("hash", "line", "partkey", F.concat("module", F.lit("/"), F.lower("p_type")).alias("importer")).repartition(tasks_of(t.lineitem), "hash")
    order = W.partitionBy("hash").orderBy("line", "partkey")
    return named.withColumn("target", F.lead("importer").over(order)).filter(F.col("target").isNotNull() & (F.col("target") != F.col("importer"))).select("hash", "importer", "target", F.col("line").cast("long").alias("line"))


def session_events(t: Tables) -> DataFrame:
    """session, seq, action, is_error, target, at_ms."""
    kind = F.col("event_type")
    action = F.when(kind == "click", "edit").when(kind == "view", "read").when(kind == "purchase", "verify").when(kind == "signup", "exec").otherwise("other")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    millis = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000 + (F.hour("ts") * 3_600_000 + F.minute("ts") * 60_000 + F.second("ts") * 1000).cast("long")
    return t.events.select(
        F.col("user_id").alias("session"), "event_id", F.row_number().over(order).cast("long").alias("seq"), action.alias("action"), (kind == "error").alias("is_error"),
        F.get_json_object("props", "$.k").cast("long").alias("target"), millis.alias("at_ms"), "value",
    )


_SQL = {
    "commits": """SELECT o_orderkey AS hash, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 86400 AS ts, o_custkey AS author,
        CASE WHEN starts_with(o_orderpriority, '1-') THEN 'fix: ' ELSE 'feat: ' END || o_orderpriority AS subject FROM orders""",
    "files": """SELECT p_partkey AS partkey, lower(replace(p_brand, '#', '_')) AS module,
        'crates/' || lower(replace(p_brand, '#', '_')) || CASE WHEN p_size % 7 = 0 THEN '/tests/' || p_partkey || '_test.rs' ELSE '/src/' || p_partkey || '.rs' END AS path,
        CAST(p_size AS BIGINT) AS size, p_type FROM part""",
    "commit_files": """SELECT hash, path, module, ins, del FROM (SELECT l_orderkey AS hash, l_partkey AS partkey, CAST(sum(l_quantity) AS BIGINT) AS ins, CAST(sum(l_linenumber) AS BIGINT) AS del
        FROM lineitem GROUP BY 1, 2) x JOIN files USING (partkey)""",
    "imports": """SELECT hash, importer, target, line FROM (SELECT hash, importer, line, lead(importer) OVER (PARTITION BY hash ORDER BY line, partkey) AS target
        FROM (SELECT l_orderkey AS hash, l_partkey AS partkey, CAST(min(l_linenumber) AS BIGINT) AS line FROM lineitem GROUP BY 1, 2) x
        JOIN (SELECT partkey, module || '/' || lower(p_type) AS importer FROM files) f USING (partkey)) y WHERE target <> importer""",
    "session_events": """SELECT user_id AS session, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
        CASE event_type WHEN 'click' THEN 'edit' WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'verify' WHEN 'signup' THEN 'exec' ELSE 'other' END AS action,
        event_type = 'error' AS is_error, CAST(json_extract_string(props, '$.k') AS BIGINT) AS target,
        CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) * 86400000 + hour(ts) * 3600000 + minute(ts) * 60000 + CAST(floor(second(ts)) AS BIGINT) * 1000 AS at_ms, value FROM events""",
}
_NEEDS = {"commit_files": ("files",), "imports": ("files",)}


def with_views(*names: str) -> str:
    """The WITH clause that defines these views."""
    wanted = dict.fromkeys(x for n in names for x in (*_NEEDS.get(n, ()), n))
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_SQL[n]})" for n in wanted)
