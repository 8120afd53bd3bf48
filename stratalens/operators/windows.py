"""Window, ranking, top-k and set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.operators.aggregates import _RISK, _SESSION, _TIMING, module_risk, timing
from stratalens.operators.joins import _PAIRS, co_changes
from stratalens.operators.ordered import running_sums
from stratalens.operators.reach import settled
from stratalens.plans.registry import Tables, query
from stratalens.shared import tasks_of
from stratalens.sources.bindings import commit_files, commits, files, imports, session_events, with_views


@query("SELECT 'unit-' || row_number() OVER (ORDER BY s DESC, m) AS unit, m AS module, round(s, 2) AS score FROM (SELECT p_brand AS m, sum(p_retailprice) AS s FROM part GROUP BY 1)")
def e01_rank_units(t: Tables) -> DataFrame:
    """Units by score, then name, with their numbers; the rank runs over aggregated units."""
    s = t.part.groupBy(F.col("p_brand").alias("module")).agg(F.sum("p_retailprice").alias("s"))
    place = F.row_number().over(W.orderBy(F.desc("s"), "module"))
    return s.select(F.concat(F.lit("unit-"), place.cast("string")).alias("unit"), "module", F.round("s", 2).alias("score"))


@query("SELECT o_custkey AS repo, o_orderkey AS run FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders WHERE o_orderstatus = 'F') WHERE k = 1")
def e02_latest_run(t: Tables) -> DataFrame:
    """Latest completed run per repository (also k19)."""
    return t.orders.filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("repo")).agg(F.max("o_orderkey").alias("run"))


@query("""SELECT o_orderkey AS run, CASE WHEN o_orderstatus = 'P' THEN 'staging' WHEN o_orderstatus = 'O' THEN 'non_completed' WHEN o_totalprice < 50000 THEN 'incomplete' WHEN year(o_orderdate) < 1997 THEN 'legacy' ELSE 'committed' END AS state FROM orders""")
def e03_run_classes(t: Tables) -> DataFrame:
    """Class of a run by the first rule that holds."""
    s = F.col("o_orderstatus")
    return t.orders.select(F.col("o_orderkey").alias("run"), F.when(s == "P", "staging").when(s == "O", "non_completed").when(F.col("o_totalprice") < 50000, "incomplete").when(F.year("o_orderdate") < 1997, "legacy").otherwise("committed").alias("state"))


@query(_TIMING + " SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY session, target ORDER BY a, event_id) = 1 THEN 'irreducible' ELSE 'repeated' END AS kind FROM s WHERE action = 'read'")
def e04_first_occurrence(t: Tables) -> DataFrame:
    """First reading of a subject in a session against later ones."""
    k = F.row_number().over(W.partitionBy("session", "target").orderBy("a", "event_id"))
    return timing(t).filter("action = 'read'").select("event_id", F.when(k == 1, "irreducible").otherwise("repeated").alias("kind"))


@query(_SESSION + " SELECT event_id, last_verify IS NULL OR seq > last_verify AS unverified FROM v WHERE action = 'edit'")
def e05_edit_after_verify(t: Tables) -> DataFrame:
    """Edits that no later verification in the session covers."""
    last = F.max(F.when(F.col("action") == "verify", F.col("seq"))).over(W.partitionBy("session"))
    marked = session_events(t).withColumn("last", last).filter("action = 'edit'")
    return marked.select("event_id", (F.col("last").isNull() | (F.col("seq") > F.col("last"))).alias("unverified"))


_RANGES = """WITH r AS (SELECT DISTINCT l_suppkey AS file, l_partkey AS lo, l_partkey + CAST(l_linenumber AS BIGINT) * 3 AS hi FROM lineitem),
  f AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY file ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM r),
  g AS (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM f)"""


def merged_ranges(t: Tables) -> DataFrame:
    """file, lo, hi: inclusive ranges merged where they touch or overlap."""
    r = t.lineitem.select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("lo"), (F.col("l_partkey") + F.col("l_linenumber").cast("long") * 3).alias("hi"))
    r = r.repartition(tasks_of(t.lineitem), "file").distinct()  # the one exchange of all steps
    order = W.partitionBy("file").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = r.withColumn("fresh", F.when(F.col("lo") <= reach + 1, 0).otherwise(1))
    return fresh.withColumn("island", F.sum("fresh").over(order)).groupBy("file", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


@query(_RANGES + " SELECT file, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY file, island")
def e06_merge_ranges(t: Tables) -> DataFrame:
    """Gaps and islands over inclusive ranges."""
    return merged_ranges(t)


@query("""WITH l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS no, unnest(x) AS line, CAST(len(x) AS BIGINT) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)) SELECT doc_id, no AS hit, greatest(1, no - 3) AS lo, least(n, no + 3) AS hi FROM l WHERE contains(lower(line), 'license')""")
def e07_hit_windows(t: Tables) -> DataFrame:
    """Lines around each hit, cut to the file."""
    x = t.documents.select("doc_id", F.split("text", "\n", -1).alias("x")).select("doc_id", F.size("x").cast("long").alias("n"), F.posexplode("x").alias("i", "line"))
    hit = (F.col("i") + 1).cast("long")
    return x.filter(F.lower("line").contains("license")).select("doc_id", hit.alias("hit"), F.greatest(F.lit(1), hit - 3).alias("lo"), F.least("n", hit + 3).alias("hi"))


#: Limits of a run, and the percentage of the limit of bytes from which a single item is too large.
WALL_LIMIT, BYTES_LIMIT, OVERSIZE = 1500, 100_000_000, 40
_DISPATCH = """WITH d AS (SELECT o_custkey AS run, CAST(year(o_orderdate) AS BIGINT) AS batch, o_orderkey AS item, CAST(floor(o_totalprice / 1000) AS BIGINT) AS secs, o_orderkey % 211 AS took, CAST(round(o_totalprice * 100) AS BIGINT) AS bytes FROM orders),
  g AS (SELECT *, bytes * 100 >= 4000000000 AS large FROM d), kept AS (SELECT * FROM g WHERE NOT large),
  s AS (SELECT *, sum(secs) OVER (PARTITION BY run, batch ORDER BY item ROWS UNBOUNDED PRECEDING) AS asked, sum(bytes) OVER (PARTITION BY run ORDER BY batch, item ROWS UNBOUNDED PRECEDING) AS b FROM kept),
  w AS (SELECT run, batch, coalesce(sum(sum(greatest(took, 1))) OVER (PARTITION BY run ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM kept GROUP BY 1, 2),
  stop AS (SELECT run, arg_min(batch, (batch, item)) AS at_batch, arg_min(item, (batch, item)) AS at_item FROM s JOIN w USING (run, batch) WHERE used + asked > 1500 OR b > 100000000 GROUP BY 1)"""


def admitted(items: DataFrame, wall_limit: int = WALL_LIMIT, bytes_limit: int = BYTES_LIMIT, oversize: int = OVERSIZE, blocks: int | None = None) -> DataFrame:
    """run, batch, item, state, stopped_at for items (run, batch, item, secs, took, bytes) that a run meets by batch and item.

    An item of `oversize` percent of the limit of bytes or more is skipped (a limit of 0 makes none too large). The first other whose estimate does not fit,
    after what earlier batches really took (a second at least) and what its own batch asks for, stops the run: it, all later items, and those of its
    batch that were accepted before it aren't dispatched. All of that is decided by sums along the run, so a run or a batch of any length fills many tasks.
    """
    large = (F.col("bytes").cast("decimal(38,0)") * 100 >= F.lit(oversize * bytes_limit)) & F.lit(bytes_limit > 0)
    zero = lambda c: F.when(large, F.lit(0)).otherwise(c)
    sums = {"secs_sum": zero(F.col("secs")), "took_sum": zero(F.greatest(F.col("took"), F.lit(1))), "bytes_sum": zero(F.col("bytes"))}
    rows = settled(running_sums(items.select("run", "batch", "item", "secs", "took", "bytes"), ["run"], ["batch", "item"], sums, blocks).withColumn("large", large))
    begun = rows.groupBy("run", "batch").agg(F.min(F.col("secs_sum") - sums["secs_sum"]).alias("secs_0"), F.min(F.col("took_sum") - sums["took_sum"]).alias("took_0"))
    over = (F.col("took_0") + F.col("secs_sum") - F.col("secs_0") > wall_limit) | (F.col("bytes_sum") > bytes_limit)
    stops = rows.filter(~F.col("large")).join(begun, ["run", "batch"]).filter(over).groupBy("run").agg(F.min(F.struct("at", "batch", "item")).alias("stop"))
    pending = F.col("stop").isNotNull() & ((F.col("batch") > F.col("stop.batch")) | ((F.col("batch") == F.col("stop.batch")) & (~F.col("large") | (F.col("at") > F.col("stop.at")))))
    state = F.when(pending, "not_dispatched").when(F.col("large"), "skipped_oversize").otherwise("dispatched")
    return rows.join(stops, "run", "left").select("run", "batch", "item", state.alias("state"), F.col("stop.item").alias("stopped_at"))


@query(_DISPATCH + """ SELECT g.run, g.batch, g.item, CASE WHEN g.batch > at_batch OR g.batch = at_batch AND (NOT large OR g.item > at_item) THEN 'not_dispatched' WHEN large THEN 'skipped_oversize' ELSE 'dispatched' END AS state, at_item AS stopped_at
  FROM g LEFT JOIN stop USING (run)""")
def e08_budget_admission(t: Tables) -> DataFrame:
    """Batches of a run while seconds and bytes last; an overrun cancels its whole batch and all that follow, oversized items are skipped alone (also e09)."""
    o = t.orders.select(F.col("o_custkey").alias("run"), F.year("o_orderdate").cast("long").alias("batch"), F.col("o_orderkey").alias("item"), F.floor(F.col("o_totalprice") / 1000).cast("long").alias("secs"), (F.col("o_orderkey") % 211).alias("took"), F.round(F.col("o_totalprice") * 100).cast("long").alias("bytes"))
    return admitted(o)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def e10_duplicate_ids(t: Tables) -> DataFrame:
    """Identifiers seen more than once."""
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query(with_views("commits", "files") + _PAIRS + " SELECT l, r, co_commits, row_number() OVER (ORDER BY co_commits DESC, l, r) AS place FROM pairs ORDER BY place LIMIT 50")
def e11_ranked_edges(t: Tables) -> DataFrame:
    """The fifty strongest co-change edges in their stable order."""
    top = co_changes(t).orderBy(F.desc("co_commits"), "l", "r").limit(50)
    return top.select("l", "r", "co_commits", F.row_number().over(W.orderBy(F.desc("co_commits"), "l", "r")).cast("long").alias("place"))


@query(with_views("session_events") + """ SELECT session, count(*) FILTER (WHERE NOT is_error) AS completed, count(*) FILTER (WHERE is_error) AS failed, round(arg_max(value, seq) - arg_min(value, seq), 4) AS delta,
  CASE WHEN arg_max(value, seq) > arg_min(value, seq) THEN 'improving' WHEN arg_max(value, seq) < arg_min(value, seq) THEN 'degrading' ELSE 'stable' END AS trend FROM session_events GROUP BY 1""")
def e12_session_trend(t: Tables) -> DataFrame:
    """Direction of a session by its first and last value (also l09)."""
    first, last = F.min_by("value", "seq"), F.max_by("value", "seq")
    return session_events(t).groupBy("session").agg(F.count_if(~F.col("is_error")).alias("completed"), F.count_if("is_error").alias("failed"), F.round(last - first, 4).alias("delta"), F.when(last > first, "improving").when(last < first, "degrading").otherwise("stable").alias("trend"))


@query(with_views("imports") + """, done AS (SELECT DISTINCT importer AS f FROM imports WHERE importer LIKE '%/small' OR importer LIKE '%/large'), p AS (SELECT DISTINCT importer, target FROM imports WHERE importer NOT IN (SELECT f FROM done))
  SELECT importer AS node, count(*) AS deps, count(*) FILTER (WHERE target NOT IN (SELECT f FROM done)) AS waiting, count(*) FILTER (WHERE target NOT IN (SELECT f FROM done)) = 0 AS ready FROM p GROUP BY 1""")
def e13_ready_batch(t: Tables) -> DataFrame:
    """Pending nodes with what they wait for; ready once all dependencies are done."""
    edges = imports(t).select("importer", "target").distinct()
    finished = F.col("f").endswith("/small") | F.col("f").endswith("/large")
    done = edges.select(F.col("importer").alias("f")).distinct().filter(finished)
    pending = edges.join(done.withColumnRenamed("f", "importer"), "importer", "left_anti").join(done.select(F.col("f").alias("target"), F.lit(True).alias("ok")), "target", "left")
    waiting = F.count_if(F.col("ok").isNull())
    return pending.groupBy(F.col("importer").alias("node")).agg(F.count(F.lit(1)).alias("deps"), waiting.alias("waiting"), (waiting == 0).alias("ready"))


@query(with_views("session_events") + " SELECT session, coalesce(min(seq) FILTER (WHERE target > 95), min(seq) FILTER (WHERE is_error OR action = 'edit'), 0) AS first FROM session_events GROUP BY 1")
def e14_first_interesting(t: Tables) -> DataFrame:
    """First event at a hotspot, else the first error or edit, else zero."""
    return session_events(t).groupBy("session").agg(F.coalesce(F.min(F.when(F.col("target") > 95, F.col("seq"))), F.min(F.when(F.col("is_error") | (F.col("action") == "edit"), F.col("seq"))), F.lit(0)).alias("first"))


@query("SELECT p_brand AS kind, count(*) > 1 AS tied, count(*) AS n, max(p_size) AS top FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS k FROM part) WHERE k = 1 GROUP BY 1")
def e15_top_ties(t: Tables) -> DataFrame:
    """Whether several rows share the top score."""
    top = t.part.withColumn("k", F.rank().over(W.partitionBy("p_brand").orderBy(F.desc("p_size")))).filter("k = 1")
    return top.groupBy(F.col("p_brand").alias("kind")).agg((F.count(F.lit(1)) > 1).alias("tied"), F.count(F.lit(1)).alias("n"), F.max("p_size").alias("top"))


@query(with_views("files") + " SELECT path, size FROM files WHERE size > 45 ORDER BY size DESC, path LIMIT 8")
def f03_god_targets(t: Tables) -> DataFrame:
    """The eight largest files over the limit (also f04)."""
    return files(t).filter("size > 45").orderBy(F.desc("size"), "path").limit(8).select("path", "size")


@query(with_views("files") + " SELECT string_agg(path, ', ' ORDER BY path) FILTER (WHERE k <= 8) || CASE WHEN count(*) > 8 THEN ' +' || (count(*) - 8) || ' more' ELSE '' END AS description FROM (SELECT path, row_number() OVER (ORDER BY path) AS k FROM files WHERE size > 48)")
def f06_overflow_description(t: Tables) -> DataFrame:
    """First eight names and how many more there are."""
    over = files(t).filter("size > 48").select("path")
    first = over.orderBy("path").limit(8).agg(F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("names"))
    more = F.when(F.col("n") > 8, F.concat(F.lit(" +"), (F.col("n") - 8).cast("string"), F.lit(" more"))).otherwise("")
    return first.crossJoin(over.agg(F.count(F.lit(1)).alias("n"))).select(F.concat("names", more).alias("description"))


@query(_RISK + ", k AS (SELECT module, risk, row_number() OVER (ORDER BY risk DESC, module) AS place FROM risk) SELECT module, risk, place FROM k WHERE place <= 20")
def f08_module_order(t: Tables) -> DataFrame:
    """Modules by risk, then name."""
    return module_risk(t).withColumn("place", F.row_number().over(W.orderBy(F.desc("risk"), "module")).cast("long")).filter("place <= 20")


@query(with_views("files") + """, a AS (SELECT path, 1 AS tier, size, row_number() OVER (ORDER BY size DESC, path) AS k FROM files WHERE size % 11 = 0), b AS (SELECT path, 2 AS tier, size, row_number() OVER (ORDER BY size DESC, path) AS k FROM files WHERE module = 'brand_3'),
  c AS (SELECT path, 3 AS tier, size, row_number() OVER (ORDER BY size DESC, path) AS k FROM files), u AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY tier) AS d FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c))
  SELECT path, CAST(tier AS INTEGER) AS tier FROM u WHERE d = 1 ORDER BY tier, size DESC, path LIMIT 300""")
def f10_tiered_topk(t: Tables) -> DataFrame:
    """Hotspots first, then a module's files, then the largest of all; each file in its first tier; 300 in total."""
    f = files(t)
    tiers = [f.filter("size % 11 = 0"), f.filter("module = 'brand_3'"), f]
    union = tiers[0].select("path", "size", F.lit(1).alias("tier"))
    for n, tier in enumerate(tiers[1:], 2):
        union = union.union(tier.select("path", "size", F.lit(n)))
    first = union.groupBy("path", "size").agg(F.min("tier").alias("tier"))
    return first.orderBy("tier", F.desc("size"), "path").limit(300).select("path", "tier")


@query("SELECT file, symbol FROM (SELECT l_suppkey AS file, l_orderkey AS symbol, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS k FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem)) WHERE k <= 80")
def f12_symbol_cap(t: Tables) -> DataFrame:
    """The first eighty symbols of each file."""
    s = t.lineitem.select(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("symbol")).distinct()
    return s.withColumn("k", F.row_number().over(W.partitionBy("file").orderBy("symbol"))).filter("k <= 80").drop("k")


@query(with_views("commits", "commit_files") + " SELECT path, hash, ts FROM (SELECT path, hash, ts, row_number() OVER (PARTITION BY path ORDER BY ts DESC, hash DESC) AS k FROM commits JOIN commit_files USING (hash)) WHERE k <= 5")
def f13_recent_commits(t: Tables) -> DataFrame:
    """The five newest commits of each file."""
    log = commits(t).join(commit_files(t), "hash").select("path", "hash", "ts")
    return log.withColumn("k", F.row_number().over(W.partitionBy("path").orderBy(F.desc("ts"), F.desc("hash")))).filter("k <= 5").drop("k")


@query("""WITH v AS (SELECT n_name AS rule, s_name AS target, row_number() OVER (PARTITION BY n_name ORDER BY s_acctbal DESC, s_name) AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT rule, string_agg(target, ',' ORDER BY k) AS plan FROM v WHERE k <= 3 GROUP BY 1""")
def f14_treatment_plan(t: Tables) -> DataFrame:
    """Up to three targets per rule on one line."""
    v = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("k", F.row_number().over(W.partitionBy("n_name").orderBy(F.desc("s_acctbal"), "s_name"))).filter("k <= 3")
    return v.groupBy(F.col("n_name").alias("rule")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "s_name"))), lambda x: x["s_name"]), ",").alias("plan"))


@query("SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS id FROM documents UNION ALL SELECT 'benchmark', CAST(item_id AS VARCHAR) FROM benchmark UNION ALL SELECT 'page', CAST(page_id AS VARCHAR) FROM pages")
def g01_union_facts(t: Tables) -> DataFrame:
    """Facts of several sources under one schema."""
    fact = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("id"))
    return fact(t.documents, "document", "doc_id").unionByName(fact(t.benchmark, "benchmark", "item_id")).unionByName(fact(t.pages, "page", "page_id"))


@query("SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders")
def g04_intersection(t: Tables) -> DataFrame:
    """Keys that both relations hold."""
    return t.customer.select("c_custkey").intersect(t.orders.select("o_custkey"))


@query("SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0 UNION SELECT o_custkey FROM orders WHERE o_totalprice > 480000")
def g07_ignored_union(t: Tables) -> DataFrame:
    """Distinct union of two exclusion lists."""
    return t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("id")).union(t.orders.filter("o_totalprice > 480000").select("o_custkey")).distinct()


@query(with_views("commit_files") + """, i AS (SELECT hash, module, count(*) FILTER (WHERE path LIKE '%/tests/%') AS direct FROM commit_files GROUP BY 1, 2), a AS (SELECT module, count(*) AS tests FROM (SELECT DISTINCT module, path FROM commit_files WHERE path LIKE '%/tests/%') GROUP BY 1)
  SELECT hash, CAST(sum(CASE WHEN direct > 0 THEN direct ELSE coalesce(tests, 0) END) AS BIGINT) AS selected FROM i LEFT JOIN a USING (module) GROUP BY 1""")
def g08_selected_tests(t: Tables) -> DataFrame:
    """Tests among the touched files of a module, else all tests of the module."""
    test = F.col("path").contains("/tests/")
    direct = commit_files(t).groupBy("hash", "module").agg(F.count_if(test).alias("direct"))
    everyone = commit_files(t).filter(test).select("module", "path").distinct().groupBy("module").agg(F.count(F.lit(1)).alias("tests"))
    chosen = F.when(F.col("direct") > 0, F.col("direct")).otherwise(F.coalesce("tests", F.lit(0)))
    return direct.join(everyone, "module", "left").groupBy("hash").agg(F.sum(chosen).alias("selected"))
