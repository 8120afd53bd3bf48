"""Joins: resolution by priority and suffix, history windows, ratchets, look-ups and paired comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.plans.registry import Tables, query
from stratalens.shared import tasks_of
from stratalens.sources.bindings import DAY, commit_files, commits, dealt_files, files, imports, session_events, with_views

_RESOLVE = """, wanted AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'crates/' || lower(replace(p_brand, '#', '_')) || '/src/' || p_partkey WHEN 1 THEN p_partkey || '_test' ELSE 'none/' || p_partkey END AS token FROM part),
  stems AS (SELECT path, regexp_replace(path, '\\.rs$', '') AS stem FROM files),
  direct AS (SELECT w.k, s.path FROM wanted w JOIN stems s ON s.stem = w.token),
  suffix AS (SELECT w.k, min(s.path) AS path, count(*) AS n FROM wanted w JOIN stems s ON s.stem LIKE '%/' || w.token GROUP BY w.k)"""


@query(with_views("files") + _RESOLVE + """ SELECT w.k, coalesce(d.path, CASE WHEN s.n = 1 THEN s.path END) AS path,
  CASE WHEN d.path IS NOT NULL THEN 'high' WHEN s.n = 1 THEN 'medium' ELSE 'unresolved' END AS confidence FROM wanted w LEFT JOIN direct d USING (k) LEFT JOIN suffix s USING (k)""")
def c01_import_resolution(t: Tables) -> DataFrame:
    """Resolves tokens to files: an exact candidate first, else the only file whose path ends in the token.

    Suffixes of each path are exploded, so the fallback is an equi-join as well.
    """
    stem = F.regexp_replace("path", r"\.rs$", "")
    n = tasks_of(t.part, 2)  # tails of a path
    known = files(t).repartition(n, "partkey").select("path", stem.alias("stem"))
    key = F.col("partkey").cast("string")
    token = F.when(F.col("partkey") % 3 == 0, F.concat(F.lit("crates/"), "module", F.lit("/src/"), key)).when(F.col("partkey") % 3 == 1, F.concat(key, F.lit("_test"))).otherwise(F.concat(F.lit("none/"), key))
    wanted = files(t).select(F.col("partkey").alias("k"), token.alias("token"))
    parts = F.split("stem", "/")
    tails = known.select("path", F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("token"))
    unique = tails.repartition(n, "token").groupBy("token").agg(F.min("path").alias("tail"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    exact = known.select(F.col("stem").alias("token"), F.col("path").alias("exact"))
    found = wanted.repartition(n, "token").join(exact, "token", "left").join(unique, "token", "left")
    return found.select("k", F.coalesce("exact", "tail").alias("path"), F.when(F.col("exact").isNotNull(), "high").when(F.col("tail").isNotNull(), "medium").otherwise("unresolved").alias("confidence"))


@query(with_views("files", "commit_files", "imports") + """, s AS (SELECT module, count(*) AS n_symbols FROM files GROUP BY 1), i AS (SELECT split_part(importer, '/', 1) AS module, count(*) AS n_imports FROM imports GROUP BY 1)
  SELECT s.module, n_symbols, coalesce(n_imports, 0) AS n_imports FROM s LEFT JOIN i USING (module)""")
def c03_enrich_modules(t: Tables) -> DataFrame:
    """Symbols and imports per module; none counts as zero."""
    symbols = files(t).groupBy("module").agg(F.count(F.lit(1)).alias("n_symbols"))
    uses = imports(t).groupBy(F.split_part("importer", F.lit("/"), F.lit(1)).alias("module")).agg(F.count(F.lit(1)).alias("n_imports"))
    return symbols.join(uses, "module", "left").select("module", "n_symbols", F.coalesce("n_imports", F.lit(0)).alias("n_imports"))


@query(with_views("session_events") + """ SELECT session, seq, target, CASE WHEN p.p_partkey IS NULL THEN 'unknown' ELSE 'matched' END AS state, p.p_brand AS module
  FROM session_events e LEFT JOIN (SELECT * FROM part WHERE p_size > 25) p ON p.p_partkey = e.target""")
def c05_target_hotspots(t: Tables) -> DataFrame:
    """Targets of session events matched to hotspots."""
    hot = t.part.filter("p_size > 25").select(F.col("p_partkey").alias("target"), F.col("p_brand").alias("module"))
    joined = session_events(t).join(hot, "target", "left")
    return joined.select("session", "seq", "target", F.when(F.col("module").isNull(), "unknown").otherwise("matched").alias("state"), "module")


@query("""WITH u AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages), k AS (SELECT DISTINCT regexp_replace(host, '^[^.]+\\.', '') AS known FROM u)
  SELECT page_id, host, arg_max(known, length(known)) AS known FROM u JOIN k ON host = known OR host LIKE '%.' || known GROUP BY 1, 2""")
def c06_longest_suffix(t: Tables) -> DataFrame:
    """The longest known suffix of each host, by exploded suffixes."""
    host = t.pages.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))
    known = host.select(F.regexp_replace("host", r"^[^.]+\.", "").alias("known")).distinct()
    parts = F.split("host", r"\.")
    tails = host.select("page_id", "host", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("known"))
    return tails.join(known, "known").groupBy("page_id", "host").agg(F.max_by("known", F.length("known")).alias("known"))


@query(with_views("imports") + """, e AS (SELECT split_part(importer, '/', 1) AS src, split_part(target, '/', 1) AS dst, count(*) AS weight FROM imports GROUP BY 1, 2),
  r AS (SELECT src, dst, weight, CAST(regexp_extract(src, '([0-9]+)$', 1) AS BIGINT) AS a, CAST(regexp_extract(dst, '([0-9]+)$', 1) AS BIGINT) AS b FROM e WHERE src <> dst)
  SELECT src, dst, weight FROM r WHERE a % 5 = 1 AND b % 5 = 3""")
def c13_boundary_rules(t: Tables) -> DataFrame:
    """Module edges that a rule forbids: edges joined with the modules of both ends and the rules."""
    modules = files(t).select("module", (F.regexp_extract("module", "([0-9]+)$", 1).cast("long") % 5).alias("zone")).distinct()
    rules = t.spark.createDataFrame([(1, 3)], "from_zone long, forbid_zone long")
    first = lambda c: F.split_part(c, F.lit("/"), F.lit(1))
    edges = imports(t).groupBy(first("importer").alias("src"), first("target").alias("dst")).agg(F.count(F.lit(1)).alias("weight")).filter("src <> dst")
    ends = edges.join(modules.select(F.col("module").alias("src"), F.col("zone").alias("from_zone")), "src").join(modules.select(F.col("module").alias("dst"), F.col("zone").alias("forbid_zone")), "dst")
    return ends.join(F.broadcast(rules), ["from_zone", "forbid_zone"]).select("src", "dst", "weight")


@query("""SELECT s.r_name AS src_layer, d.r_name AS dst_layer, count(*) AS n FROM orders o JOIN customer c ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region s ON cn.n_regionkey = s.r_regionkey
  JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region d ON sn.n_regionkey = d.r_regionkey WHERE s.r_regionkey < d.r_regionkey GROUP BY 1, 2""")
def c14_layer_order(t: Tables) -> DataFrame:
    """Uses from a layer of a later one."""
    layer = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_regionkey", "r_name")
    side = lambda key, at, name: layer.select(F.col("n_nationkey").alias(key), F.col("r_regionkey").alias(at), F.col("r_name").alias(name))
    buyers = t.customer.join(side("c_nationkey", "src", "src_layer"), "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "src", "src_layer")
    sellers = t.supplier.join(side("s_nationkey", "dst", "dst_layer"), "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"), "dst", "dst_layer")
    uses = t.lineitem.select("l_orderkey", "l_suppkey").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(buyers, "o_custkey").join(sellers, "l_suppkey")
    return uses.filter("src < dst").groupBy("src_layer", "dst_layer").agg(F.count(F.lit(1)).alias("n"))


WIDE = 50

_PAIRS = """, d AS (SELECT DISTINCT l.hash, module || '/' || lower(p_type) AS file FROM (SELECT l_orderkey AS hash, l_partkey AS partkey FROM lineitem) l JOIN files USING (partkey)),
  narrow AS (SELECT hash FROM d GROUP BY hash HAVING count(*) <= 50), e AS (SELECT d.* FROM d JOIN narrow USING (hash)),
  pairs AS (SELECT a.file AS l, b.file AS r, count(*) AS co_commits, max(a.hash) AS newest FROM e a JOIN e b ON a.hash = b.hash AND a.file < b.file GROUP BY 1, 2 HAVING count(*) >= 3)"""


def typed_files(t: Tables) -> DataFrame:
    """hash (a commit, of a size that no number of commits changes), file (module/type)."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("hash"), F.col("l_partkey").alias("partkey"))
    named = lines.join(dealt_files(t), "partkey").select("hash", F.concat("module", F.lit("/"), F.lower("p_type")).alias("file"))
    return named.repartition(tasks_of(t.lineitem), "hash").distinct()


def co_changes(t: Tables, least: int = 3) -> DataFrame:
    """l, r, co_commits, newest: ordered pairs of files that change together; a commit of over WIDE files is left out before the self-join."""
    return co_changed(typed_files(t), least)


def co_changed(touched: DataFrame, least: int) -> DataFrame:
    """The same of touched (hash, file; each once)."""
    narrow = touched.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= WIDE).select("hash")
    kept = touched.join(narrow, "hash")
    pairs = kept.alias("a").join(kept.alias("b"), (F.col("a.hash") == F.col("b.hash")) & (F.col("a.file") < F.col("b.file")))
    counted = pairs.groupBy(F.col("a.file").alias("l"), F.col("b.file").alias("r")).agg(F.count(F.lit(1)).alias("co_commits"), F.max("a.hash").alias("newest"))
    return counted.filter(F.col("co_commits") >= least)


_RECENT = """, d AS (SELECT DISTINCT l.hash, module || '/' || lower(p_type) AS file FROM (SELECT l_orderkey AS hash, l_partkey AS partkey FROM lineitem) l JOIN files USING (partkey)),
  walked AS (SELECT d.*, ts, count(*) OVER (PARTITION BY hash) AS width FROM d JOIN commits USING (hash) WHERE ts >= (SELECT max(ts) FROM commits) - 365 * 86400),
  hits AS (SELECT a.file AS l, b.file AS r, a.hash, a.ts FROM walked a JOIN walked b ON a.hash = b.hash AND a.file < b.file WHERE a.width <= 50),
  edges AS (SELECT l, r, count(*) AS co_commits, array_to_string(list(hash ORDER BY ts DESC, hash)[1:3], ',') AS commits, count(*) > 3 AS truncated FROM hits GROUP BY 1, 2 HAVING count(*) >= 3)"""
EVIDENCE = 3


def recent_touches(t: Tables, days: int = 365) -> DataFrame:
    """hash, file, ts, width (files of the commit): what the commits of the days before the newest touched."""
    log = commits(t).select("hash", "ts")
    tip = log.agg(F.max("ts").alias("tip"))
    touched = typed_files(t).join(log.crossJoin(F.broadcast(tip)).filter(F.col("ts") >= F.col("tip") - days * DAY).select("hash", "ts"), "hash")  # one row
    return touched.withColumn("width", F.count(F.lit(1)).over(W.partitionBy("hash")))


def recent_edges(touched: DataFrame, least: int = 3) -> DataFrame:
    """l, r, co_commits, commits (the newest three), truncated: pairs of files that at least `least` of the commits changed together; a commit of over WIDE files joins nothing."""
    kept = touched.filter(F.col("width") <= WIDE)
    hits = kept.alias("a").join(kept.alias("b"), (F.col("a.hash") == F.col("b.hash")) & (F.col("a.file") < F.col("b.file"))).select(F.col("a.file").alias("l"), F.col("b.file").alias("r"), "a.hash", "a.ts")
    counted = hits.groupBy("l", "r").agg(F.count(F.lit(1)).alias("co_commits")).filter(F.col("co_commits") >= least)
    newest = hits.withColumn("k", F.row_number().over(W.partitionBy("l", "r").orderBy(F.desc("ts"), "hash"))).filter(F.col("k") <= EVIDENCE)
    newest = newest.groupBy("l", "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "hash"))), lambda x: x["hash"].cast("string")), ",").alias("commits"))  # EVIDENCE at most
    return counted.join(newest, ["l", "r"]).select("l", "r", "co_commits", "commits", (F.col("co_commits") > EVIDENCE).alias("truncated"))


@query(with_views("commits", "files") + _RECENT + " SELECT l, r, co_commits, commits, truncated FROM edges")
def c15_cochange_pairs(t: Tables) -> DataFrame:
    """Co-change edges with at least three common commits of the last 365 days, with the newest three as evidence."""
    return recent_edges(recent_touches(t))


@query(with_views("commits", "commit_files") + """, h AS (SELECT hash, ts, path, subject FROM commits JOIN commit_files USING (hash)),
  w AS (SELECT path, hash, count(*) FILTER (WHERE starts_with(subject, 'fix')) OVER past AS fixes, count(*) OVER recent AS touches FROM h
  WINDOW past AS (PARTITION BY path ORDER BY ts RANGE BETWEEN 15552000 PRECEDING AND 0 FOLLOWING EXCLUDE CURRENT ROW), recent AS (PARTITION BY path ORDER BY ts RANGE BETWEEN 7776000 PRECEDING AND 0 FOLLOWING EXCLUDE CURRENT ROW))
  SELECT hash, CAST(sum(fixes) AS BIGINT) AS fixes_180d, CAST(sum(touches) AS BIGINT) AS touches_90d FROM w GROUP BY hash""")
def c16_history_windows(t: Tables) -> DataFrame:
    """Per commit, fixes of 180 days and touches of 90 days before it on its files; its own commit is left out.

    A range window replaces the range join.
    """
    return history_counts(t)


def history_counts(t: Tables) -> DataFrame:
    """hash, fixes_180d, touches_90d. A file's history is cut into periods of 180 days, each with the one before it, so a file of every commit fills many tasks."""
    h = commits(t).join(commit_files(t), "hash").select("hash", "path", "ts", F.when(F.col("subject").startswith("fix"), 1).otherwise(0).alias("fix"), F.floor(F.col("ts") / (180 * DAY)).alias("own"))
    placed = h.withColumn("period", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    order = W.partitionBy("path", "period").orderBy("ts")
    fixes = F.sum("fix").over(order.rangeBetween(-180 * DAY, 0)) - F.col("fix")
    touches = F.count(F.lit(1)).over(order.rangeBetween(-90 * DAY, 0)) - 1
    seen = placed.select("hash", "own", "period", fixes.alias("f"), touches.alias("c")).filter("own = period")
    return seen.groupBy("hash").agg(F.sum("f").alias("fixes_180d"), F.sum("c").alias("touches_90d"))


@query(with_views("files") + """, now AS (SELECT path FROM files WHERE size > 40), before AS (SELECT path FROM files WHERE size > 42 OR size % 10 = 0)
  SELECT path, 'new' AS change FROM now ANTI JOIN before USING (path) UNION ALL SELECT path, 'resolved' FROM before ANTI JOIN now USING (path)""")
def c17_god_ratchet(t: Tables) -> DataFrame:
    """Files over the threshold now but not in the baseline, and the other way round, by identity."""
    now = files(t).filter("size > 40").select("path")
    before = files(t).filter("size > 42 or size % 10 = 0").select("path")
    return now.join(before, "path", "left_anti").withColumn("change", F.lit("new")).unionByName(before.join(now, "path", "left_anti").withColumn("change", F.lit("resolved")))


_RUNS = """, runs AS (SELECT n_name AS case_id, 'C' || CAST(l_orderkey % 3 AS VARCHAR) AS condition, CAST(year(o_orderdate) AS BIGINT) AS repetition, round(avg(l_quantity), 4) AS quality, count(*) AS cost, l_orderkey % 3 AS c
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2, 3, 6)"""


def benchmark_runs(t: Tables) -> DataFrame:
    """case_id, condition, repetition, quality, cost."""
    place = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("case_id"))
    made = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.year("o_orderdate").cast("long").alias("repetition")).join(place, "o_custkey")
    lines = t.lineitem.select("l_orderkey", "l_quantity").join(made, "l_orderkey")
    condition = F.concat(F.lit("C"), (F.col("l_orderkey") % 3).cast("string"))
    return lines.groupBy("case_id", condition.alias("condition"), "repetition").agg(F.round(F.avg("l_quantity"), 4).alias("quality"), F.count(F.lit(1)).alias("cost"))


@query("WITH z AS (SELECT 1)" + _RUNS + """ SELECT a.condition, count(*) AS pairs, round(avg(a.quality - b.quality), 6) AS quality_delta, round(avg(a.cost - b.cost), 6) AS cost_delta
  FROM runs a JOIN runs b ON a.case_id = b.case_id AND a.repetition = b.repetition AND b.condition = 'C0' WHERE a.condition <> 'C0' GROUP BY 1""")
def c18_paired_deltas(t: Tables) -> DataFrame:
    """Mean difference of each condition to the control of the same case and repetition."""
    runs = benchmark_runs(t)
    control = runs.filter("condition = 'C0'").select("case_id", "repetition", F.col("quality").alias("q0"), F.col("cost").alias("c0"))
    both = runs.filter("condition <> 'C0'").join(control, ["case_id", "repetition"])
    return both.groupBy("condition").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.col("quality") - F.col("q0")), 6).alias("quality_delta"), F.round(F.avg((F.col("cost") - F.col("c0")).cast("double")), 6).alias("cost_delta"))


@query(with_views("commits") + """, latest AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY ts DESC, hash DESC) AS k FROM commits)
  SELECT c_custkey AS gap, hash, CASE WHEN hash IS NULL THEN 'reopen:no_record' WHEN starts_with(subject, 'fix') THEN 'reopen:snapshot_changed' WHEN (SELECT max(ts) FROM commits) - ts > 365 * 86400 THEN 'reopen:evidence_stale' ELSE 'replay' END AS verdict
  FROM customer LEFT JOIN (SELECT * FROM latest WHERE k = 1) ON author = c_custkey""")
def c19_latest_decision(t: Tables) -> DataFrame:
    """The latest decision of each gap and whether it can be replayed (also j09)."""
    log = commits(t)
    last = log.groupBy(F.col("author").alias("gap")).agg(F.max_by(F.struct("hash", "ts", "subject"), F.struct("ts", "hash")).alias("d"))
    joined = t.customer.select(F.col("c_custkey").alias("gap")).join(last, "gap", "left").crossJoin(F.broadcast(log.agg(F.max("ts").alias("now"))))
    verdict = F.when(F.col("d").isNull(), "reopen:no_record").when(F.col("d.subject").startswith("fix"), "reopen:snapshot_changed").when(F.col("now") - F.col("d.ts") > 365 * DAY, "reopen:evidence_stale").otherwise("replay")
    return joined.select("gap", F.col("d.hash").alias("hash"), verdict.alias("verdict"))


@query("""WITH m AS (SELECT c_mktsegment AS card, list_distinct(list(c_nationkey % 7)) AS signals FROM customer GROUP BY 1), g AS (SELECT s_suppkey AS fact, list_distinct([s_nationkey % 7, (s_nationkey + 3) % 9]) AS signals FROM supplier)
  SELECT fact, card, len(list_intersect(g.signals, m.signals)) AS matched, len(g.signals) - len(list_intersect(g.signals, m.signals)) AS missing FROM g, m WHERE len(list_intersect(g.signals, m.signals)) > 0""")
def c21_method_rules(t: Tables) -> DataFrame:
    """Methods whose rule has some of a fact's signals: how many it has and how many it lacks; met by signal, so no pair without a match is made."""
    rules = t.customer.select(F.col("c_mktsegment").alias("card"), (F.col("c_nationkey") % 7).alias("signal")).distinct()
    facts = t.supplier.select(F.col("s_suppkey").alias("fact"), F.array_distinct(F.array(F.col("s_nationkey") % 7, (F.col("s_nationkey") + 3) % 9)).alias("signals"))
    met = facts.select("fact", F.size("signals").alias("n"), F.explode("signals").alias("signal")).join(rules, "signal")
    return met.groupBy("fact", "card", "n").agg(F.count(F.lit(1)).alias("matched")).select("fact", "card", "matched", (F.col("n") - F.col("matched")).alias("missing"))


@query("""WITH d AS (SELECT sha256(text) AS pin, min(doc_id) AS source, count(*) AS n FROM documents GROUP BY 1)
  SELECT b.item_id, d.source FROM (SELECT item_id, sha256(text) AS pin FROM benchmark) b LEFT JOIN (SELECT * FROM d WHERE n = 1) d USING (pin)
  UNION ALL SELECT k.doc_id, d.source FROM documents k JOIN d ON sha256(k.text) = d.pin AND d.n = 1""")
def c22_pin_lookup(t: Tables) -> DataFrame:
    """Digest to its only source; a digest that several sources share is ambiguous and left out."""
    sources = t.documents.select(F.sha2("text", 256).alias("pin"), "doc_id")
    unique = sources.groupBy("pin").agg(F.min("doc_id").alias("source"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    items = t.benchmark.select("item_id", F.sha2("text", 256).alias("pin")).join(unique, "pin", "left").select("item_id", "source")
    return items.union(sources.join(unique, "pin").select(F.col("doc_id").alias("item_id"), "source"))


@query("""WITH s AS (SELECT l_partkey AS file, l_suppkey AS name, min(l_linenumber) AS claimed FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), d AS (SELECT l_partkey AS file, l_suppkey AS name, l_linenumber AS line FROM lineitem WHERE l_returnflag <> 'R')
  SELECT s.file, s.name, CASE WHEN count(line) = 0 THEN 'dropped' WHEN bool_or(line = claimed) THEN 'verified' ELSE 'approximate' END AS anchor, CASE WHEN bool_or(line = claimed) THEN max(claimed) ELSE min(line) END AS line FROM s LEFT JOIN d ON s.file = d.file AND s.name = d.name GROUP BY 1, 2""")
def c24_anchor_verification(t: Tables) -> DataFrame:
    """Claimed anchors against current declarations of the same file and name: the claimed line, else the first, else dropped."""
    lines = t.lineitem.select(F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("name"), F.col("l_linenumber").alias("line"), "l_returnflag")
    claims = lines.filter("l_returnflag = 'R'").groupBy("file", "name").agg(F.min("line").alias("claimed"))
    now = lines.filter("l_returnflag <> 'R'").select("file", "name", "line")
    seen = claims.join(now, ["file", "name"], "left").groupBy("file", "name", "claimed").agg(F.min("line").alias("first"), F.coalesce(F.bool_or(F.col("line") == F.col("claimed")), F.lit(False)).alias("same"))
    return seen.select("file", "name", F.when(F.col("first").isNull(), "dropped").when(F.col("same"), "verified").otherwise("approximate").alias("anchor"), F.when(F.col("same"), F.col("claimed")).otherwise(F.col("first")).alias("line"))


@query("""WITH g AS (SELECT p_brand AS file, p_size AS lo, p_size + CAST(p_partkey % 3 AS INTEGER) AS hi FROM part GROUP BY ALL), r AS (SELECT p_brand AS file, p_size - 1 AS a, p_size + 2 AS b FROM part WHERE p_type = 'PROMO' GROUP BY ALL), s AS (SELECT g.file, lo, hi, count(a) > 0 AS inside FROM g LEFT JOIN r ON r.file = g.file AND lo >= a AND hi <= b GROUP BY 1, 2, 3)
  SELECT file, count(*) AS spans, count(*) FILTER (WHERE inside) AS covered, bool_and(inside) AS complete FROM s GROUP BY 1""")
def c26_span_coverage(t: Tables) -> DataFrame:
    """Wanted spans that lie inside some retrieved range of their file.

    Of the ranges that start no later than a span the furthest end decides, so spans and ranges are sorted together once and never paired.
    """
    wanted = t.part.select(F.col("p_brand").alias("file"), F.col("p_size").alias("at"), (F.col("p_size") + (F.col("p_partkey") % 3).cast("int")).alias("hi")).distinct()
    got = t.part.filter("p_type = 'PROMO'").groupBy(F.col("p_brand").alias("file"), (F.col("p_size") - 1).alias("at")).agg(F.max(F.col("p_size") + 2).alias("end"))
    both = wanted.select("file", "at", "hi", F.lit(None).cast("int").alias("end")).union(got.select("file", "at", F.lit(None).cast("int"), "end"))
    reach = F.max("end").over(W.partitionBy("file").orderBy("at").rangeBetween(W.unboundedPreceding, 0))
    spans = both.select("file", "hi", F.coalesce(F.col("hi") <= reach, F.lit(False)).alias("inside")).filter("hi is not null")
    return spans.groupBy("file").agg(F.count(F.lit(1)).alias("spans"), F.count_if("inside").alias("covered"), F.bool_and("inside").alias("complete"))


@query(with_views("imports") + """, e AS (SELECT DISTINCT importer, target FROM imports), seeds AS (SELECT DISTINCT importer AS file FROM imports WHERE importer LIKE '%/promo')
  SELECT file FROM seeds UNION SELECT target FROM e JOIN seeds ON importer = file UNION SELECT importer FROM e JOIN seeds ON target = file""")
def c27_one_hop(t: Tables) -> DataFrame:
    """Files found, what they import and what imports them."""
    edges = imports(t).select("importer", "target").distinct()
    seeds = edges.select(F.col("importer").alias("file")).filter(F.col("file").endswith("/promo")).distinct()
    ahead = edges.join(seeds, edges["importer"] == seeds["file"]).select("target")
    back = edges.join(seeds, edges["target"] == seeds["file"]).select("importer")
    return seeds.union(ahead).union(back).distinct()


@query("""WITH a AS (SELECT DISTINCT doc_id FROM documents), b AS (SELECT DISTINCT doc_id FROM labels) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_left, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_right,
  (SELECT count(*) FROM a) = (SELECT count(*) FROM b) AS same_count""")
def c28_set_coherence(t: Tables) -> DataFrame:
    """Differences of two inventories both ways."""
    a, b = t.documents.select("doc_id").distinct(), t.labels.select("doc_id").distinct()
    sides = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), "doc_id", "full")
    counted = sides.agg(F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"), F.count("l").alias("nl"), F.count("r").alias("nr"))
    return counted.select("only_left", "only_right", (F.col("nl") == F.col("nr")).alias("same_count"))


@query("""SELECT CAST(a.doc_id AS BIGINT) AS finding, CASE WHEN count(b.doc_id) = 0 THEN 'missing' WHEN count(b.doc_id) = 1 THEN 'one' ELSE 'many' END AS cardinality FROM documents a LEFT JOIN labels b USING (doc_id) GROUP BY 1""")
def c30_cardinality(t: Tables) -> DataFrame:
    """Foreign keys with none, one or many partners."""
    partners = t.labels.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "one").otherwise("many")
    return t.documents.select("doc_id").distinct().join(partners, "doc_id", "left").select(F.col("doc_id").alias("finding"), state.alias("cardinality"))
