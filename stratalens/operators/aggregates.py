"""Aggregations: scores, histograms, risk, benchmark and retrieval measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.operators.joins import _RUNS, benchmark_runs, history_counts
from stratalens.operators.reach import chain_depths, closure, settled
from stratalens.operators.selection import MIDDLE, nth, order_statistics
from stratalens.plans.registry import REGISTERED, Tables, query
from stratalens.shared import tasks_of
from stratalens.sources.bindings import commit_files, commits, files, imports, session_events, with_views


def count() -> Column:
    return F.count(F.lit(1))


_LINES = """, x AS (SELECT doc_id, source || '/' || CASE WHEN starts_with(lang, 'e') THEN 'main.' ELSE 'part.' END || lang AS path, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_imports, CAST(n_chars % 7 AS BIGINT) AS n_symbols FROM documents)"""


@query("WITH z AS (SELECT 1)" + _LINES + """ SELECT doc_id, CASE WHEN s = 0 THEN 1 ELSE s END AS score, reasons FROM (SELECT doc_id, CASE WHEN path LIKE '%/main.%' THEN 40 ELSE 0 END + least(5 * n_symbols, 20) + least(5 * n_imports, 15) AS s,
  concat_ws(',', CASE WHEN path LIKE '%/main.%' THEN 'entrypoint' END, CASE WHEN n_symbols > 0 THEN 'symbols' END, CASE WHEN n_imports > 0 THEN 'imports' END) AS reasons FROM x)""")
def d01_slice_score(t: Tables) -> DataFrame:
    """Score of a file for a reading list: entry point 40, symbols 5 each to 20, imports 5 each to 15; at least 1."""
    leaf = F.when(F.col("lang").startswith("e"), "main.").otherwise("part.")
    path = F.concat("source", F.lit("/"), leaf, "lang")
    x = t.documents.select("doc_id", path.alias("path"), F.size(F.split("text", "\n", -1)).cast("long").alias("n_imports"), (F.col("n_chars") % 7).alias("n_symbols"))
    entry = F.element_at(F.split("path", "/"), -1).rlike(r"^(index|main|app|server|cli)\.")
    total = F.when(entry, 40).otherwise(0) + F.least(5 * F.col("n_symbols"), F.lit(20)) + F.least(5 * F.col("n_imports"), F.lit(15))
    reasons = F.concat_ws(",", F.when(entry, "entrypoint"), F.when(F.col("n_symbols") > 0, "symbols"), F.when(F.col("n_imports") > 0, "imports"), F.when(total == 0, "inventory"))
    return x.select("doc_id", F.greatest(total, F.lit(1)).cast("long").alias("score"), reasons.alias("reasons"))


@query(with_views("files", "imports") + " SELECT (SELECT count(*) FROM files) AS n_files, (SELECT count(*) FROM imports) AS n_imports, (SELECT count(DISTINCT module) FROM files) AS n_modules, CASE WHEN (SELECT count(*) FROM files) > 0 THEN 1.0::DOUBLE END AS containment")
def d02_scorecard(t: Tables) -> DataFrame:
    """Counts of facts; the containment rate is unknown, not zero, without files."""
    f = files(t).agg(count().alias("n_files"), F.count_distinct("module").alias("n_modules"))
    return f.crossJoin(imports(t).agg(count().alias("n_imports"))).withColumn("containment", F.when(F.col("n_files") > 0, F.lit(1.0)))


@query("SELECT lower(lang) AS ext, count(*) AS n FROM documents WHERE lang <> '' GROUP BY 1")
def d03_extension_histogram(t: Tables) -> DataFrame:
    """Files per lower-cased, non-empty extension."""
    return t.documents.filter("lang <> ''").groupBy(F.lower("lang").alias("ext")).agg(count().alias("n"))


@query("SELECT lang, n, row_number() OVER (ORDER BY n DESC, lang) AS place FROM (SELECT lang, count(*) AS n FROM documents WHERE lang <> 'text' GROUP BY 1)")
def d04_language_histogram(t: Tables) -> DataFrame:
    """Languages by number of files, then name."""
    by = t.documents.filter("lang <> 'text'").groupBy("lang").agg(count().alias("n"))
    return by.select("lang", "n", F.row_number().over(W.orderBy(F.desc("n"), "lang")).cast("long").alias("place"))


_QUALITY_OF = """, m AS (SELECT module, count(*) AS modeled, max(size) AS max_cc, count(*) FILTER (WHERE size > 45) AS gods, count(*) FILTER (WHERE size > 15) AS complex FROM files GROUP BY 1),
  i AS (SELECT split_part(importer, '/', 1) AS module, count(*) AS n FROM imports GROUP BY 1), q AS (SELECT m.*, round(coalesce(n, 0) / modeled * 10, 2) AS coupling FROM m LEFT JOIN i USING (module))"""
_QUALITY = with_views("files", "imports") + _QUALITY_OF


def module_metrics(t: Tables) -> DataFrame:
    """module, modeled, max_cc, gods, complex, coupling."""
    m = files(t).groupBy("module").agg(count().alias("modeled"), F.max("size").alias("max_cc"), F.count_if(F.col("size") > 45).alias("gods"), F.count_if(F.col("size") > 15).alias("complex"))
    i = imports(t).groupBy(F.split_part("importer", F.lit("/"), F.lit(1)).alias("module")).agg(count().alias("n"))
    return m.join(i, "module", "left").withColumn("coupling", F.round(F.coalesce("n", F.lit(0)) / F.col("modeled") * 10, 2)).drop("n")


@query(_QUALITY + " SELECT module, modeled, max_cc, gods, complex, coupling FROM q")
def d07_module_metrics(t: Tables) -> DataFrame:
    """Sums, maxima and coupling per project part."""
    return module_metrics(t)


@query(_QUALITY + " SELECT module, CAST(trunc(greatest(0, 10000 - 8 * coupling - 60 * complex - 120 * gods - 10 * greatest(0, max_cc - 15))) AS BIGINT) AS signal FROM q")
def d08_quality_signal(t: Tables) -> DataFrame:
    """Quality signal, cut towards zero."""
    raw = 10000 - 8 * F.col("coupling") - 60 * F.col("complex") - 120 * F.col("gods") - 10 * F.greatest(F.lit(0), F.col("max_cc") - 15)
    return module_metrics(t).select("module", F.greatest(F.lit(0.0), raw).cast("long").alias("signal"))


_EDGES = """, me AS (SELECT split_part(importer, '/', 1) AS src, split_part(target, '/', 1) AS dst, count(*) AS weight FROM imports GROUP BY 1, 2), mw AS (SELECT * FROM me WHERE src <> dst)"""


def module_edges(t: Tables) -> DataFrame:
    """src, dst, weight between different modules."""
    first = lambda c: F.split_part(c, F.lit("/"), F.lit(1))
    return imports(t).groupBy(first("importer").alias("src"), first("target").alias("dst")).agg(count().alias("weight")).filter("src <> dst")


_MODULES = with_views("files", "commits", "commit_files", "imports") + _EDGES + """, s AS (SELECT module, count(*) AS n_files, count(*) FILTER (WHERE path LIKE '%/src/%') AS sources, count(*) FILTER (WHERE path LIKE '%/tests/%') AS tests FROM files GROUP BY 1),
  c AS (SELECT module, count(*) AS churn, max(ts) AS last FROM commit_files JOIN commits USING (hash) GROUP BY 1),
  o AS (SELECT module, CAST(sum(w) AS BIGINT) AS coupling FROM (SELECT src AS module, weight AS w FROM mw UNION ALL SELECT dst, weight FROM mw) GROUP BY 1)
"""


def touched_paths(t: Tables) -> DataFrame:
    """module, path, churn, last: each file's commits and the newest of them."""
    return commit_files(t).join(commits(t).select("hash", "ts"), "hash").groupBy("module", "path").agg(count().alias("churn"), F.max("ts").alias("last"))


def modules(t: Tables, edges: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """module, n_files, sources, tests, test_gap, churn, last, coupling; from module_edges and touched_paths, if these are known already."""
    path = F.col("path")
    s = files(t).groupBy("module").agg(count().alias("n_files"), F.count_if(path.contains("/src/")).alias("sources"), F.count_if(path.contains("/tests/")).alias("tests"))
    c = (paths or touched_paths(t)).groupBy("module").agg(F.sum("churn").alias("churn"), F.max("last").alias("last"))
    e = edges or settled(module_edges(t))
    o = e.select(F.col("src").alias("module"), "weight").union(e.select("dst", "weight")).groupBy("module").agg(F.sum("weight").alias("coupling"))
    joined = s.join(c, "module", "left").join(o, "module", "left")
    return joined.select("module", "n_files", "sources", "tests", F.greatest(F.lit(0), F.col("sources") - F.col("tests")).alias("test_gap"), F.coalesce("churn", F.lit(0)).alias("churn"), "last", F.coalesce("coupling", F.lit(0)).alias("coupling"))


@query(_MODULES + " SELECT module, n_files, sources, tests, greatest(0, sources - tests) AS test_gap, coalesce(churn, 0) AS churn, last, coalesce(coupling, 0) AS coupling FROM s LEFT JOIN c USING (module) LEFT JOIN o USING (module)")
def d10_module_table(t: Tables) -> DataFrame:
    """Files, tests, gap, churn and coupling per module (also d39)."""
    return modules(t)


@query(with_views("files", "imports") + _EDGES + " SELECT src, dst, weight FROM mw")
def d11_module_edges(t: Tables) -> DataFrame:
    """Weighted edges between modules; edges within one are dropped."""
    return module_edges(t)


def heat(value: Column, top: Column) -> Column:
    return F.when(top <= 0, 0).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), F.round(100 * value / top))))


def blast_radius(edges: DataFrame) -> DataFrame:
    """module, blast_radius: modules that can reach it and the weight of the edges at it; edges: src, dst, weight."""
    edges = settled(edges)
    reach = closure(edges).filter("src <> dst").groupBy(F.col("dst").alias("module")).agg(count().alias("n"))
    at = edges.select(F.explode(F.array("src", "dst")).alias("module"), "weight").groupBy("module").agg(F.sum("weight").alias("coupling"))
    return at.join(reach, "module", "left").select("module", (F.coalesce("n", F.lit(0)) + F.col("coupling")).alias("blast_radius"))


_RISK = _MODULES + """, mc(src, dst) AS (SELECT src, dst FROM mw UNION SELECT mc.src, mw.dst FROM mc JOIN mw ON mc.dst = mw.src), reach AS (SELECT dst AS module, count(*) AS n FROM mc WHERE src <> dst GROUP BY 1),
  grp AS (SELECT module, least(module, coalesce((SELECT min(a.dst) FROM mc a JOIN mc b ON a.src = b.dst AND a.dst = b.src WHERE a.src = module), module)) AS scc FROM (SELECT DISTINCT module FROM files)),
  dag AS (SELECT DISTINCT a.scc AS src, b.scc AS dst FROM mw JOIN grp a ON a.module = mw.src JOIN grp b ON b.module = mw.dst WHERE a.scc <> b.scc), dep(node, depth) AS (SELECT DISTINCT scc, CAST(0 AS BIGINT) FROM grp UNION SELECT dag.src, depth + 1 FROM dep JOIN dag ON dag.dst = dep.node),
  dp AS (SELECT grp.module, least(max(depth), 99) AS depth FROM grp JOIN dep ON dep.node = grp.scc GROUP BY 1),
  ages AS (SELECT module, CAST(round(avg(age)) AS BIGINT) AS age FROM (SELECT module, path, ((SELECT max(ts) FROM commits) - max(ts)) // 86400 AS age FROM commit_files JOIN commits USING (hash) GROUP BY 1, 2) GROUP BY 1),
  gf AS (SELECT module, count(*) FILTER (WHERE partkey % 5 = 0) AS git FROM files GROUP BY 1),
  t AS (SELECT module, n_files, greatest(0, sources - tests) AS gap, coalesce(churn, 0) AS churn, coalesce(coupling, 0) AS coupling, coalesce(n, 0) + coalesce(coupling, 0) AS blast, coalesce(depth, 0) AS depth, coalesce(age, 0) AS age, git
    FROM s LEFT JOIN c USING (module) LEFT JOIN o USING (module) LEFT JOIN reach USING (module) LEFT JOIN dp USING (module) LEFT JOIN ages USING (module) LEFT JOIN gf USING (module)),
  h AS (SELECT module, """ + ", ".join(f"CASE WHEN max({c}) OVER () <= 0 THEN 0 ELSE round(100.0::DOUBLE * {c} / max({c}) OVER ()) END AS h_{c}" for c in ("coupling", "blast", "depth", "churn", "git", "gap", "age", "n_files")) + """ FROM t),
  risk AS (SELECT module, CAST(round(""" + " + ".join(f"h_{c} * {w}::DOUBLE" for c, w in (("coupling", 0.18), ("blast", 0.18), ("depth", 0.14), ("churn", 0.14), ("git", 0.12), ("gap", 0.12), ("age", 0.07), ("n_files", 0.05))) + """) AS BIGINT) AS risk FROM h)"""

# Weights of the heats of a module's risk.
HEATS = (("coupling", 0.18), ("blast_radius", 0.18), ("depth", 0.14), ("churn", 0.14), ("git_files", 0.12), ("test_gap", 0.12), ("age", 0.07), ("n_files", 0.05))


def module_risk(t: Tables, edges: DataFrame | None = None, table: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """module, risk of 0 to 100 from eight heats relative to the greatest value; a part divisible by five stands for a dirty file.

    Lines are read once for the edges and once for the files' commits; what is known of module_edges, modules and touched_paths is not worked out again.
    """
    edges, paths = edges or settled(module_edges(t)), paths or settled(touched_paths(t))
    now = paths.agg(F.max("last").alias("now"))
    last = paths.crossJoin(F.broadcast(now))  # one row
    ages = last.groupBy("module").agg(F.round(F.avg(F.floor((F.col("now") - F.col("last")) / 86_400))).cast("long").alias("age"))
    git = files(t).groupBy("module").agg(F.count_if(F.col("partkey") % 5 == 0).alias("git_files"))
    m = (table or modules(t, edges, paths)).join(blast_radius(edges), "module", "left").join(chain_depths(edges).withColumnRenamed("node", "module"), "module", "left").join(ages, "module", "left").join(git, "module", "left").fillna(0, ["blast_radius", "depth", "age"])
    m = settled(m)
    top = m.agg(*(F.max(c).alias(f"max_{c}") for c, _ in HEATS))
    h = m.crossJoin(F.broadcast(top))  # one row
    score = reduce(Column.__add__, (heat(F.col(c), F.col(f"max_{c}")) * w for c, w in HEATS))
    return h.select("module", F.round(score).cast("long").alias("risk"))


@query(_RISK + " SELECT module, risk FROM risk")
def d12_module_risk(t: Tables) -> DataFrame:
    """Risk score of modules from heats of coupling, blast radius, depth, churn, dirty files, test gap, age and size."""
    return module_risk(t)


_SHAPE = """, shape AS (SELECT hash, count(*) AS n, CAST(sum(ins + del) AS BIGINT) AS lines, max(ins + del) / sum(ins + del) AS share, count(*) FILTER (WHERE path LIKE '%/tests/%') AS tests, count(*) FILTER (WHERE path LIKE '%/src/%') AS sources FROM commit_files GROUP BY hash),
  sub AS (SELECT hash, n, lines, (least(n / 20, 1) + least(lines / 600, 1) + share) / 3 AS d, CASE WHEN sources > 0 AND tests = 0 THEN 1.0 ELSE 0.0 END AS a FROM shape)"""
_PAST = """, h AS (SELECT hash, ts, path, subject FROM commits JOIN commit_files USING (hash)),
  w AS (SELECT path, hash, count(*) FILTER (WHERE starts_with(subject, 'fix')) OVER past AS fixes, count(*) OVER recent AS touches FROM h
  WINDOW past AS (PARTITION BY path ORDER BY ts RANGE BETWEEN 15552000 PRECEDING AND 0 FOLLOWING EXCLUDE CURRENT ROW), recent AS (PARTITION BY path ORDER BY ts RANGE BETWEEN 7776000 PRECEDING AND 0 FOLLOWING EXCLUDE CURRENT ROW)),
  past AS (SELECT hash, sum(fixes) AS f, sum(touches) AS c FROM w GROUP BY hash),
  scored AS (SELECT hash, d, a, least(f / 6, 1) AS b, least(c / 20, 1) AS c, round(30 * d + 25 * a + 25 * least(f / 6, 1) + 20 * least(c / 20, 1) + 1e-9, 4) AS score FROM sub JOIN past USING (hash))"""


def diff_shape(t: Tables) -> DataFrame:
    """hash, n, lines, d (shape of the diff, 0 to 1), a (sources without tests)."""
    size, path = F.col("ins") + F.col("del"), F.col("path")
    s = commit_files(t).repartition(tasks_of(t.lineitem), "hash").groupBy("hash").agg(count().alias("n"), F.sum(size).alias("lines"), (F.max(size) / F.sum(size)).alias("share"), F.count_if(path.contains("/tests/")).alias("tests"), F.count_if(path.contains("/src/")).alias("sources"))
    one = F.lit(1.0)
    return s.select("hash", "n", "lines", ((F.least(F.col("n") / 20, one) + F.least(F.col("lines") / 600, one) + F.col("share")) / 3).alias("d"), F.when((F.col("sources") > 0) & (F.col("tests") == 0), 1.0).otherwise(0.0).alias("a"))


@query(with_views("commit_files") + _SHAPE + " SELECT hash, n, lines, round(d, 6) AS shape, a::DOUBLE AS asymmetry FROM sub")
def d13_diff_shape(t: Tables) -> DataFrame:
    """Shape of a diff from files, lines and the largest share, and whether tests are missing (also d14)."""
    return diff_shape(t).select("hash", "n", "lines", F.round("d", 6).alias("shape"), F.col("a").alias("asymmetry"))


def change_risk(t: Tables) -> DataFrame:
    """hash, d, a, b, c, score: change risk of each commit from its diff and the history before it."""
    past = history_counts(t)
    one = F.lit(1.0)
    joined = diff_shape(t).join(past, "hash").select("hash", "d", "a", F.least(F.col("fixes_180d") / 6, one).alias("b"), F.least(F.col("touches_90d") / 20, one).alias("c"))
    return joined.withColumn("score", F.round(30 * F.col("d") + 25 * F.col("a") + 25 * F.col("b") + 20 * F.col("c") + 1e-9, 4))  # the same digits however the terms are summed


@query(with_views("commits", "commit_files") + _SHAPE + _PAST + " SELECT hash, round(b, 6) AS bug_magnet, round(c, 6) AS churn, score FROM scored")
def d17_risk_combine(t: Tables) -> DataFrame:
    """Change risk 30 shape + 25 asymmetry + 25 bug magnet + 20 churn (also d15, d16)."""
    return change_risk(t).select("hash", F.round("b", 6).alias("bug_magnet"), F.round("c", 6).alias("churn"), "score")


_OBSERVED = """, d AS (SELECT DISTINCT l.hash, module || '/' || lower(p_type) AS file FROM (SELECT l_orderkey AS hash, l_partkey AS partkey FROM lineitem) l JOIN files USING (partkey)),
  walked AS (SELECT hash, count(*) AS width FROM d GROUP BY 1), e AS (SELECT d.* FROM d JOIN walked USING (hash) WHERE width <= 50),
  pairs AS (SELECT a.file AS l, b.file AS r, count(*) AS co_commits FROM e a JOIN e b ON a.hash = b.hash AND a.file < b.file GROUP BY 1, 2)"""


@query(with_views("files") + _OBSERVED + """ SELECT (SELECT count(*) FROM walked) AS commits_walked, (SELECT count(*) FROM walked WHERE width > 50) AS wide_skipped, (SELECT count(*) FROM pairs) AS pairs_observed, (SELECT count(*) FROM pairs WHERE co_commits >= 3) AS edges_kept, (SELECT CAST(sum(co_commits) AS BIGINT) FROM pairs WHERE co_commits >= 3) AS observations""")
def d18_cochange_observations(t: Tables) -> DataFrame:
    """What the co-change relation of all commits rests on: commits walked, wide ones left out, pairs seen, edges kept and their observations; an edge's newest commits are in c15."""
    from stratalens.operators.joins import WIDE, co_changed, typed_files

    touched = settled(typed_files(t))
    sizes = touched.groupBy("hash").agg(count().alias("n")).agg(count().alias("commits_walked"), F.count_if(F.col("n") > WIDE).alias("wide_skipped"))
    kept = F.col("co_commits") >= 3
    pairs = co_changed(touched, 1).agg(count().alias("pairs_observed"), F.count_if(kept).alias("edges_kept"), F.sum(F.when(kept, F.col("co_commits"))).alias("observations"))
    return sizes.crossJoin(pairs)  # of single rows


# Measures of a benchmark run, of quality and of cost, and the status that each run ends with.
QUALITY_MEASURES = ("recall", "precision", "reciprocal_rank", "diagnosis_recall", "diagnosis_exact", "attested", "unsupported_rate")
COST_MEASURES = ("wall_ms", "input_tokens", "output_tokens", "tool_calls", "artifact_bytes")
STATUSES = ("completed", "domain_unknown", "unavailable", "process_failed")
_SCORED = """WITH s AS (SELECT n_name AS case_id, 'C' || CAST(l_orderkey % 3 AS VARCHAR) AS condition, CAST(year(o_orderdate) AS BIGINT) AS repetition, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS d, CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS x, CAST(sum(l_linenumber) AS BIGINT) AS c
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2, 3),
  scored AS (SELECT case_id, condition, repetition, CASE WHEN n % 10 < 7 THEN 'completed' WHEN n % 10 = 7 THEN 'domain_unknown' WHEN n % 10 = 8 THEN 'unavailable' ELSE 'process_failed' END AS status, n % 10 < 8 AS observed,
    d / (10.0::DOUBLE * n) AS recall, x / (8.0::DOUBLE * n) AS precision, 1 / (1.0::DOUBLE + n % 7) AS reciprocal_rank, q / (50.0::DOUBLE * n) AS diagnosis_recall, CASE WHEN q % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS diagnosis_exact, CASE WHEN d % 4 > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS attested, (x % 11) / 10.0::DOUBLE AS unsupported_rate,
    q::DOUBLE AS wall_ms, (100 * n)::DOUBLE AS input_tokens, (7 * n + d)::DOUBLE AS output_tokens, c::DOUBLE AS tool_calls, (1000 * x)::DOUBLE AS artifact_bytes FROM s)"""


def scored_runs(t: Tables) -> DataFrame:
    """case_id, condition, repetition, status, observed (whether quality was), and every measure of a run."""
    place = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("case_id"))
    made = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.year("o_orderdate").cast("long").alias("repetition")).join(place, "o_custkey")
    whole = lambda c, by=1: F.sum(F.round(F.col(c) * by).cast("long"))
    s = t.lineitem.join(made, "l_orderkey").groupBy("case_id", F.concat(F.lit("C"), (F.col("l_orderkey") % 3).cast("string")).alias("condition"), "repetition")
    s = s.agg(count().alias("n"), whole("l_quantity").alias("q"), whole("l_discount", 100).alias("d"), whole("l_tax", 100).alias("x"), F.sum("l_linenumber").alias("c"))
    n, q, d, x, last = F.col("n"), F.col("q"), F.col("d"), F.col("x"), F.col("n") % 10
    values = (d / (10.0 * n), x / (8.0 * n), 1 / (1.0 + n % 7), q / (50.0 * n), F.when(q % 3 == 0, 1.0).otherwise(0.0), F.when(d % 4 > 0, 1.0).otherwise(0.0), (x % 11) / 10.0, q, 100 * n, 7 * n + d, F.col("c"), 1000 * x)
    status = F.when(last < 7, "completed").when(last == 7, "domain_unknown").when(last == 8, "unavailable").otherwise("process_failed")
    return s.select("case_id", "condition", "repetition", status.alias("status"), (last < 8).alias("observed"), *(v.cast("double").alias(name) for v, name in zip(values, (*QUALITY_MEASURES, *COST_MEASURES), strict=True)))


@query(_SCORED + " SELECT condition, count(*) AS attempted, " + ", ".join(f"count(*) FILTER (WHERE status = '{c}') AS {c}" for c in STATUSES) + ", round(count(*) FILTER (WHERE observed) / count(*), 6) AS availability_rate, "
  + ", ".join(f"round(count(*) FILTER (WHERE status = '{c}') / count(*), 6) AS {c}_rate" for c in STATUSES[1:]) + ", " + ", ".join(f"round(avg({c}) FILTER (WHERE observed), 6) AS {c}" for c in QUALITY_MEASURES) + ", " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in COST_MEASURES) + " FROM scored GROUP BY 1")
def d19_benchmark_conditions(t: Tables) -> DataFrame:
    """Counts by status, rates, seven means of quality over runs in which it was observed, and five of cost over all, per condition."""
    n = {c: F.count_if(F.col("status") == c) for c in STATUSES}
    rate = lambda x: F.round(x / count(), 6)
    return scored_runs(t).groupBy("condition").agg(
        count().alias("attempted"), *(x.alias(c) for c, x in n.items()), rate(F.count_if("observed")).alias("availability_rate"), *(rate(n[c]).alias(f"{c}_rate") for c in STATUSES[1:]),
        *(F.round(F.avg(F.when(F.col("observed"), F.col(c))), 6).alias(c) for c in QUALITY_MEASURES), *(F.round(F.avg(c), 6).alias(c) for c in COST_MEASURES),
    )


_DELTAS = (*QUALITY_MEASURES, *COST_MEASURES[:4])


@query(_SCORED + " SELECT c.condition, count(b.case_id) AS pairs, " + ", ".join(f"round(avg(c.{x} - b.{x}), 6) AS {x}_delta" for x in _DELTAS) + " FROM scored c LEFT JOIN scored b ON b.case_id = c.case_id AND b.repetition = c.repetition AND b.condition = 'C0' AND b.observed AND c.observed WHERE c.condition <> 'C0' GROUP BY 1")
def d20_paired_deltas(t: Tables) -> DataFrame:
    """Means of the eleven differences to the control of the same case and repetition, over pairs in which quality was observed on both sides; null without any."""
    runs = settled(scored_runs(t))
    seen = runs.filter("observed")
    control = seen.filter("condition = 'C0'").select("case_id", "repetition", *(F.col(x).alias(f"{x}_0") for x in _DELTAS))
    means = seen.filter("condition <> 'C0'").join(control, ["case_id", "repetition"]).groupBy("condition").agg(count().alias("pairs"), *(F.round(F.avg(F.col(x) - F.col(f"{x}_0")), 6).alias(f"{x}_delta") for x in _DELTAS))
    return runs.filter("condition <> 'C0'").select("condition").distinct().join(means, "condition", "left").fillna(0, ["pairs"])


@query("WITH z AS (SELECT 1)" + _RUNS + """ SELECT case_id, count(*) FILTER (WHERE k = 3) AS valid_pairs, CASE WHEN count(*) FILTER (WHERE k = 3) >= 5 THEN 'decided' ELSE 'insufficient' END AS verdict
  FROM (SELECT case_id, repetition, count(DISTINCT condition) AS k FROM runs WHERE cost > 10 GROUP BY 1, 2) GROUP BY 1""")
def d21_valid_pairs(t: Tables) -> DataFrame:
    """Repetitions in which all three conditions were observed, and the verdict they allow (also j25)."""
    full = benchmark_runs(t).filter("cost > 10").groupBy("case_id", "repetition").agg(F.count_distinct("condition").alias("k"))
    valid = F.count_if(F.col("k") == 3)
    return full.groupBy("case_id").agg(valid.alias("valid_pairs"), F.when(valid >= 5, "decided").otherwise("insufficient").alias("verdict"))


@query("""WITH q AS (SELECT o_custkey AS q, l_partkey AS item, sum(l_quantity) AS w FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
  r AS (SELECT q, item, row_number() OVER (PARTITION BY q ORDER BY w DESC, item) AS k, p_size > 25 AS root, p_size % 3 = 0 AS relevant FROM q JOIN part ON p_partkey = item)
  SELECT q, round(count(*) FILTER (WHERE root AND k <= 10) / nullif(count(*) FILTER (WHERE root), 0), 6) AS recall, round(count(*) FILTER (WHERE relevant AND k <= 10) / count(*) FILTER (WHERE k <= 10), 6) AS precision, round(coalesce(1 / min(k) FILTER (WHERE root), 0), 6) AS rr FROM r GROUP BY 1""")
def d22_retrieval_metrics(t: Tables) -> DataFrame:
    """Recall and precision at 10 and reciprocal rank per query."""
    sold = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("q")).join(t.lineitem.select("l_orderkey", "l_partkey", "l_quantity"), "l_orderkey")
    w = sold.groupBy("q", F.col("l_partkey").alias("item")).agg(F.sum("l_quantity").alias("w"))
    ranked = w.join(t.part.select(F.col("p_partkey").alias("item"), "p_size"), "item").withColumn("k", F.row_number().over(W.partitionBy("q").orderBy(F.desc("w"), "item")))
    root, top = F.col("p_size") > 25, F.col("k") <= 10
    roots = F.count_if(root)
    return ranked.groupBy("q").agg(
        F.round(F.count_if(root & top) / F.when(roots > 0, roots), 6).alias("recall"), F.round(F.count_if((F.col("p_size") % 3 == 0) & top) / F.count_if(top), 6).alias("precision"), F.round(F.coalesce(1 / F.min(F.when(root, F.col("k"))), F.lit(0.0)), 6).alias("rr")
    )


@query("""SELECT lang, count(*) FILTER (WHERE said AND quality = 1) AS tp, count(*) FILTER (WHERE said AND quality = 0) AS fp, count(*) FILTER (WHERE NOT said AND quality = 1) AS fn, count(*) FILTER (WHERE NOT said AND quality = 0) AS tn,
  round(count(*) FILTER (WHERE said AND quality = 1) / nullif(count(*) FILTER (WHERE said), 0), 6) AS precision, round(count(*) FILTER (WHERE said AND quality = 1) / nullif(count(*) FILTER (WHERE quality = 1), 0), 6) AS recall
  FROM (SELECT lang, quality, n_chars > 500 AS said FROM documents JOIN labels USING (doc_id)) GROUP BY 1""")
def d23_confusion(t: Tables) -> DataFrame:
    """Confusion matrix, precision and recall of a predicate against labels."""
    x = t.documents.join(t.labels, "doc_id").select("lang", (F.col("n_chars") > 500).alias("said"), (F.col("quality") == 1).alias("is"))
    tp, said, real = F.count_if(F.col("said") & F.col("is")), F.count_if("said"), F.count_if("is")
    return x.groupBy("lang").agg(
        tp.alias("tp"), F.count_if(F.col("said") & ~F.col("is")).alias("fp"), F.count_if(~F.col("said") & F.col("is")).alias("fn"), F.count_if(~F.col("said") & ~F.col("is")).alias("tn"),
        F.round(tp / F.when(said > 0, said), 6).alias("precision"), F.round(tp / F.when(real > 0, real), 6).alias("recall"),
    )


@query("""WITH a AS (SELECT o_orderpriority AS category, o_custkey AS q, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS arm, sum(o_totalprice) AS bytes, bool_or(o_orderstatus = 'F') AS covered FROM orders GROUP BY ALL),
  g AS (SELECT a.*, c_acctbal < 0 AS broken, CASE WHEN covered THEN bytes END AS cost FROM a JOIN customer ON c_custkey = q), w AS (SELECT *, min(cost) OVER (PARTITION BY category, q) AS least, count(*) FILTER (WHERE covered) OVER (PARTITION BY category, q) AS n_covered FROM g)
  SELECT category, arm, count(*) FILTER (WHERE NOT broken) AS graded, count(*) FILTER (WHERE broken) AS broken, round(avg(CASE WHEN covered THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT broken), 4) AS coverage, round(sum(bytes) FILTER (WHERE NOT broken), 2) AS total_bytes, round(avg(bytes) FILTER (WHERE covered AND NOT broken), 2) AS mean_covered,
    count(*) FILTER (WHERE NOT broken AND covered AND cost = least) AS wins, count(*) FILTER (WHERE NOT broken AND n_covered > 0 AND (NOT covered OR cost > least)) AS losses, count(*) FILTER (WHERE NOT broken AND n_covered = 0) AS uncovered FROM w GROUP BY 1, 2""")
def d24_retrieval_arms(t: Tables) -> DataFrame:
    """Coverage and bytes per category and arm, broken questions left out; means over covered ones; an arm wins that covers with the fewest bytes."""
    arm = F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("b")
    a = t.orders.groupBy(F.col("o_orderpriority").alias("category"), F.col("o_custkey").alias("q"), arm.alias("arm")).agg(F.sum("o_totalprice").alias("bytes"), F.bool_or(F.col("o_orderstatus") == "F").alias("covered"))
    g = a.join(t.customer.select(F.col("c_custkey").alias("q"), (F.col("c_acctbal") < 0).alias("broken")), "q").withColumn("cost", F.when(F.col("covered"), F.col("bytes")))
    least = F.min("cost").over(W.partitionBy("category", "q"))  # two rows at most
    w, ok, covered = g.withColumn("least", least), ~F.col("broken"), F.col("covered")
    best = covered & (F.col("cost") == F.col("least"))
    return w.groupBy("category", "arm").agg(
        F.count_if(ok).alias("graded"), F.count_if("broken").alias("broken"), F.round(F.avg(F.when(ok, F.when(covered, 1.0).otherwise(0.0))), 4).alias("coverage"), F.round(F.sum(F.when(ok, F.col("bytes"))), 2).alias("total_bytes"), F.round(F.avg(F.when(ok & covered, F.col("bytes"))), 2).alias("mean_covered"),
        F.count_if(ok & best).alias("wins"), F.count_if(ok & F.col("least").isNotNull() & ~best).alias("losses"), F.count_if(ok & F.col("least").isNull()).alias("uncovered"),
    )


@query("""WITH q AS (SELECT CASE WHEN c_acctbal >= 5000 THEN CASE WHEN c_nationkey >= 12 THEN 'Known Core' ELSE 'Critical Unknown' END ELSE CASE WHEN c_nationkey >= 12 THEN 'Supporting Context' ELSE 'Deferred Unknown' END END AS quadrant FROM customer),
  l(quadrant) AS (VALUES ('Known Core'), ('Critical Unknown'), ('Supporting Context'), ('Deferred Unknown')) SELECT l.quadrant, count(q.quadrant) AS n FROM l LEFT JOIN q ON q.quadrant = l.quadrant GROUP BY 1""")
def d25_quadrant_counts(t: Tables) -> DataFrame:
    """Count per fixed label; labels without rows stay with zero."""
    critical, sure = F.col("c_acctbal") >= 5000, F.col("c_nationkey") >= 12
    label = F.when(critical & sure, "Known Core").when(critical, "Critical Unknown").when(sure, "Supporting Context").otherwise("Deferred Unknown")
    found = t.customer.groupBy(label.alias("quadrant")).agg(count().alias("n"))
    labels = t.spark.createDataFrame([("Known Core",), ("Critical Unknown",), ("Supporting Context",), ("Deferred Unknown",)], "quadrant string")
    return labels.join(found, "quadrant", "left").select("quadrant", F.coalesce("n", F.lit(0)).alias("n"))


_SESSION = with_views("session_events") + """, v AS (SELECT *, max(seq) FILTER (WHERE action = 'verify') OVER (PARTITION BY session) AS last_verify FROM session_events)"""


@query(_SESSION + """, p AS (SELECT v.*, p_size, target IS NOT NULL AND target % 17 = 0 AS outside, action = 'edit' AND (last_verify IS NULL OR seq > last_verify) AS late FROM v LEFT JOIN part ON p_partkey = target AND p_size > 25 AND target % 17 <> 0)
  SELECT session, count(*) AS events, count(target) AS target_events, count(DISTINCT target) AS targets, count(p_size) AS matched, count(*) FILTER (WHERE target IS NOT NULL AND p_size IS NULL AND NOT outside) AS unmatched, count(*) FILTER (WHERE outside) AS unsafe, count(*) FILTER (WHERE p_size > 45) AS attention,
  count(*) FILTER (WHERE action = 'edit') AS edits, count(*) FILTER (WHERE action = 'verify') AS verifies, count(*) FILTER (WHERE is_error) AS errors, count(*) FILTER (WHERE late) AS unverified_edits,
  CASE WHEN count(*) FILTER (WHERE late) > 0 THEN 1 ELSE 0 END + CASE WHEN count(*) FILTER (WHERE is_error) >= 3 THEN 1 ELSE 0 END + CASE WHEN count(*) FILTER (WHERE p_size > 45 AND action = 'edit') > 0 THEN 1 ELSE 0 END AS signals FROM p GROUP BY 1""")
def d26_session_summary(t: Tables) -> DataFrame:
    """Eleven counters of a session: events, targets, those that are hotspots, are none or lie outside, touches of structural attention, edits, verifications, errors and signals; and its edits after the last verification."""
    e = session_events(t).withColumn("last", F.max(F.when(F.col("action") == "verify", F.col("seq"))).over(W.partitionBy("session")))
    hot = t.part.filter("p_size > 25 and p_partkey % 17 <> 0").select(F.col("p_partkey").alias("target"), "p_size")
    edit, outside, size = F.col("action") == "edit", F.coalesce(F.col("target") % 17 == 0, F.lit(False)), F.col("p_size")
    late, errors = F.count_if(edit & (F.col("last").isNull() | (F.col("seq") > F.col("last")))), F.count_if("is_error")
    one = lambda keep: F.when(keep, 1).otherwise(0)
    return e.join(hot, "target", "left").groupBy("session").agg(
        count().alias("events"), F.count("target").alias("target_events"), F.count_distinct("target").alias("targets"), F.count(size).alias("matched"), F.count_if(F.col("target").isNotNull() & size.isNull() & ~outside).alias("unmatched"), F.count_if(outside).alias("unsafe"), F.count_if(size > 45).alias("attention"),
        F.count_if(edit).alias("edits"), F.count_if(F.col("action") == "verify").alias("verifies"), errors.alias("errors"), late.alias("unverified_edits"), (one(late > 0) + one(errors >= 3) + one(F.count_if((size > 45) & edit) > 0)).alias("signals"),
    )


_TIMING = with_views("session_events") + """, s AS (SELECT session, event_id, action, target, at_ms AS a, least(coalesce(lead(at_ms) OVER (PARTITION BY session ORDER BY seq), at_ms), at_ms + 3600000) AS b FROM session_events)"""


def timing(t: Tables) -> DataFrame:
    """session, event_id, action, target, a, b: events as intervals that end at the next one, an hour at most."""
    following = F.lead("at_ms").over(W.partitionBy("session").orderBy("seq"))
    return session_events(t).select("session", "event_id", "action", "target", F.col("at_ms").alias("a"), F.least(F.coalesce(following, F.col("at_ms")), F.col("at_ms") + 3_600_000).alias("b"))


# Categories of a delivery's time; those from the fourth on could be saved.
TIMES = ("work", "discovery", "verification", "queue", "handoff", "repeat", "rework", "unnecessary")


@query(_TIMING + """, c AS (SELECT session, a, b, CASE WHEN action = 'other' THEN 'rework' WHEN b - a >= 3600000 THEN 'queue' WHEN action = 'exec' THEN 'handoff' WHEN action = 'read' AND row_number() OVER (PARTITION BY session, action, target ORDER BY a, event_id) > 1 THEN 'repeat' WHEN action = 'read' THEN 'discovery'
    WHEN action = 'verify' THEN 'verification' WHEN target % 10 = 0 THEN 'unnecessary' ELSE 'work' END AS category FROM s) SELECT session, max(b) - min(a) AS lead_ms, CAST(sum(b - a) AS BIGINT) AS touch_ms, """ + ", ".join(f"CAST(coalesce(sum(b - a) FILTER (WHERE category = '{c}'), 0) AS BIGINT) AS {c}_ms" for c in TIMES)
  + ", CAST(coalesce(sum(b - a) FILTER (WHERE category IN ('queue', 'handoff', 'repeat', 'rework', 'unnecessary')), 0) AS BIGINT) AS avoidable_ms FROM c GROUP BY 1")
def d27_delivery_times(t: Tables) -> DataFrame:
    """Lead and touch time per delivery, its time by eight categories, and what could be saved."""
    span, action = F.col("b") - F.col("a"), F.col("action")
    nth = F.row_number().over(W.partitionBy("session", "action", "target").orderBy("a", "event_id"))
    e = timing(t).withColumn("nth", nth)
    category = F.when(action == "other", "rework").when(span >= 3_600_000, "queue").when(action == "exec", "handoff").when((action == "read") & (F.col("nth") > 1), "repeat").when(action == "read", "discovery").when(action == "verify", "verification").when(F.col("target") % 10 == 0, "unnecessary").otherwise("work")
    e = e.withColumn("category", category)
    part = lambda keep: F.coalesce(F.sum(F.when(keep, span)), F.lit(0))
    return e.groupBy("session").agg((F.max("b") - F.min("a")).alias("lead_ms"), F.sum(span).alias("touch_ms"), *(part(F.col("category") == c).alias(f"{c}_ms") for c in TIMES), part(F.col("category").isin(*TIMES[3:])).alias("avoidable_ms"))


_MEASURES = ("lead_ms", "touch_ms", *(f"{c}_ms" for c in TIMES), "avoidable_ms")


@query(f"WITH d AS ({REGISTERED['d27_delivery_times'][1]}) SELECT c.session, " + ", ".join(f"c.{m} - b.{m} AS {m}_delta" for m in _MEASURES) + " FROM d c JOIN d b ON b.session = c.session - 1")
def d28_delivery_delta(t: Tables) -> DataFrame:
    """The eleven measures of a delivery less those of its baseline, the one before it."""
    d = settled(d27_delivery_times(t))
    base = d.select((F.col("session") + 1).alias("session"), *(F.col(m).alias(f"{m}_0") for m in _MEASURES))
    return d.join(base, "session").select("session", *((F.col(m) - F.col(f"{m}_0")).alias(f"{m}_delta") for m in _MEASURES))


@query("SELECT o_orderpriority AS kind, quantile_disc(o_totalprice, 0.5) AS p50, quantile_disc(o_totalprice, 0.95) AS p95, round(median(o_totalprice), 6) AS middle FROM orders GROUP BY 1")
def d29_percentiles(t: Tables) -> DataFrame:
    """Nearest-rank percentiles and the median, by selection (also d31)."""
    found = order_statistics(t.orders.select(F.col("o_orderpriority").alias("kind"), "o_totalprice"), ["kind"], "o_totalprice", {"p50": nth(50), "p95": nth(95), **MIDDLE})
    return found.select("kind", "p50", "p95", F.round((F.col("low") + F.col("high")) / 2, 6).alias("middle"))


@query("""WITH y AS (SELECT c_custkey, coalesce(sum(o_totalprice) FILTER (WHERE year(o_orderdate) = 1996), 0) AS base, coalesce(sum(o_totalprice) FILTER (WHERE year(o_orderdate) = 1997), 0) AS now FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
  SELECT c_custkey, CASE WHEN base = 0 THEN NULL ELSE round((now - base) / abs(base) * 100, 4) END AS improvement FROM y""")
def d32_improvement(t: Tables) -> DataFrame:
    """Improvement in percent over a base; unknown where the base is zero."""
    part = lambda y: F.coalesce(F.sum(F.when(F.year("o_orderdate") == y, F.col("o_totalprice"))), F.lit(0.0))
    y = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(part(1996).alias("base"), part(1997).alias("now"))
    return y.select("c_custkey", F.when(F.col("base") != 0, F.round((F.col("now") - F.col("base")) / F.abs("base") * 100, 4)).alias("improvement"))


@query("""WITH u AS (SELECT n_name AS unit, count(*) AS inventory, count(*) FILTER (WHERE c_acctbal >= 0) AS scanned, count(*) FILTER (WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) AS resolved, count(*) FILTER (WHERE c_mktsegment = 'FURNITURE') AS unresolved, count(*) FILTER (WHERE c_acctbal < -900) AS excluded, min(n_nationkey) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
  r AS (SELECT *, CASE WHEN resolved + unresolved > 0 THEN round_even(resolved * 100.0::DOUBLE / (resolved + unresolved), 1) END AS ratio, CASE WHEN k % 7 = 0 THEN 'unknown' WHEN excluded > 0 THEN 'quarantined' ELSE 'clean' END AS pollution_status FROM u)
  SELECT unit, CASE WHEN k % 3 = 0 THEN 100 ELSE 0 END AS step, ratio, CASE WHEN ratio IS NULL THEN 0 WHEN ratio >= 75 THEN 100 WHEN ratio >= 50 THEN 75 WHEN ratio >= 25 THEN 50 ELSE 30 END AS import_resolution, CASE WHEN scanned <= 0 OR inventory <= 0 THEN 0 ELSE CAST(round_even(least(scanned * 100.0::DOUBLE / inventory, 100), 0) AS BIGINT) END AS coverage,
  pollution_status, CASE pollution_status WHEN 'unknown' THEN 0 WHEN 'quarantined' THEN 100 ELSE 80 END AS pollution, CASE WHEN k % 4 > 0 THEN 100 ELSE 45 END AS rules FROM r""")
def d35_banded_scores(t: Tables) -> DataFrame:
    """The banded scores of a unit: a step that passed or not, import resolution, coverage of the inventory, pollution and whether there are rules."""
    seg, has = F.col("c_mktsegment"), F.count_if
    u = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("unit")).agg(
        count().alias("inventory"), has(F.col("c_acctbal") >= 0).alias("scanned"), has(seg.isin("BUILDING", "MACHINERY")).alias("resolved"), has(seg == "FURNITURE").alias("unresolved"), has(F.col("c_acctbal") < -900).alias("excluded"), F.min("n_nationkey").alias("k")
    )
    total, ratio, k = F.col("resolved") + F.col("unresolved"), F.col("ratio"), F.col("k")
    u = u.withColumn("ratio", F.when(total > 0, F.bround(F.col("resolved") * 100.0 / F.when(total > 0, total), 1)))
    status = F.when(k % 7 == 0, "unknown").when(F.col("excluded") > 0, "quarantined").otherwise("clean")
    coverage = F.when((F.col("scanned") <= 0) | (F.col("inventory") <= 0), F.lit(0).cast("long")).otherwise(F.bround(F.least(F.col("scanned") * 100.0 / F.col("inventory"), F.lit(100.0)), 0).cast("long"))
    return u.select(
        "unit", F.when(k % 3 == 0, 100).otherwise(0).alias("step"), "ratio", F.when(ratio.isNull(), 0).when(ratio >= 75, 100).when(ratio >= 50, 75).when(ratio >= 25, 50).otherwise(30).alias("import_resolution"), coverage.alias("coverage"),
        status.alias("pollution_status"), F.when(status == "unknown", 0).when(status == "quarantined", 100).otherwise(80).alias("pollution"), F.when(k % 4 > 0, 100).otherwise(45).alias("rules"),
    )


_PARTS = (("rules", "c_acctbal >= 0"), ("gate", "c_mktsegment = 'BUILDING'"), ("checked", "c_custkey % 3 = 0"), ("ct", "c_acctbal > 5000"), ("mri", "c_mktsegment IN ('BUILDING', 'MACHINERY')"), ("graph", "c_custkey % 2 = 0"), ("memory", "c_acctbal < 9000"), ("resolution", "c_custkey % 5 < 4"), ("pollution", "c_acctbal < 2000"))


@query("WITH c AS (SELECT n_name AS unit, " + ", ".join(f"CAST(round_even(100.0::DOUBLE * count(*) FILTER (WHERE {r}) / count(*), 0) AS BIGINT) AS {c}" for c, r in _PARTS) + """ FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), s AS (SELECT *, CAST(round_even((rules + gate + checked) / 3.0::DOUBLE, 0) AS BIGINT) AS governance, CAST(round_even((ct + mri + graph + memory) / 4.0::DOUBLE, 0) AS BIGINT) AS diagnostic FROM c)
  SELECT unit, governance, diagnostic, resolution, pollution, CAST(round_even((diagnostic + governance + resolution + pollution) / 4.0::DOUBLE, 0) AS BIGINT) AS overall, CASE WHEN diagnostic >= 75 THEN 100 WHEN diagnostic >= 50 THEN 75 WHEN diagnostic >= 25 THEN 50 ELSE 30 END AS band FROM s""")
def d34_composite_scores(t: Tables) -> DataFrame:
    """Governance of three parts, diagnostic of four, overall of these with resolution and pollution, halves to even; and a banded score."""
    even = lambda x: F.bround(x, 0).cast("long")
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("unit")).agg(*(even(100 * F.count_if(F.expr(r)) / count()).alias(name) for name, r in _PARTS))
    mean = lambda *cs: even(reduce(Column.__add__, map(F.col, cs)) / len(cs))
    s = c.withColumns({"governance": mean("rules", "gate", "checked"), "diagnostic": mean("ct", "mri", "graph", "memory")})
    d = F.col("diagnostic")
    return s.select("unit", "governance", "diagnostic", "resolution", "pollution", mean("diagnostic", "governance", "resolution", "pollution").alias("overall"), F.when(d >= 75, 100).when(d >= 50, 75).when(d >= 25, 50).otherwise(30).alias("band"))


@query("""WITH o AS (SELECT o_custkey AS run, min(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' THEN 1 WHEN o_orderstatus = 'O' THEN 2 WHEN o_orderstatus = 'P' THEN 3 ELSE 5 END) AS p FROM orders GROUP BY 1)
  SELECT run, CASE p WHEN 1 THEN 'timeout' WHEN 2 THEN 'process_failed' WHEN 3 THEN 'domain_failed' ELSE 'completed' END AS outcome FROM o""")
def d37_outcome_reduction(t: Tables) -> DataFrame:
    """Outcome of a run: the one of highest precedence among its steps."""
    s = F.col("o_orderstatus")
    p = F.when((F.col("o_orderpriority") == "1-URGENT") & (s == "O"), 1).when(s == "O", 2).when(s == "P", 3).otherwise(5)
    worst = t.orders.groupBy(F.col("o_custkey").alias("run")).agg(F.min(p).alias("p"))
    return worst.select("run", F.when(F.col("p") == 1, "timeout").when(F.col("p") == 2, "process_failed").when(F.col("p") == 3, "domain_failed").otherwise("completed").alias("outcome"))


@query("""SELECT c_mktsegment AS category, count(*) FILTER (WHERE c_acctbal < 0) AS blocking, count(*) AS n, round(avg(c_acctbal) FILTER (WHERE c_acctbal >= 0), 1) AS mean_score FROM customer GROUP BY 1""")
def d42_register_summary(t: Tables) -> DataFrame:
    """Entries and blocking ones per category, mean of the scored (also d33)."""
    b = F.col("c_acctbal")
    return t.customer.groupBy(F.col("c_mktsegment").alias("category")).agg(F.count_if(b < 0).alias("blocking"), count().alias("n"), F.round(F.avg(F.when(b >= 0, b)), 1).alias("mean_score"))


@query(with_views("commits", "commit_files") + """, a AS (SELECT path, author, count(*) AS touches FROM commits JOIN commit_files USING (hash) GROUP BY 1, 2), l AS (SELECT path, arg_max(author, (ts, hash)) AS last_author FROM commits JOIN commit_files USING (hash) GROUP BY 1)
  SELECT a.path, count(*) AS authors, any_value(last_author) AS last_author, round_even(max(touches) / sum(touches), 4) AS top_share, CAST(least(100, greatest(0, round_even(55 / count(*) + 45 * max(touches) / sum(touches), 0))) AS BIGINT) AS risk FROM a JOIN l USING (path) GROUP BY 1""")
def l02_bus_factor(t: Tables) -> DataFrame:
    """Authors, last author, top share and risk of knowledge in few heads per file (also l01)."""
    log = commits(t).join(commit_files(t), "hash")
    last = log.groupBy("path").agg(F.max_by("author", F.struct("ts", "hash")).alias("last_author"))
    shares = log.groupBy("path", "author").agg(count().alias("touches")).groupBy("path").agg(count().alias("authors"), (F.max("touches") / F.sum("touches")).alias("share"))
    risk = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.bround(55 / F.col("authors") + 45 * F.col("share"), 0)))
    return shares.join(last, "path").select("path", "authors", "last_author", F.bround("share", 4).alias("top_share"), risk.cast("long").alias("risk"))


@query("""SELECT p_brand AS competitor, round(avg(p_retailprice), 1) AS score FROM part GROUP BY 1""")
def l12_mean_axis_score(t: Tables) -> DataFrame:
    """Mean of axis scores to one decimal."""
    return t.part.groupBy(F.col("p_brand").alias("competitor")).agg(F.round(F.avg("p_retailprice"), 1).alias("score"))
