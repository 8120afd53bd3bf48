"""Path predicates, resolvers and small summaries over the file relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.operators.aggregates import _PAST, _QUALITY, _RISK, _SHAPE, change_risk, count, module_edges, module_metrics, module_risk, modules, touched_paths
from stratalens.operators.reach import settled
from stratalens.operators.selection import MIDDLE, nth, order_statistics
from stratalens.plans.registry import Tables, query
from stratalens.shared import tasks_of
from stratalens.sources.bindings import commit_files, commits, files, imports, with_views

# Segment names of generated paths.
GENERATED = ("generated", "gen", "dist", "build", "out", "target", "vendor", "node_modules", "coverage", "bin", "obj", "tests")


def folders(path):  # noqa: ANN001, ANN201
    """Segments of a path but its leaf."""
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


_PAGES = "WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages)"


def page_paths(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("path"))


@query(_PAGES + """, d AS (SELECT page_id, list_filter(string_split(lower(path), '/')[1:len(string_split(path, '/')) - 1], lambda x: starts_with(x, '.') OR starts_with(x, 'venv-') OR starts_with(x, 'env-') OR x IN ('static', 'public', 'de', 'es')) AS hit, path FROM p)
  SELECT page_id, len(hit) > 0 OR ends_with(path, '.min.js') AS skipped FROM d""")
def b02_default_path(t: Tables) -> DataFrame:
    """Paths left out by default: a listed, hidden or environment directory, or a minified leaf."""
    named = lambda x: x.startswith(".") | x.startswith("venv-") | x.startswith("env-") | x.isin("static", "public", "de", "es")
    return page_paths(t).select("page_id", (F.exists(folders(F.lower("path")), named) | F.col("path").endswith(".min.js")).alias("skipped"))


@query(with_views("files") + " SELECT path, path = 'crates/brand_1' OR starts_with(path, 'crates/brand_1/') AS inside FROM files")
def b03_prefix_pattern(t: Tables) -> DataFrame:
    """Whether a path is the pattern or lies under it, slashes trimmed."""
    pattern = "/crates/brand_1/".strip("/")
    return files(t).select("path", ((F.col("path") == pattern) | F.col("path").startswith(f"{pattern}/")).alias("inside"))


@query("SELECT doc_id, regexp_matches(leaf, '^(index|main|app|server|cli)[.]') AS entry, regexp_matches('/' || dir || '/', '/(examples?|fixtures?|demos?|benchmarks?)/') AS support FROM (SELECT doc_id, CASE lang WHEN 'en' THEN 'main.py' WHEN 'de' THEN 'index.js' ELSE 'util.py' END AS leaf, CASE WHEN n_chars % 3 = 0 THEN source || '/fixtures' ELSE source END AS dir FROM documents)")
def b06_entry_and_support(t: Tables) -> DataFrame:
    """Entry points by leaf, and support files by directory (also b07)."""
    leaf = F.when(F.col("lang") == "en", "main.py").when(F.col("lang") == "de", "index.js").otherwise("util.py")
    folder = F.when(F.col("n_chars") % 3 == 0, F.concat("source", F.lit("/fixtures"))).otherwise(F.col("source"))
    x = t.documents.select("doc_id", F.concat(folder, F.lit("/"), leaf).alias("path"))
    support = F.arrays_overlap(folders(F.col("path")), F.array(*(F.lit(w + s) for w in ("example", "fixture", "demo", "benchmark") for s in ("", "s"))))
    return x.select("doc_id", F.element_at(F.split("path", "/"), -1).rlike(r"^(index|main|app|server|cli)\.").alias("entry"), support.alias("support"))


@query(with_views("files") + " SELECT module, count(*) FILTER (WHERE path LIKE '%/tests/%') AS generated, count(*) AS n FROM files GROUP BY 1")
def b13_generated_paths(t: Tables) -> DataFrame:
    """Files with a segment that marks generated output, per module."""
    made = F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, GENERATED)))
    return files(t).groupBy("module").agg(F.count_if(made).alias("generated"), count().alias("n"))


@query("SELECT l_returnflag AS finding, count(*) > 5 AS truncated, count(*) > 0 AS backed, CAST((SELECT count(*) FROM lineitem) AS BIGINT) AS scanned FROM lineitem WHERE l_linenumber = 1 GROUP BY 1")
def b17_evidence_chain(t: Tables) -> DataFrame:
    """Evidence per finding: backed, more than the limit, and how much was scanned."""
    scanned = t.lineitem.agg(count().alias("scanned"))
    found = t.lineitem.filter("l_linenumber = 1").groupBy(F.col("l_returnflag").alias("finding")).agg((count() > 5).alias("truncated"), (count() > 0).alias("backed"))
    return found.crossJoin(F.broadcast(scanned))  # one row


@query("SELECT n_name AS artifact, CASE WHEN count(s_suppkey) = 0 THEN 'unknown' WHEN count(s_suppkey) FILTER (WHERE s_acctbal < 0) > 0 THEN 'fail' ELSE 'pass' END AS verdict, min(s_suppkey) FILTER (WHERE s_acctbal < 0) AS first_failing, count(s_suppkey) FILTER (WHERE s_acctbal < 0) AS failing FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def b18_gate_verdict(t: Tables) -> DataFrame:
    """Verdict with the first failing rule; unknown without rules."""
    bad = F.col("s_acctbal") < 0
    g = t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_name").alias("artifact"))
    return g.agg(F.when(F.count("s_suppkey") == 0, "unknown").when(F.count_if(bad) > 0, "fail").otherwise("pass").alias("verdict"), F.min(F.when(bad, F.col("s_suppkey"))).alias("first_failing"), F.count_if(bad).alias("failing"))


@query(with_views("files", "commit_files") + ", c AS (SELECT path, count(*) AS churn FROM commit_files GROUP BY 1) SELECT path, size >= 20 OR coalesce(churn, 0) >= 25 OR partkey % 5 = 0 AS attention FROM files LEFT JOIN c USING (path)")
def b25_attention(t: Tables) -> DataFrame:
    """Files that need attention by complexity, churn or being dirty."""
    churn = commit_files(t).groupBy("path").agg(count().alias("churn"))
    f = files(t).join(churn, "path", "left")
    return f.select("path", ((F.col("size") >= 20) | (F.coalesce("churn", F.lit(0)) >= 25) | (F.col("partkey") % 5 == 0)).alias("attention"))


@query("WITH s AS (SELECT o_custkey AS proposal, list_distinct(list(o_orderpriority)) AS refs FROM orders GROUP BY 1) SELECT proposal, len(list_filter(refs, lambda r: r NOT IN ('5-LOW', '4-NOT SPECIFIED'))) = 0 AS popularity_only, len(list_intersect(refs, ['1-URGENT', '2-HIGH'])) > 0 AS protected FROM s")
def b27_reference_predicates(t: Tables) -> DataFrame:
    """Proposals whose references are all of one kind, and those that touch protected ones (also b28)."""
    s = t.orders.groupBy(F.col("o_custkey").alias("proposal")).agg(F.collect_set("o_orderpriority").alias("refs"))
    return s.select("proposal", F.forall("refs", lambda r: r.isin("5-LOW", "4-NOT SPECIFIED")).alias("popularity_only"), (F.size(F.array_intersect("refs", F.array(F.lit("1-URGENT"), F.lit("2-HIGH")))) > 0).alias("protected"))


@query(with_views("files") + ", w AS (SELECT partkey, CASE WHEN partkey % 2 = 0 THEN module ELSE replace(module, '_', '-') END AS token FROM files), m AS (SELECT DISTINCT module FROM files) SELECT w.partkey, coalesce(a.module, b.module) AS module FROM w LEFT JOIN m a ON a.module = w.token LEFT JOIN (SELECT min(module) AS module, replace(module, '_', '-') AS leaf FROM m GROUP BY 2) b ON b.leaf = w.token")
def c08_module_token(t: Tables) -> DataFrame:
    """Modules by exact name, else by the first whose normalised leaf is the token."""
    known = files(t).select("module").distinct()
    leaf = known.groupBy(F.translate("module", "_", "-").alias("token")).agg(F.min("module").alias("by_leaf"))
    wanted = files(t).select("partkey", F.when(F.col("partkey") % 2 == 0, F.col("module")).otherwise(F.translate("module", "_", "-")).alias("token"))
    return wanted.join(known.select(F.col("module").alias("token"), F.col("module").alias("exact")), "token", "left").join(leaf, "token", "left").select("partkey", F.coalesce("exact", "by_leaf").alias("module"))


@query(_PAGES + """, k AS (SELECT DISTINCT CASE WHEN page_id % 3 = 0 THEN path ELSE regexp_extract(path, '([^/]+/[^/]+)$', 1) END AS key FROM p WHERE path LIKE '%/%'), c AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN regexp_extract(path, '([^/]*)$', 1) ELSE path END AS path FROM p)
  SELECT page_id, path, coalesce((SELECT min(key) FROM k WHERE key = path), (SELECT min(key) FROM k WHERE ends_with(path, '/' || key) OR ends_with(key, '/' || path))) AS key FROM c""")
def c07_suffix_key(t: Tables) -> DataFrame:
    """The known key that a path equals, else the first key that the path ends in or that ends in the path, at a slash; by exploded suffixes of both sides."""
    p, parts = page_paths(t), F.split("path", "/")
    short = F.when(F.col("page_id") % 3 == 0, F.col("path")).otherwise(F.regexp_extract("path", "([^/]+/[^/]+)$", 1))
    keys = p.filter(F.col("path").contains("/")).select(short.alias("key")).distinct()
    asked = p.select("page_id", F.when(F.col("page_id") % 5 == 0, F.element_at(parts, -1)).otherwise(F.col("path")).alias("path"))
    tails = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda i: F.array_join(F.slice(F.split(c, "/"), i, F.size(F.split(c, "/"))), "/"))
    ends_in = asked.select("page_id", "path", F.explode(tails("path")).alias("key")).join(keys, "key").select("page_id", "path", "key")
    first = keys.select("key", F.explode(tails("key")).alias("path")).groupBy("path").agg(F.min("key").alias("key"))  # a path that ends many keys and is asked by many pages is no product of both
    within = first.join(asked, "path").select("page_id", "path", "key")
    found = ends_in.union(within).groupBy("page_id").agg(F.min("key").alias("key"), F.min(F.when(F.col("key") == F.col("path"), F.col("key"))).alias("same"))
    return asked.join(found, "page_id", "left").select("page_id", "path", F.coalesce("same", "key").alias("key"))


@query("WITH b AS (SELECT lower(p_name) AS k, min(p_partkey) AS boundary, count(*) AS n FROM part GROUP BY 1) SELECT p_partkey, CASE WHEN b.n = 1 THEN 'known' WHEN b.n > 1 THEN 'ambiguous' ELSE 'unknown' END AS state, CASE WHEN b.n = 1 THEN boundary END AS boundary FROM part LEFT JOIN b ON lower(p_name) = k")
def c20_boundary_lookup(t: Tables) -> DataFrame:
    """Exact look-up on lower-cased names; several matches are ambiguous (also j17)."""
    b = t.part.groupBy(F.lower("p_name").alias("k")).agg(F.min("p_partkey").alias("boundary"), count().alias("n"))
    one = F.col("n") == 1
    return t.part.select("p_partkey", F.lower("p_name").alias("k")).join(b, "k", "left").select("p_partkey", F.when(one, "known").when(F.col("n") > 1, "ambiguous").otherwise("unknown").alias("state"), F.when(one, F.col("boundary")).alias("boundary"))


@query("SELECT doc_id, labels.doc_id IS NOT NULL AS known FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) labels USING (doc_id)")
def c25_anchor_exists(t: Tables) -> DataFrame:
    """Whether the anchored item exists."""
    known = t.labels.select("doc_id").distinct().withColumn("known", F.lit(True))
    return t.documents.select("doc_id").distinct().join(known, "doc_id", "left").select("doc_id", F.coalesce("known", F.lit(False)).alias("known"))


@query("SELECT l_suppkey AS capability, arg_min(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS payload FROM lineitem GROUP BY 1")
def c29_first_payload(t: Tables) -> DataFrame:
    """The first payload of each capability."""
    return t.lineitem.groupBy(F.col("l_suppkey").alias("capability")).agg(F.min_by("l_orderkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("payload"))


@query(with_views("commits", "commit_files") + _SHAPE + _PAST + " SELECT count(*) AS n, round(min(score), 4) AS lowest, round(median(score), 4) AS middle, round(max(score), 4) AS highest, count(*) FILTER (WHERE a > 0) AS untested FROM scored")
def d30_risk_distribution(t: Tables) -> DataFrame:
    """Spread of change risk over all commits, and those without tests; the median by selection (also d14)."""
    risk = settled(change_risk(t).select("score", "a"))
    middle = order_statistics(risk, [], "score", MIDDLE).select(F.round((F.col("low") + F.col("high")) / 2, 4).alias("middle"))
    spread = risk.agg(count().alias("n"), F.round(F.min("score"), 4).alias("lowest"), F.round(F.max("score"), 4).alias("highest"), F.count_if(F.col("a") > 0).alias("untested"))
    return spread.crossJoin(middle).select("n", "lowest", "middle", "highest", "untested")  # of single rows


@query("SELECT n_name AS unit, CASE WHEN count(s_suppkey) > 0 THEN round_even(100 * count(s_suppkey) FILTER (WHERE s_acctbal >= 0) / count(s_suppkey), 1) END AS resolved FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def d36_resolved_ratio(t: Tables) -> DataFrame:
    """Resolved share in percent, half-even to one place; unknown without any."""
    n = F.count("s_suppkey")
    return t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_name").alias("unit")).agg(F.when(n > 0, F.bround(100 * F.count_if(F.col("s_acctbal") >= 0) / n, 1)).alias("resolved"))


@query("SELECT event_type AS family, count(*) AS n, round(count(*) FILTER (WHERE value > 5) / count(*), 6) AS ok_ratio, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.95) <= 100 AND count(*) FILTER (WHERE value > 5) = count(*) AS passed FROM events GROUP BY 1")
def d43_quality_ratios(t: Tables) -> DataFrame:
    """Share of good checks per family, and the verdict on latency, a percentile by selection, and quality together."""
    e = t.events.select(F.col("event_type").alias("family"), "value")
    ok = e.groupBy("family").agg(count().alias("checks"), F.count_if(F.col("value") > 5).alias("ok"))
    x = ok.join(order_statistics(e, ["family"], "value", {"p95": nth(95)}), "family")
    return x.select("family", F.col("checks").alias("n"), F.round(F.col("ok") / F.col("checks"), 6).alias("ok_ratio"), "p95", ((F.col("p95") <= 100) & (F.col("ok") == F.col("checks"))).alias("passed"))


@query(_QUALITY + " SELECT module, max_cc, coupling FROM q ORDER BY coupling DESC, module LIMIT 3")
def f04_top_importers(t: Tables) -> DataFrame:
    """The three modules that import most, then by name."""
    return module_metrics(t).orderBy(F.desc("coupling"), "module").limit(3).select("module", "max_cc", "coupling")


@query("SELECT l_partkey AS file, count(*) AS hits FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 ORDER BY hits DESC, file LIMIT 5")
def f11_naive_ranking(t: Tables) -> DataFrame:
    """The five files with most hits, then by name."""
    return t.lineitem.filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("file")).agg(count().alias("hits")).orderBy(F.desc("hits"), "file").limit(5)


_COUPLED = _RISK + """, x AS (SELECT module, coupling FROM t), deg AS (SELECT module, CAST(count(DISTINCT CASE WHEN dst = module THEN src END) AS BIGINT) AS inbound, CAST(count(DISTINCT CASE WHEN src = module THEN dst END) AS BIGINT) AS outbound FROM x LEFT JOIN mw ON src = module OR dst = module GROUP BY 1),
  a AS (SELECT 'module' AS kind, module AS name, '' AS other, CAST(coupling AS BIGINT) AS value, inbound, outbound, CAST(risk AS BIGINT) AS risk FROM x JOIN deg USING (module) JOIN risk USING (module) ORDER BY coupling DESC, module LIMIT 30),
  e AS (SELECT 'edge' AS kind, src AS name, dst AS other, CAST(weight AS BIGINT) AS value, CAST(NULL AS BIGINT) AS inbound, CAST(NULL AS BIGINT) AS outbound, CAST(NULL AS BIGINT) AS risk FROM mw ORDER BY weight DESC, src, dst LIMIT 50)"""


@query(_COUPLED + " SELECT * FROM a UNION ALL SELECT * FROM e UNION ALL SELECT 'summary', (SELECT name FROM a ORDER BY value DESC, name LIMIT 1), (SELECT CAST(count(*) AS VARCHAR) FROM x) || ' modules', (SELECT max(value) FROM a), (SELECT count(*) FROM mw), NULL, NULL")
def l05_coupling_details(t: Tables) -> DataFrame:
    """The thirty modules of most coupling with their edges in and out and their risk, the fifty heaviest edges, and a summary: the top module, the number of modules, the greatest coupling and the number of edges."""
    edges, paths = settled(module_edges(t)), settled(touched_paths(t))
    table = settled(modules(t, edges, paths))
    degree = edges.select(F.col("dst").alias("module"), F.col("src").alias("i"), F.lit(None).cast("string").alias("o")).union(edges.select("src", F.lit(None).cast("string"), "dst")).groupBy("module").agg(F.count("i").alias("inbound"), F.count("o").alias("outbound"))
    m = table.select("module", F.coalesce("coupling", F.lit(0)).cast("long").alias("value")).join(degree, "module", "left").join(module_risk(t, edges, table, paths), "module").fillna(0, ["inbound", "outbound"])
    m = settled(m)
    top = settled(m.orderBy(F.desc("value"), "module").limit(30).select(F.lit("module").alias("kind"), F.col("module").alias("name"), F.lit("").alias("other"), "value", "inbound", "outbound", "risk"))
    none = F.lit(None).cast("long")
    heavy = edges.orderBy(F.desc("weight"), "src", "dst").limit(50).select(F.lit("edge").alias("kind"), F.col("src").alias("name"), F.col("dst").alias("other"), F.col("weight").cast("long").alias("value"), none.alias("inbound"), none.alias("outbound"), none.alias("risk"))
    first = top.agg(F.min_by("name", F.struct(-F.col("value"), F.col("name"))).alias("name"), F.max("value").alias("value"))
    counts = m.agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(" modules")).alias("other")).crossJoin(edges.agg(F.count(F.lit(1)).alias("inbound")))  # of single rows
    summary = first.crossJoin(counts).select(F.lit("summary").alias("kind"), "name", "other", "value", "inbound", none.alias("outbound"), none.alias("risk"))
    return top.unionByName(heavy).unionByName(summary)


_HEADS = with_views("commits", "commit_files") + """, h AS (SELECT 'file' AS kind, path AS name, author, hash FROM commits JOIN commit_files USING (hash) UNION ALL SELECT 'module', module, author, hash FROM commits JOIN commit_files USING (hash)),
  au AS (SELECT kind, name, author, count(*) AS n FROM h GROUP BY 1, 2, 3), s AS (SELECT kind, name, count(*) AS authors, CAST(sum(n) AS BIGINT) AS touches, arg_min(author, (-n, author)) AS top_author, round_even(max(n) / sum(n), 4) AS top_share, CAST(least(100, greatest(0, round_even(55 / count(*) + 45 * max(n) / sum(n), 0))) AS BIGINT) AS risk FROM au GROUP BY 1, 2)"""


@query(_HEADS + " SELECT kind, name, place, authors, touches, top_author, top_share, risk FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY risk DESC, touches DESC, name) AS place FROM s) WHERE place <= 30")
def l06_bus_factor_details(t: Tables) -> DataFrame:
    """The thirty files and the thirty modules whose knowledge is in fewest heads, each with its authors, touches and top author."""
    n = tasks_of(t.lineitem)
    log = commits(t).select("hash", "author").repartition(n, "hash").join(commit_files(t).select("hash", "path", "module"), "hash")
    share = F.max("n") / F.sum("n")
    risk = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.bround(55 / count() + 45 * share, 0)))

    def heads(kind: str, c: str, deal: bool) -> DataFrame:
        own = log.repartition(n, c, "author").groupBy(F.col(c).alias("name"), "author").agg(count().alias("n"))
        own = own.repartition(n, "name") if deal else own  # modules are few: each task's rows come down to one a module first
        s = own.groupBy("name").agg(count().alias("authors"), F.sum("n").alias("touches"), F.min_by("author", F.struct(-F.col("n"), F.col("author"))).alias("top_author"), F.bround(share, 4).alias("top_share"), risk.cast("long").alias("risk"))
        return s.select(F.lit(kind).alias("kind"), "*")

    s = heads("file", "path", True).union(heads("module", "module", False))
    place = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("risk"), F.desc("touches"), "name")).cast("long")
    return s.withColumn("place", place).filter(F.col("place") <= 30).select("kind", "name", "place", "authors", "touches", "top_author", "top_share", "risk")


@query("SELECT c_custkey, CASE WHEN s >= 50 THEN 'recommended' WHEN s >= 30 THEN 'optional' ELSE 'skip' END AS advice, CAST(s AS INTEGER) AS score FROM (SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 30 ELSE 0 END + CASE WHEN c_mktsegment = 'BUILDING' THEN 25 ELSE 0 END + CASE WHEN c_nationkey < 10 THEN 20 ELSE 5 END AS s FROM customer)")
def l11_additive_score(t: Tables) -> DataFrame:
    """Additive recommendation score and its bands."""
    s = F.when(F.col("c_acctbal") > 5000, 30).otherwise(0) + F.when(F.col("c_mktsegment") == "BUILDING", 25).otherwise(0) + F.when(F.col("c_nationkey") < 10, 20).otherwise(5)
    return t.customer.select("c_custkey", F.when(s >= 50, "recommended").when(s >= 30, "optional").otherwise("skip").alias("advice"), s.alias("score"))
