"""Reports over files, commits and modules: metrics per file, views, scopes, git statistics, digests of what depends on what."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.functions.code import _IMPORT_SQL, _LINES, extension, file_imports, i13_gate_terms, native_lines, corpus, numbered_lines, symbols
from stratalens.operators.aggregates import count, modules
from stratalens.operators.decisions import j14_minimalism_gate
from stratalens.operators.evidence import sql_of
from stratalens.operators.graph import _GROUPS, two_graphs
from stratalens.operators.reach import condensed, connected_groups, settled
from stratalens.plans.registry import Tables, query
from stratalens.sources.bindings import commit_files, commits, files, with_views

_METRICS = f"""l AS (SELECT path, count(*) FILTER (WHERE trim(line) <> '') AS loc FROM lines GROUP BY 1), s AS (SELECT path, count(*) AS fns FROM {sql_of('i04_symbols')} GROUP BY 1), m AS (SELECT path, count(*) AS imports FROM {sql_of('i07_imports')} GROUP BY 1),
  x AS (SELECT g.path, coalesce(loc, 0) AS loc, coalesce(fns, 0) AS fns, coalesce(imports, 0) AS imports, CAST(CASE WHEN coalesce(fns, 0) = 0 THEN terms + 1 ELSE greatest(1, ceil(terms / fns) + 1) END AS BIGINT) AS max_complexity FROM {sql_of('i13_gate_terms')} g LEFT JOIN l USING (path) LEFT JOIN s USING (path) LEFT JOIN m USING (path))"""


def file_metrics(t: Tables) -> DataFrame:
    """path, loc, fns, imports, max_complexity of the corpus."""
    loc = corpus(t).select("path", F.size(F.filter(native_lines(F.col("text")), lambda x: F.trim(x) != "")).cast("long").alias("loc"))
    fns = symbols(t).groupBy("path").agg(count().alias("fns"))
    uses = file_imports(t).groupBy("path").agg(count().alias("imports"))
    x = i13_gate_terms(t).join(loc, "path", "left").join(fns, "path", "left").join(uses, "path", "left").fillna(0, ["loc", "fns", "imports"])
    worst = F.when(F.col("fns") == 0, F.col("terms") + 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("terms") / F.when(F.col("fns") > 0, F.col("fns"))) + 1))
    return x.select("path", "loc", "fns", "imports", worst.cast("long").alias("max_complexity"))


@query(_LINES + ", " + _METRICS + " SELECT * FROM x")
def d09_file_metrics(t: Tables) -> DataFrame:
    """Lines of code, functions, imports and the complexity that the branching terms give the average function."""
    return file_metrics(t)


@query(_LINES + ", " + _METRICS + " SELECT regexp_extract(path, '[.]([^./]+)$', 1) AS ext, path, max_complexity, row_number() OVER (PARTITION BY regexp_extract(path, '[.]([^./]+)$', 1) ORDER BY max_complexity DESC, path) AS place FROM x")
def f07_file_order(t: Tables) -> DataFrame:
    """Files of each extension by complexity, then path."""
    x = file_metrics(t).select(extension(F.col("path")).alias("ext"), "path", "max_complexity")
    return x.withColumn("place", F.row_number().over(W.partitionBy("ext").orderBy(F.desc("max_complexity"), "path")).cast("long"))


@query(with_views("files") + " SELECT path AS target FROM files WHERE size > 45 ORDER BY 1 LIMIT 8")
def f02_violation_targets(t: Tables) -> DataFrame:
    """The first eight targets of a violation, by path."""
    return files(t).filter("size > 45").select(F.col("path").alias("target")).orderBy("target").limit(8)


@query(_LINES + """, q AS (SELECT path, no, line FROM lines WHERE regexp_matches(line, '["'']')) SELECT path, no, regexp_extract(line, '["'']([^"'']*)["'']', 1) AS first, regexp_extract(line, '["'']([^"'']*)["''][^"'']*$', 1) AS last, regexp_extract(line, ' from [^"'']*["'']([^"'']*)["'']', 1) AS after FROM q""")
def i22_quoted(t: Tables) -> DataFrame:
    """First and last quoted string of a line, and the one behind a marker."""
    q = "[\"']"
    inner = "([^\"']*)"
    line = numbered_lines(t).filter(F.col("line").rlike(q))
    return line.select("path", "no", F.regexp_extract("line", f"{q}{inner}{q}", 1).alias("first"), F.regexp_extract("line", f"{q}{inner}{q}[^\"']*$", 1).alias("last"), F.regexp_extract("line", f" from [^\"']*{q}{inner}{q}", 1).alias("after"))


@query(_LINES + _IMPORT_SQL + """ SELECT im.path, im.no, target, CASE WHEN starts_with(t.s, 'mod ') THEN 'module' WHEN starts_with(t.s, 'use ') THEN 'use' WHEN contains(t.s, 'require(') THEN 'require' WHEN starts_with(t.s, '#include') THEN 'path_reference' ELSE 'import' END AS kind FROM im JOIN t ON t.path = im.path AND t.no = im.no WHERE target <> ''""")
def i21_edge_kinds(t: Tables) -> DataFrame:
    """Targets of graph edges with their kind, by how the line starts."""
    s = F.col("s")
    kind = F.when(s.startswith("mod "), "module").when(s.startswith("use "), "use").when(s.contains("require("), "require").when(s.startswith("#include"), "path_reference").otherwise("import")
    return file_imports(t).select("path", "no", "target", kind.alias("kind"))


@query(_LINES + """ SELECT path, count(*) FILTER (WHERE regexp_matches(ltrim(line), '^(async |pub |export |export default |public static )*(def|fn|function|func|void) ')) AS functions, count(*) FILTER (WHERE regexp_matches(ltrim(line), '^(import |from |use |mod |#include|const .*require[(])')) AS imports FROM lines GROUP BY 1""")
def i15_line_predicates(t: Tables) -> DataFrame:
    """Lines that start a function or an import, per file."""
    s = F.ltrim("line")
    function = s.rlike("^(async |pub |export |export default |public static )*(def|fn|function|func|void) ")
    uses = s.rlike("^(import |from |use |mod |#include|const .*require[(])")
    return numbered_lines(t).groupBy("path").agg(F.count_if(function).alias("functions"), F.count_if(uses).alias("imports"))


_VIEW = "WITH p AS (SELECT url, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages)"


@query(_VIEW + """, v AS (SELECT 'index' AS view, host AS name, CAST(count(*) AS BIGINT) AS n, 20 AS most FROM p GROUP BY 2 UNION ALL SELECT 'entrypoints', path, count(*), 20 FROM p WHERE regexp_matches(path, '/[0-9]*0$') GROUP BY 2 UNION ALL SELECT 'tests', path, count(*), 30 FROM p WHERE regexp_matches(path, '/[0-9]*5$') GROUP BY 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY n DESC, name) AS place FROM v) SELECT view, place, name, n FROM r WHERE place <= most""")
def a19_views(t: Tables) -> DataFrame:
    """Index, entry points and tests as lists of 20, 20 and 30."""
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    p = t.pages.select(host.alias("host"), path.alias("path"))
    some = (("index", p.select(F.col("host").alias("name")), 20), ("entrypoints", p.filter(F.col("path").rlike("/[0-9]*0$")).select(F.col("path").alias("name")), 20), ("tests", p.filter(F.col("path").rlike("/[0-9]*5$")).select(F.col("path").alias("name")), 30))
    order = W.orderBy(F.desc("n"), "name")  # over the rows of one list
    lists = [df.groupBy("name").agg(count().alias("n")).orderBy(F.desc("n"), "name").limit(most).select(F.lit(view).alias("view"), F.row_number().over(order).cast("long").alias("place"), "name", "n") for view, df, most in some]
    return reduce(DataFrame.unionByName, lists)


@query("""WITH f AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'eval/' WHEN 1 THEN 'docs/archive/' WHEN 2 THEN 'docs/' WHEN 3 THEN '.out-of-scope/' ELSE 'evaluation/' END || page_id || '.md' AS path FROM pages) SELECT page_id, path, regexp_matches(path, '^(eval/|docs/archive/|[.]out-of-scope/)') AS excluded FROM f""")
def b14_corpus_exclusion(t: Tables) -> DataFrame:
    """Paths that a corpus leaves out by their first folders."""
    k = F.col("page_id")
    top = F.get(F.array(*map(F.lit, ("eval/", "docs/archive/", "docs/", ".out-of-scope/", "evaluation/"))), (k % 5).cast("int"))
    path = F.concat(top, k.cast("string"), F.lit(".md"))
    left = reduce(lambda a, b: a | b, (path.startswith(x) for x in ("eval/", "docs/archive/", ".out-of-scope/")))
    return t.pages.select("page_id", path.alias("path"), left.alias("excluded"))


@query(with_views("files") + """, scope(scope) AS (VALUES ('.'), ('crates/brand_1'), ('crates/brand_2/src'), ('crates/brand')) SELECT scope, count(*) AS n FROM files, scope WHERE scope = '.' OR path = scope OR starts_with(path, scope || '/') GROUP BY 1""")
def b23_in_scope(t: Tables) -> DataFrame:
    """Files in each scope: the whole tree, a path itself, or what lies below it."""
    parts = F.split("path", "/")
    above = files(t).select(F.explode(F.concat(F.array(F.lit(".")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))).alias("scope"))
    return above.filter(F.col("scope").isin(".", "crates/brand_1", "crates/brand_2/src", "crates/brand")).groupBy("scope").agg(count().alias("n"))


@query(f"SELECT status, reason, count(*) AS n FROM {sql_of('j14_minimalism_gate')} GROUP BY 1, 2")
def d38_batch_summary(t: Tables) -> DataFrame:
    """Changes of a batch by what became of them and why, repeats among the rejected."""
    return j14_minimalism_gate(t).groupBy("status", "reason").agg(count().alias("n"))


@query(with_views("commits") + " SELECT hash, ts, subject, (SELECT count(*) FROM commits) AS commits FROM commits ORDER BY ts DESC, hash DESC LIMIT 20")
def d40_evolution_window(t: Tables) -> DataFrame:
    """The 20 latest commits, and how many there are."""
    log = commits(t)
    return log.orderBy(F.desc("ts"), F.desc("hash")).limit(20).select("hash", "ts", "subject").crossJoin(F.broadcast(log.agg(count().alias("commits"))))  # one row


@query(with_views("files", "commits", "commit_files") + ", c AS (SELECT module, count(*) AS churn, count(DISTINCT author) AS authors, max(ts) AS last FROM commit_files JOIN commits USING (hash) GROUP BY 1), f AS (SELECT module, count(*) FILTER (WHERE partkey % 5 = 0) AS dirty, count(*) FILTER (WHERE partkey % 7 = 0) AS untracked FROM files GROUP BY 1) SELECT f.module, dirty, untracked, coalesce(churn, 0) AS churn, coalesce(authors, 0) AS authors, last FROM f LEFT JOIN c USING (module)")
def l03_git_stats(t: Tables) -> DataFrame:
    """Dirty and untracked files, churn and authors of each module."""
    k = F.col("partkey")
    f = files(t).groupBy("module").agg(F.count_if(k % 5 == 0).alias("dirty"), F.count_if(k % 7 == 0).alias("untracked"))
    c = commit_files(t).join(commits(t), "hash").groupBy("module").agg(count().alias("churn"), F.count_distinct("author").alias("authors"), F.max("ts").alias("last"))
    return f.join(c, "module", "left").fillna(0, ["churn", "authors"])


@query(with_views("files") + ", s AS (SELECT module, count(*) FILTER (WHERE path LIKE '%/src/%') - count(*) FILTER (WHERE path LIKE '%/tests/%') AS gap FROM files GROUP BY 1) SELECT module, gap FROM s WHERE gap > 0 ORDER BY gap DESC, module")
def l07_test_gaps(t: Tables) -> DataFrame:
    """Modules with more sources than tests, the widest gap first."""
    return modules(t).filter("test_gap > 0").select("module", F.col("test_gap").alias("gap")).orderBy(F.desc("gap"), "module")


@query(_GROUPS + """, top AS (SELECT DISTINCT scc AS node FROM scc ANTI JOIN k ON k.src = scc.scc), d(node, digest) AS (SELECT node, sha256(node) FROM top UNION SELECT k.src, sha256(k.src || '|' || d.digest) FROM d JOIN k ON k.dst = d.node) SELECT node, digest FROM d""")
def h10_digest_pins(t: Tables) -> DataFrame:
    """Digests that hold those of what a group depends on: of the groups without any first, then level by level until none changes."""
    edges = two_graphs(t)
    groups = settled(connected_groups(edges))
    acyclic = settled(condensed(edges, groups))
    nodes = groups.select(F.col("scc").alias("node")).distinct()
    level = done = settled(nodes.join(acyclic.select(F.col("src").alias("node")), "node", "left_anti").withColumn("digest", F.sha2("node", 256)))
    left = acyclic
    while True:
        # what depends on nothing that is still open
        left = settled(left.join(level.select(F.col("node").alias("src")), "src", "left_anti"))
        open_nodes = left.join(done.select(F.col("node").alias("dst")), "dst", "left_anti").select("src").distinct()
        ready = left.join(open_nodes, "src", "left_anti").join(done, F.col("dst") == F.col("node")).groupBy("src").agg(F.array_join(F.array_sort(F.collect_list("digest")), "|").alias("below"))
        level = settled(ready.select(F.col("src").alias("node"), F.sha2(F.concat("src", F.lit("|"), "below"), 256).alias("digest")))
        if level.isEmpty():
            return done
        done = done.union(level)
