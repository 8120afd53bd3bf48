"""Sources, projections and predicates: scans of paths and logs, gates and classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.plans.registry import Tables, query
from stratalens.sources.bindings import commit_files, commits, files, imports, with_views

# Directory names that a scan leaves out by default.
SKIPPED_DIRECTORIES = ("node_modules", "target", "dist", "build", "vendor", "tests", "coverage", "out", "bin", "obj")


@query("""SELECT lang, count(DISTINCT p) AS n_paths, CAST(sum(length(p)) AS BIGINT) AS n_chars FROM (
  SELECT DISTINCT lang, replace(rtrim(p, chr(13)), chr(92), '/') AS p FROM (SELECT lang, unnest(string_split(text, chr(10))) AS p FROM documents)) WHERE p <> '' GROUP BY lang""")
def a04_inventory_paths(t: Tables) -> DataFrame:
    """Lines of a listing as normalised distinct paths."""
    line = t.documents.select("lang", F.explode(F.split("text", "\n", -1)).alias("p"))
    path = line.select("lang", F.translate(F.regexp_replace("p", "\r+$", ""), "\\", "/").alias("p")).filter("p <> ''").distinct()
    return path.groupBy("lang").agg(F.count("p").alias("n_paths"), F.sum(F.length("p")).cast("long").alias("n_chars"))


@query(with_views("commit_files") + """ SELECT hash, count(*) AS n_files, CAST(sum(CASE WHEN del % 5 = 0 THEN 0 ELSE ins END) AS BIGINT) AS ins, CAST(sum(CASE WHEN del % 5 = 0 THEN 0 ELSE del END) AS BIGINT) AS del
  FROM commit_files GROUP BY hash""")
def a05_numstat_scan(t: Tables) -> DataFrame:
    """Parses insertions, deletions and path from tab-separated lines; a dash (binary file) counts as zero."""
    binary = F.col("del") % 5 == 0
    cell = lambda c: F.when(binary, F.lit("-")).otherwise(F.col(c).cast("string"))
    lines = commit_files(t).select("hash", F.concat_ws("\t", cell("ins"), cell("del"), "path").alias("line"))
    part = F.split("line", "\t", 3)
    number = lambda i: F.when(part[i] == "-", 0).otherwise(part[i].cast("long"))
    return lines.select("hash", number(0).alias("ins"), number(1).alias("del")).groupBy("hash").agg(F.count(F.lit(1)).alias("n_files"), F.sum("ins").alias("ins"), F.sum("del").alias("del"))


@query(with_views("commits", "commit_files") + """ SELECT c.hash, c.ts, f.path FROM commits c JOIN commit_files f USING (hash)
  WHERE c.ts BETWEEN (SELECT max(ts) FROM commits) - 365 * 86400 AND (SELECT max(ts) FROM commits)
  AND c.hash NOT IN (SELECT hash FROM commits WHERE ts = (SELECT max(ts) FROM commits)) AND f.path LIKE '%/src/%'""")
def a06_log_window(t: Tables) -> DataFrame:
    """File touches of the year before the newest commit, without the newest day's commits, on source files."""
    log = commits(t)
    tip = log.agg(F.max("ts").alias("tip"))
    window = log.crossJoin(F.broadcast(tip)).filter(F.col("ts").between(F.col("tip") - 365 * 86400, F.col("tip")))  # one row
    own = window.filter("ts = tip").select("hash")
    wanted = files(t).filter(F.col("path").contains("/src/")).select("path")
    return window.join(own, "hash", "left_anti").join(commit_files(t), "hash").join(wanted, "path", "left_semi").select("hash", "ts", "path")


@query(with_views("commits", "commit_files") + " SELECT path, count(DISTINCT hash) AS churn, max(ts) AS last_commit FROM commits JOIN commit_files USING (hash) GROUP BY path")
def a07_file_history(t: Tables) -> DataFrame:
    """Churn and last commit per file; a commit touches a file once."""
    return commits(t).join(commit_files(t), "hash").groupBy("path").agg(F.count(F.lit(1)).alias("churn"), F.max("ts").alias("last_commit"))


@query(with_views("files") + """ SELECT path, CASE WHEN partkey % 5 = 0 THEN 'untracked' WHEN partkey % 3 = 0 THEN 'modified' WHEN partkey % 2 = 0 THEN 'tracked' ELSE 'untracked' END AS state FROM files""")
def a08_git_signals(t: Tables) -> DataFrame:
    """State of a file by precedence: listed as other, modified, tracked, else untracked."""
    f = files(t)
    flag = lambda n, name: f.filter(F.col("partkey") % n == 0).select("path", F.lit(True).alias(name))
    joined = f.select("path").join(flag(2, "tracked"), "path", "left").join(flag(3, "modified"), "path", "left").join(flag(5, "other"), "path", "left")
    return joined.select("path", F.when(F.col("other"), "untracked").when(F.col("modified"), "modified").when(F.col("tracked"), "tracked").otherwise("untracked").alias("state"))


_XY = "SELECT substr(' MADRCTU?!', CAST(o_orderkey % 10 AS INTEGER) + 1, 1) AS x, substr(' MADRCTU?!', CAST(o_custkey % 10 AS INTEGER) + 1, 1) AS y FROM orders"


@query(f"""WITH xy AS ({_XY}), c AS (SELECT x, y, x || y IN ('DD', 'AA') OR x = 'U' OR y = 'U' AS unmerged, x = '!' AND y = '!' AS ignored, x = '?' AND y = '?' AS untracked FROM xy),
  l AS (SELECT 'unmerged' AS label FROM c WHERE unmerged UNION ALL SELECT 'ignored' FROM c WHERE ignored AND NOT unmerged UNION ALL SELECT 'untracked' FROM c WHERE untracked AND NOT unmerged
  UNION ALL SELECT 'staged' FROM c WHERE NOT (unmerged OR ignored OR untracked) AND x <> ' ' UNION ALL SELECT 'deleted' FROM c WHERE NOT (unmerged OR ignored OR untracked) AND 'D' IN (x, y)
  UNION ALL SELECT 'renamed' FROM c WHERE NOT (unmerged OR ignored OR untracked) AND (x IN ('R', 'C') OR y IN ('R', 'C')) UNION ALL SELECT 'type_changed' FROM c WHERE NOT (unmerged OR ignored OR untracked) AND 'T' IN (x, y)
  UNION ALL SELECT 'modified' FROM c WHERE NOT (unmerged OR ignored OR untracked) AND (x IN ('M', 'A') OR y IN ('M', 'A')))
  SELECT label, count(*) AS n FROM l GROUP BY label""")
def a09_status_labels(t: Tables) -> DataFrame:
    """Labels of two-letter status codes, several per code."""
    letter = lambda c: F.substr(F.lit(" MADRCTU?!"), (F.col(c) % 10 + 1).cast("int"), F.lit(1))
    xy = t.orders.select(letter("o_orderkey").alias("x"), letter("o_custkey").alias("y"))
    either = lambda *ls: F.col("x").isin(*ls) | F.col("y").isin(*ls)
    code = F.concat("x", "y")
    plain = F.filter(
        F.array(F.when(F.col("x") != " ", "staged"), F.when(either("D"), "deleted"), F.when(either("R", "C"), "renamed"), F.when(either("T"), "type_changed"), F.when(either("M", "A"), "modified")),
        lambda x: x.isNotNull(),
    )
    labels = F.when(either("U") | code.isin("DD", "AA"), F.array(F.lit("unmerged"))).when(code == "!!", F.array(F.lit("ignored"))).when(code == "??", F.array(F.lit("untracked"))).otherwise(plain)
    return xy.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# What is wrong with an artifact, in the order of the checks.
FAULTS = ("shape", "path_not_portable", "path_collision", "duplicate", "contract_unknown", "snapshot_mismatch", "digest_mismatch", "payload_invalid")


@query("""WITH a AS (SELECT doc_id, lang AS kind, CASE WHEN doc_id % 23 = 1 THEN '../' || doc_id WHEN doc_id % 29 = 2 THEN upper(source) || '/shared' WHEN doc_id % 29 = 3 THEN source || '/shared' ELSE source || '/' || doc_id END AS path, sha256(text) AS actual,
    CASE WHEN n_chars % 13 = 0 THEN sha256('stale') ELSE sha256(text) END AS claimed, doc_id % 37 = 4 AS other, CASE WHEN n_chars % 17 = 0 THEN '{"n": "many"}' WHEN n_chars % 19 = 0 THEN '{"n": ' ELSE '{"n": ' || n_chars || '}' END AS payload, n_chars < 5 AS empty FROM documents),
  b AS (SELECT *, count(*) OVER (PARTITION BY lower(path)) AS same, count(*) OVER (PARTITION BY path, claimed) AS twice, count(*) OVER (PARTITION BY path) AS alike FROM a)
  SELECT kind, CASE WHEN empty THEN 'shape' WHEN starts_with(path, '../') THEN 'path_not_portable' WHEN same > alike THEN 'path_collision' WHEN twice > 1 THEN 'duplicate' WHEN kind = 'es' THEN 'contract_unknown' WHEN other THEN 'snapshot_mismatch' WHEN actual <> claimed THEN 'digest_mismatch'
    WHEN NOT json_valid(payload) OR TRY_CAST(json_extract_string(payload, '$.n') AS BIGINT) IS NULL THEN 'payload_invalid' ELSE 'verified' END AS verdict, count(*) AS n FROM b GROUP BY 1, 2""")
def a10_artifact_verify(t: Tables) -> DataFrame:
    """Artifacts by the first of eight checks that fails: shape, portable path, paths that differ in case only, repeats, registered contract, snapshot, digest, payload under its schema."""
    k, n, actual = F.col("doc_id"), F.col("n_chars"), F.sha2("text", 256)
    path = F.when(k % 23 == 1, F.concat(F.lit("../"), k.cast("string"))).when(k % 29 == 2, F.concat(F.upper("source"), F.lit("/shared"))).when(k % 29 == 3, F.concat("source", F.lit("/shared"))).otherwise(F.concat("source", F.lit("/"), k.cast("string")))
    payload = F.when(n % 17 == 0, '{"n": "many"}').when(n % 19 == 0, '{"n": ').otherwise(F.concat(F.lit('{"n": '), n.cast("string"), F.lit("}")))
    a = t.documents.select(F.col("lang").alias("kind"), path.alias("path"), actual.alias("actual"), F.when(n % 13 == 0, F.sha2(F.lit("stale"), 256)).otherwise(actual).alias("claimed"), (k % 37 == 4).alias("other"), F.from_json(payload, "n long")["n"].alias("parsed"), (n < 5).alias("empty"))
    alike = a.groupBy("path").agg(F.count(F.lit(1)).alias("alike"))
    same = alike.groupBy(F.lower("path").alias("low")).agg(F.count(F.lit(1)).alias("cases"))
    twice = a.groupBy("path", "claimed").agg(F.count(F.lit(1)).alias("twice"))
    x = a.join(twice, ["path", "claimed"]).join(same, F.lower("path") == F.col("low"))
    bad = (F.col("empty"), F.col("path").startswith("../"), F.col("cases") > 1, F.col("twice") > 1, F.col("kind") == "es", F.col("other"), F.col("actual") != F.col("claimed"), F.col("parsed").isNull())
    verdict = F.coalesce(*(F.when(b, name) for b, name in zip(bad, FAULTS, strict=True)), F.lit("verified"))
    return x.groupBy("kind", verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, count(*) FILTER (WHERE octet_length(encode(text)) <= 4096) AS n_read, count(*) FILTER (WHERE octet_length(encode(text)) > 4096) AS n_refused FROM documents GROUP BY source")
def a11_bounded_read(t: Tables) -> DataFrame:
    """Texts within the byte limit of a bounded read, and those refused."""
    fits = F.octet_length("text") <= 4096
    return t.documents.groupBy("source").agg(F.count_if(fits).alias("n_read"), F.count_if(~fits).alias("n_refused"))


@query("""SELECT url, doc_url, n FROM (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS url, min(url) AS doc_url, count(*) AS n FROM pages GROUP BY 1) ORDER BY n DESC, url LIMIT 20""")
def a19_index_view(t: Tables) -> DataFrame:
    """Top 20 hosts of a page index, with a first page each."""
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return t.pages.groupBy(host.alias("h")).agg(F.min("url").alias("doc_url"), F.count(F.lit(1)).alias("n")).select(F.col("h").alias("url"), "doc_url", "n").orderBy(F.desc("n"), "url").limit(20)


@query("""WITH l AS (SELECT event_id, 'run ' || event_type || ' done' AS a, event_type || ' : ' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS b FROM events)
  SELECT event_id, trim(regexp_extract(b, '^(.*):', 1)) AS metric, CAST(regexp_extract(b, ':\\s*([0-9]+)\\s*$', 1) AS BIGINT) AS number FROM l WHERE regexp_matches(b, ':\\s*[0-9]+\\s*$')""")
def a20_last_metric_line(t: Tables) -> DataFrame:
    """Name and number of the last line of an output that reads `name: number`."""
    text = t.events.select("event_id", F.concat(F.lit("run "), "event_type", F.lit(" done\n"), "event_type", F.lit(" : "), F.round(F.col("value") * 100).cast("long").cast("string"), F.lit("\nend")).alias("out"))
    line = text.select("event_id", F.posexplode(F.split("out", "\n", -1)).alias("no", "line"))
    name, number = F.regexp_extract("line", r"^\s*(.*\S)\s*:\s*(-?[0-9]+)\s*$", 1), F.regexp_extract("line", r"^\s*(.*\S)\s*:\s*(-?[0-9]+)\s*$", 2)
    found = line.select("event_id", "no", name.alias("metric"), number.alias("number")).filter("number <> ''")
    return found.groupBy("event_id").agg(F.max_by(F.struct("metric", "number"), "no").alias("m")).select("event_id", "m.metric", F.col("m.number").cast("long").alias("number"))


_GATE = """WITH g AS (SELECT path, size, CASE WHEN regexp_matches(path, '[05]\\.rs$') THEN 'unsupported_ext' WHEN starts_with(path, 'crates/brand_1/') THEN 'user_exclude'
  WHEN regexp_matches(path, '/tests/') THEN 'default_path' WHEN size > 45 THEN 'oversized' WHEN size % 9 = 0 THEN 'binary' ELSE 'default_include' END AS gate FROM files)"""


def gated(t: Tables) -> DataFrame:
    """First gate that takes a file."""
    directories = F.transform(F.slice(F.split(F.lower("path"), "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(1))), lambda x: x)
    skipped = F.arrays_overlap(directories, F.array(*map(F.lit, SKIPPED_DIRECTORIES)))
    gate = (
        F.when(F.col("path").rlike(r"[05]\.rs$"), "unsupported_ext")
        .when((F.col("path") == "crates/brand_1") | F.col("path").startswith("crates/brand_1/"), "user_exclude")
        .when(skipped, "default_path")
        .when(F.col("size") > 45, "oversized")
        .when(F.col("size") % 9 == 0, "binary")
        .otherwise("default_include")
    )
    return files(t).select("path", "size", gate.alias("gate"))


@query(with_views("files") + ", " + _GATE.removeprefix("WITH ") + " SELECT path, gate FROM g")
def b01_file_gate(t: Tables) -> DataFrame:
    """First-match-wins classification of files."""
    return gated(t).select("path", "gate")


@query(with_views("files") + ", " + _GATE.removeprefix("WITH ") + " SELECT gate, count(*) AS n, (SELECT count(*) FROM files) = (SELECT count(*) FROM g) AS conserved FROM g GROUP BY gate")
def b04_gate_conservation(t: Tables) -> DataFrame:
    """Files per gate, and whether every candidate got one decision."""
    by_gate = gated(t).groupBy("gate").agg(F.count(F.lit(1)).alias("n"))
    totals = files(t).agg(F.count(F.lit(1)).alias("all"))
    decided = by_gate.agg(F.sum("n").alias("decided"))
    check = totals.crossJoin(decided).select((F.col("all") == F.col("decided")).alias("conserved"))  # one row
    return by_gate.crossJoin(F.broadcast(check))


@query(with_views("files") + ", " + _GATE.removeprefix("WITH ") + """, o(gate, ordinal) AS (VALUES ('unsupported_ext', 1), ('user_exclude', 2), ('default_path', 3), ('oversized', 4), ('binary', 5))
  SELECT CAST(ordinal AS INTEGER) AS ordinal, o.gate, count(*) AS n FROM g JOIN o ON g.gate = o.gate GROUP BY 1, 2""")
def d05_gate_rollup(t: Tables) -> DataFrame:
    """Exclusions per gate in declared order; gates without files are left out."""
    order = ("unsupported_ext", "user_exclude", "default_path", "oversized", "binary")
    ordinal = t.spark.createDataFrame([(i + 1, g) for i, g in enumerate(order)], "ordinal int, gate string")
    return gated(t).groupBy("gate").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(ordinal), "gate").select("ordinal", "gate", "n")


@query(with_views("files") + ", " + _GATE.removeprefix("WITH ") + """, r AS (SELECT *, row_number() OVER (PARTITION BY gate ORDER BY path) AS k FROM g WHERE gate NOT IN ('default_include', 'unsupported_ext'))
  SELECT gate, count(*) AS n, string_agg(path, ',' ORDER BY path) FILTER (WHERE k <= 8) AS samples FROM r GROUP BY gate""")
def d06_excluded_samples(t: Tables) -> DataFrame:
    """Excluded files per reason with the first eight paths; each task keeps eight of a reason, whatever their number."""
    from pyspark.sql import Window as W

    out = gated(t).filter(~F.col("gate").isin("default_include", "unsupported_ext"))
    first = out.withColumn("k", F.row_number().over(W.partitionBy("gate").orderBy("path"))).filter(F.col("k") <= 8)
    samples = first.groupBy("gate").agg(F.concat_ws(",", F.array_sort(F.collect_list("path"))).alias("samples"))
    return out.groupBy("gate").agg(F.count(F.lit(1)).alias("n")).join(samples, "gate")


@query(with_views("files") + """ SELECT module, count(*) FILTER (WHERE path LIKE '%/tests/%') AS t1, count(*) FILTER (WHERE path LIKE '%/tests/%' OR path LIKE '%\\_test.%' ESCAPE '\\') AS t2,
  count(*) FILTER (WHERE regexp_matches(path, '(^|/)(test_[^/]*|[^/]*_tests?)\\.rs$') OR path LIKE '%/tests/%') AS t4, count(*) FILTER (WHERE path LIKE '%/src/%') AS sources FROM files GROUP BY module""")
def b08_test_predicates(t: Tables) -> DataFrame:
    """Files that the variants of the test predicate take (ranking, impact, risk), and source files, per module."""
    parts = F.split("path", "/")
    leaf, folders = F.element_at(parts, -1), F.slice(parts, 1, F.size(parts) - 1)
    t1 = F.arrays_overlap(folders, F.array(*map(F.lit, ("test", "tests", "spec")))) | leaf.contains("test.") | leaf.contains("spec.")
    stem = F.regexp_replace(leaf, r"\.[^.]*$", "")
    t4 = F.array_contains(parts, "tests") | (stem == "tests") | stem.startswith("test_") | stem.endswith("_test") | stem.endswith("_tests")
    source = (parts[0] == "crates") & F.array_contains(folders, "src")
    return files(t).groupBy("module").agg(F.count_if(t1).alias("t1"), F.count_if(t1 | leaf.contains("_test.")).alias("t2"), F.count_if(t4).alias("t4"), F.count_if(source).alias("sources"))


@query(with_views("commits") + " SELECT subject, count(*) AS n, contains(lower(subject), 'fix') AS is_fix FROM commits GROUP BY subject")
def b12_fix_subjects(t: Tables) -> DataFrame:
    """Commits per subject, with the predicate that marks fixes."""
    fix = F.lower("subject").contains("fix") | F.col("subject").contains("修复") | F.col("subject").contains("修正")
    return commits(t).groupBy("subject", fix.alias("is_fix")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, lang, regexp_replace(left(text, 400), '[\\x00-\\x08\\x0A-\\x1F\\x7F]', chr(65533), 'g') AS preview, length(text) > 400 AS truncated
  FROM documents WHERE contains(lower(text), 'license') ORDER BY doc_id LIMIT 20""")
def b15_evidence_query(t: Tables) -> DataFrame:
    """Evidence search: case-insensitive substring, 20 results, previews of 400 characters without control characters."""
    hit = t.documents.filter(F.lower("text").contains("license")).orderBy("doc_id").limit(20)
    return hit.select("doc_id", "lang", F.regexp_replace(F.left("text", F.lit(400)), r"[\x00-\x08\x0A-\x1F\x7F]", "�").alias("preview"), (F.length("text") > 400).alias("truncated"))


@query("""WITH s AS (SELECT k.lang, count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS labelled, count(*) AS n, max(CASE WHEN l.quality = 0 THEN 1 ELSE 0 END) AS low FROM documents k LEFT JOIN labels l USING (doc_id) GROUP BY k.lang)
  SELECT lang, CASE WHEN labelled = 0 THEN 'unavailable' ELSE 'available' END AS requested, CASE WHEN labelled = n THEN 'complete' ELSE 'partial' END AS coverage, CASE WHEN labelled = n AND low = 0 THEN 'high' ELSE 'low' END AS confidence FROM s""")
def b16_evidence_coverage(t: Tables) -> DataFrame:
    """Availability, coverage and confidence of evidence per kind."""
    s = t.documents.join(t.labels, "doc_id", "left").groupBy("lang").agg(F.count("quality").alias("labelled"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("low"))
    full = F.col("labelled") == F.col("n")
    return s.select(
        "lang", F.when(F.col("labelled") == 0, "unavailable").otherwise("available").alias("requested"), F.when(full, "complete").otherwise("partial").alias("coverage"), F.when(full & (F.col("low") == 0), "high").otherwise("low").alias("confidence")
    )


@query(with_views("commits") + """ SELECT author, count(*) FILTER (WHERE age BETWEEN 0 AND 400 * 86400) AS n_current, count(*) FILTER (WHERE NOT age BETWEEN 0 AND 400 * 86400) AS n_stale
  FROM (SELECT author, (SELECT max(ts) FROM commits) - ts AS age FROM commits) GROUP BY author""")
def b20_freshness(t: Tables) -> DataFrame:
    """Current and stale observations at the newest time: not from the future, and not older than the limit."""
    log = commits(t)
    aged = log.crossJoin(F.broadcast(log.agg(F.max("ts").alias("now")))).withColumn("age", F.col("now") - F.col("ts"))
    current = (F.col("ts") <= F.col("now")) & (F.col("age") <= 400 * 86400)
    return aged.groupBy("author").agg(F.count_if(current).alias("n_current"), F.count_if(~current).alias("n_stale"))


@query("""SELECT line_no, count(*) AS n FROM (SELECT unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT string_split(html, chr(10)) AS l FROM pages))
  WHERE regexp_matches(regexp_replace(line, '<style>[^<]*</style>', '', 'g'), '[{]|<script') GROUP BY line_no""")
def b22_hardcoded_lines(t: Tables) -> DataFrame:
    """Lines that hold an inlined block once the allowed form is taken out."""
    line = t.pages.select(F.posexplode(F.split("html", "\n", -1)).alias("i", "line"))
    hit = F.regexp_replace("line", "<style>[^<]*</style>", "").rlike("[{]|<script")
    return line.filter(hit).groupBy((F.col("i") + 1).cast("long").alias("line_no")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN p = '' THEN 'empty' WHEN starts_with(p, '/') THEN 'absolute' WHEN contains(p, ':') THEN 'colon' WHEN regexp_matches(p, '(^|/)\\.{0,2}(/|$)') THEN 'component' ELSE 'portable' END AS verdict, count(*) AS n
  FROM (SELECT regexp_replace(url, '^https?://[^/]+', CASE page_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN '' WHEN 2 THEN 'c:' ELSE 'a/..' END) AS p FROM pages) GROUP BY 1""")
def b24_portable_paths(t: Tables) -> DataFrame:
    """Why a path is not portable: empty, absolute, a colon, or a dotted or empty component."""
    head = F.when(F.col("page_id") % 4 == 0, "a").when(F.col("page_id") % 4 == 1, "").when(F.col("page_id") % 4 == 2, "c:").otherwise("a/..")
    path = F.concat(head, F.regexp_replace("url", "^https?://[^/]+", ""))
    p = t.pages.select(path.alias("p"))
    dotted = F.exists(F.split("p", "/", -1), lambda x: x.isin("", ".", ".."))
    return p.groupBy(F.when(F.col("p") == "", "empty").when(F.col("p").startswith("/"), "absolute").when(F.col("p").contains(":"), "colon").when(dotted, "component").otherwise("portable").alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_brand AS module, count(*) FILTER (WHERE p_retailprice > 1050 OR (p_size > 25 AND p_retailprice > 1000)) AS gods, count(*) AS n FROM part GROUP BY 1""")
def b26_god_files(t: Tables) -> DataFrame:
    """Files over the line limit, or over the function limit with a lower line limit."""
    god = (F.col("p_retailprice") > 1050) | ((F.col("p_size") > 25) & (F.col("p_retailprice") > 1000))
    return t.part.groupBy(F.col("p_brand").alias("module")).agg(F.count_if(god).alias("gods"), F.count(F.lit(1)).alias("n"))


@query(with_views("imports") + """, e AS (SELECT importer, target, hash, line, row_number() OVER (PARTITION BY target, importer ORDER BY line, hash) AS k FROM imports)
  SELECT target, importer, hash, line FROM e WHERE k = 1""")
def c02_reverse_edges(t: Tables) -> DataFrame:
    """Reverse edges: the earliest import of each importer and target."""
    return imports(t).groupBy("target", "importer").agg(F.min(F.struct("line", "hash")).alias("first")).select("target", "importer", "first.hash", "first.line")
