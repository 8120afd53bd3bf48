"""Evidence: rule texts and traces read from strings, freshness, audits, classifications and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.functions.code import _IMPORT_SQL, _LINES, _SYMBOL_SQL, corpus, file_imports, symbols
from stratalens.operators.aggregates import count
from stratalens.operators.decisions import j01_structural_rules
from stratalens.operators.graph import _GROUPS, two_graphs
from stratalens.operators.joins import c17_god_ratchet, c24_anchor_verification
from stratalens.operators.reach import connected_groups, settled
from stratalens.plans.registry import REGISTERED, Tables, query
from stratalens.sources.files import MOST_TRACE, listing, traces


def sql_of(name: str) -> str:
    """The registered SQL of a query, as a subquery."""
    return f"({REGISTERED[name][1]})"


@query()
def a01_directory_scan(t: Tables) -> DataFrame:
    """Files below the tables' folder with their relative paths and sizes, what lies under .git left out; SQL has no folders, tests have.

    The scan's content column is never read.
    """
    return listing(t.spark, t.folder)


@query("""WITH rg AS (SELECT doc_id FROM documents WHERE n_chars > 100), git AS (SELECT doc_id FROM labels), known AS (SELECT DISTINCT source FROM documents JOIN git USING (doc_id)), u AS (SELECT doc_id FROM rg UNION SELECT doc_id FROM git)
  SELECT d.doc_id, known.source IS NULL OR u.doc_id IS NOT NULL AS visible FROM (SELECT DISTINCT doc_id, source FROM documents) d LEFT JOIN known USING (source) LEFT JOIN u ON u.doc_id = d.doc_id""")
def a02_governed_visible(t: Tables) -> DataFrame:
    """Documents in either listing; where a source has no second listing nothing can be told, and nothing is left out."""
    listed = t.documents.filter("n_chars > 100").select("doc_id").union(t.labels.select("doc_id")).distinct().withColumn("listed", F.lit(True))
    known = t.documents.join(t.labels, "doc_id", "left_semi").select("source").distinct().withColumn("known", F.lit(True))
    d = t.documents.select("doc_id", "source").distinct()
    return d.join(known, "source", "left").join(listed, "doc_id", "left").select("doc_id", (F.col("known").isNull() | F.col("listed").isNotNull()).alias("visible"))


# What an inventory leaves out, as regular expressions over paths.
EXCLUDED = (r"^\.git/", r"(^|/)node_modules/", r"(^|/)target/", r"(^|/)dist/", r"(^|/)build/", r"(^|/)vendor/", r"(^|/)\.venv/", r"(^|/)__pycache__/", r"\.min\.js$", r"\.lock$", r"(^|/)coverage/")
_TREE = """WITH tree AS (SELECT page_id, CASE page_id % 12 WHEN 0 THEN '.git/' WHEN 1 THEN 'web/node_modules/' WHEN 2 THEN 'target/' WHEN 3 THEN 'src/dist/' WHEN 4 THEN 'build/' WHEN 5 THEN 'vendor/' WHEN 6 THEN '.venv/' WHEN 7 THEN 'src/__pycache__/' WHEN 8 THEN 'coverage/' ELSE 'src/' END || 'f' || page_id || CASE page_id % 5 WHEN 0 THEN '.min.js' WHEN 1 THEN '.lock' ELSE '.rs' END AS path FROM pages)"""


def tree(t: Tables) -> DataFrame:
    """page_id, path: a tree with every kind of folder that an inventory leaves out."""
    tops = (".git/", "web/node_modules/", "target/", "src/dist/", "build/", "vendor/", ".venv/", "src/__pycache__/", "coverage/")
    top = F.coalesce(F.get(F.array(*map(F.lit, tops)), (F.col("page_id") % 12).cast("int")), F.lit("src/"))
    leaf = F.when(F.col("page_id") % 5 == 0, ".min.js").when(F.col("page_id") % 5 == 1, ".lock").otherwise(".rs")
    return t.pages.select("page_id", F.concat(top, F.lit("f"), F.col("page_id").cast("string"), leaf).alias("path"))


@query(_TREE + ", seen AS (SELECT path FROM tree WHERE NOT (" + " OR ".join(f"regexp_matches(path, '{r}')" for r in EXCLUDED) + """)), manifest AS (SELECT path FROM tree WHERE page_id % 12 > 8 AND page_id % 7 <> 0)
  SELECT path, 'not_in_manifest' AS finding FROM (SELECT * FROM seen EXCEPT SELECT * FROM manifest) UNION ALL SELECT path, 'not_seen' FROM (SELECT * FROM manifest EXCEPT SELECT * FROM seen)""")
def a03_inventory_check(t: Tables) -> DataFrame:
    """The tree without what an inventory leaves out, against a manifest, both ways."""
    everything = tree(t)
    seen = everything.filter(~F.col("path").rlike("|".join(EXCLUDED))).select("path")
    manifest = everything.filter("page_id % 12 > 8 and page_id % 7 <> 0").select("path")
    return seen.subtract(manifest).withColumn("finding", F.lit("not_in_manifest")).union(manifest.subtract(seen).withColumn("finding", F.lit("not_seen")))


_RULES = """WITH r AS (SELECT p_brand AS file, p_partkey AS k, '[[rule]]' || chr(10) || 'name = "' || p_name || '" # a # name' || chr(10) || '  limit = ' || p_size || chr(10) || '# note' || chr(10) || '[[layer]]' || chr(10) || 'strict = ' || CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END AS text FROM part)"""


def rule_texts(t: Tables) -> DataFrame:
    """k, text: two tables of rules with comments."""
    strict = F.when(F.col("p_size") > 25, "true").otherwise("false")
    body = F.concat(F.lit('[[rule]]\nname = "'), "p_name", F.lit('" # a # name\n  limit = '), F.col("p_size").cast("string"), F.lit("\n# note\n[[layer]]\nstrict = "), strict)
    return t.part.select(F.col("p_partkey").alias("k"), body.alias("text"))


def rule_values(texts: DataFrame) -> DataFrame:
    """k, no (of the table in its text), header, name, value, kind: scalars of [[header]] tables, comments stripped; texts: k, text."""
    line = F.btrim(F.regexp_replace("line", r"^((?:[^\"#]|\"[^\"]*\")*)#.*$", "$1"))
    lines = texts.select("k", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).select("k", "pos", line.alias("line"))
    header = F.regexp_extract("line", r"^\[\[([A-Za-z0-9_.]+)\]\]$", 1)
    so_far = W.partitionBy("k").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    placed = lines.withColumn("head", F.when(header != "", header)).withColumns({"no": F.count("head").over(so_far), "header": F.last("head", ignorenulls=True).over(so_far)})
    raw = F.regexp_extract("line", r"^([A-Za-z0-9_]+)\s*=\s*(.*)$", 2)
    kind = F.when(raw.startswith('"'), "string").when(raw.rlike(r"^-?\d+$"), "integer").when(raw.isin("true", "false"), "boolean").otherwise("other")
    return placed.select("k", "no", "header", F.regexp_extract("line", r"^([A-Za-z0-9_]+)\s*=", 1).alias("name"), F.btrim(raw, F.lit('"')).alias("value"), kind.alias("kind")).filter("name <> '' and header is not null")


@query(_RULES + """ SELECT k, CAST(1 AS BIGINT) AS no, 'rule' AS header, 'name' AS name, regexp_extract(text, 'name = "([^"]*)"', 1) AS value, 'string' AS kind FROM r UNION ALL SELECT k, 1, 'rule', 'limit', regexp_extract(text, 'limit = ([0-9]+)', 1), 'integer' FROM r
  UNION ALL SELECT k, 2, 'layer', 'strict', regexp_extract(text, 'strict = (true|false)', 1), 'boolean' FROM r""")
def a13_rule_tables(t: Tables) -> DataFrame:
    """Tables and scalars of rule texts."""
    return rule_values(rule_texts(t))


@query("""WITH e AS (SELECT user_id, event_id % 50 AS seq, event_type AS action, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE user_id % 11 <> 3), n AS (SELECT user_id, count(*) AS n_events, count(DISTINCT seq) AS distinct_seq, count(*) FILTER (WHERE action = 'error') AS errors, count(k) AS targets FROM e GROUP BY 1),
  every AS (SELECT DISTINCT user_id FROM events), s AS (SELECT user_id, CASE WHEN user_id % 11 = 3 THEN 'broken' WHEN user_id % 13 = 5 THEN 'unsupported_version' WHEN distinct_seq < n_events THEN 'duplicate_seq' ELSE 'ok' END AS status, * EXCLUDE (user_id) FROM every LEFT JOIN n USING (user_id))
  SELECT 'traces/' || user_id || '.json' AS path, status, CASE WHEN status IN ('ok', 'duplicate_seq') THEN n_events END AS n_events, CASE WHEN status IN ('ok', 'duplicate_seq') THEN errors END AS errors, CASE WHEN status IN ('ok', 'duplicate_seq') THEN targets END AS targets FROM s""")
def a14_session_traces(t: Tables) -> DataFrame:
    """Session traces as JSON texts, parsed under a schema with a bound on their size and checked: version, session, numbers that occur once; sources/files.py reads them from a folder.

    One trace a user; some are cut off and some of another version. A trace's events are one document, as its format is.
    """
    event = F.struct((F.col("event_id") % 50).alias("seq"), F.col("event_type").alias("action"), F.lit("shell").alias("tool"), (F.col("event_type") == "error").alias("isError"), F.array(F.struct(F.get_json_object("props", "$.k").alias("path"), F.lit("read").alias("touch"))).alias("targets"))
    user = F.col("user_id")
    made = t.events.groupBy("user_id").agg(F.collect_list(event).alias("events"))
    body = F.to_json(F.struct(F.when(user % 13 == 5, 2).otherwise(1).alias("version"), F.struct(user.cast("string").alias("id"), F.lit("h").alias("harness"), F.lit("/").alias("cwd")).alias("session"), "events"))
    files = settled(made.withColumn("json", body).select(F.concat(F.lit("traces/"), user.cast("string"), F.lit(".json")).alias("path"), F.when(user % 11 == 3, F.substring("json", 1, 40)).otherwise(F.col("json")).alias("text")))
    found = traces(files.withColumn("status", F.when(F.octet_length("text") > MOST_TRACE, "oversized").otherwise("ok")))
    events = F.col("trace.events")
    return found.select("path", "status", F.when(F.col("trace").isNotNull(), F.size(events)).cast("long").alias("n_events"), F.when(F.col("trace").isNotNull(), F.size(F.filter(events, lambda e: e["isError"]))).cast("long").alias("errors"), F.when(F.col("trace").isNotNull(), F.size(F.filter(F.flatten(F.transform(events, lambda e: e["targets"])), lambda x: x["path"].isNotNull()))).cast("long").alias("targets"))


_T3 = "regexp_matches(lower(path), '^tests?/|/tests?/|/__tests__/|(^|/)test_[^/]*$|[.](test|spec)[.][^/]*$')"
_NAMED = """WITH f AS (SELECT p_partkey AS k, CASE p_partkey % 8 WHEN 0 THEN 'Tests/A' || p_partkey || '.cs' WHEN 1 THEN 'src/__TESTS__/b.js' WHEN 2 THEN 'src/Test_c.py' WHEN 3 THEN 'src/d.Spec.ts' WHEN 4 THEN 'spec/e.rb' WHEN 5 THEN 'src/contest/f.rs' WHEN 6 THEN 'lib/test/g.rs' ELSE 'src/latest.rs' END AS path FROM part)"""


@query(_NAMED + f" SELECT k, path, {_T3} AS is_test FROM f")
def b10_test_files(t: Tables) -> DataFrame:
    """Test files whatever the case: a test folder, or a leaf that starts with test_ or holds .test. or .spec. ."""
    names = ("src/__TESTS__/b.js", "src/Test_c.py", "src/d.Spec.ts", "spec/e.rb", "src/contest/f.rs", "lib/test/g.rs", "src/latest.rs")
    k = F.col("p_partkey")
    path = F.when(k % 8 == 0, F.concat(F.lit("Tests/A"), k.cast("string"), F.lit(".cs"))).otherwise(F.get(F.array(*map(F.lit, names)), (k % 8 - 1).cast("int")))
    low = F.split(F.lower(path), "/")
    leaf = F.element_at(low, -1)
    folders = F.slice(low, 1, F.size(low) - 1)
    inner = F.slice(low, 2, F.greatest(F.size(low) - 2, F.lit(0)))
    test = F.arrays_overlap(folders, F.array(F.lit("test"), F.lit("tests"))) | F.array_contains(inner, "__tests__") | leaf.startswith("test_") | leaf.contains(".test.") | leaf.contains(".spec.")
    return t.part.select(k.alias("k"), path.alias("path"), test.alias("is_test"))


@query("""WITH asked AS (SELECT n_name AS department, n_nationkey AS n FROM nation UNION ALL SELECT 'ELSEWHERE', -1), a AS (SELECT s_nationkey AS n, count(*) AS findings, count(*) FILTER (WHERE s_acctbal < 0) AS open FROM supplier GROUP BY 1),
  p AS (SELECT n_nationkey AS n, count(*) FILTER (WHERE n_regionkey <> 4) OVER (PARTITION BY n_regionkey) > 0 AS published FROM nation)
  SELECT department, CASE WHEN p.n IS NULL THEN 'unknown_department' WHEN NOT published THEN 'unavailable' ELSE 'available' END AS status, CASE WHEN published THEN coalesce(findings, 0) ELSE 0 END AS findings, CASE WHEN published THEN coalesce(open, 0) ELSE 0 END AS open FROM asked LEFT JOIN p USING (n) LEFT JOIN a USING (n)""")
def b19_audit_status(t: Tables) -> DataFrame:
    """Audit of each department asked for: unknown, not published (which is no clean audit), or its findings."""
    known = t.nation.select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("department"), (F.col("n_regionkey") != 4).alias("published"))
    asked = known.select("department").union(t.spark.createDataFrame([("ELSEWHERE",)], "department string"))
    audit = t.supplier.groupBy(F.col("s_nationkey").alias("n")).agg(count().alias("findings"), F.count_if(F.col("s_acctbal") < 0).alias("open"))
    status = F.when(F.col("published").isNull(), "unknown_department").when(~F.col("published"), "unavailable").otherwise("available")
    shown = lambda c: F.when(F.col("published"), F.coalesce(c, F.lit(0))).otherwise(0).cast("long")
    return asked.join(known, "department", "left").join(audit, "n", "left").select("department", status.alias("status"), shown("findings").alias("findings"), shown("open").alias("open"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_shipdate >= o_orderdate AND date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) <= 60 THEN 'current' ELSE 'stale' END AS freshness FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def b21_freshness_label(t: Tables) -> DataFrame:
    """Current if observed no later than evaluated and no older than the limit, else stale."""
    x = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    age = F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    return x.select("l_orderkey", "l_linenumber", F.when((F.col("l_shipdate") >= F.col("o_orderdate")) & (age <= 60), "current").otherwise("stale").alias("freshness"))


@query(_LINES + _SYMBOL_SQL + " SELECT path || '#' || name || ':' || no AS symbol, left(sha256(path), 16) || ':1' AS chunk FROM found WHERE name <> ''")
def c04_symbol_chunks(t: Tables) -> DataFrame:
    """Symbols with the chunk that holds them; its identifier follows from the file."""
    return symbols(t).select(F.concat("path", F.lit("#"), "name", F.lit(":"), F.col("no").cast("string")).alias("symbol"), F.concat(F.left(F.sha2("path", 256), F.lit(16)), F.lit(":1")).alias("chunk"))


@query("""WITH r AS (SELECT o_orderkey AS run, o_custkey AS k, o_orderstatus AS claimed FROM orders), a AS (SELECT l_orderkey AS run, CASE WHEN bool_and(l_linestatus = 'F') THEN 'F' WHEN bool_and(l_linestatus = 'O') THEN 'O' ELSE 'P' END AS attested FROM lineitem GROUP BY 1)
  SELECT n_name AS treatment, count(*) AS runs, count(*) FILTER (WHERE attested IS NULL) AS unattested, count(*) FILTER (WHERE attested <> claimed) AS contradicted FROM r LEFT JOIN a USING (run) JOIN customer ON c_custkey = k JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def c23_attested_runs(t: Tables) -> DataFrame:
    """Runs with their attestation, case and treatment; what is attested must equal what the run claims."""
    s = F.col("l_linestatus")
    attested = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.when(F.bool_and(s == "F"), "F").when(F.bool_and(s == "O"), "O").otherwise("P").alias("attested"))
    case = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("treatment"))
    runs = t.orders.join(attested, "o_orderkey", "left").join(case, "o_custkey")
    return runs.groupBy("treatment").agg(count().alias("runs"), F.count_if(F.col("attested").isNull()).alias("unattested"), F.count_if(F.col("attested") != F.col("o_orderstatus")).alias("contradicted"))


@query("""WITH o AS (SELECT o_custkey AS k, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS quota, count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS tool, count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS graph, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS gate,
  count(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') AS quota2, count(*) FILTER (WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'P') AS tool2, count(*) FILTER (WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'P') AS gate2, count(*) FILTER (WHERE o_orderstatus = 'O') AS debt FROM orders GROUP BY 1),
  e AS (SELECT k, gate, debt, CASE WHEN c_acctbal >= 0 THEN quota2 ELSE quota END AS q, CASE WHEN c_acctbal >= 0 THEN tool2 ELSE tool END AS t, CASE WHEN c_acctbal >= 0 THEN gate2 ELSE gate END AS g FROM o JOIN customer ON c_custkey = k)
  SELECT k, q AS provider_quota, t AS local_tool_error, g AS gate_fail, q + t + g > 0 AS blocking, gate > 0 AND g = 0 AND debt > 0 AS known_debt_only, CASE WHEN q + t + g > 0 THEN 'research' ELSE 'understanding' END AS next FROM e""")
def d41_failure_classes(t: Tables) -> DataFrame:
    """Failures by category; effective counts hold where their block is there, zeros included, else the plain ones."""
    p, partial = F.col("o_orderpriority"), F.col("o_orderstatus") == "P"
    classes = (("q", "1-URGENT"), ("t", "2-HIGH"), ("g", "5-LOW"))
    o = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(*(F.count_if(p == v).alias(c) for c, v in classes), *(F.count_if((p == v) & partial).alias(f"{c}2") for c, v in classes), F.count_if(F.col("o_orderstatus") == "O").alias("debt"))
    x = o.join(t.customer.select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") >= 0).alias("block")), "k")
    x = x.select("k", "debt", F.col("g").alias("gate"), *(F.when(F.col("block"), F.col(f"{c}2")).otherwise(F.col(c)).alias(c) for c, _ in classes))
    any_of = F.col("q") + F.col("t") + F.col("g") > 0
    return x.select("k", F.col("q").alias("provider_quota"), F.col("t").alias("local_tool_error"), F.col("g").alias("gate_fail"), any_of.alias("blocking"), ((F.col("gate") > 0) & (F.col("g") == 0) & (F.col("debt") > 0)).alias("known_debt_only"), F.when(any_of, "research").otherwise("understanding").alias("next"))


@query(f"SELECT name, count(*) FILTER (WHERE anchor = 'verified') AS verified, count(*) FILTER (WHERE anchor = 'approximate') AS approximate, count(*) FILTER (WHERE anchor = 'dropped') AS dropped FROM {sql_of('c24_anchor_verification')} GROUP BY 1")
def d44_anchor_counts(t: Tables) -> DataFrame:
    """Anchors verified, approximate and dropped per name."""
    return c24_anchor_verification(t).groupBy("name").agg(*(F.count_if(F.col("anchor") == s).alias(s) for s in ("verified", "approximate", "dropped")))


@query("SELECT source, array_to_string(list_sort(list_distinct(list(lang))), ',') AS kinds, count(DISTINCT text) AS texts FROM documents GROUP BY 1")
def d45_distinct_kinds(t: Tables) -> DataFrame:
    """Sorted set of kinds per source, and its distinct texts."""
    return t.documents.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("kinds"), F.count_distinct("text").alias("texts"))


@query(_LINES + _SYMBOL_SQL + _IMPORT_SQL + """, r AS (SELECT 'files' AS relation, path, CAST(0 AS BIGINT) AS line, '' AS name FROM corpus UNION ALL SELECT 'symbols', path, no, name FROM found WHERE name <> '' UNION ALL SELECT 'imports', path, no, target FROM im WHERE target <> '')
  SELECT relation, path, line, name, row_number() OVER (PARTITION BY relation, path ORDER BY line, name) AS place FROM r""")
def f01_canonical_order(t: Tables) -> DataFrame:
    """Files, symbols and imports in one relation and one order, with the place in the file; the order itself is the sink's sort."""
    named = lambda df, kind, line, name: df.select(F.lit(kind).alias("relation"), "path", F.lit(line).alias("line") if isinstance(line, int) else F.col(line).alias("line"), name.alias("name"))
    rows = named(corpus(t), "files", 0, F.lit("")).withColumn("line", F.col("line").cast("long")).unionByName(named(symbols(t), "symbols", "no", F.col("name"))).unionByName(named(file_imports(t), "imports", "no", F.col("target")))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("relation", "path").orderBy("line", "name")).cast("long")).orderBy("relation", "path", "place")


@query(_GROUPS + " SELECT DISTINCT node AS target FROM scc WHERE scc IN (SELECT scc FROM scc GROUP BY 1 HAVING count(*) > 1) ORDER BY 1 LIMIT 8")
def f05_cycle_targets(t: Tables) -> DataFrame:
    """The first eight members of cycles, by name."""
    groups = connected_groups(two_graphs(t))
    cyclic = groups.groupBy("scc").agg(count().alias("n")).filter("n > 1").select("scc")
    return groups.join(cyclic, "scc", "left_semi").select(F.col("node").alias("target")).distinct().orderBy("target").limit(8)


_SIDES = "WITH a AS (SELECT DISTINCT lang, doc_id FROM documents WHERE n_chars > 100), b AS (SELECT DISTINCT lang, doc_id FROM documents JOIN labels USING (doc_id))"


def two_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    d = t.documents.select("lang", "doc_id", "n_chars")
    return d.filter("n_chars > 100").select("lang", "doc_id").distinct(), d.join(t.labels.select("doc_id"), "doc_id", "left_semi").select("lang", "doc_id").distinct()


@query(_SIDES + """, d AS (SELECT 'left' AS side, doc_id FROM (SELECT doc_id FROM a EXCEPT SELECT doc_id FROM b) UNION ALL SELECT 'right', doc_id FROM (SELECT doc_id FROM b EXCEPT SELECT doc_id FROM a)), r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY doc_id) AS k FROM d)
  SELECT side, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (WHERE k <= 32) AS sample FROM r GROUP BY 1""")
def g02_difference_samples(t: Tables) -> DataFrame:
    """Differences of two sets, each way, with the 32 smallest of each."""
    a, b = (x.select("doc_id").distinct() for x in two_sides(t))
    out = []
    for side, one, two in (("left", a, b), ("right", b, a)):
        only = one.join(two, "doc_id", "left_anti")
        sample = only.orderBy("doc_id").limit(32).agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("sample"))
        out.append(only.agg(count().alias("n")).crossJoin(sample).filter("n > 0").select(F.lit(side).alias("side"), "n", "sample"))  # single rows
    return out[0].union(out[1])


@query(_SIDES + """, d AS (SELECT lang, doc_id FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a))) SELECT l.lang, count(d.doc_id) AS apart, count(d.doc_id) = 0 AS equal FROM (SELECT DISTINCT lang FROM documents) l LEFT JOIN d USING (lang) GROUP BY 1""")
def g03_set_equality(t: Tables) -> DataFrame:
    """Whether two sets are equal: nothing is in just one of them."""
    a, b = two_sides(t)
    one = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), ["lang", "doc_id"], "full").filter("l is null or r is null").groupBy("lang").agg(count().alias("apart"))
    return t.documents.select("lang").distinct().join(one, "lang", "left").select("lang", F.coalesce("apart", F.lit(0)).alias("apart"), F.col("apart").isNull().alias("equal"))


def disjoint(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """one, unless a key of it is in two: that is an error, raised where it is met."""
    met = one.join(two.select(key).distinct().withColumn("__met", F.lit(True)), key, "left")
    return met.filter(F.when(F.col("__met"), F.raise_error(F.concat(F.lit("in both sets: "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))).drop("__met")


@query("SELECT o_orderkey AS fact, o_orderpriority AS signal FROM orders WHERE o_orderstatus = 'F'")
def g05_disjoint_sets(t: Tables) -> DataFrame:
    """Facts that are available, asserted to be no gaps."""
    o = t.orders.select(F.col("o_orderkey").alias("fact"), F.col("o_orderpriority").alias("signal"), "o_orderstatus")
    return disjoint(o.filter("o_orderstatus = 'F'").drop("o_orderstatus"), o.filter("o_orderstatus <> 'F'"), "fact")


@query(f"SELECT rule AS kind, module AS target FROM {sql_of('j01_structural_rules')} UNION ALL SELECT 'no_new_god_files', path FROM {sql_of('c17_god_ratchet')} WHERE change = 'new'")
def g06_all_violations(t: Tables) -> DataFrame:
    """Violations of rules and of the ratchet in one relation."""
    rules = j01_structural_rules(t).select(F.col("rule").alias("kind"), F.col("module").alias("target"))
    return rules.unionByName(c17_god_ratchet(t).filter("change = 'new'").select(F.lit("no_new_god_files").alias("kind"), F.col("path").alias("target")))


@query("""WITH f AS (SELECT p_partkey AS k, p_name || CASE p_partkey % 8 WHEN 0 THEN '.Language' WHEN 1 THEN '.documentation' WHEN 2 THEN '.Examples' WHEN 3 THEN '.meta_data' WHEN 4 THEN '.METADATA' WHEN 5 THEN '.restyled' ELSE '.cost' END AS field FROM part)
  SELECT k, CASE WHEN regexp_matches(lower(field), 'language|documentation|example|context|metadata|style') THEN 25 ELSE 90 END AS criticality FROM f""")
def i30_unknown_criticality(t: Tables) -> DataFrame:
    """Weight of an unknown field: low if its name holds one of the harmless words."""
    k = F.col("p_partkey")
    ends = F.coalesce(F.get(F.array(*map(F.lit, (".Language", ".documentation", ".Examples", ".meta_data", ".METADATA", ".restyled"))), (k % 8).cast("int")), F.lit(".cost"))
    field = F.lower(F.concat("p_name", ends))
    harmless = F.exists(F.array(*map(F.lit, ("language", "documentation", "example", "context", "metadata", "style"))), lambda w: F.contains(field, w))
    return t.part.select(k.alias("k"), F.when(harmless, 25).otherwise(90).alias("criticality"))


# How critical each kind of item of an orientation is, and the confidence of each level; an unknown has none.
CRITICALITY = (("identity", 100), ("purpose", 90), ("language", 30), ("boundary", 90), ("entry-point", 80), ("command", 75), ("active-change", 70), ("risk", 85), ("evidence", 35))
_CONFIDENCE = "CASE WHEN s_acctbal >= 5000 THEN 100 WHEN s_acctbal >= 0 THEN 70 ELSE 40 END"
_HIDDEN = "kind = 'purpose' AND s_nationkey % 3 = 0 OR kind = 'evidence' AND s_suppkey % 4 = 0"


@query(f"WITH k(kind, criticality) AS (VALUES {', '.join(map(str, CRITICALITY))}), i AS (SELECT s_suppkey AS project, kind AS item, criticality, CASE WHEN {_HIDDEN} THEN 0 ELSE {_CONFIDENCE} END AS confidence, CASE WHEN {_HIDDEN} THEN 'unknown' ELSE 'known' END AS state FROM supplier, k)"
  " SELECT project, item, criticality, confidence, state, CASE WHEN criticality >= 50 THEN 'critical' ELSE 'supporting' END AS weight, CASE WHEN criticality >= 50 THEN CASE WHEN confidence >= 50 THEN 'Known Core' ELSE 'Critical Unknown' END WHEN confidence >= 50 THEN 'Supporting Context' ELSE 'Deferred Unknown' END AS quadrant FROM i")
def j05_understanding_quadrants(t: Tables) -> DataFrame:
    """Items of a project's orientation by their fixed criticality and the confidence of what is known of them, in four quadrants; what is unknown stays visible."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(c).alias("criticality")) for k, c in CRITICALITY))).alias("k")
    i = t.supplier.select("*", kinds).select("*", "k.*")
    hidden, critical = F.expr(_HIDDEN), F.col("criticality") >= 50
    i = i.withColumn("confidence", F.when(hidden, 0).otherwise(F.expr(_CONFIDENCE)))
    sure = F.col("confidence") >= 50
    quadrant = F.when(critical & sure, "Known Core").when(critical, "Critical Unknown").when(sure, "Supporting Context").otherwise("Deferred Unknown")
    return i.select(F.col("s_suppkey").alias("project"), F.col("kind").alias("item"), "criticality", "confidence", F.when(hidden, "unknown").otherwise("known").alias("state"), F.when(critical, "critical").otherwise("supporting").alias("weight"), quadrant.alias("quadrant"))
