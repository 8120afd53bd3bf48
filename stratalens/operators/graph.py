"""Graph operators over imports between files and modules; every edge counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.operators.aggregates import _EDGES, module_edges
from stratalens.operators.joins import WIDE
from stratalens.operators.reach import chain_depths, closure, condensed, connected_groups, distances, ends, first_reached, joined_groups, settled, stuck
from stratalens.plans.registry import Tables, query
from stratalens.sources.bindings import commit_files, files, imports, with_views


def part_edges(t: Tables) -> DataFrame:
    """src, dst: consecutive files of a commit at module/type level."""
    return imports(t).select(F.col("importer").alias("src"), F.col("target").alias("dst")).distinct()


_GRAPH = with_views("imports") + ", e AS (SELECT DISTINCT importer AS src, target AS dst FROM imports)"
#: Two graphs side by side: all edges between modules, which are dense, and each file's most frequent import, which are sparse.
_TWO = with_views("files", "imports") + _EDGES + """, counted AS (SELECT importer AS src, target AS dst, count(*) AS n FROM imports GROUP BY 1, 2),
  g AS (SELECT src, dst FROM mw UNION ALL SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS k FROM counted) WHERE k = 1),
  ends AS (SELECT src AS node FROM g UNION SELECT dst FROM g), c(src, dst) AS (SELECT src, dst FROM g UNION SELECT c.src, g.dst FROM c JOIN g ON c.dst = g.src)"""
_GROUPS = _TWO + """, scc AS (SELECT node, least(node, coalesce((SELECT min(a.dst) FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src WHERE a.src = node), node)) AS scc FROM ends),
  k AS (SELECT DISTINCT a.scc AS src, b.scc AS dst FROM g JOIN scc a ON a.node = g.src JOIN scc b ON b.node = g.dst WHERE a.scc <> b.scc)"""


def two_graphs(t: Tables) -> DataFrame:
    """src, dst of _TWO; names of modules and of files don't meet."""
    counted = imports(t).groupBy(F.col("importer").alias("src"), F.col("target").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    first = counted.groupBy("src").agg(F.min_by("dst", F.struct(-F.col("n"), F.col("dst"))).alias("dst"))
    return settled(module_edges(t).select("src", "dst").union(first.select("src", "dst")))


#: An import that two commits or more make is one of high confidence. Levels by distance first; then each level's order of arrival, from that of the level before.
_IMPACT = """, le AS (SELECT importer AS src, target AS dst, CASE WHEN count(*) > 1 THEN 'high' ELSE 'medium' END AS label FROM imports GROUP BY 1, 2),
  b(node, distance) AS (SELECT node, CAST(0 AS BIGINT) FROM seeds UNION SELECT le.src, b.distance + 1 FROM b JOIN le ON le.dst = b.node WHERE b.distance < 150), level AS (SELECT node, min(distance) AS distance FROM b GROUP BY 1),
  q(node, distance, via, label, place) AS (SELECT node, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), row_number() OVER (ORDER BY node) FROM seeds
    UNION ALL SELECT node, distance, via, label, row_number() OVER (ORDER BY first, node) FROM (SELECT level.node, any_value(level.distance) AS distance, arg_min(q.node, q.place) AS via, arg_min(le.label, q.place) AS label, min(q.place) AS first
      FROM q JOIN le ON le.dst = q.node JOIN level ON level.node = le.src AND level.distance = q.distance + 1 GROUP BY 1)),
  impact AS (SELECT node, distance, CASE WHEN distance = 0 THEN 'changed' ELSE 'reverse_import' END AS reason, via, coalesce(label, 'high') AS confidence FROM q)"""


def impacted(t: Tables, changed: DataFrame) -> DataFrame:
    """node, distance, reason, via, confidence: what a change of `changed` (node) reaches against the direction of imports, with the node and the edge that reached it first."""
    counted = imports(t).groupBy(F.col("importer").alias("dst"), F.col("target").alias("src")).agg(F.count(F.lit(1)).alias("n"))
    back = settled(counted.select("src", "dst", F.when(F.col("n") > 1, "high").otherwise("medium").alias("label")))
    reason = F.when(F.col("distance") == 0, "changed").otherwise("reverse_import")
    return first_reached(back, changed).select("node", "distance", reason.alias("reason"), "via", F.coalesce("label", F.lit("high")).alias("confidence"))


@query(with_views("imports") + ", seeds AS (SELECT DISTINCT target AS node FROM imports WHERE target LIKE 'brand_1/%')" + _IMPACT + " SELECT * FROM impact")
def h01_impacted_files(t: Tables) -> DataFrame:
    """Files that a change of the first module can reach against the direction of imports: distance, reason, the file that reached each first, and that import's confidence."""
    return impacted(t, imports(t).filter(F.col("target").startswith("brand_1/")).select(F.col("target").alias("node")))


@query(_TWO + " SELECT node, count(src) AS dependents FROM ends LEFT JOIN (SELECT * FROM c WHERE src <> dst) ON dst = node GROUP BY 1")
def h02_dependents(t: Tables) -> DataFrame:
    """Number of nodes that can reach each, itself left out even on a cycle."""
    edges = two_graphs(t)
    reach = closure(edges).filter("src <> dst").groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("dependents"))
    return ends(edges).join(reach, "node", "left").select("node", F.coalesce("dependents", F.lit(0)).alias("dependents"))


@query(_TWO + """, r AS (SELECT dst AS node, count(*) AS dependents FROM c WHERE src <> dst GROUP BY 1), o AS (SELECT node, CAST(sum(w) AS BIGINT) AS coupling FROM (SELECT src AS node, weight AS w FROM mw UNION ALL SELECT dst, weight FROM mw) GROUP BY 1)
  SELECT o.node AS module, coalesce(dependents, 0) + coupling AS blast_radius FROM o LEFT JOIN r USING (node)""")
def h03_blast_radius(t: Tables) -> DataFrame:
    """Dependents of each module and the edges at it."""
    from stratalens.operators.aggregates import blast_radius

    return blast_radius(module_edges(t))


@query(_GROUPS + " SELECT scc AS cycle, count(*) AS size, string_agg(node, ',' ORDER BY node) AS members FROM scc GROUP BY 1 HAVING count(*) > 1")
def h04_cycles(t: Tables) -> DataFrame:
    """Strongly connected groups of two nodes or more with their sorted members."""
    groups = connected_groups(two_graphs(t)).groupBy(F.col("scc").alias("cycle"))
    return groups.agg(F.count(F.lit(1)).alias("size"), F.array_join(F.array_sort(F.collect_list("node")), ",").alias("members")).filter("size > 1")


@query(_GROUPS + ", d(node, depth) AS (SELECT DISTINCT scc, CAST(0 AS BIGINT) FROM scc UNION SELECT k.src, depth + 1 FROM d JOIN k ON k.dst = d.node) SELECT scc.node, least(max(depth), 99) AS depth FROM scc JOIN d ON d.node = scc.scc GROUP BY 1")
def h05_execution_depth(t: Tables) -> DataFrame:
    """Longest dependency chain below each node, over strongly connected groups, 99 at most."""
    return chain_depths(two_graphs(t))


_CLUSTER = with_views("files", "commit_files") + """, wide AS (SELECT hash FROM commit_files GROUP BY 1 HAVING count(*) > 50), p AS (SELECT a.path AS a, b.path AS b FROM commit_files a JOIN commit_files b ON a.hash = b.hash AND a.path < b.path WHERE a.hash NOT IN (SELECT hash FROM wide) GROUP BY 1, 2 HAVING count(*) >= 3),
  u AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r(node, low) AS (SELECT a, a FROM u UNION SELECT u.b, r.low FROM r JOIN u ON u.a = r.node), k AS (SELECT node, min(low) AS cluster FROM r GROUP BY 1)"""


@query(_CLUSTER + " SELECT path, coalesce(cluster, path) AS cluster FROM files LEFT JOIN k ON node = path")
def h06_clusters(t: Tables) -> DataFrame:
    """Components of files that three commits or more changed together; others stay alone. Commits of over WIDE files join nothing."""
    cf = commit_files(t).select("hash", "path")
    narrow = cf.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= WIDE).select("hash")
    cf = cf.join(narrow, "hash")
    pairs = cf.alias("a").join(cf.alias("b"), (F.col("a.hash") == F.col("b.hash")) & (F.col("a.path") < F.col("b.path"))).groupBy(F.col("a.path").alias("x"), F.col("b.path").alias("y")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")
    groups = joined_groups(pairs.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("path"), "root")
    return files(t).select("path").join(groups, "path", "left").select("path", F.coalesce("root", "path").alias("cluster"))


@query(_GROUPS + """, w AS (SELECT scc AS node, count(*) AS n, CAST(sum(ascii(right(node, 1)) + length(node)) AS BIGINT) AS own FROM scc GROUP BY 1), kc(src, dst) AS (SELECT src, dst FROM k UNION SELECT kc.src, k.dst FROM kc JOIN k ON kc.dst = k.src),
  held AS (SELECT node, node AS part FROM w UNION SELECT src, dst FROM kc), sums AS (SELECT h.node, CAST(sum(own) AS BIGINT) AS total, list(part ORDER BY part) AS ids FROM held h JOIN w ON w.node = part GROUP BY 1), best AS (SELECT ids FROM sums ORDER BY total DESC, ids LIMIT 1)
  SELECT sums.node, total, CAST(len(ids) AS BIGINT) AS n_groups, list_contains((SELECT ids FROM best), sums.node) AS critical FROM sums""")
def h07_critical_closure(t: Tables) -> DataFrame:
    """Weight of each group and all it depends on; the groups of the heaviest, of ties the one with the lesser ids, are critical."""
    edges = two_graphs(t)
    groups = settled(connected_groups(edges))
    own = groups.groupBy(F.col("scc").alias("part")).agg(F.sum(F.ascii(F.right("node", F.lit(1))) + F.length("node")).alias("own"))
    below = closure(condensed(edges, groups)).select(F.col("src").alias("node"), F.col("dst").alias("part"))
    held = own.select(F.col("part").alias("node"), "part").union(below).join(own, "part")
    sums = settled(held.groupBy("node").agg(F.sum("own").alias("total"), F.array_sort(F.collect_list("part")).alias("ids")))
    best = sums.orderBy(F.desc("total"), "ids").limit(1).select(F.explode("ids").alias("node"), F.lit(True).alias("critical"))
    return sums.join(best, "node", "left").select("node", "total", F.size("ids").cast("long").alias("n_groups"), F.coalesce("critical", F.lit(False)).alias("critical"))


@query(_TWO + """, known AS (SELECT DISTINCT module AS node FROM files), cyc AS (SELECT src AS node FROM c WHERE src = dst), stuck AS (SELECT node FROM cyc UNION SELECT dst FROM c JOIN cyc ON src = node)
  SELECT (SELECT count(*) FROM imports) AS declared, (SELECT count(*) FROM imports) - (SELECT count(*) FROM counted) AS duplicates, (SELECT count(DISTINCT dst) FROM g ANTI JOIN known ON node = dst) AS unknown, (SELECT count(*) FROM ends) AS nodes,
  (SELECT count(*) FROM ends) - (SELECT count(*) FROM stuck) AS ordered, (SELECT count(*) FROM stuck) > 0 AS cyclic""")
def h08_dag_validation(t: Tables) -> DataFrame:
    """Repeated declarations, targets that are no module, and how many nodes a topological order can take; fewer than all means a cycle."""
    edges = two_graphs(t)
    declared = imports(t).groupBy("importer", "target").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("declared"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    known = files(t).select(F.col("module").alias("dst")).distinct()
    unknown = edges.select("dst").distinct().join(known, "dst", "left_anti").agg(F.count(F.lit(1)).alias("unknown"))
    n = ends(edges).agg(F.count(F.lit(1)).alias("nodes"))
    held = stuck(edges).agg(F.count(F.lit(1)).alias("stuck"))
    one_row = declared.crossJoin(unknown).crossJoin(n).crossJoin(held)  # of single rows
    return one_row.select("declared", "duplicates", "unknown", "nodes", (F.col("nodes") - F.col("stuck")).alias("ordered"), (F.col("stuck") > 0).alias("cyclic"))


@query(_TWO + """, failed AS (SELECT node FROM ends WHERE node LIKE 'brand_2/%'), blocked AS (SELECT DISTINCT src AS node FROM c WHERE dst IN (SELECT node FROM failed) AND src NOT IN (SELECT node FROM failed)), b AS (SELECT node FROM failed UNION SELECT node FROM blocked)
  SELECT ends.node, CASE WHEN ends.node IN (SELECT node FROM failed) THEN 'failed' WHEN ends.node IN (SELECT node FROM blocked) THEN 'dependency_blocked' ELSE 'pending' END AS state,
  CASE WHEN ends.node IN (SELECT node FROM blocked) THEN (SELECT string_agg(dst, ',' ORDER BY dst) FROM (SELECT DISTINCT g.src, g.dst FROM g JOIN b ON b.node = g.dst) x WHERE x.src = ends.node) END AS blocked_by FROM ends""")
def h09_blocked(t: Tables) -> DataFrame:
    """Nodes that depend on a failed one, directly or not, with their direct dependencies that block; one breadth-first walk."""
    edges = two_graphs(t).distinct()
    failed = ends(edges).filter(F.col("node").startswith("brand_2/"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    reached = settled(distances(back, failed))
    by = edges.join(reached.select(F.col("node").alias("dst")), "dst").groupBy(F.col("src").alias("node")).agg(F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("by"))
    state = F.when(F.col("distance") == 0, "failed").when(F.col("distance") > 0, "dependency_blocked").otherwise("pending")
    return ends(edges).join(reached, "node", "left").join(by, "node", "left").select("node", state.alias("state"), F.when(F.col("distance") > 0, F.col("by")).alias("blocked_by"))


@query(_GRAPH + ", n AS (SELECT DISTINCT importer AS id FROM imports UNION SELECT target FROM imports) SELECT 'node' AS kind, id AS a, '' AS b FROM n UNION ALL SELECT 'edge', src, dst FROM e")
def h11_knowledge_graph(t: Tables) -> DataFrame:
    """Nodes and edges of the knowledge graph in one relation (also k12)."""
    e = part_edges(t)
    nodes = e.select("src").union(e.select("dst")).distinct().select(F.lit("node").alias("kind"), F.col("src").alias("a"), F.lit("").alias("b"))
    return nodes.union(e.select(F.lit("edge"), "src", "dst"))


@query("""WITH g AS (SELECT o_custkey AS branch, CASE WHEN o_orderstatus = 'O' THEN 2 WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS s, o_orderkey AS gap FROM orders) SELECT branch, CASE max(s) WHEN 2 THEN 'blocked_by_gap' WHEN 1 THEN 'blocked_by_fact' ELSE 'open' END AS status, count(*) FILTER (WHERE s > 0) AS blockers FROM g GROUP BY 1""")
def h12_branch_blocking(t: Tables) -> DataFrame:
    """Status of a branch by precedence of what blocks it (also j08)."""
    s = F.when(F.col("o_orderstatus") == "O", 2).when(F.col("o_orderstatus") == "P", 1).otherwise(0)
    g = t.orders.groupBy(F.col("o_custkey").alias("branch")).agg(F.max(s).alias("s"), F.count_if(s > 0).alias("blockers"))
    return g.select("branch", F.when(F.col("s") == 2, "blocked_by_gap").when(F.col("s") == 1, "blocked_by_fact").otherwise("open").alias("status"), "blockers")
