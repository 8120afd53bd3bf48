"""Decision tables: rules in a fixed order over rows of evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.operators.aggregates import _QUALITY_OF, _RISK, blast_radius, module_edges, module_metrics, modules
from stratalens.operators.graph import _GROUPS, two_graphs
from stratalens.operators.reach import connected_groups, settled
from stratalens.plans.registry import Tables, query
from stratalens.sources.bindings import DAY, commit_files, commits, files, with_views

# Limits of the structural rules; files of the first kind of module may not use the second, nor a layer a later one.
MAX_CC, MAX_GODS, MAX_CYCLES, MAX_COUPLING, FORBIDDEN, LAYERS = 49, 6, 1, 60.0, (1, 3), 3
_CYCLES = _GROUPS + _QUALITY_OF + """, large AS (SELECT scc AS k FROM scc GROUP BY 1 HAVING count(*) > 1), cyc AS (SELECT split_part(node, '/', 1) AS module, count(DISTINCT scc) AS cycles FROM scc JOIN large ON k = scc GROUP BY 1),
  x AS (SELECT q.*, coalesce(cycles, 0) AS cycles, CAST(trunc(greatest(0, 10000 - 8 * coupling - 60 * complex - 120 * gods - 10 * greatest(0, max_cc - 15))) AS BIGINT) AS signal FROM q LEFT JOIN cyc USING (module)),
  zoned AS (SELECT src, dst, CAST(regexp_extract(src, '([0-9]+)$', 1) AS BIGINT) AS a, CAST(regexp_extract(dst, '([0-9]+)$', 1) AS BIGINT) AS b FROM mw)"""


def gated_metrics(t: Tables) -> DataFrame:
    """module, modeled, max_cc, gods, coupling, cycles (strongly connected groups that it takes part in) and quality signal."""
    groups = settled(connected_groups(two_graphs(t)))
    large = groups.groupBy("scc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("scc")
    cycles = groups.join(large, "scc").groupBy(F.split_part("node", F.lit("/"), F.lit(1)).alias("module")).agg(F.count_distinct("scc").alias("cycles"))
    raw = 10000 - 8 * F.col("coupling") - 60 * F.col("complex") - 120 * F.col("gods") - 10 * F.greatest(F.lit(0), F.col("max_cc") - 15)
    return module_metrics(t).join(cycles, "module", "left").fillna(0, ["cycles"]).withColumn("signal", F.greatest(F.lit(0.0), raw).cast("long"))


@query(_CYCLES + f""" SELECT 'max_cc' AS rule, module, '' AS detail FROM x WHERE max_cc > {MAX_CC} UNION ALL SELECT 'no_god_files', module, '' FROM x WHERE gods > {MAX_GODS} UNION ALL SELECT 'max_cycles', module, '' FROM x WHERE cycles > {MAX_CYCLES} UNION ALL SELECT 'max_coupling', module, '' FROM x WHERE coupling > {MAX_COUPLING}
  UNION ALL SELECT 'boundary', src, dst FROM zoned WHERE a % 5 = {FORBIDDEN[0]} AND b % 5 = {FORBIDDEN[1]} UNION ALL SELECT 'layer', src, dst FROM zoned WHERE a % {LAYERS} < b % {LAYERS}""")
def j01_structural_rules(t: Tables) -> DataFrame:
    """Violations of the six structural rules: complexity, god files, cycles and coupling of a module, forbidden uses between modules and of later layers (detail: what is used)."""
    m = gated_metrics(t)
    limits = (("max_cc", F.col("max_cc") > MAX_CC), ("no_god_files", F.col("gods") > MAX_GODS), ("max_cycles", F.col("cycles") > MAX_CYCLES), ("max_coupling", F.col("coupling") > MAX_COUPLING))
    broken = F.filter(F.array(*(F.when(over, name) for name, over in limits)), lambda r: r.isNotNull())
    own = m.select(F.explode(broken).alias("rule"), "module", F.lit("").alias("detail"))
    number = lambda c: F.regexp_extract(c, "([0-9]+)$", 1).cast("long")
    edges = module_edges(t).select(F.col("src").alias("module"), F.col("dst").alias("detail"), number("src").alias("a"), number("dst").alias("b"))
    between = (("boundary", (F.col("a") % 5 == FORBIDDEN[0]) & (F.col("b") % 5 == FORBIDDEN[1])), ("layer", F.col("a") % LAYERS < F.col("b") % LAYERS))
    broken = F.filter(F.array(*(F.when(over, name) for name, over in between)), lambda r: r.isNotNull())
    return own.unionByName(edges.select(F.explode(broken).alias("rule"), "module", "detail"))


@query(_CYCLES + """, fresh AS (SELECT module, count(*) AS n FROM files WHERE size > 45 AND partkey % 7 = 0 GROUP BY 1), b AS (SELECT *, coupling - (modeled % 3) + 1 AS coupling0, signal + (modeled % 5 - 2) * 100 AS signal0, CAST(1 AS BIGINT) AS cycles0 FROM x),
  v AS (SELECT b.module, concat_ws(',', CASE WHEN signal < signal0 THEN 'quality_degraded' END, CASE WHEN coupling > coupling0 THEN 'coupling_increased' END, CASE WHEN cycles > cycles0 THEN 'cycles_increased' END, CASE WHEN n > 0 THEN 'god_files_increased' END) AS broken FROM b LEFT JOIN fresh USING (module))
  SELECT module, CASE WHEN module LIKE '%7' THEN 'baseline_missing' WHEN module LIKE '%5' THEN 'baseline_engine_mismatch' WHEN broken = '' THEN 'pass' ELSE broken END AS verdict, module NOT LIKE '%7' AS governed FROM v""")
def j02_ratchet_gate(t: Tables) -> DataFrame:
    """Four metrics against a baseline: quality, coupling, cycles, and god files by identity, so that an old one that goes makes no room for a new one.

    A module without a baseline isn't governed; one whose baseline another engine wrote fails without being compared.
    """
    fresh = files(t).filter((F.col("size") > 45) & (F.col("partkey") % 7 == 0)).groupBy("module").agg(F.count(F.lit(1)).alias("fresh"))  # god files that the baseline doesn't list
    x = gated_metrics(t).join(fresh, "module", "left")
    rules = (
        ("quality_degraded", F.col("signal") < F.col("signal") + (F.col("modeled") % 5 - 2) * 100), ("coupling_increased", F.col("coupling") > F.col("coupling") - F.col("modeled") % 3 + 1),
        ("cycles_increased", F.col("cycles") > 1), ("god_files_increased", F.col("fresh") > 0),
    )
    broken = F.concat_ws(",", *(F.when(over, name) for name, over in rules))
    missing, other = F.col("module").endswith("7"), F.col("module").endswith("5")
    verdict = F.when(missing, "baseline_missing").when(other, "baseline_engine_mismatch").when(broken == "", "pass").otherwise(broken)
    return x.select("module", verdict.alias("verdict"), (~missing).alias("governed"))


_IMPACT = _RISK + """, m3 AS (SELECT t.module, coupling, blast, gap, risk FROM t JOIN risk USING (module)),
  w AS (SELECT 1 AS o, 'current_max_cc_gate' AS scenario, path AS target, CAST(size AS BIGINT) AS value, CAST(25 AS BIGINT) AS bound, NULL::BIGINT AS risk FROM files WHERE size > 25 UNION ALL SELECT 2, 'module_coupling_cap', module, coupling, 76, risk FROM m3 WHERE coupling > 76
  UNION ALL SELECT 3, 'blast_radius_cap', module, blast, 78, risk FROM m3 WHERE blast > 78 UNION ALL SELECT 4, 'test_gap_gate', module, gap, 0, risk FROM m3 WHERE gap > 0)"""
# Scenarios in order with their limits; the third is the second's plus two.
SCENARIOS = (("current_max_cc_gate", 25), ("module_coupling_cap", 76), ("blast_radius_cap", 78), ("test_gap_gate", 0))


def what_if(t: Tables) -> DataFrame:
    """scenario, target, value, limit, over: all that fails each scenario."""
    m = modules(t).select("module", "coupling", "test_gap").join(blast_radius(module_edges(t)), "module", "left")
    long = [files(t).select(F.col("path").alias("target"), F.col("size").alias("value")), *(m.select(F.col("module").alias("target"), F.coalesce(c, F.lit(0)).cast("long").alias("value")) for c in ("coupling", "blast_radius", "test_gap"))]
    some = [df.filter(F.col("value") > limit).select(F.lit(name).alias("scenario"), "target", "value", F.lit(limit).cast("long").alias("bound")) for df, (name, limit) in zip(long, SCENARIOS, strict=True)]
    return reduce(DataFrame.unionByName, some).withColumn("over", F.col("value") - F.col("bound"))


@query(_IMPACT + " SELECT scenario, target, value, bound, value - bound AS over FROM w")
def j03_what_if(t: Tables) -> DataFrame:
    """Everything over the limit of each of four scenarios: complexity, coupling, blast radius (the coupling limit and two) and test gap (also f09)."""
    return what_if(t)


# All scenarios with the severity of failing each; ceilings of complexity, and the risk from which a module's knowledge is in too few heads.
WHAT_IF = (("current_max_cc_gate", "high"), ("strict_max_cc_gate", "medium"), ("hard_max_cc_gate", "medium"), ("module_coupling_cap", "high"), ("blast_radius_cap", "high"), ("test_gap_gate", "medium"), ("god_file_gate", "high"), ("bus_factor_gate", "medium"), ("pollution_gate", "medium"))
STRICT_CC, HARD_CC, GOD_SIZE, BUS_RISK, SHOWN = 15, 10, 45, 45, 20
_EXTENDED = _IMPACT + f""", au AS (SELECT module, author, count(*) AS touches FROM commit_files JOIN commits USING (hash) GROUP BY 1, 2), bus AS (SELECT module, CAST(least(100, greatest(0, round_even(55 / count(*) + 45 * max(touches) / sum(touches), 0))) AS BIGINT) AS value FROM au GROUP BY 1),
  polluted AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages),
  w9 AS (SELECT scenario, target, value, bound FROM w UNION ALL SELECT 'strict_max_cc_gate', path, CAST(size AS BIGINT), {STRICT_CC} FROM files WHERE size > {STRICT_CC} UNION ALL SELECT 'hard_max_cc_gate', path, CAST(size AS BIGINT), {HARD_CC} FROM files WHERE size > {HARD_CC}
    UNION ALL SELECT 'god_file_gate', path, CAST(size AS BIGINT), {GOD_SIZE} FROM files WHERE size > {GOD_SIZE} UNION ALL SELECT 'bus_factor_gate', module, value, {BUS_RISK} FROM bus WHERE value >= {BUS_RISK}
    UNION ALL SELECT 'pollution_gate', path, CAST(count(*) AS BIGINT), 0 FROM polluted WHERE regexp_matches(path, '(^|/)(static|public|dist|build)(/|$)') GROUP BY path),
  scen(o, scenario, severity) AS (VALUES {", ".join(f"({i}, '{n}', '{sev}')" for i, (n, sev) in enumerate(WHAT_IF))}), ranked AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY value DESC, target) AS k FROM w9),
  n AS (SELECT scen.o, scen.scenario, any_value(severity) AS severity, count(r.target) AS failing, coalesce(string_agg(r.target, ',' ORDER BY k) FILTER (WHERE k <= {SHOWN}), '') AS affected FROM scen LEFT JOIN ranked r USING (scenario) GROUP BY 1, 2)"""


@query(_EXTENDED + " SELECT scenario, failing, failing = 0 AS pass, CASE WHEN failing = 0 THEN 'ok' ELSE severity END AS severity, affected, coalesce(o = (SELECT min(o) FROM n WHERE failing > 0), false) AS primary_risk FROM n")
def l08_what_if_summary(t: Tables) -> DataFrame:
    """Nine scenarios, with stricter ceilings of complexity, god files, knowledge in few heads and pollution beside j03's four: how many fail each, the worst twenty, and the first that fails as the primary risk."""
    f = files(t).select(F.col("path").alias("target"), F.col("size").alias("value"))
    over = lambda df, name, limit, least=False: df.filter(F.col("value") >= limit if least else F.col("value") > limit).select(F.lit(name).alias("scenario"), "target", "value")
    authors = commit_files(t).select("hash", "module").join(commits(t).select("hash", "author"), "hash").groupBy("module", "author").agg(F.count(F.lit(1)).alias("touches"))
    risk = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.bround(55 / F.count(F.lit(1)) + 45 * F.max("touches") / F.sum("touches"), 0)))
    bus = authors.groupBy(F.col("module").alias("target")).agg(risk.cast("long").alias("value"))
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    polluted = t.pages.select(path.alias("target")).filter(F.col("target").rlike("(^|/)(static|public|dist|build)(/|$)")).groupBy("target").agg(F.count(F.lit(1)).alias("value"))
    some = (what_if(t).select("scenario", "target", "value"), over(f, "strict_max_cc_gate", STRICT_CC), over(f, "hard_max_cc_gate", HARD_CC), over(f, "god_file_gate", GOD_SIZE), over(bus, "bus_factor_gate", BUS_RISK, True), over(polluted, "pollution_gate", 0))
    found = settled(reduce(DataFrame.unionByName, some))
    worst = found.withColumn("k", F.row_number().over(W.partitionBy("scenario").orderBy(F.desc("value"), "target"))).filter(F.col("k") <= SHOWN)
    shown = worst.groupBy("scenario").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "target"))), lambda x: x["target"]), ",").alias("affected"))  # SHOWN at most
    names = t.spark.createDataFrame([(i, name, severity) for i, (name, severity) in enumerate(WHAT_IF)], "o int, scenario string, severity string")
    n = settled(names.join(found.groupBy("scenario").agg(F.count(F.lit(1)).alias("failing")), "scenario", "left").join(shown, "scenario", "left").fillna(0, ["failing"]).fillna("", ["affected"]))
    first = n.filter("failing > 0").agg(F.min("o").alias("first"))
    ok = F.col("failing") == 0
    return n.crossJoin(first).select("scenario", "failing", ok.alias("pass"), F.when(ok, "ok").otherwise(F.col("severity")).alias("severity"), "affected", F.coalesce(F.col("o") == F.col("first"), F.lit(False)).alias("primary_risk"))  # one row


# The cascade as (diagnosis, status, protocol, disposition, verdict), first match wins.
CASCADE = (
    ("local tool failure", "unknown", "triage", "admit", "unknown"),
    ("provider quota exhausted", "unknown", "triage", "admit", "unknown"),
    ("architecture gate failure", "red", "govern", "admit", "fail"),
    ("architecture graph missing", "unknown", "diagnose", "admit", "unknown"),
    ("authoritative structural evidence unavailable", "unknown", "diagnose", "admit", "unknown"),
    ("ungoverned structural scope", "amber", "govern", "admit", "fail"),
    ("known modernization debt", "amber", "surgery_plan", "admit", "fail"),
    ("clean snapshot", "green", "post_op", "observe", "pass"),
)
_CASE = """WITH e AS (SELECT o_orderkey AS case_id, o_orderstatus AS s, o_orderpriority AS p, o_totalprice AS v, o_custkey % 4 AS c, count(l_orderkey) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
  d AS (SELECT case_id, CASE WHEN p = '1-URGENT' AND s = 'P' THEN 0 WHEN p = '2-HIGH' AND s = 'P' THEN 1 WHEN n > 0 AND s = 'F' AND r > 2 THEN 2 WHEN n = 0 OR v > 450000 THEN 3 WHEN c < 3 AND (n < 2 OR s = 'P') THEN 4 WHEN c < 3 AND p = '3-MEDIUM' THEN 5 WHEN r > 0 THEN 6 ELSE 7 END AS k FROM e)"""


@query(_CASE + ", m(k, diagnosis, status, protocol, disposition, verdict) AS (VALUES " + ", ".join(f"({i}, {', '.join(map(repr, x))})" for i, x in enumerate(CASCADE)) + ") SELECT case_id, diagnosis, status, protocol, disposition, verdict FROM d JOIN m USING (k)")
def j04_diagnosis(t: Tables) -> DataFrame:
    """Diagnosis by the first of eight rules, with status, protocol, disposition and verdict."""
    seen = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    e = t.orders.join(seen, "o_orderkey", "left").fillna(0, ["n", "r"])
    s, p, n, r, scope = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("n"), F.col("r"), F.col("o_custkey") % 4 < 3
    rules = ((p == "1-URGENT") & (s == "P"), (p == "2-HIGH") & (s == "P"), (n > 0) & (s == "F") & (r > 2), (n == 0) | (F.col("o_totalprice") > 450000), scope & ((n < 2) | (s == "P")), scope & (p == "3-MEDIUM"), r > 0)
    made = lambda row: F.struct(*(F.lit(v).alias(c) for v, c in zip(row, ("diagnosis", "status", "protocol", "disposition", "verdict"), strict=True)))
    out = reduce(lambda w, x: w.when(x[0], made(x[1])), zip(rules[1:], CASCADE[1:], strict=False), F.when(rules[0], made(CASCADE[0]))).otherwise(made(CASCADE[-1]))
    return e.select(F.col("o_orderkey").alias("case_id"), out.alias("x")).select("case_id", "x.*")


@query("""WITH s AS (SELECT o_custkey AS fact, list_distinct(list(o_orderpriority)) AS have FROM orders GROUP BY 1) SELECT fact, CASE WHEN len(list_intersect(have, ['1-URGENT', '2-HIGH'])) = 0 THEN 'none' WHEN list_contains(have, '5-LOW') THEN 'unknown' ELSE 'proposal' END AS method, CASE WHEN len(list_intersect(have, ['1-URGENT', '2-HIGH'])) > 1 THEN 'high' ELSE 'low' END AS confidence FROM s""")
def j07_method_selection(t: Tables) -> DataFrame:
    """Method proposed from signals, unless contraindicated; sure with more than one match."""
    s = t.orders.groupBy(F.col("o_custkey").alias("fact")).agg(F.collect_set("o_orderpriority").alias("have"))
    hits = F.size(F.array_intersect("have", F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))))
    return s.select("fact", F.when(hits == 0, "none").when(F.array_contains("have", "5-LOW"), "unknown").otherwise("proposal").alias("method"), F.when(hits > 1, "high").otherwise("low").alias("confidence"))


@query(with_views("commits") + """ SELECT hash, CASE WHEN (SELECT max(ts) FROM commits) - ts > 700 * 86400 THEN 'rejected_stale' WHEN author % 7 = 0 THEN 'rejected_mismatch' WHEN starts_with(subject, 'fix') AND hash % 2 = 0 THEN 'observed' ELSE 'unknown' END AS verdict, sha256(hash || '|' || ts || '|' || subject) AS identity FROM commits""")
def j10_evidence_admission(t: Tables) -> DataFrame:
    """Admission of observations by age and origin, observed only if complete, with a content identity."""
    log = commits(t)
    aged = log.crossJoin(F.broadcast(log.agg(F.max("ts").alias("now"))))
    verdict = F.when(F.col("now") - F.col("ts") > 700 * DAY, "rejected_stale").when(F.col("author") % 7 == 0, "rejected_mismatch").when(F.col("subject").startswith("fix") & (F.col("hash") % 2 == 0), "observed").otherwise("unknown")
    return aged.select("hash", verdict.alias("verdict"), F.sha2(F.concat_ws("|", F.col("hash").cast("string"), F.col("ts").cast("string"), "subject"), 256).alias("identity"))


# Reasons in the order of their checks.
CHECKS = ("not_discovered", "endpoint_not_configured", "executable_not_verified", "authentication_absent", "authentication_unverified", "model_not_available", "external_data_not_authorized", "consumption_scope_not_authorized", "paid_spend_not_authorized")


@query("""WITH e AS (SELECT n_name AS workload, s_suppkey AS candidate, s_suppkey % 5 = 0 AS pinned, CASE WHEN s_suppkey % 19 = 1 THEN 0 WHEN s_suppkey % 2 = 0 AND s_suppkey % 17 = 2 THEN 1 WHEN s_suppkey % 13 = 3 THEN 2 WHEN s_acctbal < -500 THEN 3 WHEN s_acctbal < 0 THEN 4 WHEN s_suppkey % 11 = 4 THEN 5
    WHEN n_regionkey = 1 AND s_suppkey % 3 = 0 THEN 6 WHEN s_suppkey % 7 = 5 THEN 7 WHEN s_acctbal > 9000 THEN 8 END AS failed FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  r AS (SELECT *, row_number() OVER (PARTITION BY workload ORDER BY pinned DESC, candidate) AS attempt, min(CASE WHEN failed IS NULL THEN (CASE WHEN pinned THEN 0 ELSE 1 END, candidate) END) OVER (PARTITION BY workload) AS best, count(*) FILTER (WHERE pinned) OVER (PARTITION BY workload) AS pins FROM e)
  SELECT workload, candidate, attempt, coalesce([""" + ", ".join(f"'{c}'" for c in CHECKS) + """][failed + 1], 'eligible') AS reason, coalesce(best = (CASE WHEN pinned THEN 0 ELSE 1 END, candidate), false) AS chosen, coalesce(best = (CASE WHEN pinned THEN 0 ELSE 1 END, candidate), false) AND NOT pinned AND pins > 0 AS fallback FROM r""")
def j12_candidate_routing(t: Tables) -> DataFrame:
    """Candidates by nine ordered checks; pinned ones are tried first, one that isn't is a fallback only after all pinned have failed."""
    e = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    k, b = F.col("s_suppkey"), F.col("s_acctbal")
    fails = (k % 19 == 1, (k % 2 == 0) & (k % 17 == 2), k % 13 == 3, b < -500, b < 0, k % 11 == 4, (F.col("n_regionkey") == 1) & (k % 3 == 0), k % 7 == 5, b > 9000)
    reason = reduce(lambda w, x: w.when(x[0], x[1]), zip(fails[1:], CHECKS[1:], strict=True), F.when(fails[0], CHECKS[0])).otherwise("eligible")
    e = e.select(F.col("n_name").alias("workload"), k.alias("candidate"), (k % 5 == 0).alias("pinned"), reason.alias("reason"))
    order = F.struct((~F.col("pinned")).alias("late"), "candidate")
    by = W.partitionBy("workload")
    best = F.min(F.when(F.col("reason") == "eligible", order)).over(by)
    chosen = F.coalesce(best == order, F.lit(False))
    return e.select("workload", "candidate", F.row_number().over(by.orderBy(F.desc("pinned"), "candidate")).cast("long").alias("attempt"), "reason", chosen.alias("chosen"), (chosen & ~F.col("pinned") & F.bool_or("pinned").over(by)).alias("fallback"))


@query("""WITH k AS (SELECT o_orderkey, o_custkey AS branch, count(*) OVER (PARTITION BY o_custkey, o_orderdate) AS same, o_totalprice AS p FROM orders) SELECT branch, count(*) FILTER (WHERE same > 1) AS duplicates, count(*) FILTER (WHERE same = 1 AND p < 450000) AS accepted, count(*) FILTER (WHERE same = 1 AND p >= 450000) AS rejected FROM k GROUP BY 1""")
def j13_transition_batch(t: Tables) -> DataFrame:
    """Accepted and rejected transitions per branch; duplicates are rejected by themselves."""
    one = t.orders.groupBy(F.col("o_custkey").alias("branch"), "o_orderdate").agg(F.count(F.lit(1)).alias("same"), F.max("o_totalprice").alias("p"))
    alone, fine = F.col("same") == 1, F.col("p") < 450000
    return one.groupBy("branch").agg(F.coalesce(F.sum(F.when(~alone, F.col("same"))), F.lit(0)).alias("duplicates"), F.count_if(alone & fine).alias("accepted"), F.count_if(alone & ~fine).alias("rejected"))


# What stands in the way of a retirement, in order.
BLOCKERS = ("open", "owes", "unused", "partial", "recent", "large")


@query("""WITH b AS (SELECT c_custkey, c_acctbal < 0 AS owes, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(o_orderkey) AS n, count(*) FILTER (WHERE o_orderstatus = 'P') AS partial, count(*) FILTER (WHERE year(o_orderdate) >= 1998) AS recent, coalesce(max(o_totalprice), 0) > 300000 AS large FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
  SELECT c_custkey, concat_ws(',', CASE WHEN open > 0 THEN 'open' END, CASE WHEN owes THEN 'owes' END, CASE WHEN n = 0 THEN 'unused' END, CASE WHEN partial > 0 THEN 'partial' END, CASE WHEN recent > 0 THEN 'recent' END, CASE WHEN large THEN 'large' END) AS blockers, open = 0 AND NOT owes AND n > 0 AND partial = 0 AND recent = 0 AND NOT large AS approved FROM b""")
def j15_retirement_gate(t: Tables) -> DataFrame:
    """All blockers of a retirement by six checks; none means approved."""
    s = F.col("o_orderstatus")
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(s == "O").alias("open"), F.count(F.lit(1)).alias("n"), F.count_if(s == "P").alias("partial"), F.count_if(F.year("o_orderdate") >= 1998).alias("recent"), F.max("o_totalprice").alias("most"))
    b = t.customer.select("c_custkey", "c_acctbal").join(o, "c_custkey", "left").fillna(0, ["open", "n", "partial", "recent", "most"])
    holds = (F.col("open") > 0, F.col("c_acctbal") < 0, F.col("n") == 0, F.col("partial") > 0, F.col("recent") > 0, F.col("most") > 300000)
    blockers = F.concat_ws(",", *(F.when(h, name) for h, name in zip(holds, BLOCKERS, strict=True)))
    return b.select("c_custkey", blockers.alias("blockers"), (blockers == "").alias("approved"))


# What each profile asks of the providers repowise, understand, graph, sentrux, codenexus and open_spec.
PROVIDERS = ("repowise", "understand", "graph", "sentrux", "codenexus", "open_spec")
PROFILES = {
    "default": ("optional", "optional", "required", "optional", "optional", "optional"),
    "strict": ("required",) * 6,
    "compatibility": ("required", "optional", "required", "required", "required", "required"),
    "offline": ("disabled",) * 6,
}


@query("WITH g(profile, provider, base) AS (VALUES " + ", ".join(f"('{p}', '{v}', '{x}')" for p, xs in PROFILES.items() for v, x in zip(PROVIDERS, xs, strict=True)) + """), r AS (SELECT p_partkey AS run, ['default', 'strict', 'compatibility', 'offline'][p_partkey % 4 + 1] AS profile, p_size % 2 = 0 AS lite, p_size % 3 = 0 AS skip_repowise, p_size % 5 = 0 AS skip_sentrux, p_size % 7 = 0 AS skip_spec, p_size % 11 = 0 AS need_understand FROM part)
  SELECT run, provider, CASE WHEN base = 'optional' AND (provider = 'sentrux' AND (lite OR skip_sentrux) OR provider = 'repowise' AND skip_repowise OR provider = 'open_spec' AND skip_spec) THEN 'disabled' WHEN base = 'optional' AND provider = 'understand' AND need_understand THEN 'required' ELSE base END AS policy FROM r JOIN g USING (profile)""")
def j18_execution_policy(t: Tables) -> DataFrame:
    """What a run asks of each provider: its profile's table; a mode or a skip may only narrow what is optional, one switch makes it required."""
    table = t.spark.createDataFrame([(p, v, x) for p, xs in PROFILES.items() for v, x in zip(PROVIDERS, xs, strict=True)], "profile string, provider string, base string")
    n = F.col("p_size")
    r = t.part.select(F.col("p_partkey").alias("run"), F.get(F.array(*map(F.lit, PROFILES)), (F.col("p_partkey") % 4).cast("int")).alias("profile"), (n % 2 == 0).alias("lite"), *((n % d == 0).alias(c) for d, c in ((3, "skip_repowise"), (5, "skip_sentrux"), (7, "skip_spec"), (11, "need_understand"))))
    v = F.col("provider")
    skipped = ((v == "sentrux") & (F.col("lite") | F.col("skip_sentrux"))) | ((v == "repowise") & F.col("skip_repowise")) | ((v == "open_spec") & F.col("skip_spec"))
    optional = F.col("base") == "optional"
    policy = F.when(optional & skipped, "disabled").when(optional & (v == "understand") & F.col("need_understand"), "required").otherwise(F.col("base"))
    return r.join(F.broadcast(table), "profile").select("run", "provider", policy.alias("policy"))  # 24 fixed rows


@query("""SELECT lang, concat_ws(';', CASE WHEN max(n_chars) > 20000 THEN 'truncated' END, CASE WHEN count(*) > 200 THEN 'cap_hit' END, CASE WHEN min(n_chars) < 10 THEN 'unreadable_input' END) AS scope, CASE WHEN max(n_chars) > 20000 OR count(*) > 200 OR min(n_chars) < 10 THEN 'partial' ELSE 'complete' END AS claim FROM documents GROUP BY 1""")
def j20_completeness(t: Tables) -> DataFrame:
    """Completeness claimed for a source, with what limits it."""
    s = t.documents.groupBy("lang").agg(F.max("n_chars").alias("m"), F.count(F.lit(1)).alias("n"), F.min("n_chars").alias("least"))
    scope = F.concat_ws(";", F.when(F.col("m") > 20000, "truncated"), F.when(F.col("n") > 200, "cap_hit"), F.when(F.col("least") < 10, "unreadable_input"))
    return s.select("lang", scope.alias("scope"), F.when(scope == "", "complete").otherwise("partial").alias("claim"))


@query("SELECT p_brand AS module, string_agg(DISTINCT 'cargo test -p ' || lower(p_type), ' && ' ORDER BY 'cargo test -p ' || lower(p_type)) AS command FROM part WHERE p_size % 7 = 0 GROUP BY 1")
def j23_test_commands(t: Tables) -> DataFrame:
    """Sorted set of test commands per module."""
    command = F.concat(F.lit("cargo test -p "), F.lower("p_type"))
    return t.part.filter("p_size % 7 = 0").groupBy(F.col("p_brand").alias("module")).agg(F.array_join(F.array_sort(F.collect_set(command)), " && ").alias("command"))


@query("""WITH code AS (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_returnflag = 'R'), decl AS (SELECT s_suppkey AS id, s_acctbal FROM supplier WHERE s_suppkey % 10 <> 3 UNION ALL SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey % 10 = 5), d AS (SELECT id, any_value(s_acctbal) AS s_acctbal, count(*) AS n FROM decl GROUP BY 1)
  SELECT id, 'undeclared' AS finding FROM code ANTI JOIN d USING (id) UNION ALL SELECT id, 'missing' FROM d ANTI JOIN code USING (id) UNION ALL SELECT id, 'duplicate' FROM d WHERE n > 1 UNION ALL SELECT id, 'drifted' FROM d JOIN code USING (id) WHERE s_acctbal < 0""")
def j26_registry_audit(t: Tables) -> DataFrame:
    """Participants in code against declarations, both ways, those declared twice, and drifted ones."""
    code = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("id")).distinct().withColumn("used", F.lit(True))
    s = t.supplier.select(F.col("s_suppkey").alias("id"), "s_acctbal")
    declared = s.filter("id % 10 <> 3").union(s.filter("id % 10 = 5")).groupBy("id").agg(F.first("s_acctbal").alias("balance"), F.count(F.lit(1)).alias("n"))
    used, known = F.col("used").isNotNull(), F.col("n").isNotNull()
    findings = F.filter(F.array(F.when(~known, "undeclared"), F.when(~used, "missing"), F.when(F.col("n") > 1, "duplicate"), F.when(known & used & (F.col("balance") < 0), "drifted")), lambda x: x.isNotNull())
    return code.join(declared, "id", "full").select("id", F.explode(findings).alias("finding"))


@query("""WITH r AS (SELECT o_orderkey AS id, o_orderdate AS asked FROM orders), a AS (SELECT l_orderkey AS id, min(l_shipdate) AS answered, count(*) AS n FROM lineitem GROUP BY 1)
  SELECT CASE WHEN a.id IS NULL THEN 'pending' WHEN answered < asked THEN 'error_early' WHEN answered > asked + INTERVAL 60 DAY THEN 'timeout' ELSE 'resolved' END AS state, count(*) AS n FROM r LEFT JOIN a USING (id) GROUP BY 1""")
def j28_request_correlation(t: Tables) -> DataFrame:
    """State of requests by their first response and its time."""
    answers = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("answered"))
    late = F.col("answered") > F.col("o_orderdate") + F.expr("INTERVAL 60 DAY")
    state = F.when(F.col("answered").isNull(), "pending").when(F.col("answered") < F.col("o_orderdate"), "error_early").when(late, "timeout").otherwise("resolved")
    return t.orders.join(answers, "o_orderkey", "left").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'language' AS kind, lang AS name, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'boundary', split_part(path, '/', 1), count(*) FROM (SELECT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages) GROUP BY 2
  UNION ALL SELECT 'entry', split_part(path, '/', -1), count(*) FROM (SELECT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages) WHERE regexp_matches(split_part(path, '/', -1), '^[0-9]*0$') GROUP BY 2
  UNION ALL SELECT 'risk', p_brand, count(*) FROM part WHERE p_size > 45 GROUP BY 2 UNION ALL SELECT 'unknown', source, count(*) FROM documents ANTI JOIN labels USING (doc_id) GROUP BY 2""")
def j06_orientation(t: Tables) -> DataFrame:
    """Orientation in one relation: languages, top folders, entry points, risks and what nothing is known of, with their numbers."""
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    parts = F.split(path, "/")
    leaf = F.element_at(parts, -1)
    counted = lambda df, kind, name: df.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    some = (
        counted(t.documents, "language", F.col("lang")),
        counted(t.pages, "boundary", parts[0]),
        counted(t.pages.filter(leaf.rlike("^[0-9]*0$")), "entry", leaf),
        counted(t.part.filter("p_size > 45"), "risk", F.col("p_brand")),
        counted(t.documents.join(t.labels.select("doc_id"), "doc_id", "left_anti"), "unknown", F.col("source")),
    )
    return reduce(DataFrame.unionByName, some)


@query("""WITH s AS (SELECT o_orderkey AS id, o_custkey % 9 = 0 AS other, date_diff('day', CAST(o_orderdate AS DATE), (SELECT CAST(max(o_orderdate) AS DATE) FROM orders)) > 900 AS old, CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'O' THEN 'failed' ELSE 'unknown' END AS tests, CASE WHEN o_orderpriority = '1-URGENT' THEN 'failed' ELSE 'passed' END AS build,
    CASE WHEN o_totalprice > 400000 THEN 'degraded' WHEN o_totalprice > 10000 THEN 'healthy' ELSE 'unknown' END AS runtime, o_custkey % 4 <> 1 AS complete FROM orders)
  SELECT id, CASE WHEN other THEN 'snapshot_mismatch' WHEN old THEN 'stale' ELSE 'current' END AS freshness, CASE WHEN other OR old THEN 'unknown' WHEN tests = 'failed' OR build = 'failed' OR runtime = 'degraded' THEN 'red' WHEN complete AND tests = 'passed' AND build = 'passed' AND runtime = 'healthy' THEN 'green' ELSE 'unknown' END AS health,
  CASE WHEN other THEN 'snapshot_mismatch' WHEN old THEN 'stale' WHEN tests = 'failed' OR build = 'failed' OR runtime = 'degraded' THEN 'observed_failure' WHEN complete AND tests = 'passed' AND build = 'passed' AND runtime = 'healthy' THEN 'none' ELSE 'partial_coverage' END AS failure FROM s""")
def j11_runtime_health(t: Tables) -> DataFrame:
    """Health from tests, build and runtime: of another snapshot or stale is rejected, any failure is red, all positive and complete is green, else unknown."""
    now = t.orders.agg(F.max("o_orderdate").alias("now"))
    s, v = F.col("o_orderstatus"), F.col("o_totalprice")
    x = t.orders.crossJoin(F.broadcast(now)).select(  # one row
        F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 9 == 0, "snapshot_mismatch").when(F.datediff(F.to_date("now"), F.to_date("o_orderdate")) > 900, "stale").otherwise("current").alias("freshness"),
        ((s == "O") | (F.col("o_orderpriority") == "1-URGENT") | (v > 400000)).alias("failed"), ((F.col("o_custkey") % 4 != 1) & (s == "F") & (F.col("o_orderpriority") != "1-URGENT") & (v > 10000) & (v <= 400000)).alias("positive"),
    )
    current = F.col("freshness") == "current"
    health = F.when(~current, "unknown").when(F.col("failed"), "red").when(F.col("positive"), "green").otherwise("unknown")
    failure = F.when(~current, F.col("freshness")).when(F.col("failed"), "observed_failure").when(F.col("positive"), "none").otherwise("partial_coverage")
    return x.select("id", "freshness", health.alias("health"), failure.alias("failure"))


@query("""WITH c AS (SELECT o_orderkey AS k, o_custkey AS event, o_custkey || '|' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS id, o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' AS removes, o_totalprice > 200000 AS against, o_orderkey % 3 = 0 AS bypass FROM orders),
  d AS (SELECT *, count(*) OVER (PARTITION BY id) > 1 AS twice FROM c), e AS (SELECT *, NOT twice AND NOT removes AND against AND bypass AS asks FROM d), f AS (SELECT *, asks AND row_number() OVER (PARTITION BY event, asks ORDER BY k) = 1 AS granted FROM e)
  SELECT k, CASE WHEN twice OR removes THEN 'rejected' WHEN granted THEN 'bypassed' WHEN against OR bypass THEN 'rejected' ELSE 'accepted' END AS status, CASE WHEN twice THEN 'duplicate' WHEN removes THEN 'protection_removed' WHEN granted THEN 'policy' WHEN against AND bypass THEN 'event_consumed' WHEN against THEN 'policy' WHEN bypass THEN 'needless_bypass' ELSE 'none' END AS reason FROM f""")
def j14_minimalism_gate(t: Tables) -> DataFrame:
    """Changes accepted, bypassed or rejected: repeated and protection-removing ones never pass, a bypass needs a policy rejection and an event that no earlier change has used."""
    c = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("event"), F.concat_ws("|", F.col("o_custkey").cast("string"), F.to_date("o_orderdate").cast("string")).alias("id"), ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")).alias("removes"), (F.col("o_totalprice") > 200000).alias("against"), (F.col("o_orderkey") % 3 == 0).alias("bypass"))
    twice = c.groupBy("id").agg((F.count(F.lit(1)) > 1).alias("twice"))
    d = c.join(twice, "id").withColumn("asks", ~F.col("twice") & ~F.col("removes") & F.col("against") & F.col("bypass"))
    first = d.filter("asks").groupBy("event").agg(F.min("k").alias("first"))
    e = d.join(first, "event", "left").withColumn("granted", F.col("asks") & (F.col("k") == F.col("first")))
    hard, granted, against, bypass = F.col("twice") | F.col("removes"), F.col("granted"), F.col("against"), F.col("bypass")
    status = F.when(hard, "rejected").when(granted, "bypassed").when(against | bypass, "rejected").otherwise("accepted")
    reason = F.when(F.col("twice"), "duplicate").when(F.col("removes"), "protection_removed").when(granted, "policy").when(against & bypass, "event_consumed").when(against, "policy").when(bypass, "needless_bypass").otherwise("none")
    return e.select("k", status.alias("status"), reason.alias("reason"))


# Kinds in the order of a dossier.
KINDS = ("PROMO", "STANDARD", "MEDIUM", "SMALL", "ECONOMY", "LARGE")


@query("WITH d AS (SELECT p_brand AS gap, p_name AS id, coalesce(list_position([" + ", ".join(f"'{k}'" for k in KINDS) + "], p_type), 99) AS kind, count(*) AS n FROM part GROUP BY ALL) SELECT gap, id, CAST(kind AS INTEGER) AS kind, row_number() OVER (PARTITION BY gap ORDER BY kind, id) AS place, n > 1 OR count(*) OVER (PARTITION BY gap, id) > 1 AS duplicate FROM d")
def j16_dossier_order(t: Tables) -> DataFrame:
    """Candidates for each gap by kind, then name; a name that comes twice is an error and marked."""
    at = F.array_position(F.array(*map(F.lit, KINDS)), F.col("p_type")).cast("int")
    d = t.part.groupBy(F.col("p_brand").alias("gap"), F.col("p_name").alias("id"), F.when(at > 0, at).otherwise(99).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    by = W.partitionBy("gap")
    return d.select("gap", "id", "kind", F.row_number().over(by.orderBy("kind", "id")).cast("long").alias("place"), ((F.col("n") > 1) | (F.count(F.lit(1)).over(W.partitionBy("gap", "id")) > 1)).alias("duplicate"))


@query("""SELECT s_suppkey AS provider, CASE WHEN s_suppkey % 3 = 0 OR s_acctbal > 0 THEN 'present' ELSE 'missing' END AS presence, CASE WHEN s_suppkey % 3 = 0 AND s_acctbal <= 0 OR s_suppkey % 2 = 0 AND s_suppkey % 5 <> 0 THEN 'ready' ELSE 'unavailable' END AS readiness,
  CASE WHEN s_acctbal > 0 AND NOT (s_suppkey % 2 = 0 AND s_suppkey % 5 <> 0) THEN 'nonconforming' WHEN s_suppkey % 3 = 0 OR s_acctbal > 0 THEN 'conforming' ELSE 'not_evaluated' END AS conformance FROM supplier""")
def j19_provider_readiness(t: Tables) -> DataFrame:
    """Presence, readiness and conformance of a provider that is built in or outside: one outside must conform even where the other would do."""
    k = F.col("s_suppkey")
    builtin, outside, parts = k % 3 == 0, F.col("s_acctbal") > 0, (k % 2 == 0) & (k % 5 != 0)
    there = builtin | outside
    return t.supplier.select(k.alias("provider"), F.when(there, "present").otherwise("missing").alias("presence"), F.when((builtin & ~outside) | parts, "ready").otherwise("unavailable").alias("readiness"), F.when(outside & ~parts, "nonconforming").when(there, "conforming").otherwise("not_evaluated").alias("conformance"))


@query("""WITH r AS (SELECT o_custkey AS k, count(DISTINCT o_orderpriority) FILTER (WHERE o_orderpriority <> '4-NOT SPECIFIED') AS known, bool_or(o_orderpriority = '4-NOT SPECIFIED') AS unsupported, bool_and(o_orderpriority = '4-NOT SPECIFIED' OR o_orderstatus <> 'P') AS evaluated, max(o_orderdate) AS seen, bool_or(o_totalprice > 480000) AS crashed FROM orders GROUP BY 1),
  x AS (SELECT *, NOT crashed AND NOT unsupported AND evaluated AND known >= 2 AS complete FROM r) SELECT k, CASE WHEN complete THEN 'complete' ELSE 'partial' END AS completeness, CASE WHEN crashed THEN 'crashed' WHEN complete THEN 'none' ELSE 'domain_unknown' END AS failure, CASE WHEN k % 8 = 0 THEN 'snapshot_mismatch' WHEN date_diff('day', CAST(seen AS DATE), (SELECT CAST(max(o_orderdate) AS DATE) FROM orders)) <= 365 THEN 'current' ELSE 'stale' END AS freshness FROM x""")
def j21_structural_status(t: Tables) -> DataFrame:
    """Structural verdicts brought to one form: complete only if nothing crashed, no rule is unsupported, all known ones ran and enough are known."""
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    odd = p == "4-NOT SPECIFIED"
    r = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count_distinct(F.when(~odd, p)).alias("known"), F.bool_or(odd).alias("unsupported"), F.bool_and(odd | (s != "P")).alias("evaluated"), F.max("o_orderdate").alias("seen"), F.bool_or(F.col("o_totalprice") > 480000).alias("crashed"))
    x = r.crossJoin(F.broadcast(t.orders.agg(F.max("o_orderdate").alias("now"))))  # one row
    complete = ~F.col("crashed") & ~F.col("unsupported") & F.col("evaluated") & (F.col("known") >= 2)
    fresh = F.when(F.col("k") % 8 == 0, "snapshot_mismatch").when(F.datediff(F.to_date("now"), F.to_date("seen")) <= 365, "current").otherwise("stale")
    return x.select("k", F.when(complete, "complete").otherwise("partial").alias("completeness"), F.when(F.col("crashed"), "crashed").when(complete, "none").otherwise("domain_unknown").alias("failure"), fresh.alias("freshness"))


@query("""WITH g AS (SELECT c_custkey AS k, c_acctbal, count(o_orderkey) AS n, count(*) FILTER (WHERE o_orderstatus = 'P') AS partial FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
  SELECT k, CASE WHEN n = 0 THEN 'missing' WHEN partial > 0 THEN 'partial' ELSE 'current' END AS status, CASE WHEN n > 0 AND partial = 0 THEN 'complete' ELSE 'partial' END AS completeness, CASE WHEN n = 0 THEN 'provider_unavailable' WHEN partial > 0 THEN 'domain_unknown' ELSE 'none' END AS failure, CASE WHEN (n = 0 OR partial > 0) AND c_acctbal > 0 THEN k % 10 END AS fallback FROM g""")
def j22_graph_provider(t: Tables) -> DataFrame:
    """A graph provider's answer brought to one form: current, partial or missing, what failed, and the fallback where one is named."""
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("partial"))
    g = t.customer.select("c_custkey", "c_acctbal").join(o, "c_custkey", "left").fillna(0, ["n", "partial"])
    none, some = F.col("n") == 0, F.col("partial") > 0
    return g.select(F.col("c_custkey").alias("k"), F.when(none, "missing").when(some, "partial").otherwise("current").alias("status"), F.when(none | some, "partial").otherwise("complete").alias("completeness"), F.when(none, "provider_unavailable").when(some, "domain_unknown").otherwise("none").alias("failure"), F.when((none | some) & (F.col("c_acctbal") > 0), F.col("c_custkey") % 10).alias("fallback"))


@query("""WITH c AS (SELECT p_brand AS catalog, replace(p_name, ' ', CASE WHEN p_partkey % 9 = 0 THEN '/' ELSE '-' END) AS id, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_type END AS kind FROM part), i AS (SELECT catalog, id, count(*) AS n, count(*) - count(kind) AS lacking, NOT regexp_matches(id, '^[a-z0-9][a-z0-9._-]*$') AS odd FROM c GROUP BY 1, 2)
  SELECT catalog, CAST(sum(n) AS BIGINT) AS cards, count(*) FILTER (WHERE n > 1) AS repeated, CAST(sum(lacking) AS BIGINT) AS lacking, count(*) FILTER (WHERE odd) AS not_portable, sum(lacking) = 0 AND count(*) FILTER (WHERE odd OR n > 1) = 0 AS valid FROM i GROUP BY 1""")
def j27_catalog_validation(t: Tables) -> DataFrame:
    """Cards of each catalogue: identifiers unique and portable, required fields there."""
    sign = F.when(F.col("p_partkey") % 9 == 0, "/").otherwise("-")
    c = t.part.select(F.col("p_brand").alias("catalog"), F.replace("p_name", F.lit(" "), sign).alias("id"), F.when(F.col("p_size") % 10 != 0, F.col("p_type")).alias("kind"))
    i = c.groupBy("catalog", "id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind").isNull()).alias("lacking")).withColumn("odd", ~F.col("id").rlike("^[a-z0-9][a-z0-9._-]*$"))
    out = i.groupBy("catalog").agg(F.sum("n").alias("cards"), F.count_if(F.col("n") > 1).alias("repeated"), F.sum("lacking").alias("lacking"), F.count_if("odd").alias("not_portable"))
    return out.withColumn("valid", (F.col("repeated") == 0) & (F.col("lacking") == 0) & (F.col("not_portable") == 0))


# Which provider offers which operation, in how many steps.
OFFERS = (("graph", "view", 2), ("graph", "click", 1), ("structure", "purchase", 4), ("structure", "view", 3), ("memory", "signup", 1), ("memory", "error", 2))


@query("WITH o(provider, operation, steps) AS (VALUES " + ", ".join(map(str, OFFERS)) + ") SELECT provider, operation, count(*) AS asked, CAST(sum(steps) AS BIGINT) AS steps FROM events JOIN o ON operation = event_type GROUP BY 1, 2")
def j30_operation_plan(t: Tables) -> DataFrame:
    """Offers of a fixed registry that the operations asked for meet, and their steps."""
    offers = t.spark.createDataFrame(list(OFFERS), "provider string, operation string, steps int")
    asked = t.events.groupBy(F.col("event_type").alias("operation")).agg(F.count(F.lit(1)).alias("asked"))
    return asked.join(F.broadcast(offers), "operation").select("provider", "operation", "asked", (F.col("asked") * F.col("steps")).alias("steps"))  # six fixed rows


@query("SELECT p_partkey AS k, CAST(CASE WHEN p_size % 4 = 0 THEN 0 ELSE floor(p_retailprice / (30 * (p_size % 4))) END AS BIGINT) AS steps FROM part")
def j31_step_budget(t: Tables) -> DataFrame:
    """Steps that a budget allows, rounded down; none where a step has no price."""
    price = 30 * (F.col("p_size") % 4)
    return t.part.select(F.col("p_partkey").alias("k"), F.when(price > 0, F.floor(F.col("p_retailprice") / F.when(price > 0, price))).otherwise(0).cast("long").alias("steps"))
