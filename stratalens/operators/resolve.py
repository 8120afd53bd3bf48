"""Resolution of names to files: ordered candidates as an exploded equi-join, then unique suffixes, first files under a folder, or the raw name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.plans.registry import Tables, query
from stratalens.shared import tasks_of
from stratalens.sources.bindings import files, with_views

# Extensions in the order in which they are tried.
CODE = ("rs", "py", "js", "jsx", "ts", "tsx", "go", "java")
GRAPH = ("rs", "ps1", "py", "js", "ts", "tsx", "json", "md", "toml")

_BRAND = "lower(replace(p_brand, '#', '_'))"
_KNOWN = f"""WITH known AS (SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'crates/' || {_BRAND} || '/src/m' || p_partkey || '.rs' WHEN 1 THEN 'crates/' || {_BRAND} || '/src/m' || p_partkey || '/mod.rs'
    WHEN 2 THEN 'web/' || {_BRAND} || '/m' || p_partkey || '.js' WHEN 3 THEN 'web/' || {_BRAND} || '/m' || p_partkey || '/index.ts' WHEN 4 THEN 'py/' || {_BRAND} || '/m' || p_partkey || '.py' ELSE 'py/' || {_BRAND} || '/m' || p_partkey || '/__init__.py' END AS path FROM part)"""
_WANTED = f""", wanted AS (SELECT p_partkey AS k, ['web', {_BRAND}] AS parent, CASE p_partkey % 7 WHEN 0 THEN './m' || p_partkey WHEN 1 THEN '../' || {_BRAND} || '/m' || p_partkey || '.js' WHEN 2 THEN 'crates.' || {_BRAND} || '.src.m' || p_partkey
    WHEN 3 THEN '..\\' || {_BRAND} || '\\m' || p_partkey WHEN 4 THEN '../../../../m' || p_partkey WHEN 5 THEN 'm' || p_partkey ELSE 'crate::m' || p_partkey END AS target FROM part),
  n AS (SELECT k, parent, target, replace(target, '\\', '/') AS name FROM wanted)"""


def text(*parts: str | Column) -> Column:
    """Columns and words in a row; a word in braces is a column's name."""
    return F.concat(*(F.col(p[1:-1]).cast("string") if isinstance(p, str) and p.startswith("{") else F.lit(p) if isinstance(p, str) else p for p in parts))


def keyed(t: Tables) -> DataFrame:
    """k, b: parts with their module's name."""
    return t.part.select(F.col("p_partkey").alias("k"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("b"))


def turn(n: int, *choices: Column) -> Column:
    """The choice whose turn it is by k modulo n."""
    out = choices[-1]
    for i in range(n - 2, -1, -1):
        out = F.when(F.col("k") % n == i, choices[i]).otherwise(out)
    return out


def known_files(t: Tables) -> DataFrame:
    """k, path: files of several languages."""
    path = turn(6, text("crates/", "{b}", "/src/m", "{k}", ".rs"), text("crates/", "{b}", "/src/m", "{k}", "/mod.rs"), text("web/", "{b}", "/m", "{k}", ".js"), text("web/", "{b}", "/m", "{k}", "/index.ts"), text("py/", "{b}", "/m", "{k}", ".py"), text("py/", "{b}", "/m", "{k}", "/__init__.py"))
    return keyed(t).select("k", path.alias("path"))


def wanted_names(t: Tables) -> DataFrame:
    """k, parent (folders of the importing file), target, name: imports in each form, with slashes forward."""
    target = turn(7, text("./m", "{k}"), text("../", "{b}", "/m", "{k}", ".js"), text("crates.", "{b}", ".src.m", "{k}"), text("..\\", "{b}", "\\m", "{k}"), text("../../../../m", "{k}"), text("m", "{k}"), text("crate::m", "{k}"))
    return keyed(t).select("k", F.array(F.lit("web"), "b").alias("parent"), target.alias("target")).withColumn("name", F.replace("target", F.lit("\\"), F.lit("/")))


def walked(parent: Column, path: Column, strict: bool) -> Column:
    """Folders after following a relative path; strict: null when it leaves the root, else it stays there."""
    up = lambda a: F.when(F.size(a) > 0, F.slice(a, 1, F.size(a) - 1)).otherwise(F.lit(None) if strict else a)
    return F.aggregate(F.split(path, "/"), parent, lambda a, x: F.when(x.isin("", "."), a).when(x == "..", up(a)).otherwise(F.concat(a, F.array(x))))


def first_known(candidates: DataFrame, known: DataFrame, tasks: int) -> DataFrame:
    """k, path: of each k's candidates (an array) the first that is a known path. Both are dealt to `tasks` tasks before the candidates are made rows."""
    tried = candidates.repartition(tasks, "k").select("k", F.posexplode("candidates").alias("pos", "path"))
    return tried.join(known.select("path").repartition(tasks, "path"), "path").repartition(tasks, "k").groupBy("k").agg(F.min_by("path", "pos").alias("path"))


_REDUCE = "list_reduce(list_prepend(parent, list_transform(string_split(name, '/'), lambda x: [x])), lambda a, x: CASE WHEN a IS NULL THEN NULL WHEN x[1] IN ('', '.') THEN a WHEN x[1] = '..' THEN CASE WHEN len(a) > 0 THEN a[1:len(a) - 1] ELSE {out} END ELSE list_concat(a, x) END)"
_CODE_LIST = "[base, " + ", ".join(f"base || '.{e}', base || '/index.{e}'" for e in CODE) + ", base || '/mod.rs', base || '/__init__.py']"
_GRAPH_LIST = "[base, " + ", ".join(f"base || '.{e}'" for e in GRAPH) + ", " + ", ".join(f"base || '/mod.{e}', base || '/index.{e}'" for e in GRAPH) + "]"


@query(_KNOWN + _WANTED + f""", b AS (SELECT k, CASE WHEN starts_with(name, '.') THEN array_to_string({_REDUCE.format(out="NULL")}, '/') WHEN starts_with(name, 'crate::') THEN 'src/' || replace(name[8:], '::', '/') ELSE replace(replace(name, '::', '/'), '.', '/') END AS base FROM n),
  c AS (SELECT k, unnest(l) AS c, unnest(range(len(l))) AS pos FROM (SELECT k, CASE WHEN contains(string_split(base, '/')[-1], '.') THEN [base] ELSE {_CODE_LIST} END AS l FROM b WHERE base IS NOT NULL)),
  hit AS (SELECT c.k, arg_min(path, pos) AS path FROM c JOIN known ON c = path GROUP BY 1), s AS (SELECT b.k, min(path) AS path, count(*) AS n FROM b JOIN known ON regexp_replace(path, '[.][^.]*$', '') = trim(base, '/') OR ends_with(regexp_replace(path, '[.][^.]*$', ''), '/' || trim(base, '/')) GROUP BY 1)
  SELECT wanted.k, target, coalesce(hit.path, CASE WHEN s.n = 1 THEN s.path END) AS path, CASE WHEN hit.path IS NOT NULL THEN 'high' WHEN s.n = 1 THEN 'medium' ELSE 'unresolved' END AS confidence FROM wanted LEFT JOIN hit USING (k) LEFT JOIN s USING (k)""")
def c01_import_candidates(t: Tables) -> DataFrame:
    """Imports to files: relative, crate and dotted names; each extension and index in order gives high confidence, the only file that ends in the name medium."""
    name = F.col("name")
    base = F.when(name.startswith("."), F.array_join(walked(F.col("parent"), name, strict=True), "/")).when(name.startswith("crate::"), F.concat(F.lit("src/"), F.replace(F.substring(name, 8, 1 << 20), F.lit("::"), F.lit("/")))).otherwise(F.translate(F.replace(name, F.lit("::"), F.lit("/")), ".", "/"))
    wanted = wanted_names(t).select("k", "target", base.alias("base"))
    b = F.col("base")
    endings = [x for e in CODE for x in (F.concat(b, F.lit(f".{e}")), F.concat(b, F.lit(f"/index.{e}")))]
    tries = F.when(F.element_at(F.split(b, "/"), -1).contains("."), F.array(b)).otherwise(F.array(b, *endings, F.concat(b, F.lit("/mod.rs")), F.concat(b, F.lit("/__init__.py"))))
    n, m = tasks_of(t.part, 4), tasks_of(t.part, len(CODE) * 2 + 3)  # for tails of a path, and for candidates
    known = known_files(t).repartition(n, "k")
    exact = first_known(wanted.filter("base is not null").select("k", tries.alias("candidates")), known, m).withColumnRenamed("path", "exact")
    parts = F.split(F.regexp_replace("path", r"\.[^.]*$", ""), "/")
    tails = known.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("token"))
    only = tails.repartition(n, "token").groupBy("token").agg(F.min("path").alias("only"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    none = F.concat(F.lit("\0"), F.col("k").cast("string"))  # no path's token: names that leave the root do not all meet in one task
    found = wanted.withColumn("token", F.coalesce(F.btrim("base", F.lit("/")), none)).join(exact, "k", "left").join(only, "token", "left")
    return found.select("k", "target", F.coalesce("exact", "only").alias("path"), F.when(F.col("exact").isNotNull(), "high").when(F.col("only").isNotNull(), "medium").otherwise("unresolved").alias("confidence"))


@query(_KNOWN + _WANTED + f""", b AS (SELECT k, target, CASE WHEN starts_with(name, '.') THEN array_to_string({_REDUCE.format(out="a")}, '/') ELSE name END AS base FROM n), c AS (SELECT k, unnest(l) AS c, unnest(range(len(l))) AS pos FROM (SELECT k, {_GRAPH_LIST} AS l FROM b)),
  hit AS (SELECT c.k, arg_min(path, pos) AS path FROM c JOIN known ON c = path GROUP BY 1) SELECT b.k, coalesce(hit.path, target) AS node, hit.path IS NOT NULL AS resolved FROM b LEFT JOIN hit USING (k)""")
def c12_graph_targets(t: Tables) -> DataFrame:
    """Targets of the knowledge graph: the name, then each extension, then module and index files; what is unknown keeps its raw name."""
    name = F.col("name")
    wanted = wanted_names(t).select("k", "target", F.when(name.startswith("."), F.array_join(walked(F.col("parent"), name, strict=False), "/")).otherwise(name).alias("base"))
    b = F.col("base")
    tries = F.array(b, *(F.concat(b, F.lit(f".{e}")) for e in GRAPH), *(F.concat(b, F.lit(f"/{m}.{e}")) for e in GRAPH for m in ("mod", "index")))
    hit = first_known(wanted.select("k", tries.alias("candidates")), known_files(t), tasks_of(t.part, 3 * len(GRAPH) + 1))
    return wanted.join(hit, "k", "left").select("k", F.coalesce("path", "target").alias("node"), F.col("path").isNotNull().alias("resolved"))


@query(_KNOWN + f""", w AS (SELECT p_partkey AS k, ['py', {_BRAND}, 'deep'] AS dirs, CASE p_partkey % 5 WHEN 0 THEN 'py.' || {_BRAND} || '.m' || p_partkey WHEN 1 THEN '..m' || p_partkey WHEN 2 THEN '...' || {_BRAND} || '.m' || p_partkey WHEN 3 THEN '..' ELSE '.m' || p_partkey END AS token FROM part),
  d AS (SELECT k, dirs, token, length(regexp_extract(token, '^[.]*')) AS dots FROM w), b AS (SELECT k, token, list_concat(CASE WHEN dots = 0 THEN [] ELSE dirs[1:greatest(len(dirs) - (dots - 1), 0)] END, list_filter(string_split(token[dots + 1:], '.'), lambda x: x <> '')) AS parts FROM d),
  j AS (SELECT k, token, array_to_string(parts, '/') AS base FROM b WHERE len(parts) > 0), own AS (SELECT j.k, min(path) AS path FROM j JOIN known ON path IN (base || '.py', base || '/__init__.py') GROUP BY 1), under AS (SELECT j.k, min(path) AS path FROM j JOIN known ON starts_with(path, base || '/') GROUP BY 1)
  SELECT w.k, token, coalesce(own.path, under.path) AS path FROM w LEFT JOIN own USING (k) LEFT JOIN under USING (k)""")
def c09_python_imports(t: Tables) -> DataFrame:
    """Python imports: leading dots climb from the importing file; the module or package of that name, else the first file under it."""
    token = turn(5, text("py.", "{b}", ".m", "{k}"), text("..m", "{k}"), text("...", "{b}", ".m", "{k}"), F.lit(".."), text(".m", "{k}"))
    wanted = keyed(t).select("k", F.array(F.lit("py"), F.col("b"), F.lit("deep")).alias("dirs"), token.alias("token")).withColumn("dots", F.length(F.regexp_extract("token", r"^(\.*)", 1)))
    climbed = F.when(F.col("dots") == 0, F.array().cast("array<string>")).otherwise(F.slice("dirs", 1, F.greatest(F.size("dirs") - (F.col("dots") - 1), F.lit(0))))
    parts = F.concat(climbed, F.filter(F.split(F.substr("token", F.col("dots") + 1), r"\."), lambda x: x != ""))
    base = wanted.select("k", "token", F.when(F.size(parts) > 0, F.array_join(parts, "/")).alias("base"))
    known = known_files(t).select("path")
    own = base.select("k", F.explode(F.array(F.concat("base", F.lit(".py")), F.concat("base", F.lit("/__init__.py")))).alias("path")).join(known, "path").groupBy("k").agg(F.min("path").alias("own"))
    cut = F.split("path", "/")
    under = known.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(cut) - 1), lambda i: F.array_join(F.slice(cut, 1, i), "/"))).alias("base")).groupBy("base").agg(F.min("path").alias("under"))
    return base.join(own, "k", "left").join(under, "base", "left").select("k", "token", F.coalesce("own", "under").alias("path"))


@query(_KNOWN + f""", w AS (SELECT p_partkey AS k, 'crates/' || {_BRAND} || '/src' AS root, p_partkey % 2 = 0 AS relative, p_partkey % 3 = 0 AS deep FROM part), b AS (SELECT k, relative, CASE WHEN relative AND deep THEN root || '/deep' ELSE root END || '/m' || k AS base FROM w)
  SELECT b.k, CASE WHEN relative THEN 'mod' ELSE 'use' END AS form, min(path) AS path FROM b LEFT JOIN known ON path IN (base || '.rs', base || '/mod.rs') GROUP BY 1, 2""")
def c10_rust_modules(t: Tables) -> DataFrame:
    """Rust modules: `mod x` beside the file, `use crate::x` from the source root; a file or a folder's module file."""
    w = keyed(t).select("k", text("crates/", "{b}", "/src", F.when(F.col("k") % 3 == 0, "/deep").otherwise(""), "/x", "{k}", ".rs").alias("source"), F.when(F.col("k") % 2 == 0, "mod").otherwise("use").alias("form"))
    folder, root = F.regexp_replace("source", "/[^/]*$", ""), F.regexp_extract("source", "^(.*?/src)/", 1)
    base = F.concat(F.when(F.col("form") == "mod", folder).otherwise(root), F.lit("/m"), F.col("k").cast("string"))
    tried = w.select("k", "form", F.explode(F.array(F.concat(base, F.lit(".rs")), F.concat(base, F.lit("/mod.rs")))).alias("path"))
    hit = tried.join(known_files(t).select("path"), "path").groupBy("k").agg(F.min("path").alias("path"))
    return w.select("k", "form").join(hit, "k", "left").select("k", "form", "path")


@query(_KNOWN + f""", used AS (SELECT l_orderkey AS o, p_partkey AS k, {_BRAND} AS b FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL), e AS (SELECT DISTINCT s.path AS src, 'crates/' || a.b || '/src/m' || z.k AS base FROM used a JOIN known s ON s.k = a.k JOIN used z ON a.o = z.o WHERE s.path LIKE 'crates/%'),
  f AS (SELECT e.src, coalesce(x.path, y.path) AS dst FROM e LEFT JOIN known x ON x.path = base || '.rs' LEFT JOIN known y ON y.path = base || '/mod.rs') SELECT DISTINCT src, dst FROM f WHERE dst IS NOT NULL AND dst <> src""")
def c11_crate_edges(t: Tables) -> DataFrame:
    """Edges between modules of a crate: files used together, the file before the folder's module, none to itself."""
    used = t.lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("k")).distinct().join(keyed(t), "k")
    known = known_files(t)
    sources = used.join(known.filter(F.col("path").startswith("crates/")), "k").select("o", "b", F.col("path").alias("src"))
    wanted = sources.join(used.select("o", "k"), "o").select("src", text("crates/", "{b}", "/src/m", "{k}").alias("base")).distinct()
    plain, nested = (known.select(F.col("path").alias(c)) for c in ("plain", "nested"))
    found = wanted.join(plain, F.concat("base", F.lit(".rs")) == F.col("plain"), "left").join(nested, F.concat("base", F.lit("/mod.rs")) == F.col("nested"), "left")
    return found.select("src", F.coalesce("plain", "nested").alias("dst")).filter("dst <> src").distinct()


@query(with_views("files") + """, w AS (SELECT partkey AS k, CASE partkey % 4 WHEN 0 THEN path WHEN 1 THEN 'repo/' || path WHEN 2 THEN regexp_replace(path, '^crates/[^/]+/', '') ELSE 'lost/' || partkey END AS target FROM files),
  c AS (SELECT k, path, path = target AS exact FROM w JOIN files ON path = target OR ends_with(target, '/' || path) OR ends_with(path, '/' || target)) SELECT w.k, arg_max(path, (CASE WHEN exact THEN 1 ELSE 0 END, length(path), path)) AS path FROM w LEFT JOIN c USING (k) GROUP BY 1""")
def c06_two_way_suffix(t: Tables) -> DataFrame:
    """Targets to hotspots: the same path, else the longest of which one ends in the other; suffixes of both sides are exploded."""
    n = tasks_of(t.part, 4)  # tails of a path
    f = files(t).repartition(n, "partkey")
    paths = f.select("path").repartition(n, "path")
    target = turn(4, F.col("path"), F.concat(F.lit("repo/"), "path"), F.regexp_replace("path", "^crates/[^/]+/", ""), text("lost/", "{k}"))
    wanted = f.select(F.col("partkey").alias("k"), "path").select("k", target.alias("target"))

    def tails(c: str) -> Column:
        parts = F.split(c, "/")
        return F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/")))

    ours = wanted.select("k", "target", tails("target").alias("path")).join(paths, "path").select("k", "target", "path")
    theirs = f.select("path", tails("path").alias("target")).join(wanted.repartition(n, "target"), "target").select("k", "target", "path")
    best = ours.union(theirs).repartition(n, "k").groupBy("k").agg(F.max_by("path", F.struct((F.col("path") == F.col("target")).alias("exact"), F.length("path").alias("n"), "path")).alias("path"))
    return wanted.select("k").join(best, "k", "left")
