"""Text functions over source code: lines, symbols, imports, names, counts and small scalars."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.plans.registry import Tables, query

# A small corpus with each branch of the scanners; (path, text).
CORPUS = (
    ("src/app/main.py", "import os\nfrom app.core import run\n\n# entry\ndef main(self, a, b):\n    if a and b:\n        run(a)\n    return os.getcwd()\n\nasync def later():\n    pass\n"),
    ("src/app/tests/test_main.py", "from app.main import main\n\n\nclass TestMain:\n    def test_ok(self):\n        assert main(1, 2)\n"),
    ("crates/core/src/lib.rs", "use crate::graph::walk;\nmod graph;\n\n// walks\npub fn start(x: i32) -> i32 {\n    if x > 0 && walk(x) {\n        return x;\n    }\n    x\n}\nfn helper() {}\n"),
    ("crates/core/src/graph.rs", "pub fn walk(x: i32) -> bool {\n    match x {\n        0 => false,\n        _ => true,\n    }\n}\npub struct Node;\n"),
    ("web/index.js", "import { a } from './a.js';\nconst b = require('./b');\nconst go = (x) => x + 1;\nfunction load(p) {\n  if (p || go(p)) { return b(p); }\n}\nexport default function skip() {}\n"),
    ("web/a.ts", "import type { B } from \"./b\";\nexport const a = 1;\nexport class Box {}\nexport function open(x: number) {\n  return x;\n}\n"),
    ("cmd/main.go", "package main\n\nimport \"fmt\"\n\nfunc main() {\n\tfmt.Println(\"x\")\n}\n"),
    ("src/Main.java", "public class Main {\n    public static void main(String[] args) {\n        run();\n    }\n}\n"),
    ("lib/util.c", "#include \"util.h\"\n#include <stdio.h>\nint add(int a, int b) {\n    return a + b;\n}\n"),
    ("docs/readme.md", "# Title\n\nText with C:\\Users\\me and /home/me.\r\n"),
    ("empty.txt", ""),
    ("tools/run.ps1", "# set up\nFunction Start-Run { param($x)\n  if ($x) { go }\n}\nfunctional\n"),
    ("src/Shape.java", "public interface Shape {\n}\nprotected enum Kind { A }\nprivate class Box {\n    // if when\n}\n"),
    ("cmd/server.go", "func (s *Server) Serve(a int) {\n\tx := with(a) || a\n}\nfunc plain() {}\n"),
    ("web/b.mjs", "export async function later(a, b) {\n  return a || b;\n}\nexport interface Face {\n}\nconst two-words = (x) => x;\nlet ok = x => x;\n"),
    ("core/match.rs", "pub async fn pick(x: i32) -> i32 {\n    match x {\n        0 => 1,\n        n if n > 2 => n, // => not counted twice\n        _ => 0,\n    }\n}\n"),
    ("src/Main.cs", "class Other {\n}\n"),
)


def corpus(t: Tables) -> DataFrame:
    """path, text: one source file per part, in the part's turn of the templates; its key is in the leaf's name and in names of main.

    The keys are dealt out first: a table of parts is few bytes, so one or two tasks would read it and scan all that is made of it.
    """
    templates = t.spark.createDataFrame([(i, p, s) for i, (p, s) in enumerate(CORPUS)], "no long, path string, text string")
    key = F.col("p_partkey").cast("string")
    path = F.regexp_replace("path", F.lit(r"([^/.]+)\.([^/.]+)$"), F.concat(F.lit("$1_"), key, F.lit(".$2")))
    tasks = max(t.spark.sparkContext.defaultParallelism, int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    made = t.part.select("p_partkey").repartition(tasks, "p_partkey").join(F.broadcast(templates), F.col("p_partkey") % len(CORPUS) == F.col("no"))  # eleven fixed rows
    return made.select(path.alias("path"), F.replace("text", F.lit("main"), F.concat(F.lit("main_"), key)).alias("text"))


def _literal(s: str) -> str:
    parts = s.replace("'", "''").replace("\r", "\x00r").split("\n")
    return " || chr(10) || ".join("'" + p.replace("\x00r", "' || chr(13) || '") + "'" for p in parts)


_CORPUS = "WITH template(no, path, text) AS (VALUES " + ", ".join(f"({i}, '{p}', {_literal(s)})" for i, (p, s) in enumerate(CORPUS)) + r"""),
  corpus AS (SELECT regexp_replace(path, '([^/.]+)[.]([^/.]+)$', '\1_' || p_partkey || '.\2') AS path, replace(text, 'main', 'main_' || p_partkey) AS text, p_partkey, no FROM part JOIN template ON p_partkey % """ + f"{len(CORPUS)} = no)"
_LINES = _CORPUS + ", lines AS (SELECT path, CAST(unnest(range(1, len(l) + 1)) AS BIGINT) AS no, rtrim(unnest(l), chr(13)) AS line FROM (SELECT path, string_split(text, chr(10)) AS l FROM corpus WHERE text <> ''))"


def native_lines(text: Column) -> Column:
    """Lines without their carriage returns; an empty text has none, a final line end gives an empty line."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(text, "\n", -1), lambda x: F.rtrim(x, F.lit("\r"))))


def numbered_lines(t: Tables) -> DataFrame:
    """path, lang, no (from 1), line of the corpus."""
    return lines_in(corpus(t))


def lines_in(texts: DataFrame) -> DataFrame:
    """path, lang, no (from 1), line of texts (path, text). The language is told once a file, below the lines: above them a filter would take its expression along for every use."""
    told = texts.select("path", language(F.col("path")).alias("lang"), native_lines(F.col("text")).alias("lines"))
    return told.select("path", "lang", F.posexplode("lines").alias("i", "line")).select("path", "lang", (F.col("i") + 1).cast("long").alias("no"), "line")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


@query(_LINES + " SELECT path, no, line FROM lines")
def i01_native_lines(t: Tables) -> DataFrame:
    """Lines of each file, native rule."""
    return numbered_lines(t).select("path", "no", "line")


@query(_CORPUS + " SELECT path, CAST(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END AS BIGINT) AS n FROM corpus")
def i02_gate_lines(t: Tables) -> DataFrame:
    """Number of lines without the empty one after a final line end."""
    n = F.size(F.split("text", "\n", -1)) - F.when(F.col("text").endswith("\n"), 1).otherwise(0)
    return corpus(t).select("path", F.when(F.col("text") == "", 0).otherwise(n).cast("long").alias("n"))


# Extensions of the native languages.
_LANGS = {"rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "ps1": "powershell", "psm1": "powershell", "cs": "csharp"}
_LANG_SQL = "CASE lower(regexp_extract(path, '[.]([^./]+)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in _LANGS.items()) + " ELSE 'text' END"


def language(path: Column) -> Column:
    """Native language map; all else is text."""
    known = F.create_map(*(F.lit(x) for pair in _LANGS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("text"))


@query(_CORPUS + f" SELECT path, {_LANG_SQL} AS lang, {_LANG_SQL} <> 'text' AS supported FROM corpus")
def i03_language(t: Tables) -> DataFrame:
    """Language by extension, and whether it is supported (also b05)."""
    return corpus(t).select("path", language(F.col("path")).alias("lang")).withColumn("supported", F.col("lang") != "text")


# Declarations per language, as (languages, pattern with the name in its only group, kind), the first that fits.
_NAME = "([A-Za-z0-9_$:-]+)"
_DECLARED = (
    (("powershell",), f"^(?i:function ){_NAME}", "function"),
    (("python",), f"^def {_NAME}", "function"), (("python",), f"^class {_NAME}", "class"),
    *((("javascript", "typescript"), f"^(?:export )?(?:async )?{kind} {_NAME}", kind) for kind in ("function", "class", "interface")),
    (("javascript", "typescript"), r"^(?:export )?(?:async )?(?:const|let|var)[ ]+([A-Za-z0-9_$]+)[ ]*=.*=>", "function"),
    (("javascript", "typescript"), r"^(?:export )?(?:async )?(?:const|let|var)[ ]+([A-Za-z0-9_$]+)[ ]*=>", "function"),
    (("rust",), f"^(?:pub )?(?:async )?fn {_NAME}", "function"),
    (("go",), f"^func (?:[(][^)]*[)][ ]*)?{_NAME}", "function"),
    *((("java",), f"^(?:public )?(?:private )?(?:protected )?{kind} {_NAME}", kind) for kind in ("class", "interface", "enum")),
)
_SYMBOL_SQL = """, trimmed AS (SELECT path, no, ltrim(line) AS s, """ + _LANG_SQL + """ AS lang FROM lines),
  found AS (SELECT path, no, coalesce(x.name, '') AS name, x.kind AS kind FROM (SELECT path, no, CASE """ + " ".join(
    f"WHEN lang IN ({', '.join(repr(x) for x in langs)}) AND regexp_matches(s, '{pattern}') THEN {{'name': regexp_extract(s, '{pattern}', 1), 'kind': '{kind}'}}" for langs, pattern, kind in _DECLARED
) + """ END AS x FROM trimmed))"""


def declared(s: Column, lang: Column) -> Column:
    """name, kind of what a trimmed line declares, by its prefix; else null."""
    return F.coalesce(*(F.when(lang.isin(*langs) & s.rlike(pattern), F.struct(F.regexp_extract(s, pattern, 1).alias("name"), F.lit(kind).alias("kind"))) for langs, pattern, kind in _DECLARED))


def symbols_in(lines: DataFrame) -> DataFrame:
    """path, no, name, kind of lines (path, lang, no, line): one symbol per line at most."""
    found = declared(F.ltrim("line"), F.col("lang"))
    return lines.select("path", "no", found.alias("x")).filter("x is not null").select("path", "no", "x.name", "x.kind")


def symbols(t: Tables) -> DataFrame:
    """path, no, name of the corpus."""
    return symbols_in(numbered_lines(t)).select("path", "no", "name")


@query(_LINES + _SYMBOL_SQL + " SELECT path || '#' || kind || ':' || name AS id, path, no, name, kind FROM found WHERE name <> ''")
def i04_symbols(t: Tables) -> DataFrame:
    """Declared names per line with their kinds and ids, in eight languages, of which one has none (also i05, i06)."""
    return symbols_in(numbered_lines(t)).select(F.concat("path", F.lit("#"), "kind", F.lit(":"), "name").alias("id"), "path", "no", "name", "kind")


_IMPORT_SQL = """, t AS (SELECT path, no, ltrim(line) AS s, """ + _LANG_SQL + """ AS lang FROM lines),
  im AS (SELECT path, no, CASE WHEN lang IN ('javascript', 'typescript') AND contains(s, ' from ') THEN regexp_extract(s, ' from [^\"'']*[\"'']([^\"'']+)', 1) WHEN lang IN ('javascript', 'typescript') AND contains(s, 'require(') THEN regexp_extract(s, 'require\\([\"'']([^\"'']+)', 1)
    WHEN lang = 'python' THEN regexp_extract(s, '^(?:from|import) ([^ ,]+)', 1) WHEN lang = 'go' THEN regexp_extract(s, '^import \"([^\"]+)\"', 1) WHEN lang = 'rust' THEN regexp_extract(s, '^(?:use|mod) ([A-Za-z0-9_:]+)', 1)
    WHEN lang = 'text' THEN regexp_extract(s, '^#include [\"<]([^\">]+)', 1) ELSE '' END AS target FROM t)"""


def file_imports(t: Tables) -> DataFrame:
    """path, no, s (the trimmed line), target."""
    s, lang = F.col("s"), F.col("lang")
    js = lang.isin("javascript", "typescript")
    target = (
        F.when(js & s.contains(" from "), F.regexp_extract(s, " from [^\"']*[\"']([^\"']+)", 1))
        .when(js & s.contains("require("), F.regexp_extract(s, "require\\([\"']([^\"']+)", 1))
        .when(lang == "python", F.regexp_extract(s, "^(?:from|import) ([^ ,]+)", 1))
        .when(lang == "go", F.regexp_extract(s, '^import "([^"]+)"', 1))
        .when(lang == "rust", F.regexp_extract(s, "^(?:use|mod) ([A-Za-z0-9_:]+)", 1))
        .when(lang == "text", F.regexp_extract(s, '^#include ["<]([^">]+)', 1))
        .otherwise("")
    )
    return numbered_lines(t).select("path", "no", "lang", F.ltrim("line").alias("s")).select("path", "no", "s", target.alias("target")).filter("target <> ''")


@query(_LINES + _IMPORT_SQL + " SELECT path, no, target FROM im WHERE target <> ''")
def i07_imports(t: Tables) -> DataFrame:
    """Imported names per line."""
    return file_imports(t).select("path", "no", "target")


# Words that branch.
_BRANCHES = r"\b(if|elif|for|while|except|case|catch|match|guard|when|with)\b"


@query(_LINES + f""", c AS (SELECT path, trim(line) AS s, {_LANG_SQL} AS lang FROM lines), n AS (SELECT path, sum(len(regexp_extract_all(s, '{_BRANCHES}')) + len(regexp_extract_all(s, '&&')) + len(regexp_extract_all(s, '\\|\\|')) + CASE WHEN lang NOT IN ('javascript', 'typescript') AND contains(s, ' => ') THEN 1 ELSE 0 END) AS n FROM c WHERE s <> '' AND NOT starts_with(s, '#') AND NOT starts_with(s, '//') GROUP BY 1)
  SELECT path, CAST(1 + coalesce(n, 0) AS BIGINT) AS complexity FROM corpus LEFT JOIN n USING (path)""")
def i12_complexity(t: Tables) -> DataFrame:
    """One plus branching words and boolean operators of all lines but comments, and one for each line with a match arm, where these aren't functions."""
    return complexity_of(corpus(t))


def complexity_of(texts: DataFrame) -> DataFrame:
    """path, complexity of texts (path, text)."""
    lines = F.filter(F.transform(native_lines(F.col("text")), lambda x: F.trim(x)), lambda s: (s != "") & ~s.startswith("#") & ~s.startswith("//"))
    arm = lambda s: F.when(~F.col("lang").isin("javascript", "typescript") & s.contains(" => "), 1).otherwise(0)
    terms = lambda s: F.regexp_count(s, F.lit(_BRANCHES)) + F.regexp_count(s, F.lit("&&")) + F.regexp_count(s, F.lit(r"\|\|")) + arm(s)
    told = texts.select("path", "text", language(F.col("path")).alias("lang"))
    return told.select("path", F.aggregate(F.transform(lines, terms), F.lit(1), lambda a, b: a + b).cast("long").alias("complexity"))


# Signatures per language, as (languages, pattern with name and parameters in its groups, pattern of asynchronous ones, pattern of public ones), the first that fits.
_SIGNED = (
    (("python",), r"^(?:async )?def ([A-Za-z0-9_]+) *[(]([^)]*)", "^async ", "^$"),
    (("rust",), r"^(?:pub (?:async )?|pub[(][^)]*[)] (?:async )?|async )?fn ([A-Za-z0-9_]+) *[(]([^)]*)", r"^(?:pub(?:[(][^)]*[)])? )?async ", "^pub"),
    (("javascript", "typescript"), r"function ([A-Za-z0-9_$]+) *[(]([^)]*)", "async function |= async ", "^export "),
    (("javascript", "typescript"), r"([A-Za-z0-9_$-]+) *= *(?:async *)?[(]?([^()=]*)[)]? *=>", "async function |= async ", "^export "),
    (("powershell",), r"^(?i:function) +([A-Za-z0-9_:-]+) *[(]?([^){]*)", "^$", "^$"),
)


@query(_LINES + f", s AS (SELECT path, no, ltrim(line) AS s, {_LANG_SQL} AS lang FROM lines), m AS (SELECT path, no, CASE " + " ".join(
    f"WHEN lang IN ({', '.join(repr(x) for x in langs)}) AND regexp_matches(s, '{pattern}') THEN {{'name': regexp_extract(s, '{pattern}', 1), 'p': regexp_extract(s, '{pattern}', 2), 'is_async': regexp_matches(s, '{late}'), 'is_public': regexp_matches(s, '{seen}')}}" for langs, pattern, late, seen in _SIGNED
) + " END AS x FROM s) SELECT path, no, x.name AS name, CAST(len(list_filter(string_split(x.p, ','), lambda y: trim(y) NOT IN ('', 'self', '&self', '&mut self'))) AS BIGINT) AS params, x.is_async AS is_async, x.is_public AS is_public FROM m WHERE x IS NOT NULL")
def i09_signatures(t: Tables) -> DataFrame:
    """Signatures in four languages: name, number of parameters without the receiver, whether asynchronous and whether public."""
    s, lang = F.col("s"), F.col("lang")
    made = lambda pattern, late, seen: F.struct(F.regexp_extract(s, pattern, 1).alias("name"), F.regexp_extract(s, pattern, 2).alias("p"), s.rlike(late).alias("is_async"), s.rlike(seen).alias("is_public"))
    found = F.coalesce(*(F.when(lang.isin(*langs) & s.rlike(pattern), made(pattern, late, seen)) for langs, pattern, late, seen in _SIGNED))
    x = numbered_lines(t).select("path", "no", "lang", F.ltrim("line").alias("s")).select("path", "no", found.alias("x")).filter("x is not null")
    params = F.size(F.filter(F.split("x.p", ","), lambda y: ~F.trim(y).isin("", "self", "&self", "&mut self")))
    return x.select("path", "no", "x.name", params.cast("long").alias("params"), "x.is_async", "x.is_public")


@query(_CORPUS + r""" SELECT path, CAST(len(regexp_extract_all(text, '[A-Za-z0-9_] *\(')) AS BIGINT) AS calls FROM corpus""")
def i14_call_sites(t: Tables) -> DataFrame:
    """Opening brackets behind a name."""
    return corpus(t).select("path", F.regexp_count("text", F.lit(r"[A-Za-z0-9_] *\(")).cast("long").alias("calls"))


@query("""WITH l AS (SELECT lang, ltrim(unnest(string_split(text, chr(10)))) AS s FROM documents WHERE text <> '') SELECT lang, count(*) AS total, count(*) FILTER (WHERE s = '') AS blank, count(*) FILTER (WHERE regexp_matches(s, '^(#|//|/[*]|[*])')) AS comment, count(*) FILTER (WHERE s <> '' AND NOT regexp_matches(s, '^(#|//|/[*]|[*])')) AS loc FROM l GROUP BY 1""")
def i16_line_stats(t: Tables) -> DataFrame:
    """Total, blank, comment and code lines."""
    line = t.documents.select("lang", F.explode(native_lines(F.col("text"))).alias("line")).select("lang", F.ltrim("line").alias("s"))
    comment = F.col("s").rlike(r"^(#|//|/[*]|[*])")
    return line.groupBy("lang").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("s") == "").alias("blank"), F.count_if(comment).alias("comment"), F.count_if((F.col("s") != "") & ~comment).alias("loc"))


@query(_LINES + """, sig AS (SELECT path, no, regexp_extract(line, '(?:def|fn|function|func) [A-Za-z0-9_]+[(]([^)]*)[)]', 1) AS p, regexp_matches(line, '(def|fn|function|func) [A-Za-z0-9_]+[(]') AS is_sig FROM lines)
  SELECT path, no, CAST(len(list_filter(string_split(p, ','), lambda x: trim(x) NOT IN ('', 'self', '&self', '&mut self'))) AS BIGINT) AS params FROM sig WHERE is_sig""")
def i17_param_count(t: Tables) -> DataFrame:
    """Parameters of declared functions without the receiver."""
    sig = numbered_lines(t).filter(F.col("line").rlike(r"(def|fn|function|func) [A-Za-z0-9_]+[(]"))
    inside = F.regexp_extract("line", r"(?:def|fn|function|func) [A-Za-z0-9_]+[(]([^)]*)[)]", 1)
    return sig.select("path", "no", F.size(F.filter(F.split(inside, ","), lambda x: ~F.trim(x).isin("", "self", "&self", "&mut self"))).cast("long").alias("params"))


# Folders by which a module is named.
_INNER, _PACKAGES, _AREAS = ("app", "src", "tests"), ("crates", "packages"), ("frontend", "integrations", "research", "scripts", "services")
_PLACES = ("backend/app/core/test_f{}.py", "backend/lib/f{}.py", "packages/p{}/x.rs", "app/f{}.py", "tests/unit/f{}.py", "tests/f{}.py", "scripts/f{}.sh", "services/s/f{}.py", "test_f{}.md", "other/a/f{}.py", "backend/f{}.py", "src/test_f{}", "//crates//c/f{}.rs")
_PLACED = "CASE page_id % " + str(len(_PLACES)) + " " + " ".join(f"WHEN {i} THEN '{p.split('{}')[0]}' || page_id || '{p.split('{}')[1]}'" for i, p in enumerate(_PLACES)) + " END"


def module_name(path: Column) -> Column:
    """Module of a path: by app, src and tests, below backend or not, by package, by area, or the first folder; a leaf's test_ doesn't count."""
    p = F.filter(F.split(path, "/"), lambda x: x != "")
    leaf = F.regexp_replace(F.element_at(p, -1), "^test_", "")
    p = F.when(F.size(p) > 0, F.concat(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.array(leaf))).otherwise(p)
    n, one, two, three = F.size(p), F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2))
    upto = lambda *x: F.concat_ws("/", *x)
    return (
        F.when(n == 0, "root").when(n == 1, one)
        .when((n == 2) & one.isin(*_INNER) & two.contains("."), one)
        .when((one == "backend") & (n > 2) & two.isin(*_INNER), upto(one, two, three))
        .when(one == "backend", upto(one, two))
        .when(one.isin(*_PACKAGES), upto(one, two))
        .when((n > 2) & one.isin(*_INNER), upto(one, two, three))
        .when((n == 2) & one.isin(*_AREAS), one)
        .when(one.isin(*_AREAS), upto(one, two))
        .otherwise(one)
    )


@query(_CORPUS + f""", every AS (SELECT path FROM corpus UNION ALL SELECT {_PLACED} FROM pages), s AS (SELECT path, list_filter(string_split(path, '/'), lambda x: x <> '') AS q FROM every), l AS (SELECT path, list_concat(q[1:len(q) - 1], [regexp_replace(q[len(q)], '^test_', '')]) AS p, len(q) AS n FROM s)
  SELECT path, CASE WHEN n = 0 THEN 'root' WHEN n = 1 THEN p[1] WHEN n = 2 AND p[1] IN {_INNER} AND contains(p[2], '.') THEN p[1] WHEN p[1] = 'backend' AND n > 2 AND p[2] IN {_INNER} THEN array_to_string(p[1:3], '/') WHEN p[1] = 'backend' OR p[1] IN {_PACKAGES} THEN array_to_string(p[1:2], '/')
    WHEN n > 2 AND p[1] IN {_INNER} THEN array_to_string(p[1:3], '/') WHEN p[1] IN {_AREAS} THEN CASE WHEN n = 2 THEN p[1] ELSE array_to_string(p[1:2], '/') END ELSE p[1] END AS module FROM l""")
def i18_module_name(t: Tables) -> DataFrame:
    """Module of a path."""
    place = F.element_at(F.array(*map(F.lit, _PLACES)), (F.col("page_id") % len(_PLACES) + 1).cast("int"))
    every = corpus(t).select("path").union(t.pages.select(F.replace(place, F.lit("{}"), F.col("page_id").cast("string")).alias("path")))
    return every.select("path", module_name(F.col("path")).alias("module"))


_RUST = """WITH f AS (SELECT DISTINCT 'crates/' || lower(replace(p_brand, '#', '_')) || CASE p_partkey % 7 WHEN 0 THEN '/src/m' || p_size || '/f' || p_partkey || '.rs' WHEN 1 THEN '/src/m' || p_size || '.rs' WHEN 2 THEN '/src/m' || p_size || '/mod.rs' WHEN 3 THEN '/src/f' || p_partkey || '.rs' WHEN 4 THEN '/tests/f' || p_partkey || '.rs' WHEN 5 THEN '/src/deep/src/m1/f' || p_partkey || '.rs' ELSE '/src/f' || p_partkey || '.txt' END AS path FROM part)"""


def rust_tree(t: Tables) -> DataFrame:
    """path: files of crates, nested, flat and outside src."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    leaf = F.element_at(F.array(F.concat(F.lit("/src/m"), size, F.lit("/f"), key, F.lit(".rs")), F.concat(F.lit("/src/m"), size, F.lit(".rs")), F.concat(F.lit("/src/m"), size, F.lit("/mod.rs")), F.concat(F.lit("/src/f"), key, F.lit(".rs")), F.concat(F.lit("/tests/f"), key, F.lit(".rs")), F.concat(F.lit("/src/deep/src/m1/f"), key, F.lit(".rs")), F.concat(F.lit("/src/f"), key, F.lit(".txt"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    return t.part.select(F.concat(F.lit("crates/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), leaf).alias("path")).distinct()


@query(_RUST + """, r AS (SELECT path, regexp_extract(path, '^(?:(.*)/)?src/[^/]*(?:/[^/]*)*$', 1) AS x, path LIKE '%.rs' AS rust FROM f), s AS (SELECT path, rust, regexp_extract(path, '^((?:.*/)?src)/(?:[^/]+/)*?[^/]+$', 1) AS root FROM f JOIN r USING (path) WHERE regexp_matches(path, '(^|/)src/')),
  k AS (SELECT path, root, path[len(root) + 2:] AS rest FROM s WHERE rust)
  SELECT path, root, CASE WHEN NOT contains(rest, '/') THEN regexp_replace(rest, '[.]rs$', '') WHEN EXISTS (SELECT 1 FROM f WHERE f.path IN (root || '/' || split_part(rest, '/', 1) || '.rs', root || '/' || split_part(rest, '/', 1) || '/mod.rs')) THEN split_part(rest, '/', 1) END AS module FROM k""")
def i19_owning_module(t: Tables) -> DataFrame:
    """Source root of each Rust file, its last src folder, and the crate's module that owns it: a flat file's own name, or the first folder if that is a module's file or folder; else none."""
    return owning_modules(rust_tree(t))


def owning_modules(paths: DataFrame) -> DataFrame:
    """path, root, module of the Rust files among paths (path); the modules that exist are looked up among them."""
    root, folder = F.regexp_extract("path", "^((?:.*/)?src)/[^/]+(?:/[^/]+)*$", 1), F.split_part("rest", F.lit("/"), F.lit(1))
    rust = paths.filter(F.col("path").endswith(".rs"))
    k = rust.withColumn("root", root).filter("root <> ''").withColumn("rest", F.expr("substring(path, length(root) + 2)"))
    k = k.withColumn("first", F.when(F.col("rest").contains("/"), folder))
    known = rust.select(F.regexp_replace("path", r"(/mod)?\.rs$", "").alias("known")).distinct()
    met = k.join(known, F.concat_ws("/", "root", "first") == F.col("known"), "left")
    return met.select("path", "root", F.when(F.col("first").isNull(), F.regexp_replace("rest", r"\.rs$", "")).when(F.col("known").isNotNull(), F.col("first")).alias("module"))


_USES = """WITH s AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'use crate::{' WHEN 1 THEN '  pub use crate::' WHEN 2 THEN 'pub(crate) use crate::{self, super, ' WHEN 3 THEN 'use other::' ELSE '// use crate::' END || replace(p_name, ' ', ', ') || CASE WHEN p_partkey % 5 IN (0, 2) THEN '::{deep}, ' || lower(replace(p_brand, '#', '_')) || '::x};' ELSE '::y;' END AS line FROM part)"""


@query(_USES + r""", r AS (SELECT p_partkey, regexp_extract(line, '^ *(?:pub |pub[(]crate[)] )?use crate::(.*)$', 1) AS rest FROM s WHERE regexp_matches(line, '^ *(?:pub |pub[(]crate[)] )?use crate::')),
  e AS (SELECT p_partkey, unnest(CASE WHEN starts_with(rest, '{') THEN string_split(regexp_replace(rest[2:], '[};]+$', ''), ',') ELSE [rest] END) AS entry FROM r), n AS (SELECT DISTINCT p_partkey, regexp_extract(trim(entry), '^([A-Za-z0-9_]*)', 1) AS segment FROM e)
  SELECT p_partkey, segment FROM n WHERE segment NOT IN ('', 'self', 'super')""")
def i20_use_segments(t: Tables) -> DataFrame:
    """First segments that a file's uses of its own crate name, single or in a group, each once."""
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))
    head = F.element_at(F.array(*map(F.lit, ("use crate::{", "  pub use crate::", "pub(crate) use crate::{self, super, ", "use other::", "// use crate::"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    tail = F.when((F.col("p_partkey") % 5).isin(0, 2), F.concat(F.lit("::{deep}, "), brand, F.lit("::x};"))).otherwise("::y;")
    return use_segments(t.part.select("p_partkey", F.concat(head, F.regexp_replace("p_name", " ", ", "), tail).alias("line")), "p_partkey")


def use_segments(lines: DataFrame, key: str) -> DataFrame:
    """key, segment of lines (key, line)."""
    pattern = "^ *(?:pub |pub[(]crate[)] )?use crate::(.*)$"
    rest = lines.filter(F.col("line").rlike(pattern)).select(key, F.regexp_extract("line", pattern, 1).alias("rest"))
    entries = F.when(F.col("rest").startswith("{"), F.split(F.regexp_replace(F.expr("substring(rest, 2)"), "[};]+$", ""), ",")).otherwise(F.array("rest"))
    segment = F.regexp_extract(F.trim("entry"), "^([A-Za-z0-9_]*)", 1)
    return rest.select(key, F.explode(entries).alias("entry")).select(key, segment.alias("segment")).filter(~F.col("segment").isin("", "self", "super")).distinct()


@query("""WITH p AS (SELECT doc_id, text, left(text, 200) AS head FROM documents), n AS (SELECT doc_id, text, list_max(list_filter(range(0, 201), lambda k: octet_length(encode(left(head, k))) <= 197)) AS fit FROM p)
  SELECT doc_id, CASE WHEN octet_length(encode(text)) > 200 THEN left(text, fit) || '...' ELSE text END AS short FROM n""")
def i23_truncate(t: Tables) -> DataFrame:
    """Texts of over 200 bytes cut to 197 or fewer at a character's end, with an ellipsis: the head's bytes are cut and an unfinished character goes."""
    cut = F.encode("text", "UTF-8")
    whole = lambda n: F.decode(F.substring(cut, 1, n), "UTF-8")
    lead = lambda n: F.conv(F.hex(F.substring(cut, n + 1, 1)), 16, 10).cast("int").bitwiseAND(0xC0) != 0x80  # noqa: E731  # the byte behind n starts a character
    fit = F.when(lead(197), whole(197)).when(lead(196), whole(196)).when(lead(195), whole(195)).otherwise(whole(194))
    return t.documents.select("doc_id", F.when(F.octet_length("text") > 200, F.concat(fit, F.lit("..."))).otherwise(F.col("text")).alias("short"))


@query("""WITH h AS (SELECT p_partkey, p_size * 2 AS h FROM part), c AS (SELECT p_partkey, CASE WHEN h <= 50 THEN round(h * 5.1::DOUBLE) ELSE 255 END AS r, CASE WHEN h <= 50 THEN 255 ELSE round(255 - (h - 50) * 5.1::DOUBLE) END AS g FROM h)
  SELECT p_partkey, '#' || lpad(upper(to_hex(CAST(r AS BIGINT))), 2, '0') || lpad(upper(to_hex(CAST(greatest(g, 0) AS BIGINT))), 2, '0') || '00' AS colour FROM c""")
def i24_heat_colour(t: Tables) -> DataFrame:
    """Heat as a colour from green over yellow to red."""
    h = F.col("p_size") * 2
    r = F.when(h <= 50, F.round(h * 5.1)).otherwise(255.0)
    g = F.greatest(F.when(h <= 50, F.lit(255.0)).otherwise(F.round(255 - (h - 50) * 5.1)), F.lit(0.0))
    two = lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")
    return t.part.select("p_partkey", F.concat(F.lit("#"), two(r), two(g), F.lit("00")).alias("colour"))


@query("""SELECT p_partkey, sha256(unhex(lpad(to_hex(octet_length(encode(p_name))), 16, '0')) || encode(p_name) || unhex(lpad(to_hex(octet_length(encode(p_brand))), 16, '0')) || encode(p_brand)) AS digest FROM part""")
def i25_record_hash(t: Tables) -> DataFrame:
    """SHA-256 over fields, each behind its length in eight bytes."""
    field = lambda c: F.concat(F.unhex(F.lpad(F.hex(F.octet_length(c).cast("long")), 16, "0")), F.encode(c, "UTF-8"))
    return t.part.select("p_partkey", F.sha2(F.concat(field(F.col("p_name")), field(F.col("p_brand"))), 256).alias("digest"))


# The closed lists of a trace's fields, and tool families in order with the parts of a name that tell them (of rg, the whole).
_ACTIONS, _TOUCHES, _GRADES = ("search", "read", "edit", "exec", "verify"), ("read", "edit"), ("exact", "estimated")
_FAMILIES = (("edit", ("apply_patch", "write", "edit")), ("shell", ("exec", "command", "shell")), ("read", ("read", "view", "open")), ("search", ("search", "find")), ("orchestration", ("agent", "wait", "message")))
#: Raw values that the events of the tables stand for, by turns.
_RAW = {
    "action": ("search", "read", "edit", "exec", "verify", "READ", None, "click"), "touch": ("read", "edit", "hit", None, "Edit"), "grade": ("exact", "estimated", "unavailable", None, "about"),
    "tool": ("apply_patch", "WriteFile", "exec_command", "shell", "view_image", "OpenFile", "rg", "Find", "agent", "wait", "send_message", "browser", None, "read_and_write", "rg2"),
}
_RAW_SQL = "WITH r AS (SELECT event_id, " + ", ".join(f"[{', '.join('NULL' if v is None else repr(v) for v in some)}][event_id % {len(some)} + 1] AS {name}" for name, some in _RAW.items()) + " FROM events)"


@query(_RAW_SQL + f" SELECT event_id, CASE WHEN action IN {_ACTIONS} THEN action ELSE 'other' END AS action, CASE WHEN touch IN {_TOUCHES} THEN touch ELSE 'hit' END AS touch, CASE WHEN grade IN {_GRADES} THEN grade ELSE 'unavailable' END AS grade, CASE "
  + " ".join(f"WHEN regexp_matches(lower(tool), '{'|'.join(parts)}'){' OR lower(tool) = ' + repr('rg') if family == 'search' else ''} THEN '{family}'" for family, parts in _FAMILIES) + " ELSE 'other' END AS family FROM r")
def i26_normalisers(t: Tables) -> DataFrame:
    """Actions, touches, grades and tool families from free values, each a closed list with a default."""
    raw = lambda name: F.element_at(F.array(*map(F.lit, _RAW[name])), (F.col("event_id") % len(_RAW[name]) + 1).cast("int")).alias(name)
    r, tool = t.events.select("event_id", *map(raw, _RAW)), F.lower("tool")
    known = lambda c, some, default: F.when(F.col(c).isin(*some), F.col(c)).otherwise(default).alias(c)
    family = F.coalesce(*(F.when(tool.rlike("|".join(parts)) | ((tool == "rg") & F.lit(name == "search")), name) for name, parts in _FAMILIES), F.lit("other"))
    return r.select("event_id", known("action", _ACTIONS, "other"), known("touch", _TOUCHES, "hit"), known("grade", _GRADES, "unavailable"), family.alias("family"))


@query("""SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: length(x) >= 3))), ' ') AS terms FROM benchmark""")
def i27_query_terms(t: Tables) -> DataFrame:
    """Distinct lower-cased terms of three characters or more."""
    words = F.split(F.lower("text"), "[^a-z0-9_]+", -1)
    return t.benchmark.select("item_id", F.array_join(F.array_sort(F.array_distinct(F.filter(words, lambda x: F.length(x) >= 3))), " ").alias("terms"))


@query("SELECT doc_id, contains(lower(text), 'the') AND contains(lower(text), 'tion') AND contains(lower(text), 'er') AS matched FROM documents")
def i28_keyword_match(t: Tables) -> DataFrame:
    """Whether a text holds all keywords."""
    wanted = F.array(*map(F.lit, ("the", "tion", "er")))
    return t.documents.select("doc_id", F.forall(wanted, lambda w: F.contains(F.lower("text"), w)).alias("matched"))


# The gate's ladder of coupling grades and the what-if tool's; the latter's default.
_GATE, _TOOL, _TOOL_DEFAULT = {"A": 5, "B": 15, "C": 30, "D": 60}, {"A": 2, "B": 5, "C": 8, "D": 12}, 5
_GRADE_TEXTS = ("A", " B ", "c", "D", "76.5", "-1", "E", None, " 76 ", "")
_GRADED = f"WITH g AS (SELECT p_partkey, [{', '.join('NULL' if v is None else repr(v) for v in _GRADE_TEXTS)}][p_partkey % {len(_GRADE_TEXTS)} + 1] AS grade FROM part)"


@query(_GRADED + " SELECT p_partkey, grade, CASE trim(grade) " + " ".join(f"WHEN '{g}' THEN {n}.0::DOUBLE" for g, n in _GATE.items()) + " ELSE CASE WHEN TRY_CAST(trim(grade) AS DOUBLE) >= 0 THEN TRY_CAST(trim(grade) AS DOUBLE) END END AS gate_limit, CASE upper(trim(grade)) " + " ".join(f"WHEN '{g}' THEN {n}" for g, n in _TOOL.items())
  + f" ELSE CASE WHEN regexp_matches(trim(grade), '^[+-]?[0-9]+$') THEN TRY_CAST(trim(grade) AS INTEGER) ELSE {_TOOL_DEFAULT} END END AS tool_limit FROM g")
def i29_grade_limit(t: Tables) -> DataFrame:
    """Limit of a coupling grade by two ladders: the gate's takes a number of 0 or more too, and is unknown otherwise; the tool's takes lower case and whole numbers, and has a default."""
    texts = F.element_at(F.array(*map(F.lit, _GRADE_TEXTS)), (F.col("p_partkey") % len(_GRADE_TEXTS) + 1).cast("int"))
    g, mark = t.part.select("p_partkey", texts.alias("grade")), F.trim("grade")
    ladder = lambda c, steps: F.coalesce(*(F.when(c == k, n) for k, n in steps.items()))
    number, whole = F.expr("try_cast(trim(grade) as double)"), F.expr("try_cast(trim(grade) as int)")
    gate = F.coalesce(ladder(mark, _GATE).cast("double"), F.when(number >= 0, number))
    tool = F.coalesce(ladder(F.upper(mark), _TOOL), F.when(mark.rlike("^[+-]?[0-9]+$"), whole), F.lit(_TOOL_DEFAULT))
    return g.select("p_partkey", "grade", gate.alias("gate_limit"), tool.alias("tool_limit"))


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1) AS owner, regexp_extract(url, '^https?://[^/]+/[^/?#]+/([^/?#]+)', 1) AS repo FROM pages""")
def i31_remote_parts(t: Tables) -> DataFrame:
    """Host, owner and repository of a remote address."""
    path = F.split(F.regexp_replace("url", r"^https?://[^/]*|[?#].*$", ""), "/")
    part = lambda i: F.coalesce(F.try_element_at(path, F.lit(i)), F.lit(""))
    return t.pages.select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), part(2).alias("owner"), part(3).alias("repo"))


@query(_CORPUS + r""" SELECT path, left(regexp_replace(regexp_replace(text, 'c:\\users\\me', '<home>', 'gi'), '/home/me', '<home>', 'gi'), 180) AS redacted FROM corpus""")
def i32_redaction(t: Tables) -> DataFrame:
    """Home paths replaced whatever their case, cut to 180 characters."""
    out = F.regexp_replace(F.regexp_replace("text", r"(?i)c:\\users\\me", "<home>"), "(?i)/home/me", "<home>")
    return corpus(t).select("path", F.left(out, F.lit(180)).alias("redacted"))


def _uses(text: str) -> list[str]:
    """Paths of `use a::{b, c::d as e};` statements, groups expanded, self dropped to its prefix."""
    out: list[str] = []

    def expand(prefix: str, body: str) -> None:
        depth, start = 0, 0
        for i, c in enumerate(body + ","):
            depth += (c == "{") - (c == "}")
            if c == "," and not depth:
                item, start = body[start:i].strip(), i + 1
                head, brace, rest = item.partition("{")
                if brace:
                    expand(prefix + head.strip(), rest.rsplit("}", 1)[0])
                elif item:
                    name = item.split(" as ")[0].strip()
                    out.append(prefix.removesuffix("::") if name == "self" else prefix + name)

    for statement in text.split(";"):
        words = statement.strip().split("use ", 1)
        if len(words) == 2 and words[0].strip() in ("", "pub"):
            expand("", words[1].strip())
    return out


@query("""WITH u AS (SELECT p_partkey, 'crate::' || lower(replace(p_brand, '#', '_')) AS root, string_split(p_name, ' ') AS names FROM part)
  SELECT p_partkey, unnest(list_concat(list_transform(names, lambda n: root || '::' || n), [root, root || '::deep::x', root || '::deep::y'])) AS target FROM u""")
def i08_use_trees(t: Tables) -> DataFrame:
    """Use statements with their groups expanded; recursive, so an Arrow function."""

    @F.arrow_udf("array<string>")
    def uses(column: pa.Array) -> pa.Array:
        return pa.array([_uses(x or "") for x in column.to_pylist()], pa.list_(pa.string()))

    use = F.concat(F.lit("use crate::"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("::{"), F.regexp_replace("p_name", " ", ", "), F.lit(", self, deep::{x, y as z}};"))
    return t.part.select("p_partkey", F.explode(uses(use)).alias("target"))


@query(_LINES + """, code AS (SELECT path, no, line, length(line) - length(ltrim(line)) AS indent FROM lines WHERE path LIKE '%.py' AND trim(line) <> '' AND NOT starts_with(ltrim(line), '#')),
  defs AS (SELECT path, no, indent FROM code WHERE regexp_matches(line, '^ *def ')), last AS (SELECT path, max(no) AS last FROM code GROUP BY path)
  SELECT d.path, d.no AS start, coalesce(min(c.no) - 1, any_value(last)) AS end_no FROM defs d JOIN last USING (path) LEFT JOIN code c ON c.path = d.path AND c.no > d.no AND c.indent <= d.indent GROUP BY 1, 2""")
def i10_indented_ends(t: Tables) -> DataFrame:
    """End of each Python function: before the first later code line that is indented no deeper; one pass over a file, with a stack, so an Arrow function."""

    @F.arrow_udf("array<struct<start:long,end_no:long>>")
    def ends(text: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end_no", pa.int64())]))
        return pa.array([[{"start": a, "end_no": b} for a, b in indented_ends(x or "")] for x in text.to_pylist()], kind)

    found = corpus(t).filter(F.col("path").endswith(".py")).select("path", F.explode(ends("text")).alias("f"))
    return found.select("path", "f.start", "f.end_no")


def indented_ends(text: str) -> list[tuple[int, int]]:
    """(line of a def, its last line) of each; lines that are blank or hold a comment only say nothing, and what is open at the end closes with the last line of code."""
    open_: list[tuple[int, int]] = []  # indents only grow up the stack
    found, last = [], 0
    for no, raw in enumerate(text.split("\n"), 1):
        line = raw.rstrip("\r")
        code = line.lstrip(" ")
        if not code or code.startswith("#"):
            continue
        indent, last = len(line) - len(code), no
        while open_ and open_[-1][0] >= indent:
            found.append((open_.pop()[1], no - 1))
        if code.startswith("def "):
            open_.append((indent, no))
    return sorted(found + [(start, last) for _, start in open_])


def blanked(text: str, hash_comments: bool = False) -> str:
    """The text with strings and comments blanked out, line ends kept."""
    out, i, n = [], 0, len(text)
    while i < n:
        two, c = text[i : i + 2], text[i]
        if two == "/*":
            end = text.find("*/", i + 2)
            end = n if end < 0 else end + 2
        elif two == "//" or hash_comments and c == "#":
            end = text.find("\n", i)
            end = n if end < 0 else end
        elif c in "\"'`":
            end = i + 1
            while end < n and text[end] != c and (text[end] != "\n" or c == "`"):
                end += 2 if text[end] == "\\" else 1
            end = min(end + 1, n)
        else:
            out.append(c)
            i += 1
            continue
        out += ["\n" if x == "\n" else " " for x in text[i:end]]
        i = end
    return "".join(out)


def brace_ends(text: str, starts: list[int]) -> list[int]:
    """For each line (from 1) that starts a block, the line on which the block that opens at or after it closes; the last line if it never does. One pass over the text."""
    lines = blanked(text).split("\n")
    waiting: dict[int, list[int]] = {}  # line -> the starts on it
    for k, no in enumerate(starts):
        waiting.setdefault(no, []).append(k)
    out, depth = [len(lines)] * len(starts), 0
    unopened: list[tuple[int, int]] = []  # start's number and the depth before its line
    opened: list[tuple[int, int]] = []  # a heap, the greatest depth first: a block closes when the depth falls to that before it
    for no, line in enumerate(lines, 1):
        unopened += [(k, depth) for k in waiting.get(no, ())]
        up = line.count("{")
        depth += up - line.count("}")
        if up:
            for k, before in unopened:
                heapq.heappush(opened, (-before, k))
            unopened = []
        while opened and depth <= -opened[0][0]:
            out[heapq.heappop(opened)[1]] = no
    return out


#: Ends and terms of the templates, worked out by hand: (number, name, first line, last line) and (number, terms).
_ENDS = ((2, "start", 5, 10), (2, "helper", 11, 11), (3, "walk", 1, 6), (4, "go", 3, 6), (4, "load", 4, 6), (5, "Box", 3, 3), (5, "open", 4, 6), (6, "main", 5, 7), (7, "Main", 1, 5), (11, "Start-Run", 2, 4), (12, "Shape", 1, 2), (12, "Kind", 3, 3), (12, "Box", 4, 6), (13, "Serve", 1, 3), (13, "plain", 4, 4), (14, "later", 1, 3), (14, "Face", 4, 5), (14, "ok", 7, 8), (15, "pick", 1, 7))
_TERMS = ((0, 2), (1, 0), (2, 2), (3, 1), (4, 2), (5, 0), (6, 0), (7, 0), (8, 0), (9, 0), (10, 0), (11, 1), (12, 0), (13, 1), (14, 1), (15, 2), (16, 0))


@query(_CORPUS + f", e(no, name, a, b) AS (VALUES {', '.join(map(str, _ENDS))}) SELECT path, replace(name, 'main', 'main_' || p_partkey) AS name, CAST(a AS BIGINT) AS start, CAST(b AS BIGINT) AS end_no FROM corpus JOIN e USING (no)")
def i11_brace_ends(t: Tables) -> DataFrame:
    """End of each braced function, by one scan of a file that knows strings and comments; stateful, so an Arrow function."""

    @F.arrow_udf("array<long>")
    def ends(text: pa.Array, starts: pa.Array) -> pa.Array:
        return pa.array([brace_ends(x or "", s) for x, s in zip(text.to_pylist(), starts.to_pylist(), strict=True)], pa.list_(pa.int64()))

    told = corpus(t).filter(~F.col("path").endswith(".py")).select("path", "text", language(F.col("path")).alias("lang"))
    own = F.transform(native_lines(F.col("text")), lambda x, i: F.struct(declared(F.ltrim(x), F.col("lang"))["name"].alias("name"), (i + 1).cast("long").alias("no")))
    found = told.select("path", "text", F.filter(own, lambda x: x["name"].isNotNull()).alias("f"))
    braced = found.select("path", "f", ends("text", F.col("f.no")).alias("ends"))
    return braced.select("path", F.explode(F.arrays_zip("f", "ends")).alias("x")).select("path", "x.f.name", F.col("x.f.no").alias("start"), F.col("x.ends").alias("end_no"))


@query(_CORPUS + f", e(no, terms) AS (VALUES {', '.join(map(str, _TERMS))}) SELECT path, CAST(terms AS BIGINT) AS terms FROM corpus JOIN e USING (no)")
def i13_gate_terms(t: Tables) -> DataFrame:
    """Branching terms of each file once strings and comments are blanked; the blanking is an Arrow function."""

    @F.arrow_udf("string")
    def code(text: pa.Array, hashes: pa.Array) -> pa.Array:
        return pa.array([blanked(x or "", h) for x, h in zip(text.to_pylist(), hashes.to_pylist(), strict=True)], pa.string())

    python = F.col("path").endswith(".py")
    clean = corpus(t).select("path", python.alias("python"), code("text", python).alias("code"))
    words = F.when(F.col("python"), F.regexp_count("code", F.lit(r"\b(if|for|while|elif|except|and|or)\b"))).otherwise(F.regexp_count("code", F.lit(r"\b(if|for|while|match|case|catch)\b|&&|\|\|")))
    return clean.select("path", words.cast("long").alias("terms"))
