"""Every registered query against its SQL over the same tables, and the driver's entry points."""

import hashlib
import math

import duckdb
import pytest

from stratalens.plans.registry import REGISTERED
from stratalens.registry import flagship, oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def canonical(rows, columns):
    cell = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else repr(v)
    return sorted(tuple(cell(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    got = [r.asDict() for r in df.collect()]
    sql = oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = duck.execute(sql)
    names, kinds = [d[0] for d in found.description], {d[0]: str(d[1]) for d in found.description}
    columns = sorted(names)
    assert columns == sorted(df.columns)
    assert {c: TYPES[k] for c, k in df.dtypes} == kinds
    assert canonical(got, columns) == canonical([dict(zip(names, row, strict=True)) for row in found.fetchall()], columns)


def test_flagship_has_rows(spark, sf_dir):
    df = flagship(spark, sf_dir)
    assert df.count() > 0
    assert df.columns == ["hash", "score", "sampled", "percentile", "level"]


def test_names_are_unique_and_checked():
    unchecked = {n for n, (_, sql) in REGISTERED.items() if sql is None}
    assert unchecked == {"a01_directory_scan"}


def test_use_trees():
    from stratalens.functions.code import _uses

    assert _uses("use a::{b, c::{d, self}, e as f};\npub use g;") == ["a::b", "a::c::d", "a::c", "a::e", "g"]


def test_publish_refuses_uncommitted(spark, tmp_path):
    from stratalens.sources.publish import committed, load, publish

    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    folder = publish(df, str(tmp_path))
    assert committed(spark, folder) and publish(df.orderBy("v"), str(tmp_path)) == folder
    assert sorted(map(tuple, load(spark, folder).collect()), key=str) == [(1, "a"), (2, None)]
    with pytest.raises(FileNotFoundError):
        load(spark, str(tmp_path / "none"))


def test_entry_points_import():
    import __spark_entry__ as e

    assert set(oracle_sql()) <= set(e.oracle_sql())
    assert set(queries()) <= set(e.queries())


def test_blanking_and_ends():
    from stratalens.functions.code import blanked, brace_ends

    assert blanked('a("}") // }\n/* {\n */ b') == 'a(   )     \n    \n    b'
    assert blanked("x = 'if' # if\ny", True) == "x =          \ny"
    assert brace_ends('fn f() { // }\n  g("}");\n}\nfn h() {}', [1, 4]) == [3, 4]
    assert brace_ends("fn f() {\n", [1, 2]) == [2, 2]


def test_ends_of_functions_in_one_pass():
    """Against the plain definitions, on random files and on one of 100,000 lines."""
    import random
    import time

    from stratalens.functions.code import brace_ends, indented_ends

    rng = random.Random(1)

    def indented(text):
        lines = [x.rstrip("\r") for x in text.split("\n")]
        code = [(no, len(x) - len(x.lstrip(" ")), x.lstrip(" ")) for no, x in enumerate(lines, 1) if x.strip(" ") and not x.lstrip(" ").startswith("#")]
        return [(no, next((n - 1 for n, i, _ in code if n > no and i <= indent), code[-1][0])) for no, indent, x in code if x.startswith("def ")]

    def braced(text, start):
        depth, opened, lines = 0, False, text.split("\n")
        for no in range(start, len(lines) + 1):
            depth += lines[no - 1].count("{") - lines[no - 1].count("}")
            opened = opened or "{" in lines[no - 1]
            if opened and depth <= 0:
                return no
        return len(lines)

    for _ in range(200):
        text = "\n".join(" " * rng.randint(0, 4) + rng.choice(["def f():", "x = 1", "# note", "", "   ", "return\r", "defer"]) for _ in range(rng.randint(1, 40)))
        assert indented_ends(text) == indented(text)
        text = "\n".join("".join(rng.choices("{}ab ", (3, 3, 1, 1, 1), k=rng.randint(0, 5))) for _ in range(rng.randint(1, 30)))
        starts = [rng.randint(1, text.count("\n") + 1) for _ in range(6)]
        assert brace_ends(text, starts) == [braced(text, s) for s in starts]
    began = time.time()
    deep = "\n".join(" " * (i % 50) + "def f():" for i in range(100_000))
    assert len(indented_ends(deep)) == 100_000
    assert brace_ends("{\n" * 50_000 + "}\n" * 50_000, list(range(1, 50_001)))[:2] == [100_000, 99_999]
    assert time.time() - began < 10


def test_cochange_observations_of_all_years(spark, duck, sf_dir):
    """Every commit counts, not those of the last year only."""
    row = queries()["d18_cochange_observations"](spark, sf_dir).first()
    assert row["commits_walked"] == duck.execute("SELECT count(DISTINCT l_orderkey) FROM lineitem JOIN part ON p_partkey = l_partkey").fetchone()[0]
    assert row["pairs_observed"] >= row["edges_kept"] and row["observations"] >= 3 * row["edges_kept"] > 0


def test_snapshot_identity_is_of_all_members(spark, duck, sf_dir):
    want = {a: hashlib.sha256(",".join(map(str, sorted(keys))).encode()).hexdigest() for a, keys in duck.execute("SELECT o_custkey, list(o_orderkey) FROM orders GROUP BY 1").fetchall()}
    assert {r["repo"]: r["now"] for r in queries()["k14_snapshot_status"](spark, sf_dir).collect()} == want


def test_snapshot_status_keeps_every_repository(spark, duck, sf_dir, tmp_path):
    """Repositories whose members all lack a key stay, and missing dates, missing authors and repeated keys are taken as the SQL takes them."""
    odd = """SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 7 = 0
        UNION ALL SELECT * REPLACE (NULL AS o_orderkey, -1 - o_custkey AS o_custkey) FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT * REPLACE (NULL AS o_orderkey) FROM orders WHERE o_orderkey % 5 = 1
        UNION ALL SELECT * REPLACE (NULL AS o_orderdate) FROM orders WHERE o_orderkey % 5 = 2 UNION ALL SELECT * REPLACE (NULL AS o_custkey) FROM orders WHERE o_orderkey % 5 = 3"""
    duck.execute(f"COPY ({odd}) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    columns = ["repo", "recorded", "now", "status"]
    want = [dict(zip(columns, row, strict=True)) for row in con.execute(f"SELECT repo, recorded, now, status FROM ({oracle_sql()['k14_snapshot_status']})").fetchall()]
    assert any(r["now"] is None for r in want)
    assert canonical(queries()["k14_snapshot_status"](spark, str(tmp_path)).collect(), columns) == canonical(want, columns)


@pytest.mark.parametrize("name", ["i04_symbols", "i07_imports", "i09_signatures", "i12_complexity"])
def test_language_is_told_once_a_file(spark, sf_dir, name):
    """The pattern of a path's extension isn't copied into the conditions on lines, and files fill all tasks."""
    df = queries()[name](spark, sf_dir)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("([^./]+)$") <= 2
    assert df.rdd.getNumPartitions() >= 4


def test_suffix_keys_are_reduced_before_the_join(spark, sf_dir):
    """Of the keys that end in a path the first is taken before pages meet them."""
    plan = queries()["c07_suffix_key"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Aggregate [path#" in line and "min(key#" in line for line in plan.splitlines()) == 1
