"""Files on disk: read, scanned, and broken and oversized ones reported."""

import json

from stratalens.functions.code import complexity_of, lines_in, symbols_in
from stratalens.sources import files


def write(folder, name, data):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_texts_of_a_tree(spark, tmp_path):
    write(tmp_path, "src/a.py", "def one():\n    if x:\n        pass\nclass Two:\n    pass\n")
    write(tmp_path, "cmd/b.go", "func (s *T) Run() {\n\tfor i := range x {}\n}\n")
    write(tmp_path, "c d/é.txt", "Grüße\r\nzwei")
    write(tmp_path, "bad.bin", b"\xff\xfe\x00")
    write(tmp_path, "large.rs", "fn big() {}\n" + "x" * 400)
    write(tmp_path, "empty.md", "")  # Spark's listing leaves it out
    write(tmp_path, ".git/config", "hidden")
    found = files.texts(spark, str(tmp_path), most=300)
    rows = {r["path"]: r for r in found.collect()}
    assert {p: r["status"] for p, r in rows.items()} == {"src/a.py": "ok", "cmd/b.go": "ok", "c d/é.txt": "ok", "bad.bin": "not_utf8", "large.rs": "oversized"}
    assert rows["c d/é.txt"]["text"] == "Grüße\r\nzwei" and rows["large.rs"]["text"] is None and rows["large.rs"]["length"] == 412
    good = found.filter("status = 'ok'").select("path", "text")
    assert {(r["path"], r["no"], r["name"], r["kind"]) for r in symbols_in(lines_in(good)).collect()} == {("src/a.py", 1, "one", "function"), ("src/a.py", 4, "Two:", "class"), ("cmd/b.go", 1, "Run", "function")}
    assert {r["path"]: r["complexity"] for r in complexity_of(good).collect()} == {"src/a.py": 2, "cmd/b.go": 2, "c d/é.txt": 1}
    plan = files.texts(spark, str(tmp_path), most=300)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,300)" in plan  # what is too large is never read


def test_traces(spark, tmp_path):
    event = lambda seq, *targets: {"seq": seq, "action": "edit", "tool": "t", "isError": seq == 2, "note": "x", "targets": [{"path": p, "touch": "write"} for p in targets]}
    good = {"version": 1, "session": {"id": "s1", "harness": "h", "cwd": "/"}, "stats": {"n": 1}, "events": [event(2, "a.py", "b.py"), event(0), event(1, "a.py")]}
    write(tmp_path, "good.json", json.dumps(good, indent=2))
    write(tmp_path, "deep/cut.json", json.dumps(good)[:60])
    write(tmp_path, "wrong.json", '{"version": 1, "session": {"id": 5}, "events": "none"}')
    write(tmp_path, "old.json", json.dumps(good | {"version": 2}))
    write(tmp_path, "anon.json", json.dumps(good | {"session": {"harness": "h"}}))
    write(tmp_path, "twice.json", json.dumps(good | {"events": [event(1), event(1)]}))
    write(tmp_path, "minus.json", json.dumps(good | {"events": [event(-1)]}))
    write(tmp_path, "none.json", json.dumps(good | {"events": []}))
    write(tmp_path, "tool.json", json.dumps(good | {"events": [event(1) | {"tool": None}]}))
    write(tmp_path, "target.json", json.dumps(good | {"events": [event(1, "")]}))
    write(tmp_path, "blank.json", " ")
    write(tmp_path, "bytes.json", b"\xff{")
    write(tmp_path, "huge.json", json.dumps(good | {"pad": "x" * 5000}))
    found = files.traces(files.texts(spark, str(tmp_path), most=4000))
    status = {r["path"]: r["status"] for r in found.collect()}
    assert status == {
        "good.json": "ok", "none.json": "event_count", "deep/cut.json": "broken", "wrong.json": "broken", "blank.json": "broken", "old.json": "unsupported_version", "anon.json": "no_session", "twice.json": "duplicate_seq",
        "minus.json": "invalid_event", "tool.json": "invalid_event", "target.json": "invalid_target", "bytes.json": "not_utf8", "huge.json": "oversized",
    }
    events = [(r["session"], r["seq"], r["place"], r["is_error"], r["target"]) for r in files.trace_events(found).collect()]
    assert sorted(events, key=str) == sorted([("s1", 0, 1, False, None), ("s1", 1, 2, False, "a.py"), ("s1", 2, 3, True, "a.py"), ("s1", 2, 3, True, "b.py")], key=str)


def test_a_tree_that_spark_wrote(spark, tmp_path):
    rows = [("src/a+b.py", "x = 1\n\ny = 2"), ("deep/er/c d.txt", " "), ("q=1/%41.md", "é\n"), ("long.rs", "z" * 99)]
    files.write_tree(spark.createDataFrame(rows, "path string, text string"), f"{tmp_path}/tree")
    found = {(r["path"], r["text"], r["status"], r["length"]) for r in files.tree_texts(spark, f"{tmp_path}/tree", most=50).collect()}
    assert found == {(p, t if len(t) < 50 else None, "ok" if len(t) < 50 else "oversized", len(t.encode())) for p, t in rows}
