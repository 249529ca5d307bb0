import json

import pytest
from pyspark.sql import functions as F

from skein.sources import coverage, files, protocols, store, traces
from skein.streaming import sync
from tests.conftest import rows


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")
    return str(path)


NODES = [
    ("fn:pkg.mod.run", "function", "run", "pkg.mod.run"), ("class:pkg.mod.Job", "class", "Job", "pkg.mod.Job"), ("table:jobs", "table", "jobs", None),
    ("route:GET:/items/", "route", "items", None), ("route:get:/items", "route", "items", None), ("route:POST:/items", "route", "items", None),
]


def nodes(spark):
    return spark.createDataFrame(NODES, "id string, kind string, name string, qualname string")


def test_scan_and_python_facts(spark, tmp_path):
    root = tmp_path / "project"
    write(root / "pyproject.toml", '[tool.setuptools.packages.find]\nwhere = ["src"]\n')
    write(root / "src/pkg/__init__.py", "")
    write(root / "src/pkg/mod.py", "import os\nfrom pkg.other import helper as h\n\nclass Base:\n    pass\n\nclass Job(Base):\n    def run(self):\n        self.stop()\n        h(1)\n        os.listdir()\n        x().y()\n\n    def stop(self):\n        return local()\n\ndef local():\n    pass\n")
    write(root / "src/pkg/bad.py", "def (:\n")
    write(root / "src/pkg/gen.py", "# @generated\nx = 1\n")
    write(root / "node_modules/n.py", "x = 1\n")
    assert files.detect_roots(str(root)) == ["src"]
    found = files.scan(spark, str(root), exclude=("gen",))
    got = {r.path: r for r in found.collect()}
    assert set(got) == {"src/pkg/__init__.py", "src/pkg/mod.py", "src/pkg/bad.py"}
    assert (got["src/pkg/mod.py"].module, got["src/pkg/mod.py"].line_count, got["src/pkg/__init__.py"].is_package) == ("pkg.mod", 18, True)
    facts = files.python_facts(found).collect()
    ids = {(r.id, r.kind) for r in facts if r.entity == "node"}
    assert {("mod:pkg.mod", "module"), ("class:pkg.mod.Job", "class"), ("method:pkg.mod.Job.run", "method"), ("fn:pkg.mod.local", "function"), ("mod:pkg.bad", "parse_error")} <= ids
    links = {(r.source, r.target, r.kind, r.confidence) for r in facts if r.entity == "edge"}
    assert {
        ("mod:pkg.mod", "mod:pkg.other", "imports", "confirmed"), ("class:pkg.mod.Job", "class:pkg.mod.Base", "extends", "inferred"), ("method:pkg.mod.Job.run", "method:pkg.mod.Job.stop", "calls", "inferred"),
        ("method:pkg.mod.Job.run", "fn:pkg.other.helper", "calls", "inferred"), ("method:pkg.mod.Job.run", "fn:os.listdir", "calls", "inferred"), ("method:pkg.mod.Job.run", "attr:y", "dynamic_call", "unresolved"),
        ("method:pkg.mod.Job.stop", "fn:pkg.mod.local", "calls", "heuristic"), ("class:pkg.mod.Job", "method:pkg.mod.Job.run", "defines", "confirmed"),
    } <= links
    assert ("package:pkg", "mod:pkg.mod", "contains") in rows(files.packages(found))
    both = files.workspace(spark, {"a": str(root), "b": str(root)}, lambda s, p: files.scan(s, p))
    assert {r.repo_id for r in both.select("repo_id").distinct().collect()} == {"a", "b"}


def test_traces(spark, tmp_path):
    write(tmp_path / "t/one.json", {"trace_run": {"trace_run_id": "r", "commit_sha": "c1"}, "events": [{"kind": "call", "source": "pkg.mod.run", "target": "class:pkg.mod.Job"}, {"kind": "read", "source": "mod.nowhere", "target": "jobs"}, {"source": "fn:pkg.mod.run", "target": "fn:pkg.mod.run"}]})
    write(tmp_path / "t/two.json", {"trace_run": {"trace_run_id": "q", "commit_sha": "c2"}, "events": [{"source": "a", "target": "b"}]})
    events = traces.read_traces(spark, str(tmp_path / "t"), commit="c1")
    assert {r.trace_run_id for r in events.collect()} == {"r"}
    got = rows(traces.trace_edges(traces.bind_events(events, nodes(spark))))
    assert got == [("fn:pkg.mod.run", "class:pkg.mod.Job", "calls", "runtime-only", 1)]
    assert sync.is_stale("c2", None, "c1", "v") and not sync.is_stale(None, None, "c1", "v")


def test_spans(spark, tmp_path):
    attributes = [{"key": "trace.source", "value": {"stringValue": "a"}}, {"key": "trace.target", "value": {"stringValue": "b"}}, {"key": "code.lineno", "value": {"intValue": "7"}}]
    place = write(tmp_path / "s.json", {"resourceSpans": [{"scopeSpans": [{"spans": [{"spanId": "1", "attributes": attributes}, {"spanId": "2", "attributes": []}, {"spanId": "3"}]}]}]})
    got = rows(traces.read_spans(spark, place).select("spanId", "source", "target", "line"))
    assert got == [("1", "a", "b", 7), ("2", None, None, None), ("3", None, None, None)]


def test_har(spark, tmp_path):
    urls = [("get", "https://x/items/"), ("POST", "https://x//items"), ("GET", "https://x/none"), ("GET", "ftp://x/items"), (None, "https://x/items"), ("POST", "https://x/it%65ms?q=1")]
    place = write(tmp_path / "h.har", {"log": {"entries": [{"request": {"method": m, "url": u}, "response": {"status": 200}} for m, u in urls]}})
    got = [(r.route_id, r.state) for r in traces.har_routes(spark, place, nodes(spark)).orderBy("pos").collect()]
    assert got == [(None, "ambiguous"), ("route:POST:/items", "matched"), (None, "unmatched"), (None, "not_http"), (None, "malformed"), ("route:POST:/items", "matched")]


def test_coverage_shapes(spark, tmp_path):
    own = write(tmp_path / "own.json", {"tests": [{"test": "t1", "covers": ["a", "b", "a"]}, {"symbol": "t2", "covers": ["c"]}, {"covers": ["d"]}]})
    assert rows(coverage.read_tests(spark, own)) == [("t1", "a"), ("t1", "b"), ("t2", "c")]
    py = write(tmp_path / "py.json", {"meta": {}, "files": {"src/a.py": {"executed_lines": [1, 2], "contexts": {"2": ["tests/t.py::T::test_x[1|2]|run", "", "production"]}}}})
    assert rows(coverage.read_python(spark, py).select("path", "line", "context")) == [("src/a.py", 1, None), ("src/a.py", 2, None), ("src/a.py", 2, "tests/t.py::T::test_x")] or rows(
        coverage.read_python(spark, py).select("path", "line", "context")
    ) == sorted([("src/a.py", 1, None), ("src/a.py", 2, None), ("src/a.py", 2, "tests/t.py::T::test_x")], key=repr)
    ist = write(tmp_path / "ist.json", {"a.ts": {"path": "src/a.ts", "statementMap": {"0": {"start": {"line": 3}, "end": {"line": 4}}, "1": {"start": {"line": 9}, "end": {"line": 9}}}, "s": {"0": 2, "1": 0}, "fnMap": {"0": {"loc": {"start": {"line": 7}, "end": {"line": 6}}}}, "f": {"0": 1}}})
    assert rows(coverage.read_istanbul(spark, ist).select("path", "line")) == [("src/a.ts", 3), ("src/a.ts", 4)]
    web = write(tmp_path / "web.json", [{"url": "https://x/src/a%20b.js", "text": "ab\ncd\nef\n", "ranges": [{"start": 0, "end": 1}, {"start": 4, "end": 7}, {"start": 9, "end": 9}]}, {"url": "file:///q", "text": "z", "ranges": [{"start": 0, "end": 1}]}])
    assert rows(coverage.read_browser(spark, web).select("path", "line")) == [("src/a b.js", 1), ("src/a b.js", 2), ("src/a b.js", 3)]
    xml = write(tmp_path / "c.xml", '<coverage><packages><package><classes><class filename="a.py"><lines><line number="1" hits="2"/><line number="2" hits="0"/></lines></class></classes></package></packages></coverage>')
    assert rows(coverage.read_cobertura(spark, xml).select("path", "line")) == [("a.py", 1)]
    known = spark.createDataFrame([("src/a.py",), ("lib/a.py",), ("src/only.py",)], "path string")
    lines = spark.createDataFrame([("/home/x/src/a.py", 1), ("only.py", 2), ("a.py", 3), ("zz.py", 4)], "path string, line int")
    assert rows(coverage.match_paths(lines, known).select("line", "file")) == [(1, "src/a.py"), (2, "src/only.py"), (3, None), (4, None)]


def test_document_index(spark, tmp_path):
    def at(symbol, rng, roles=0):
        return {"symbol": symbol, "range": rng, "symbolRoles": roles}

    index = {"documents": [{"relativePath": "a.py", "occurrences": [at("Outer", [0, 0, 90, 0], 1), at("inner", [10, 0, 20, 5], 1), at("inner", [15, 2, 8]), at("ext", [50, 0, 4]), at("inner", [95, 0, 3]), at("", [1, 1, 2]), at("short", [1])]}]}
    found = protocols.occurrences(spark, write(tmp_path / "i.json", index))
    got = rows(protocols.reference_edges(found).select("source", "target", "external"))
    assert got == [("Outer", "ext", True), ("inner", "inner", False), ("mod:a.py", "inner", False)]


def test_openapi_and_external(spark, tmp_path):
    spec = {"openapi": "3.0.0", "paths": {"/jobs": {"get": {"operationId": "run", "responses": {"200": {"schema": {"$ref": "#/components/schemas/Job"}}}}, "post": {"operationId": "none"}, "parameters": []}}}
    operations = protocols.openapi(spark, write(tmp_path / "o.json", spec))
    got = rows(protocols.bind_operations(operations, nodes(spark)).select("method", "route", "handler", "state", F.array_join("schemas", ",")))
    assert got == [("GET", "/jobs", "fn:pkg.mod.run", "matched", "Job"), ("POST", "/jobs", None, "unmatched", "")]
    payload = {"schema_version": "1", "extractor": "x", "language": "go", "nodes": [{"id": "n", "kind": "function"}], "edges": [{"source": "n", "target": "m", "kind": "calls"}], "warnings": []}
    n, e, w = protocols.external(spark, write(tmp_path / "x/p.json", payload))
    assert rows(n.select("language", "id")) == [("go", "n")] and rows(e.select("source", "kind")) == [("n", "calls")] and w.count() == 0
    write(tmp_path / "bad/p.json", "{nope")
    with pytest.raises(Exception):
        protocols.external(spark, str(tmp_path / "bad"))[0].collect()


def test_diff_and_metrics(spark, tmp_path):
    status = spark.createDataFrame([("M\ta.py",), ("R100\told.py\tnew.py",), ("T\tx",), ("",)], "value string")
    assert rows(protocols.changed_paths(status)) == sorted([("M", "a.py", None), ("R", "new.py", "old.py"), ("other", "x", None)], key=repr)
    text = ["--- a/a.py", "+++ b/a.py", "@@ -1,2 +3,4 @@ def x", "+y", "@@ -9 +12 @@", "@@ -20,2 +21,0 @@", "+++ b/b.py", "@@ -0,0 +1 @@"]
    diff = spark.createDataFrame([("d", i, t) for i, t in enumerate(text)], "file string, line_no int, value string")
    assert rows(protocols.hunks(diff)) == [("a.py", 12, 12), ("a.py", 21, 20), ("a.py", 3, 6), ("b.py", 1, 1)]
    log = write(tmp_path / "m.jsonl", '{"command": "stats", "duration_ms": 5}\n{broken\n{"tool_name": "t", "duration_ms": 1.5}\n{"command": "x"}\n')
    assert rows(protocols.read_metrics(spark, log).select("command", "duration_ms")) == [("stats", 5.0), ("t", 1.5)]


def test_snapshot_store(spark, tmp_path):
    place = store.SnapshotStore(spark, str(tmp_path / "store"))
    assert place.current() is None
    with pytest.raises(LookupError):
        place.read("nodes")
    for i in range(4):
        place.write(f"v{i}", {"nodes": spark.range(i + 1)})
    assert place.current() == "v3" and place.read("nodes").count() == 4 and place.read("nodes", "v0").count() == 1
    assert sorted(place.prune(2, pinned=("v0",))) == ["v1", "v2"] and place.versions() == ["v0", "v3"]
    df = spark.createDataFrame([(2, None, "z"), (1, "x", "y")], "b int, a string, c string")
    store.export_jsonl(df, str(tmp_path / "out"))
    assert rows(spark.read.text(str(tmp_path / "out"))) == [('{"a":"x","b":1,"c":"y"}',), ('{"b":2,"c":"z"}',)]
    assert store.summary({"t": df}, 1)["t"] == {"count": 2, "sample": ['{"a":"x","b":1,"c":"y"}'], "omitted": 1}
    assert "| 1 | x | y |" in store.markdown("T", df, ["b"])
    assert store.force_graph(df, df).count() == 4
    assert store.manifest(spark, str(tmp_path / "out/*.txt"), "c").count() >= 1


def test_streams(spark, tmp_path):
    from skein.operators.incremental import IncrementalTarget

    schema = "record_type string, record_key string, version string, at timestamp_ntz"
    first = spark.createDataFrame([("f", "a", "1", None), ("f", "b", "1", None)], schema)
    first.write.parquet(str(tmp_path / "in/one"))
    target = IncrementalTarget(spark, str(tmp_path / "target"), 2)
    args = (spark, str(tmp_path / "in/*"), schema, target, str(tmp_path / "cp"))
    sync.sync(*args).awaitTermination()
    spark.createDataFrame([("f", "a", "2", None)], schema).write.parquet(str(tmp_path / "in/two"))
    sync.sync(*args).awaitTermination()
    sync.sync(*args).awaitTermination()
    assert rows(target.rows().where("changed").select("run_no", "record_key")) == [(0, "a"), (0, "b"), (1, "a")]


def test_windowed_stream_equals_batch(spark, tmp_path):
    from datetime import datetime, timedelta

    from skein.streaming import windows

    t = datetime(2026, 1, 1)
    df = spark.createDataFrame([(t + timedelta(minutes=7 * i), "k", float(i)) for i in range(30)], "ts timestamp_ntz, k string, value double")
    df.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "ev"))
    query = windows.tumbling(stream, "ts", "1 hour", ["k"], "value").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows(spark.table("counted")) == rows(windows.tumbling(df, "ts", "1 hour", ["k"], "value"))
