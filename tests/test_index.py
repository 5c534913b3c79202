"""Scanning, decoding, the fact cache and freshness on a real folder."""

import io
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from ferrule import logs
from ferrule.cli import main, parser
from ferrule.server import Server
from ferrule.sources import store, tree
from ferrule.sources.cache import FactCache, newest
from ferrule.streaming.freshness import FreshGraph, changes


def make(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_scan_takes_hidden_names_and_exact_suffixes(spark, tmp_path):
    make(tmp_path, {".hid/c.c": "int a;", "_u/d.h": "int b;", "F.C": "int c;", "g.cc": "int d;", "bad.h": b"\xff\xfe", "ok.c": "int e;"})
    os.makedirs(tmp_path / "dir.c")
    files = {os.path.relpath(r.path, tmp_path): r.content for r in tree.decode(tree.scan(spark, str(tmp_path))).collect()}
    # a folder that is named like a source can't be read, which counts as an error
    assert files == {".hid/c.c": "int a;", "_u/d.h": "int b;", "bad.h": None, "ok.c": "int e;", "dir.c": None}


def test_names_that_are_only_a_suffix_have_no_extension(tmp_path):
    make(tmp_path, {".c": "int a;", ".h": "int b;", "a..c": "int c;"})
    assert [os.path.basename(p) for p in tree.walk(str(tmp_path))] == ["a..c"]


def test_empty_folder(spark, tmp_path):
    graph, stats = FactCache(spark, str(tmp_path / "cache")).refresh(tree.decode(tree.scan(spark, str(tmp_path))))
    assert graph.functions.isEmpty() and stats.first().files_ok == 0


def test_cache_parses_only_what_changed(spark, tmp_path):
    src, cache = tmp_path / "src", FactCache(spark, str(tmp_path / "cache"))
    make(src, {"a.c": "int f(void) { g(); }", "b.c": "int g(void) {}", "same.c": "int g(void) {}", "bad.c": b"\xff"})
    files = lambda: tree.decode(tree.scan(spark, str(src)))
    graph, stats = cache.refresh(files())
    assert (stats.first().files_ok, stats.first().files_err, stats.first().l2_hits, stats.first().functions) == (3, 1, 0, 3)
    make(src, {"a.c": "int f2(void) { g(); }"})
    os.remove(src / "b.c")
    graph, stats = cache.refresh(files())
    assert (stats.first().files_ok, stats.first().l2_hits) == (2, 1)
    # equal contents keep their own paths, deleted files leave the graph
    assert sorted((r.name, os.path.basename(r.file)) for r in graph.functions.collect()) == [("f2", "a.c"), ("g", "same.c")]


def test_newest(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 3), ("c", 2), ("d", 3)], "path string, last_used int")
    assert {r.path for r in newest(rows, 2).collect()} == {"b", "d"} and newest(rows, 0).count() == 4


def test_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, content_hash string")
    assert {(r.path, r.change) for r in changes(old, new).collect()} == {("b", "modified"), ("c", "deleted"), ("d", "added")}


def test_fresh_graph_follows_the_files(spark, tmp_path):
    src = tmp_path / "src"
    make(src, {"a.c": "int f(void) {}"})
    fresh = FreshGraph(spark, str(src), str(tmp_path / "cache"), debounce=0.0)
    assert [r.name for r in fresh.graph().functions.collect()] == ["f"]
    make(src, {"b.c": "int g(void) {}"})
    os.utime(src / "b.c", (1, 1))  # an old time doesn't hide a new file
    assert sorted(r.name for r in fresh.graph().functions.collect()) == ["f", "g"]
    os.remove(src / "a.c")
    assert [r.name for r in fresh.graph().functions.collect()] == ["g"]


def test_debounce(spark, tmp_path):
    src = tmp_path / "src"
    make(src, {"a.c": "int f(void) {}"})
    fresh = FreshGraph(spark, str(src), str(tmp_path / "cache"), debounce=60.0)
    make(src, {"b.c": "int g(void) {}"})
    time.sleep(0.01)
    assert [r.name for r in fresh.graph().functions.collect()] == ["f"]


def test_inside_the_debounce_the_graph_is_the_snapshots(spark, tmp_path):
    src = tmp_path / "src"
    make(src, {"a.c": "int f(void) {}", "b.c": "int g(void) {}"})
    fresh = FreshGraph(spark, str(src), str(tmp_path / "cache"), debounce=60.0)
    make(src, {"a.c": "int changed(void) {}"})
    assert sorted(r.name for r in fresh.graph().functions.collect()) == ["f", "g"]
    os.remove(src / "b.c")
    assert sorted(r.name for r in fresh.graph().functions.collect()) == ["f", "g"]
    assert fresh.stats.first().files_ok == 2


def test_cold_and_warm_graphs_are_equal_and_old_snapshots_go(spark, tmp_path):
    src, cache = tmp_path / "src", FactCache(spark, str(tmp_path / "cache"))
    make(src, {f"f{i}.c": f"int f{i}(void) {{ f{i + 1}(); }}" for i in range(6)})
    rows = lambda g: sorted(map(tuple, g.functions.select("name", "file", "line").collect())) + sorted(map(tuple, g.calls.select("caller", "callee", "line").collect()))
    seen = [rows(cache.refresh(tree.decode(tree.scan(spark, str(src))))[0]) for _ in range(4)]
    assert seen[0] and all(s == seen[0] for s in seen)
    assert len([p for p in os.listdir(tmp_path / "cache") if p.startswith("snap-")]) == 2


def test_eviction_keeps_what_is_present_and_the_newest_others(spark, tmp_path):
    src, cache = tmp_path / "src", FactCache(spark, str(tmp_path / "cache"), overhead_percent=50)
    for k in range(4):
        make(src, {f"g{k}.c": f"int g{k}(void) {{}}"})
        cache.refresh(tree.decode(tree.scan(spark, str(src))))
        os.remove(src / f"g{k}.c")
        make(src, {"stays.c": "int s(void) {}", "too.c": "int t(void) {}"})
    cache.refresh(tree.decode(tree.scan(spark, str(src))))
    files, _ = cache.load()
    assert {(os.path.basename(r.path), r.here) for r in files.collect()} == {("stays.c", True), ("too.c", True), ("g3.c", False)}


def test_a_folder_that_cannot_be_made_means_an_uncached_run(spark, tmp_path):
    (tmp_path / "file").write_text("")
    src = tmp_path / "src"
    make(src, {"a.c": "int f(void) {}"})
    assert FactCache.open(spark, str(tmp_path / "file" / "cache")) is None
    fresh = FreshGraph(spark, str(src), str(tmp_path / "file" / "cache"), debounce=0.0)
    assert [r.name for r in fresh.graph().functions.collect()] == ["f"]
    assert FactCache.open(spark, str(tmp_path / "new")) and (tmp_path / "new" / ".gitignore").read_text() == "*\n"


def test_first_rows_of_many(spark, monkeypatch):
    monkeypatch.setattr(store, "TOP", 3)
    rows = spark.range(1000).selectExpr("id", "(id * 7919) % 1009 AS v")
    for n in (2, 4, 57, 1000, 2000):
        got = sorted(r.v for r in store.first_rows(rows, n, F.col("v").desc()).collect())
        assert got == sorted(((i * 7919) % 1009 for i in range(1000)), reverse=True)[:n][::-1]


def test_logs_go_to_a_file(tmp_path, capsys):
    log = logs.init(str(tmp_path / "logs"), quiet=True)
    log.info("hello")
    assert "INFO hello" in (tmp_path / "logs" / "log").read_text() and not capsys.readouterr().err
    logs.init(str(tmp_path / "logs" / "log" / "none"), quiet=True)


def test_server(spark, tmp_path):
    make(tmp_path, {"a.c": "int f(void) { g(); }"})
    graph, _ = FactCache(spark, str(tmp_path / "cache")).refresh(tree.decode(tree.scan(spark, str(tmp_path))))
    server = Server(lambda: graph)
    ask = lambda method, **params: {"jsonrpc": "2.0", "id": 1, "method": method, "params": params}
    requests = [
        ask("initialize", protocolVersion="2024-11-05"), {"jsonrpc": "2.0", "method": "notifications/initialized"}, ask("tools/list"),
        ask("tools/call", name="query_call_graph", arguments={"name": "f", "direction": "callees"}), ask("tools/call", name="get_source", arguments={"name": "f"}),
        ask("tools/call", name="symbol_lookup", arguments={"file": "a.c", "kind": "nonsense"}), ask("tools/call", name="symbol_lookup", arguments={}), ask("tools/call", name="none"), ask("other"), ask("ping"),
    ]
    out = io.StringIO()
    server.serve(io.StringIO("\n".join(map(json.dumps, requests)) + "\nnot json\n[]\n"), out)
    got = [json.loads(line) for line in out.getvalue().splitlines()]
    assert len(got) == len(requests) + 1
    assert [t["name"] for t in got[1]["result"]["tools"]] == ["symbol_lookup", "get_source", "query_call_graph"] and got[1]["result"]["tools"][2]["inputSchema"]["required"] == ["name", "direction"]
    text = [m["result"]["content"][0]["text"] if "content" in m.get("result", {}) else m.get("error", {}).get("message") for m in got[2:]]
    assert '"callees":[{"name":"g","file":"","line":1}]' in text[0] and text[1].endswith("int f(void) { g(); }") and "unknown kind" in text[2]
    assert text[3] == "missing parameter 'file'" and text[4] == "unknown tool 'none'" and text[5] == "unknown method 'other'" and got[-2]["error"]["code"] == -32700 and got[-1]["error"]["code"] == -32600


def test_cli_refuses_before_indexing(tmp_path):
    assert main([str(tmp_path / "none"), "index"]) == 2
    with pytest.raises(SystemExit):
        parser().parse_args([str(tmp_path), "nonsense"])


def test_cli_answers(spark, tmp_path, capsys):
    make(tmp_path, {"a.c": "int f(void) { g(); }"})
    main([str(tmp_path), "--cache", str(tmp_path / "cache"), "query-call-graph", "f", "--direction", "callees"])
    assert '"line": 1' in capsys.readouterr().out
