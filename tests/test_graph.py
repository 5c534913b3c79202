"""The fixture project, scoping rules and traversal against a breadth-first search in Python."""

import random

import pytest
from pyspark.sql import functions as F

from ferrule import render
from ferrule.operators import graph as G
from ferrule.operators import lookups as Q
from ferrule.operators.index import Graph, index_sources

MATH = "int add(int a, int b) {\n    return a + b;\n}\n\nint subtract(int a, int b) {\n    return a - b;\n}\n\nint multiply(int a, int b) {\n    return add(a, b) + subtract(a, b);\n}\n"
MAIN = "#include <stdio.h>\n\nvoid show(int value) {\n    printf(\"%d\", value);\n}\n\nint main(void) {\n    int x = add(3, 4);\n    int y = subtract(10, 3);\n    int z = multiply(2, 5);\n    show(x);\n    show(y);\n    return 0;\n}\n"


@pytest.fixture(scope="module")
def project(spark):
    return index_sources(spark, [("math.c", MATH), ("main.c", MAIN)])


def called(answer, what="callees"):
    return [(r["name"], r["file"], r.get("line")) for r in answer[what]]


def test_stats(project):
    assert project[1].first().asDict() == {"status": "ok", "files_ok": 2, "files_err": 0, "l2_hits": 0, "functions": 5, "call_edges": 8}


def test_call_graph(project):
    g = project[0]
    assert called(Q.query_call_graph(g, "main", "callees")) == [("add", "math.c", 8), ("subtract", "math.c", 9), ("multiply", "math.c", 10), ("show", "main.c", 11)]
    two = called(Q.query_call_graph(g, "main", "callees", depth=2))
    assert two == [("add", "math.c", None), ("subtract", "math.c", None), ("multiply", "math.c", None), ("show", "main.c", None), ("printf", "", None)]
    assert called(Q.query_call_graph(g, "add", "callers"), "callers") == [("main", "main.c", 8), ("multiply", "math.c", 10)]
    assert Q.query_call_graph(g, "main", "both", depth=0) == {"name": "main", "file": "main.c", "callers": [], "callees": []}
    assert Q.query_call_graph(g, "main", "sideways") == {"name": "main", "file": "main.c"}
    assert Q.query_call_graph(g, "printf", "callees") == {"error": "function 'printf' not found"}
    assert Q.query_call_graph(g, "main", "callees", "math") == {"error": "function 'main' not found in files matching 'math'"}


def test_lookups(project):
    g = project[0]
    assert [(s["name"], s["line"], s["signature"]) for s in Q.symbol_lookup(g, "MATH")["symbols"]][0] == ("add", 1, "int add(int a, int b)")
    assert Q.symbol_lookup(g, "none") == {"file": "none", "symbols": []}
    assert Q.symbol_lookup(g, "", "klass")["error"].startswith("unknown kind 'klass', valid: function|variable")
    assert Q.get_source(g, "add") == "// file: math.c\n// line: 1\n\nint add(int a, int b) {\n    return a + b;\n}"
    assert Q.get_source(g, "nothing") == {"error": "symbol 'nothing' not found"}


def test_find(project):
    g = project[0].functions
    assert [r.name for r in G.find_function(g, "ADD").collect()] == ["add"]
    assert {r.name for r in G.find_functions_in_file(g, "MAIN").collect()} == {"show", "main"}


def test_scoping(spark):
    a = "static void s(void) {}\nvoid t(void) { s(); u(); v(); }"
    b = "static void s(void) {}\nvoid w(void) { s(); }\nvoid u(void) {}\nvoid v(void) {}"
    c = "void v(void) {}\nvoid z(void) { v(); }"
    g, _ = index_sources(spark, [("a.c", a), ("b.c", b), ("c.c", c)])
    assert Q.query_call_graph(g, "s", "callers")["ambiguous"]
    assert called(Q.query_call_graph(g, "s", "callers", "b.c"), "callers") == [("w", "b.c", 2)]
    assert called(Q.query_call_graph(g, "t", "callees")) == [("s", "a.c", 2), ("u", "b.c", 2), ("v", "b.c", 2)]
    assert called(Q.query_call_graph(g, "z", "callees")) == [("v", "c.c", 2)]


def test_ambiguous_source_and_labels(spark):
    g, _ = index_sources(spark, [("x.h", "typedef struct S { int x; } S;\n#define M(a) (a)\nenum { A = 1, B };\nint gv = 2;")])
    assert [(m["kind"], m["signature"]) for m in Q.get_source(g, "S")["matches"]] == [("typedef", "struct S { int x; }"), ("typedef", "typedef struct S { int x; } S;")]
    assert Q.get_source(g, "M").endswith("\n\n#define M(a) (a)") and Q.get_source(g, "A").endswith("\n\nA = 1") and Q.get_source(g, "B").endswith("\n\nB")
    kinds = [(s["name"], s["kind"], s["signature"]) for s in Q.symbol_lookup(g, "x")["symbols"]]
    assert ("M", "macro", "#define M(a)") in kinds and ("A", "enum_value", "A = 1") in kinds and ("gv", "variable", "int gv = 2;") in kinds


def spec(functions, calls, start, direction, depth):
    """Breadth-first search over (name, file) as the rules say."""
    defs, static = {}, {}
    for name, file, pos, is_static in sorted(functions, key=lambda f: (f[1], f[2])):
        defs.setdefault(name, []).append(file)
        static.setdefault((name, file), is_static)
    seen, queue, out = {start}, [(start, 0)], []
    while queue:
        (name, file), d = queue.pop(0)
        if d >= depth:
            continue
        for caller, callee, caller_file, _ in sorted(calls, key=lambda c: (c[2], c[3])):
            if direction == "callees":
                if (caller, caller_file) != (name, file):
                    continue
                where = defs.get(callee, [])
                state = (callee, "" if not where else caller_file if caller_file in where else where[0])
            else:
                if callee != name or static.get((name, file), False) and caller_file != file:
                    continue
                state = (caller, caller_file)
            if state not in seen:
                seen.add(state)
                out.append((*state, d + 1))
                queue.append((state, d + 1))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_traversal_follows_the_search_order(spark, seed):
    rnd = random.Random(seed)
    names, files = [f"f{i}" for i in range(7)], [f"{c}.c" for c in "abc"]
    functions = [(rnd.choice(names), rnd.choice(files), p, rnd.random() < 0.4) for p in range(12)]
    calls = [(c, d, f, p) for p in range(30) for c, d, f in [(rnd.choice(names), rnd.choice([*names, "ext"]), rnd.choice(files))] if c != d]
    graph = Graph.empty(spark)
    graph.functions = spark.createDataFrame(functions, "name string, file string, pos long, is_static boolean")
    graph.calls = spark.createDataFrame(calls, "caller string, callee string, caller_file string, pos long").withColumn("line", F.col("pos"))
    start = functions[0][:2]
    starts = spark.createDataFrame([start], "name string, file string")
    for direction in ("callees", "callers"):
        for depth in (1, 3):
            got = G.reach(starts, graph, direction, depth).orderBy("depth", "path").collect()
            assert [(r.name, r.file, r.depth) for r in got] == spec(functions, calls, start, direction, depth), (direction, depth)


def plain_names(calls, start, direction, depth):
    """Breadth-first search over names alone, calls in the order of file and place."""
    seen, queue, out = {start}, [(start, 0)], []
    while queue:
        name, d = queue.pop(0)
        for caller, callee, _, _ in sorted(calls, key=lambda c: (c[2], c[3])) if d < depth else []:
            src, dst = (caller, callee) if direction == "callees" else (callee, caller)
            if src == name and dst not in seen:
                seen.add(dst)
                out.append((dst, d + 1))
                queue.append((dst, d + 1))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_search_by_name_follows_the_search_order(spark, seed):
    rnd = random.Random(seed)
    names = [f"f{i}" for i in range(9)]
    calls = [(*rnd.sample(names, 2), rnd.choice("abc"), p) for p in range(25)]
    frame = spark.createDataFrame(calls, "caller string, callee string, caller_file string, pos long")
    for direction in ("callees", "callers"):
        for depth in (0, 1, 2, 4):
            got = G.reach_by_name("f0", frame, direction, depth).orderBy("depth", "path").collect()
            assert [(r.name, r.depth) for r in got] == plain_names(calls, "f0", direction, depth)


def test_tabular_output():
    answer = {"file": "a.c", "symbols": [{"name": "x", "line": 1, "signature": "int x, y;"}]}
    assert render.tabular(answer) == 'file: a.c\nsymbols[1]{name,line,signature}:\n  x,1,"int x, y;"'
    assert render.tabular("text") == "text" and render.pretty("text") == "text" and render.compact({"a": [1]}) == '{"a":[1]}'
    assert render.tabular({"callers": [{"name": "a"}, {"name": "b", "line": 1}]}).startswith("{")
