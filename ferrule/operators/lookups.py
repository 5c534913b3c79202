"""The three queries over the graph: symbol_lookup, get_source, query_call_graph.

Each has a DataFrame form, which stays distributed, and a form that returns what a tool
answers: a dict or text. Only answers reach the driver.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.functions import scalars as S
from ferrule.operators import graph as G
from ferrule.operators.index import Graph

_SYMBOLS = ("name", "kind", "line", "signature", "arm", "file", "pos")


def symbol_rows(graph: Graph, file: str, kind: str | None = None) -> DataFrame:
    """name, kind, line, signature of the symbols in matching files; arm, file and pos order equal lines.

    Arms that the kind rules out aren't scanned.
    """
    col, lit = F.col, F.lit
    arms = []

    def arm(table: DataFrame, number: int, kind_, signature) -> None:
        rows = table.where(S.contains_ci(col("file"), file))
        arms.append(rows.select("name", kind_.alias("kind"), "line", signature.alias("signature"), lit(number).alias("arm"), "file", "pos"))

    if kind in (None, "function"):
        arm(graph.functions, 0, lit("function"), S.function_signature(col("source")))
    if kind in (None, "variable"):
        arm(graph.globals, 1, lit("variable"), col("decl"))
    if kind in (None, "typedef", "struct", "union", "enum"):
        types = graph.types if kind is None else graph.types.where(col("kind") == kind)
        arm(types, 2, col("kind"), S.first_line(col("definition")))
    if kind in (None, "macro"):
        arm(graph.symbols.where(col("kind").isin("define", "macro_fn")), 3, lit("macro"), S.macro_signature(col("name"), col("kind"), col("value")))
    if kind in (None, "enum_value"):
        arm(graph.symbols.where(col("kind") == "enum_value"), 4, lit("enum_value"), S.enum_signature(col("name"), col("value")))
    out = arms[0]
    for other in arms[1:]:
        out = out.unionByName(other)
    return out


def kind_error(kind: str | None) -> dict | None:
    if kind is None or kind in S.KINDS:
        return None
    return {"error": f"unknown kind '{kind}', valid: {'|'.join(S.KINDS)}"}


def symbol_lookup(graph: Graph, file: str, kind: str | None = None) -> dict[str, Any]:
    if error := kind_error(kind):
        return error
    rows = symbol_rows(graph, file, kind).orderBy("line", "arm", "name", "file", "pos").collect()
    return {"file": file, "symbols": [{k: r[k] for k in ("name", "kind", "line", "signature")} for r in rows]}


def source_rows(graph: Graph, name: str, file: str | None = None) -> DataFrame:
    """name, kind, file, line, signature, source of every definition of a name, in answer order by arm, file, pos.

    Types of all sorts are called typedef and symbols of all sorts macro.
    """
    col, lit = F.col, F.lit
    text = S.symbol_source(col("name"), col("kind"), col("value"))
    arms = [
        (graph.functions, "function", S.function_signature(col("source")), col("source")),
        (graph.types, "typedef", S.first_line(col("definition")), col("definition")),
        (graph.globals, "variable", col("decl"), col("decl")),
        (graph.symbols, "macro", text, text),
    ]
    out = None
    for number, (table, kind, signature, source) in enumerate(arms):
        rows = table.where(col("name") == name)
        if file is not None:
            rows = rows.where(S.contains_ci(col("file"), file))
        rows = rows.select("name", lit(kind).alias("kind"), "file", "line", signature.alias("signature"), source.alias("source"), lit(number).alias("arm"), "pos")
        out = rows if out is None else out.unionByName(rows)
    return out


def source_answer(graph: Graph, name: str, file: str | None = None) -> DataFrame:
    """outcome, name, kind, file, signature, text: one row if found or not found, one a match if ambiguous."""
    rows = source_rows(graph, name, file)
    counted = rows.groupBy().agg(F.count("*").alias("n"))
    n = F.broadcast(counted)  # one row
    found = rows.join(n).select(
        F.when(F.col("n") == 1, "found").otherwise("ambiguous").alias("outcome"),
        "name",
        "kind",
        "file",
        "signature",
        F.when(F.col("n") == 1, S.with_header(F.col("file"), F.col("line"), F.col("source"))).alias("text"),
    )
    null = F.lit(None).cast("string")
    missing = counted.where("n = 0").select(F.lit("error").alias("outcome"), F.lit(name).alias("name"), null.alias("kind"), null.alias("file"), null.alias("signature"), F.lit(f"symbol '{name}' not found").alias("text"))
    return found.unionByName(missing)


def get_source(graph: Graph, name: str, file: str | None = None) -> str | dict[str, Any]:
    rows = source_rows(graph, name, file)
    few = rows.limit(2).collect()
    if not few:
        return {"error": f"symbol '{name}' not found"}
    if len(few) == 1:
        return f"// file: {few[0]['file']}\n// line: {few[0]['line']}\n\n{few[0]['source']}"
    # of an ambiguous name no source is shown, so none is fetched
    rows = rows.orderBy("arm", "file", "pos").select("name", "kind", "file", "signature").collect()
    return {"ambiguous": True, "matches": [{k: r[k] for k in ("name", "kind", "file", "signature")} for r in rows]}


def candidates(graph: Graph, name: str, file: str | None = None) -> DataFrame:
    rows = graph.functions.where(F.col("name") == name)
    if file is not None:
        rows = rows.where(S.contains_ci(F.col("file"), file))
    return rows.select("name", "file", "pos", S.function_signature(F.col("source")).alias("signature"))


def entries(graph: Graph, name: str, file: str, direction: str, depth: int = 1) -> DataFrame:
    """name, file, line, path of the callers or callees; line (of the first call site) at depth 1 only."""
    spark = graph.functions.sparkSession
    starts = spark.createDataFrame([(name, file)], "name string, file string")
    found = G.reach(starts, graph, direction, depth)
    line = F.col("line") if depth == 1 else F.lit(None).cast("long")
    return found.select("name", "file", line.alias("line"), "depth", "path")


def answer_parts(direction: str) -> list[str]:
    """The lists that an answer has for a direction; none for one that isn't known."""
    return [what for what in ("callers", "callees") if direction in (what, "both")]


def call_graph_error(graph: Graph, name: str, file: str | None) -> dict[str, Any]:
    if graph.functions.where(F.col("name") == name).isEmpty():
        return {"error": f"function '{name}' not found"}
    return {"error": f"function '{name}' not found in files matching '{file or ''}'"}


def query_call_graph(graph: Graph, name: str, direction: str, file: str | None = None, depth: int = 1) -> dict[str, Any]:
    """Callers, callees or both of one function; any other direction gives its name and file only."""
    own = candidates(graph, name, file).orderBy("file", "pos").collect()
    if not own:
        return call_graph_error(graph, name, file)
    if len(own) > 1:
        return {"ambiguous": True, "matches": [{"name": name, "kind": "function", "file": r["file"], "signature": r["signature"]} for r in own]}
    out: dict[str, Any] = {"name": name, "file": own[0]["file"]}
    for what in answer_parts(direction):
        rows = entries(graph, name, own[0]["file"], what, depth).orderBy("depth", "path").collect()
        out[what] = [{"name": r["name"], "file": r["file"]} | ({} if r["line"] is None else {"line": r["line"]}) for r in rows]
    return out
