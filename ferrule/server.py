"""The tools over a fresh graph, and a server that answers JSON-RPC messages, one a line."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import MISSING, dataclass, fields
from typing import Any, TextIO

from ferrule import render
from ferrule.functions.scalars import KINDS
from ferrule.operators import lookups
from ferrule.operators.index import Graph

log = logging.getLogger("ferrule")
PROTOCOL = "2024-11-05"
_TYPES = {"str": (str, "string"), "str | None": (str, "string"), "int": (int, "integer")}


@dataclass(frozen=True)
class SymbolLookup:
    file: str
    kind: str | None = None


@dataclass(frozen=True)
class GetSource:
    name: str
    file: str | None = None


@dataclass(frozen=True)
class QueryCallGraph:
    name: str
    direction: str
    file: str | None = None
    depth: int = 1


@dataclass(frozen=True)
class ToolSpec:
    """A tool: what it is called, what it says of itself, its parameter record and what answers it."""

    name: str
    description: str
    parameters: type
    answer: Callable[[Graph, Any], Any]

    def schema(self) -> dict[str, Any]:
        """The parameter record as a JSON schema."""
        known = {f.name: {"type": _TYPES[str(f.type)][1]} | ({} if f.default in (MISSING, None) else {"default": f.default}) for f in fields(self.parameters)}
        return {"type": "object", "properties": known, "required": [f.name for f in fields(self.parameters) if f.default is MISSING]}

    def record(self, arguments: dict[str, Any]) -> Any:
        """The arguments as a record; unknown ones are ignored, missing and mistyped ones are errors."""
        values = {}
        for f in fields(self.parameters):
            value = arguments.get(f.name)
            if value is None:
                if f.default is MISSING:
                    raise ValueError(f"missing parameter '{f.name}'")
                continue
            kind = _TYPES[str(f.type)][0]
            if not isinstance(value, kind) or isinstance(value, bool) or kind is int and value < 0:
                raise ValueError(f"parameter '{f.name}' must be of type {_TYPES[str(f.type)][1]}")
            values[f.name] = value
        return self.parameters(**values)


TOOLS = (
    ToolSpec("symbol_lookup", f"Symbols of the files whose path contains `file`, with line and signature; kind is one of {', '.join(KINDS)}.", SymbolLookup, lambda g, p: lookups.symbol_lookup(g, p.file, p.kind)),
    ToolSpec("get_source", "Whole source of the definition with exactly this name; several are listed, and `file` tells them apart.", GetSource, lambda g, p: lookups.get_source(g, p.name, p.file)),
    ToolSpec("query_call_graph", "Callers, callees or both of a function up to `depth` calls away; call lines at depth 1. Several functions of the name are listed, and `file` tells them apart.", QueryCallGraph, lambda g, p: lookups.query_call_graph(g, p.name, p.direction, p.file, p.depth)),
)


class Server:
    """Answers tool calls; `graph` gives the graph as it is at each call."""

    def __init__(self, graph: Callable[[], Graph], tabular: bool = False):
        self.graph, self.form, self.tools = graph, render.tabular if tabular else render.compact, {t.name: t for t in TOOLS}

    def call(self, name: str, arguments: dict[str, Any] | None = None) -> str:
        tool = self.tools[name]
        log.info("%s %s", name, arguments)
        return self.form(tool.answer(self.graph(), tool.record(arguments or {})))

    def handle(self, message: dict[str, Any]) -> dict[str, Any] | None:
        """The answer to a request; none to a notification."""
        if "id" not in message:
            return None
        method, params = message.get("method"), message.get("params") or {}
        head = {"jsonrpc": "2.0", "id": message["id"]}
        if method == "initialize":
            return head | {"result": {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "ferrule", "version": "0"}, "instructions": "Symbols, sources and call graph of a C project."}}
        if method == "ping":
            return head | {"result": {}}
        if method == "tools/list":
            return head | {"result": {"tools": [{"name": t.name, "description": t.description, "inputSchema": t.schema()} for t in TOOLS]}}
        if method != "tools/call":
            return head | {"error": {"code": -32601, "message": f"unknown method '{method}'"}}
        if params.get("name") not in self.tools:
            return head | {"error": {"code": -32602, "message": f"unknown tool '{params.get('name')}'"}}
        try:
            text = self.call(params["name"], params.get("arguments"))
        except ValueError as e:
            return head | {"error": {"code": -32602, "message": str(e)}}
        return head | {"result": {"content": [{"type": "text", "text": text}], "isError": False}}

    def serve(self, lines: TextIO, out: TextIO) -> None:
        """Reads a message a line until the end, and writes an answer a line."""
        for line in lines:
            if not line.strip():
                continue
            try:
                message = json.loads(line)
                answer = self.handle(message) if isinstance(message, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "not a request"}}
            except ValueError:
                answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
            if answer is not None:
                out.write(json.dumps(answer, ensure_ascii=False) + "\n")
                out.flush()
