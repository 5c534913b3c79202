"""Command line: ferrule PATH {index,mcp,symbol-lookup,get-source,query-call-graph} ..."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from ferrule import logs, render
from ferrule.operators import lookups
from ferrule.server import Server
from ferrule.sources import tree
from ferrule.sources.cache import FactCache, index_cached
from ferrule.streaming.freshness import FreshGraph

#: Folder in a project for its cache and logs.
DATA = ".ferrule"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ferrule")
    p.add_argument("path", help="folder of C sources")
    p.add_argument("--cache", help="folder of the fact cache (default: .ferrule in the path)")
    p.add_argument("--cache-overhead", type=int, default=25, help="percent of entries kept beyond the present files")
    p.add_argument("--table", action="store_true", help="compact tabular output")
    p.add_argument("--quiet", action="store_true", help="log to the file only")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("index")
    sub.add_parser("mcp", help="serve the tools over standard input and output")
    s = sub.add_parser("symbol-lookup")
    s.add_argument("file")
    s.add_argument("--kind")
    s = sub.add_parser("get-source")
    s.add_argument("name")
    s.add_argument("--file")
    s = sub.add_parser("query-call-graph")
    s.add_argument("name")
    s.add_argument("--direction", required=True)
    s.add_argument("--file")
    s.add_argument("--depth", type=int, default=1)
    return p


def cache_folder(args: argparse.Namespace) -> str:
    return args.cache or os.path.join(args.path, DATA)


def answer(spark: SparkSession, args: argparse.Namespace):
    cache = FactCache.open(spark, cache_folder(args), args.cache_overhead)
    graph, stats = index_cached(tree.decode(tree.scan(spark, args.path)), cache)
    if args.command == "symbol-lookup":
        return lookups.symbol_lookup(graph, args.file, args.kind)
    if args.command == "get-source":
        return lookups.get_source(graph, args.name, args.file)
    if args.command == "query-call-graph":
        return lookups.query_call_graph(graph, args.name, args.direction, args.file, args.depth)
    return stats.first().asDict()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if not os.path.isdir(args.path):
        print(f"not a folder: {args.path}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("ferrule").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    log = logs.init(os.path.join(cache_folder(args), "logs"), quiet=args.quiet or args.command != "mcp")
    log.info("indexing %s", args.path)
    if args.command == "mcp":
        fresh = FreshGraph(spark, args.path, cache_folder(args), overhead_percent=args.cache_overhead)
        Server(fresh.graph, args.table).serve(sys.stdin, sys.stdout)
        return 0
    found = answer(spark, args)
    print(render.tabular(found) if args.table else render.pretty(found))
    return 0


if __name__ == "__main__":
    sys.exit(main())
