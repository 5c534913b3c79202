"""Traversal of the call graph.

States are (name, file). Every level is joins and hash aggregates of the frontier with
the call and function tables; new states are those not seen before, and the smallest
path of call places that reaches a state orders it. The frontier is small beside the
tables, so adaptive execution broadcasts it where it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.operators.index import Graph
from ferrule.sources.store import materialise


def static_flags(functions: DataFrame) -> DataFrame:
    """(name, file, is_static): of several definitions in a file the first decides."""
    return functions.groupBy("name", "file").agg(F.min_by("is_static", "pos").alias("is_static"))


def definitions(functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, n, first_file) by name and (name, file) pairs; first in the order of (file, pos)."""
    by_name = functions.groupBy(F.col("name").alias("def_name")).agg(F.count("*").alias("n"), F.min("file").alias("first_file"))
    return by_name, functions.select(F.col("name").alias("own_name"), F.col("file").alias("own_file")).distinct()


def resolve_callees(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """Adds callee_file: the only definition; of several the one in the caller's file or else the first; '' if there is none."""
    by_name, pairs = definitions(functions)
    joined = edges.join(by_name, F.col("callee") == F.col("def_name"), "left").join(pairs, (F.col("callee") == F.col("own_name")) & (F.col("caller_file") == F.col("own_file")), "left")
    file = F.when(F.col("n").isNull(), "").when(F.col("n") == 1, F.col("first_file")).otherwise(F.coalesce("own_file", "first_file"))
    return joined.withColumn("callee_file", file).drop("def_name", "n", "first_file", "own_name", "own_file")


def _place(file: str = "caller_file") -> F.Column:
    return F.struct(F.col(file).alias("f"), F.col("pos").alias("p"))


def callee_steps(frontier: DataFrame, graph: Graph) -> DataFrame:
    """Edges out of the frontier (name, file, path): dst_name, dst_file, path, line."""
    edges = graph.calls.join(frontier, (F.col("caller") == F.col("name")) & (F.col("caller_file") == F.col("file")))
    edges = resolve_callees(edges.select("caller", "callee", "caller_file", "pos", "line", "path"), graph.functions)
    return edges.select(F.col("callee").alias("dst_name"), F.col("callee_file").alias("dst_file"), F.concat("path", F.array(_place())).alias("path"), "line")


def caller_steps(frontier: DataFrame, graph: Graph) -> DataFrame:
    """Edges into the frontier: a static function is called from its own file only."""
    flags = static_flags(graph.functions).select(F.col("name").alias("s_name"), F.col("file").alias("s_file"), "is_static")
    known = frontier.join(flags, (F.col("name") == F.col("s_name")) & (F.col("file") == F.col("s_file")), "left").select("name", "file", "path", F.coalesce("is_static", F.lit(False)).alias("is_static"))
    edges = graph.calls.join(known, (F.col("callee") == F.col("name")) & (~F.col("is_static") | (F.col("caller_file") == F.col("file"))))
    return edges.select(F.col("caller").alias("dst_name"), F.col("caller_file").alias("dst_file"), F.concat("path", F.array(_place())).alias("path"), "line")


_PATH = "array<struct<f:string,p:bigint>>"


def reach(starts: DataFrame, graph: Graph, direction: str, depth: int) -> DataFrame:
    """(name, file, depth, path, line) of the states reached from the starts within `depth` steps, the starts themselves left out.

    path orders them as a breadth-first search meets them; line is that of the last step's
    call site. depth 0 gives none.
    """
    step = callee_steps if direction == "callees" else caller_steps
    spark = starts.sparkSession
    frontier = starts.select("name", "file", F.array().cast(_PATH).alias("path"))
    seen = frontier.select("name", "file", F.lit(0).cast("long").alias("depth"), "path", F.lit(None).cast("long").alias("line"))
    for level in range(1, depth + 1):
        reached = step(frontier, graph).groupBy(F.col("dst_name").alias("name"), F.col("dst_file").alias("file")).agg(F.min("path").alias("path"), F.min_by("line", "path").alias("line"))
        fresh = reached.join(seen.select("name", "file"), ["name", "file"], "left_anti")
        if depth > 1:  # cuts the plan, which doubles with each level otherwise
            fresh = materialise(fresh, "level")
            if level < depth and fresh.isEmpty():
                break
        seen = seen.unionByName(fresh.select("name", "file", F.lit(level).cast("long").alias("depth"), "path", "line"))
        frontier = fresh.select("name", "file", "path")
    return seen.where("depth > 0") if depth else spark.createDataFrame([], f"name string, file string, depth long, path {_PATH}, line long")


def reach_by_name(start: str, calls: DataFrame, direction: str, depth: int) -> DataFrame:
    """(name, depth, path) of the functions reached by name alone, without regard to files.

    depth and path order them as a breadth-first search meets them.
    """
    src, dst = ("caller", "callee") if direction == "callees" else ("callee", "caller")
    edges = calls.groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg(F.min(_place()).alias("place"))
    spark = calls.sparkSession
    frontier = spark.createDataFrame([(start,)], "name string").withColumn("path", F.array().cast(_PATH))
    seen = frontier.withColumn("depth", F.lit(0).cast("long"))
    for level in range(1, depth + 1):
        reached = edges.join(frontier, F.col("src") == F.col("name")).groupBy(F.col("dst").alias("name")).agg(F.min(F.concat("path", F.array("place"))).alias("path"))
        frontier = reached.join(seen.select("name"), "name", "left_anti")
        if depth > 1:
            frontier = materialise(frontier, "level")
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(level).cast("long")))
    return seen.where("depth > 0").select("name", "depth", "path")


def call_site_lines(steps: DataFrame) -> DataFrame:
    """(name, file, line): the first call site of each state one step away."""
    return steps.groupBy(F.col("dst_name").alias("name"), F.col("dst_file").alias("file")).agg(F.min_by("line", "path").alias("line"))


def find_function(functions: DataFrame, part: str) -> DataFrame:
    return functions.where(F.contains(F.lower("name"), F.lower(F.lit(part))))


def find_functions_in_file(functions: DataFrame, part: str) -> DataFrame:
    return functions.where(F.contains(F.lower("file"), F.lower(F.lit(part))))
