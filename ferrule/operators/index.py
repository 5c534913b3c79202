"""Index: from files to the code graph's tables, in memory or incrementally."""

from __future__ import annotations

from collections.abc import Collection, Iterable, Iterator
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule import schema
from ferrule.functions.c_facts import KINDS, extract
from ferrule.sources import tree
from ferrule.sources.store import materialise

_ARROW = pa.schema(
    [
        ("fact", pa.string()), ("file", pa.string()), ("content_hash", pa.string()), ("name", pa.string()), ("kind", pa.string()),
        ("line", pa.int64()), ("pos", pa.int64()), ("text", pa.string()), ("flag", pa.bool_()), ("conditions", pa.list_(pa.string())),
    ]
)

#: Facts, or characters of their texts, after which a batch goes out.
BATCH_FACTS, BATCH_CHARS = 4096, 4 << 20


@dataclass
class Graph:
    """The code graph: five fact tables over all files."""

    functions: DataFrame
    calls: DataFrame
    symbols: DataFrame
    types: DataFrame
    globals: DataFrame

    def merge(self, other: Graph) -> Graph:
        """All facts of both, repeated ones too."""
        return Graph(**{f.name: getattr(self, f.name).unionByName(getattr(other, f.name)) for f in fields(Graph)})

    @staticmethod
    def empty(spark: SparkSession) -> Graph:
        kinds = {"functions": schema.FUNCTIONS, "calls": schema.CALLS, "symbols": schema.SYMBOLS, "types": schema.TYPES, "globals": schema.GLOBALS}
        return Graph(**{k: spark.createDataFrame([], v) for k, v in kinds.items()})


def fact_batches(batches: Iterable[pa.RecordBatch], kinds: Collection[str] = KINDS) -> Iterator[pa.RecordBatch]:
    """The facts of the given kinds of each batch's files, in batches of many files: `BATCH_FACTS` facts or `BATCH_CHARS` characters and what the last file adds."""
    rows, chars = [], 0
    for batch in batches:
        for path, content, key in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "content_hash")), strict=True):
            for f in extract(content, kinds):
                rows.append((f.fact, path, key, f.name, f.kind, f.line, f.pos, f.text, f.flag, f.conditions))
                chars += len(f.text or "")
            if len(rows) >= BATCH_FACTS or chars >= BATCH_CHARS:
                yield _batch(rows)
                rows, chars = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(col, t.type) for col, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def extract_facts(files: DataFrame, kinds: Collection[str] = KINDS) -> DataFrame:
    """One row a fact of every readable file, in one pass over its text; only facts of the given kinds, nothing is made of others."""
    return tree.readable(files).select("path", "content", "content_hash").mapInArrow(lambda batches: fact_batches(batches, kinds), schema.FACTS)


def graph_of(facts: DataFrame) -> Graph:
    """The five tables as projections of the fact rows."""
    of = lambda kind: facts.where(F.col("fact") == kind)
    return Graph(
        functions=of("function").select("name", "file", "line", F.col("text").alias("source"), "conditions", F.col("flag").alias("is_static"), "pos"),
        calls=of("call").select(F.col("name").alias("caller"), F.col("kind").alias("callee"), "line", F.col("file").alias("caller_file"), "pos"),
        symbols=of("symbol").select("name", "kind", "conditions", F.col("text").alias("value"), "file", "line", "pos"),
        types=of("type").select("name", "kind", F.col("text").alias("definition"), "conditions", "file", "line", "pos"),
        globals=of("global").select("name", F.col("text").alias("decl"), "conditions", F.col("flag").alias("is_static"), "file", "line", "pos"),
    )


def index_sources(spark: SparkSession, pairs, materialised: bool = True) -> tuple[Graph, DataFrame]:
    """Graph and stats of in-memory (path, text) pairs; nothing is cached between calls."""
    return index_files(tree.from_pairs(spark, pairs), materialised)


def index_files(files: DataFrame, materialised: bool = True) -> tuple[Graph, DataFrame]:
    facts = extract_facts(files)
    if materialised:  # else every table parses the files again
        facts = materialise(facts, "facts", "fact")
    return graph_of(facts), index_stats(files, facts)


def index_stats(files: DataFrame, facts: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """One row: status, files_ok, files_err, l2_hits, functions, call_edges; every call site counts."""
    ok = F.col("content").isNotNull()
    counts = files.agg(F.count_if(ok).alias("files_ok"), F.count_if(~ok).alias("files_err"))
    edges = facts.agg(F.count_if(F.col("fact") == "function").alias("functions"), F.count_if(F.col("fact") == "call").alias("call_edges"))
    found = hits.agg(F.count("*").alias("l2_hits")) if hits is not None else files.sparkSession.sql("SELECT 0L AS l2_hits")
    # three one-row tables side by side
    return counts.join(found).join(edges).select(F.lit("ok").alias("status"), "files_ok", "files_err", "l2_hits", "functions", "call_edges")
