"""Freshness: whether files changed, and a graph that is refreshed before it is queried."""

from __future__ import annotations

import threading
import time
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators.index import Graph
from ferrule.sources import tree
from ferrule.sources.cache import FactCache, index_cached

#: Seconds within which a second query doesn't look at the files again.
DEBOUNCE = 2.0


def has_stale_files(files: DataFrame, since: datetime) -> DataFrame:
    """One row, `stale`: whether a source file was modified after `since`."""
    newer = tree.is_source(F.col("path")) & (F.col("mtime") > F.lit(since))
    return files.agg(F.coalesce(F.max(newer), F.lit(False)).alias("stale"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): added, modified or deleted between two (path, content_hash) snapshots."""
    old, new = before.select("path", F.col("content_hash").alias("old")), after.select("path", F.col("content_hash").alias("new"))
    what = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return old.join(new, "path", "full").select("path", what.alias("change")).where("change IS NOT NULL")


class FreshGraph:
    """A project's graph, indexed at once and again whenever its files differ from the last snapshot."""

    def __init__(self, spark: SparkSession, root: str, cache: str, debounce: float = DEBOUNCE, overhead_percent: int = 25):
        self.spark, self.root, self.cache, self.debounce = spark, root, FactCache.open(spark, cache, overhead_percent), debounce
        self._lock, self._checked, self._seen = threading.Lock(), float("-inf"), None
        self._graph: Graph | None = None
        self.stats: DataFrame | None = None
        self.graph()

    def _listing(self) -> frozenset[tuple[str, int, int]]:
        import os

        found = []
        for path in tree.walk(self.root):
            try:
                s = os.stat(path)
                found.append((path, s.st_mtime_ns, s.st_size))
            except OSError:
                found.append((path, 0, 0))
        return frozenset(found)

    def graph(self) -> Graph:
        """The graph as the files are now; looks at most once every `debounce` seconds."""
        if time.monotonic() - self._checked >= self.debounce or self._graph is None:
            with self._lock:
                if time.monotonic() - self._checked >= self.debounce or self._graph is None:
                    listing = self._listing()
                    if listing != self._seen:
                        files = tree.decode(tree.scan(self.spark, self.root))
                        self._graph, self.stats = index_cached(files, self.cache)
                        self._seen = listing
                    self._checked = time.monotonic()
        return self._graph
