"""The fact cache and its snapshots: parsed files by path and content key, as Parquet.

A file is parsed again only if no cached entry has its path and content. Every refresh
writes a new snapshot beside the old one and then moves a pointer to it, so a reader
never sees a half-written index and a lost executor costs a stage, not the cache.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ferrule import schema
from ferrule.operators.index import Graph, extract_facts, graph_of, index_files, index_stats
from ferrule.sources.store import first_rows, remove

_FILES = "path string, content_hash string, mtime timestamp, last_used timestamp, here boolean"
_FACTS = StructType([*schema.FACTS.fields, StructField("here", BooleanType())])
_KEY = ["path", "content_hash"]


def split_hits(files: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): files whose path and content are in the cache, and the others."""
    key = ["path", "content_hash"]
    known = cached.select(*key).distinct()
    return files.join(known, key, "left_semi"), files.join(known, key, "left_anti")


def newest(entries: DataFrame, slots: int, used: str = "last_used", key: str = "path") -> DataFrame:
    """The `slots` most recently used entries; 0 keeps all. Equal times go by the key, greatest first."""
    return entries if slots == 0 else first_rows(entries, slots, F.col(used).desc(), F.col(key).desc())


@dataclass
class FactCache:
    """A folder of snapshots; `folder` may be any store Spark writes to."""

    spark: SparkSession
    folder: str
    overhead_percent: int = 25

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def current(self) -> str | None:
        """Name of the newest finished snapshot; anything unreadable counts as none."""
        fs, path = self._fs()
        if not fs.exists(path):
            return None
        names = sorted(s.getPath().getName() for s in fs.listStatus(path))
        done = [n for n in names if n.startswith("snap-") and fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/files/_SUCCESS"))]
        return done[-1] if done else None

    @classmethod
    def open(cls, spark: SparkSession, folder: str, overhead_percent: int = 25) -> FactCache | None:
        """The cache in a folder, which is made where it isn't there, with a file that keeps it out of version control; None if that is impossible."""
        cache = cls(spark, folder, overhead_percent)
        try:
            fs, path = cache._fs()
            if not fs.mkdirs(path):
                return None
            ignore = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, ".gitignore")
            if not fs.exists(ignore):
                out = fs.create(ignore)
                out.write(bytearray(b"*\n"))
                out.close()
        except Py4JJavaError:
            return None
        return cache

    def load(self) -> tuple[DataFrame, DataFrame]:
        """(files, facts) of the current snapshot; `here` tells the files it was made of from those that only the cache keeps."""
        name = self.current()
        if name is None:
            return self.spark.createDataFrame([], _FILES), self.spark.createDataFrame([], _FACTS)
        return self.spark.read.schema(_FILES).parquet(f"{self.folder}/{name}/files"), self.spark.read.schema(_FACTS).parquet(f"{self.folder}/{name}/facts")

    def refresh(self, files: DataFrame, now: datetime | None = None) -> tuple[Graph, DataFrame]:
        """Indexes `files`, parsing only what the cache lacks; returns the graph and its stats.

        The files are read once, and the graph is the new snapshot's: what happens to the
        files later doesn't change it. Deleted files drop out of the graph, files that came
        with an old mtime come in; entries of other paths stay in the cache while it has
        room for them.
        """
        now = now or datetime.now(tz=UTC)
        before = self.current()
        cached_files, cached_facts = self.load()
        name = f"snap-{now:%Y%m%d%H%M%S%f}"
        files = files.persist(StorageLevel.DISK_ONLY)
        try:
            hits, misses = split_hits(files, cached_files)
            readable = F.col("content").isNotNull()
            n, n_here = files.agg(F.count("*"), F.count_if(readable)).first()
            slots = n * (100 + self.overhead_percent) // 100
            present = files.where(readable).select(*_KEY, "mtime", F.lit(now).cast("timestamp").alias("last_used"), F.lit(True).alias("here"))
            absent = cached_files.join(present.select(*_KEY), _KEY, "left_anti").withColumn("here", F.lit(False))
            # what was asked for is never evicted; no slots mean no eviction
            room = slots - n_here
            kept = present.unionByName(newest(absent, room)) if room > 0 or not slots else present
            kept.write.parquet(f"{self.folder}/{name}/files.part")
            entries = self.spark.read.schema(_FILES).parquet(f"{self.folder}/{name}/files.part").select(F.col("path").alias("file"), "content_hash", "here")
            old = cached_facts.drop("here").join(entries, ["file", "content_hash"])
            facts = old.unionByName(extract_facts(misses).withColumn("here", F.lit(True)))
            facts.write.partitionBy("here").parquet(f"{self.folder}/{name}/facts")
            graph = self.spark.read.schema(_FACTS).parquet(f"{self.folder}/{name}/facts").where("here").drop("here")
            stats = index_stats(files, graph, hits.where(readable))
            stats = self.spark.createDataFrame([stats.first()], stats.schema)
        finally:
            files.unpersist()
        fs, path = self._fs()
        of = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs.rename(of(f"{self.folder}/{name}/files.part"), of(f"{self.folder}/{name}/files"))  # from here on it is the current one
        for status in fs.listStatus(path):
            old_name = status.getPath().getName()
            if old_name.startswith("snap-") and old_name not in (name, before):  # the last one may still be read
                remove(self.spark, f"{self.folder}/{old_name}")
        return graph_of(graph), stats


def index_cached(files: DataFrame, cache: FactCache | None) -> tuple[Graph, DataFrame]:
    """Graph and stats of the files, through the cache if there is one."""
    return cache.refresh(files) if cache else index_files(files)
