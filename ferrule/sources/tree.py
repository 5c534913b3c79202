"""Source files as rows: a directory scan, in-memory pairs, decoding and the content key."""

from __future__ import annotations

import os
from collections.abc import Iterable
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule import schema

SUFFIXES = (".c", ".h")
#: Tasks a core that rows are dealt over.
TASKS = 4
_RAW = "path string, raw binary, mtime timestamp"


def walk(root: str) -> list[str]:
    """Paths under a folder whose extension is .c or .h, hidden ones included, in byte order; what can't be listed is left out.

    A name that is nothing but `.c` has no extension. A folder of such a name is listed
    too: it can't be read as a file, which counts as an error.
    """
    found = [os.path.join(folder, name) for folder, below, names in os.walk(root, onerror=None) for name in [*names, *below] if os.path.splitext(name)[1] in SUFFIXES]
    return sorted(found, key=os.fsencode)


def scan(spark: SparkSession, root: str, partitions: int | None = None) -> DataFrame:
    """(path, raw, mtime) of every source file; raw is null where it can't be read.

    Spark's own file listing leaves out names that start with `.` or `_`, so the driver
    lists paths only and executors read the files, which must lie on a shared mount.
    """
    paths = walk(root)
    if not paths:
        return spark.createDataFrame([], _RAW)
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    n = partitions or max(1, min(len(paths) // 64 + 1, spark.sparkContext.defaultParallelism * 8))

    def read(batches):
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                try:
                    with open(path, "rb") as f:
                        raw = f.read()
                    found.append((path, raw, datetime.fromtimestamp(os.stat(path).st_mtime, tz=UTC)))
                except OSError:
                    found.append((path, None, None))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.binary()), pa.array([x[2] for x in found], pa.timestamp("us", tz="UTC"))], names=["path", "raw", "mtime"])

    return rows.repartition(n, "path").mapInArrow(read, _RAW)


def scan_store(spark: SparkSession, root: str) -> DataFrame:
    """The same from any store that Spark reads (object stores too); names that start with `.` or `_` are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{c,h}").load(root)
    return files.select("path", F.col("content").alias("raw"), F.col("modificationTime").alias("mtime"))


def decode(raw: DataFrame) -> DataFrame:
    """`files` rows, content null where bytes are missing or no UTF-8; the key is a hash of the bytes."""
    text = F.when(F.is_valid_utf8(F.col("raw").cast("string")), F.col("raw").cast("string"))
    return raw.select("path", text.alias("content"), F.sha2("raw", 256).alias("content_hash"), "mtime")


def readable(files: DataFrame) -> DataFrame:
    return files.where(F.col("content").isNotNull())


def from_pairs(spark: SparkSession, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    """`files` from in-memory (path, text) pairs."""
    rows = spark.createDataFrame(list(pairs), "path string, content string")
    return rows.select("path", "content", F.sha2("content", 256).alias("content_hash"), F.lit(None).cast("timestamp").alias("mtime"))


def dealt(rows: DataFrame) -> DataFrame:
    """The rows in several tasks a core, however few files or row groups they lie in: parsing costs far more than reading.

    Rows go round in turn, so one repeated many times isn't parsed in one task. Deal rows
    while they are narrow: texts that are made of keys are better made afterwards.
    Before its executors have come, a session knows of two cores only; the number of its
    shuffle partitions is a lower bound then.
    """
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism * TASKS, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def from_rows(rows: DataFrame) -> DataFrame:
    """`files` from any rows with path and content."""
    return rows.select("path", "content", F.sha2("content", 256).alias("content_hash"), F.lit(None).cast("timestamp").alias("mtime"))


def is_source(path) -> F.Column:
    return path.rlike(r"[^/]\.[ch]$")


FILES = schema.FILES
