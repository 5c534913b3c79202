"""Tables in a shared folder: facts, snapshots and intermediate results."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a plain sort with a limit, which ends in one task, may return.
TOP = 100_000


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^,]*(,\d+)?\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="ferrule-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialise(df: DataFrame, name: str, partition: str | None = None) -> DataFrame:
    """Writes the rows where all executors find them, and reads them again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ferrule-{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(partition) if partition else df.write).parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any store, if it is there and the session still runs."""
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; its shared folder is cleared with it
        pass


def first_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows in an order, without gathering many of them in one task."""
    if n <= TOP:
        return df.orderBy(*order).limit(n)
    # sorted ranges; a row's number holds its partition in the upper bits and its place there in the lower 33
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("place")).persist(StorageLevel.DISK_ONLY)
    counts = dict(dealt.groupBy(F.shiftright("place", 33).alias("part")).count().collect())  # one row a partition
    end, left = 0, n
    for part in sorted(counts):
        end, left = (part << 33) + min(left, counts[part]), left - min(left, counts[part])
        if not left:
            break
    return dealt.where(F.col("place") < end).select("row.*")
