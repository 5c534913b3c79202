"""What the training-data operators share: intermediate tables, Arrow batches, ids."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: code points other than the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null id, so that it counts as greater than every other.
LAST_ID = (1 << 63) - 1
#: Bytes of input an output partition is worth, and partitions a core at least.
PARTITION_BYTES, PER_CORE = 16 << 20, 2
_held: dict[str, list[DataFrame]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_id(name: str = "doc_id") -> Column:
    """The id as a long; null becomes the greatest."""
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST_ID))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only in local mode, where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^,]*(,\d+)?\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="ferrule-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; its shared folder is cleared with it
        pass


def written(df: DataFrame, name: str, *sources: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage, for loops, whole stages and large results.

    Compacted as `compact` does where sources are given.
    """
    spark = df.sparkSession
    df = compact(df, *sources) if sources else df
    path = f"{shared_dir(spark)}/ferrule-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder: cuts lineage as a written table does, for small results of loops.

    Its files go with the session, or earlier where Spark cleans checkpoints that nobody refers to.
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    out = df.checkpoint()
    atexit.register(_remove, spark, out._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
    return out


def held(df: DataFrame) -> DataFrame:
    """The rows on the executors' disks, for results that are used more than once, until `release`.

    What a lost executor held is computed anew from its lineage, which is short. Both
    sides of a join are held first where a key may be hot, so that adaptive execution
    sees plain exchanges and can split the large partitions.
    """
    _held.setdefault(df.sparkSession.sparkContext.applicationId, []).append(df.persist(StorageLevel.DISK_ONLY))
    return df


def release(spark: SparkSession) -> None:
    """Lets go of all held results; for when what was made of them is written. What still needs one computes it anew."""
    for df in _held.pop(spark.sparkContext.applicationId, []):
        df.unpersist()
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # plans hold shuffles and checkpoints until they are collected


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """The whole row as the struct `row` and further columns, so that no name clashes with the table's; `row.*` unpacks it."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(value.alias(name) for name, value in more.items()))


def sampled(h: Column, share: Column | float) -> Column:
    """Whether a row with this 64-bit hash is in a sample of that share; shares of 10^-15 still tell rows apart."""
    return (h.cast("double") / float(1 << 64) + 0.5) < share


def compact(df: DataFrame, *sources: DataFrame) -> DataFrame:
    """At most one partition for PARTITION_BYTES of the sources' files, so that small inputs don't end in very many small files.

    A source of unknown size (rows from memory) counts as very large: nothing is compacted.
    """
    size = sum(int(str(s._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for s in sources)
    return df.coalesce(min(1 << 30, max(PER_CORE * df.sparkSession.sparkContext.defaultParallelism, -(-size // PARTITION_BYTES))))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds what a Python worker holds of whole texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)
