"""Mixing sources to target weights (operator 3).

Sources share the corpus's words by weight, none beyond MOST times its own size. Within
a source the documents are ordered by a hash-random key; the words taken are whole
epochs of the source and then the first documents of that order, cut at the exact
budget. The prefix sums are distributed: the key's range is cut into equal slices (keys
are uniform, so slices are even), slices are summed, the sums are accumulated over the
slices of a source, and a running sum inside each slice starts from there. Only
ids and sizes are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ferrule.llm.common import WORD, held

#: Weights by rank of the source, repeating; a source gives at most MOST times its size.
WEIGHTS, MOST = (1, 2, 3), 3
#: Documents in a slice of the key range, on average.
SLICE = 2048
#: Sources (of 40 bytes and a name each) up to which their table is broadcast, so that a hot source isn't gathered; beyond, both sides are shuffled.
BROADCAST = 100_000
_KEYS = 1 << 60


def size_of(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Adds `target` to one row a source (source, source_size, docs).

    Capping in rounds ends at one level per unit of weight: sources ordered by
    cap / weight are capped while their ratio is at most the level of the rest.
    The windows below run over one row a source.
    """
    by_source = W.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_source) - 1) % len(WEIGHTS) + 1).cast("int")).cast("double"))
    weighed = weighed.withColumn("cap", (F.col("source_size") * MOST).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    levels = weighed.select(
        "*",
        ((F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))).alias("level"),
    )
    # the first source, by ratio, that its cap doesn't bind fixes the level
    level = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(everything)["level"]
    return levels.withColumn("final", level).select("source", "source_size", "docs", F.when(F.col("final").isNull() | (F.col("ratio") <= F.col("final")), F.col("cap")).otherwise(F.col("weight") * F.col("final")).alias("target"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """doc_id, source, tie, size, source_size, target, taken for every row (tie: md5 of the text).

    A null id orders as the empty text; repeated rows are interchangeable, and follow
    each other as one entry until the cut.
    """
    digest = F.md5(F.coalesce(F.col(text), F.lit("")))
    random = F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), digest))
    each = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), digest.alias("tie"), size_of(F.col(text)).alias("size"), F.conv(F.substring(random, 1, 15), 16, 10).cast("long").alias("key"))
    rows = held(each.groupBy("doc_id", "source", "tie", "size", "key").agg(F.count("*").alias("copies")))
    sources = held(targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("docs"))))
    # a source with n documents has about n / SLICE slices
    slices = (F.floor(F.col("docs") / SLICE) + 1).cast("long")
    named = sources.select(F.col("source").alias("s"), "source_size", "target", slices.alias("slices"))
    side = F.broadcast if sources.count() <= BROADCAST else (lambda x: x)
    dealt = rows.join(side(named), F.col("source").eqNullSafe(F.col("s"))).withColumn("slice", F.floor(F.col("key") / (F.lit(_KEYS) / F.col("slices"))).cast("long"))
    dealt = held(dealt.drop("s", "slices"))
    sums = dealt.groupBy("source", "slice").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    before = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    sums = held(sums.select(F.col("source").alias("s"), F.col("slice").alias("p"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start")))
    inside = W.partitionBy("source", "slice").orderBy("key", F.col("doc_id").asc_nulls_first(), "tie").rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("p"))).withColumn("start", F.col("start") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")).cast("long")).otherwise(F.lit(0).cast("long"))
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("start")))
    return placed.select("doc_id", "source", "tie", "size", "source_size", "target", taken.alias("taken"))


def source_mixing(docs: DataFrame) -> DataFrame:
    """Operator 3: doc_id, size, source_size, target, taken of every document.

    Null texts have size 0; null sources are one source, ordered last; a corpus without
    words takes nothing; repeated rows count each; an empty table gives no rows;
    other columns are ignored.
    """
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS tie,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), keyed AS (
  SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || tie), 1, 15) AS BIGINT) AS key FROM rows
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source
), weighed AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight,
         CAST(3 * source_size AS DOUBLE) AS cap FROM sources
), rounds AS (
  SELECT source, source_size, weight, cap, FALSE AS capped, 0 AS n,
         (sum(source_size) OVER ()) / (sum(weight) OVER ()) AS level FROM weighed
  UNION ALL
  SELECT source, source_size, weight, cap, cap / weight <= level, n + 1,
         (sum(source_size) OVER () - coalesce(sum(CASE WHEN cap / weight <= level THEN cap END) OVER (), 0))
           / nullif(coalesce(sum(CASE WHEN cap / weight > level THEN weight END) OVER (), 0), 0)
  FROM rounds WHERE n <= (SELECT count(*) FROM sources) AND level IS NOT NULL
), targets AS (
  SELECT source, source_size, CASE WHEN capped OR level IS NULL THEN cap ELSE weight * level END AS target
  FROM rounds WHERE n = (SELECT max(n) FROM rounds)
), placed AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS FIRST, k.tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source
), epoch AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed
)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - start)) AS BIGINT) AS taken
FROM epoch
"""
