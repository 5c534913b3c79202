"""A training-corpus pipeline of five stages over `documents`, each on all the one before kept.

For all stages: a null id counts as the greatest, a null text as empty; texts are
taken whole, however long; an empty table gives an empty table; columns of any name pass
through, whatever the operators call theirs. The stages' docstrings say what else is odd.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ferrule.llm import decontamination, langid, mixing, near_duplicates, secrets
from ferrule.llm.common import compact, held, order_id, packed, release, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised (operator 1); those it rejects go.

    A text without a letter, or null, is rejected; rows alike are judged alike. A table
    without labels teaches nothing, so that everything goes.
    """
    return compact(langid.drop_rejected(docs, langid.fit(docs)), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (operator 6's fingerprints among the candidates; exact Jaccard of 0.8 decides).

    It is the one with the smallest id, of those with its id and group the text with the
    smallest hash, and of rows alike in both the one with the smallest hash of the whole
    row. Texts without words, nulls among them, are one group.
    """
    kept = near_duplicates.representatives(docs)
    whole = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))
    rows = packed(docs, doc=order_id(), tie=F.xxhash64("text"), whole=whole)
    once = rows.join(kept.where("times = 1"), ["doc", "tie"], "left_semi").select("row.*")
    several = rows.join(kept.where("times > 1"), ["doc", "tie"], "left_semi")
    return compact(once.unionByName(several.groupBy("doc", "tie").agg(F.min_by("row", "whole").alias("row")).select("row.*")), docs)


def decontamination_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold benchmark items (operator 5).

    Null and empty texts hold none, and stay; rows alike go together; an empty benchmark drops nothing.
    """
    return compact(decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")), docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts (operator 8); n_chars follows the text.

    All rows stay, nulls and repeated ones too; a null text has a null n_chars.
    """
    clean = secrets.redact(docs)
    return compact(clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean, docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes (operator 3), with the size, target and words taken of each.

    Null sources are one source; documents without words, or beyond their source's budget,
    aren't taken. Of rows alike in id, text and source the first by a hash of the whole row
    come first. Columns of the table that are called like the new ones give way to them.
    """
    mixed = held(mixing.mix(docs).where("taken > 0"))
    keys = ["k", "t", "s", "n"]
    of = lambda id_, tie, source: {"k": F.coalesce(id_.cast("string"), F.lit("")), "t": tie, "s": F.coalesce(source, F.lit("")), "n": source.isNull()}
    left = packed(docs, **of(F.col("doc_id"), F.md5(F.coalesce("text", F.lit(""))), F.col("source")))
    left = left.withColumn("i", F.row_number().over(W.partitionBy(*keys).orderBy(F.xxhash64("row"))))
    new = {"mix_size": "size", "mix_source_size": "source_size", "mix_target": "target", "mix_taken": "taken"}
    right = mixed.select(*(F.col(c).alias(n) for n, c in new.items()), *(c.alias(n) for n, c in of(F.col("doc_id"), F.col("tie"), F.col("source")).items()))
    right = right.withColumn("i", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("mix_taken"))))
    joined = left.join(right, [*keys, "i"])
    return compact(joined.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in new), *new), docs)


def _stage(function):
    """A stage lets go of what the one before held for its rows, which are written by then."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)
        return function(spark, docs, sf_dir)

    return run


STAGES = [
    ("language_id", _stage(language_id)),
    ("near_dedup", _stage(near_dedup)),
    ("decontamination", _stage(decontamination_)),
    ("secret_scan", _stage(secret_scan)),
    ("source_mixing", _stage(source_mixing)),
]
#: Language models, sketches and redaction have no SQL form; the tests check the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
