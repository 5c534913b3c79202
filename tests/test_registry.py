"""Every registered query of the code graph against its oracle, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from ferrule.operators.index import extract_facts
from ferrule.plans import adapters, registry
from ferrule.sources import tree

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query_equals_oracle(spark, duck, name):
    got, want = registry.queries()[name](spark, DIR).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    tidy = lambda df: df[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert tidy(got).equals(tidy(want))


def test_generated_files_are_parsed_in_several_tasks(spark, tmp_path):
    """A supplier table of one row group, a key repeated often and a null: every task parses about as many files, all are there."""
    keys = [*range(300), *[7] * 100, None]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    facts = extract_facts(adapters.c_files(spark, str(tmp_path))).where("fact = 'global' AND name LIKE 'count%'")
    found = facts.select("file", F.spark_partition_id().alias("task")).collect()
    assert Counter(r.file for r in found) == Counter(f"gen/s_{k}.c" for k in keys if k is not None)
    tasks = Counter(r.task for r in found)
    assert len(tasks) > spark.sparkContext.defaultParallelism and max(tasks.values()) <= 2 * 400 / len(tasks)


def test_rows_are_dealt_over_the_shuffle_partitions_where_few_cores_are_known(spark):
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "50")
        assert tree.dealt(spark.range(100).coalesce(1)).rdd.getNumPartitions() == 50
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        assert tree.dealt(spark.range(100).coalesce(1)).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
