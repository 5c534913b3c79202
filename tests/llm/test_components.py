"""Components, compaction and held results."""

import random

import pytest
from pyspark.sql import functions as F

from ferrule.llm import common
from ferrule.llm import components as C
from ferrule.llm.components import components


def roots(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(up)}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 1), (1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(-5, 3), (3, 9), (8, 7)]])
def test_components(spark, edges):
    frame = spark.createDataFrame(edges, "a long, b long")
    got = components(frame).collect()
    assert {r.node: r.root for r in got} == roots(edges) and len(got) == len(roots(edges))


def test_components_of_random_graphs(spark):
    rnd = random.Random(3)
    edges = [(rnd.randint(0, 150), rnd.randint(0, 150)) for _ in range(110)]
    assert {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == roots(edges)


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_rounds_of_many_edges(spark, monkeypatch, few):
    monkeypatch.setattr(C, "EDGES", 3)
    monkeypatch.setattr(C, "FEW", few)
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(12)] + [(rnd.randint(100, 140), rnd.randint(100, 140)) for _ in range(25)]
    assert {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == roots(edges)


def test_few_edges_take_no_rounds(spark):
    """The driver keeps a record of each job: rounds of small ones took its memory."""
    edges = [(i, i + 1) for i in range(40)]
    spark.sparkContext.setJobGroup("few edges", "")
    try:
        got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.node: r.root for r in got} == roots(edges)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few edges")) <= 8


def test_compaction_follows_the_size_of_the_sources(spark, tmp_path, monkeypatch):
    spark.range(2000).repartition(40).withColumn("x", F.sha2(F.col("id").cast("string"), 256)).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    many = table.repartition(40)
    least = common.PER_CORE * spark.sparkContext.defaultParallelism
    assert common.compact(many, table).rdd.getNumPartitions() == least
    monkeypatch.setattr(common, "PARTITION_BYTES", 1)
    assert common.compact(many, table).rdd.getNumPartitions() == 40


def test_released_results_stay_right(spark):
    frames = [common.held(spark.range(n)) for n in range(3, 6)]
    common.release(spark)
    assert not any(f.storageLevel.useDisk for f in frames) and [f.count() for f in frames] == [3, 4, 5]


def test_written_tables_lie_in_the_sessions_folder(spark):
    common.written(spark.range(3), "probe")
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
