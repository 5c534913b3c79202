"""The pipeline's stages on odd tables, and whole on the smallest tables."""

import os
import re

import pytest
import xxhash

import corpus_pipeline as P
from ferrule.llm.common import written
from tests.llm import docs as D
from tests.llm.test_documents import plain_share

DIR = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark, tmp_path):
    spark.createDataFrame([(1, next(r[1] for r in D.rows() if r[0] == 67))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    D.frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_stages_keep_columns_and_take_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in P.STAGES[:-1]:
        docs = written(stage(spark, docs, tables), name)
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4]
    ids = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(ids) == len(set(ids)), "a repeated row stays once"
    mixed = P.STAGES[-1][1](spark, docs, tables)
    assert set(columns) < set(mixed.columns) and all(r.mix_taken > 0 for r in mixed.collect())


@pytest.mark.parametrize("stage", [P.near_dedup, P.decontamination_])
def test_plans_do_not_show_all_that_was_held_before(spark, tables, stage):
    """Spark's record of a plan is kept on the driver: the nested ones of held results took its memory."""
    plan = stage(spark, spark.read.parquet(f"{tables}/documents.parquet"), tables)._jdf.queryExecution().toString()
    assert "InMemoryRelation" not in plan and len(plan) < 60_000


def plain(name, docs, bench):
    """What a stage keeps, by rules of its own: (doc_id, text) of the rows, or None where it has none here."""
    if name == "near_dedup":
        of = groups([t for _, t in docs])
        order = lambda r: (r[0] is None, r[0] or 0, xxhash.xxh64_intdigest((r[1] or "").encode(), 42))
        return {g: min((order(r)[:2] for r, o in zip(docs, of, strict=True) if o == g)) for g in set(of)}.values()
    if name == "decontamination":
        return [(i is None, i or 0) for i, t in docs if plain_share(t, bench) < 0.5]
    return [(i is None, i or 0) for i, t in docs]


def test_every_stage_equals_brute_force_on_its_own_input(spark, tables):
    bench = spark.read.parquet(f"{tables}/benchmark.parquet").first().text
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in P.STAGES[1:4]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = written(stage(spark, docs, tables), name)
        after = [(r.doc_id, r.text) for r in docs.collect()]
        assert sorted((i is None, i or 0) for i, _ in after) == sorted(plain(name, before, bench)), name
        if name == "secret_scan":
            was = {(i, t) for i, t in before}
            assert all((i, t) in was or "[SECRET]" in t for i, t in after)


def test_columns_called_like_the_mixs_give_way(spark, tables):
    docs = D.simple(spark, ["a b c", "d e"]).withColumnRenamed("h", "mix_size").withColumnRenamed("k", "row").withColumnRenamed("run", "i")
    got = P.source_mixing(spark, docs, tables)
    assert got.columns.count("mix_size") == 1 and sorted(r.mix_size for r in got.collect()) == [2, 3] and got.first()["row"] == "c"


def groups(texts):
    sets = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([" ".join(w)] if w else []))
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def test_near_dedup_keeps_the_smallest_id_of_each_group(spark):
    data = D.rows(n=120)
    data += [(500, "alike in id and text", "en", "s1", 1) + data[0][5:], (500, "alike in id and text", "en", "s2", 1) + data[0][5:], (501, None, "en", "s2", 1) + data[0][5:]]
    docs = D.frame(spark, data).withColumnRenamed("doc", "row").withColumnRenamed("tie", "__doc")
    got = [tuple(r) for r in P.near_dedup(spark, docs, "").collect()]
    again = [tuple(r) for r in P.near_dedup(spark, docs.repartition(7), "").collect()]
    assert sorted(got, key=repr) == sorted(again, key=repr)
    of = groups([r[1] for r in data])
    order = lambda r: (r[0] is None, r[0] or 0)
    want = {g: min(order(r) for r, o in zip(data, of, strict=True) if o == g) for g in set(of)}
    assert sorted(order(r) for r in got) == sorted(want.values()) and set(got) <= set(data)


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_stages_of_an_empty_table(spark, tables, name, stage):
    assert stage(spark, D.frame(spark, []), tables).count() == 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_run(spark):
    rows = P.run(spark, DIR).collect()
    assert 0 < len(rows) < 200 and len({r.doc_id for r in rows}) == len(rows)
