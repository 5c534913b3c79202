import json

import pytest
from pyspark.sql import functions as F

from ferrule.functions import scalars as S
from ferrule.operators import evaluation as E
from ferrule.operators import judging as J


def test_loaders_and_totals(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"id": "t1", "question": "?", "rubric": [{"criterion": "a", "points": 3}, {"criterion": "b", "points": 1}]}]))
    for run, cond, data in (("r1", "exp", [{"task_id": "t1", "response": "x", "duration_sec": 2.5}, {"response": "no id"}]), ("r1", "ctrl", {"task_id": "t1", "response": None, "duration_sec": None})):
        (tmp_path / run).mkdir(exist_ok=True)
        (tmp_path / run / f"{cond}.json").write_text(json.dumps(data))
    rubric, results = E.load_questions(spark, str(tmp_path / "q.json")), E.load_results(spark, [str(tmp_path / "r1")])
    assert sorted((r.condition, r.response, r.duration_sec, r.run) for r in results.collect()) == [("ctrl", "", 0.0, "r1"), ("exp", "x", 2.5, "r1")]
    assert sorted(r.label for r in E.blind(results, 7).collect()) == ["A", "B"]
    judged = spark.createDataFrame([("t1", "r1", "exp", [3, 1], None), ("t1", "r1", "ctrl", [None, 1], 2.5), ("zz", "r1", "ctrl", [1], None)], "task_id string, run string, condition string, criteria_scores array<long>, total double")
    totals = {r.condition: (r.score, r.max_score, r.responses, r.seconds, r.percent) for r in E.condition_totals(judged, rubric, results).collect()}
    assert totals == {"exp": (4, 4, 1, 2.5, 100.0), "ctrl": (2, 4, 1, 0.0, 50.0)}
    assert E.task_counts(results).first().asDict() == {"responses": 2, "tasks": 1, "per_task": 2}


def test_blind_files_scores_and_report(spark, tmp_path):
    questions = [{"id": f"t{k}", "question": "?", "rubric": [{"criterion": "a", "points": 3}, {"criterion": "b", "points": 1}]} for k in (1, 2, 3)]
    (tmp_path / "q.json").write_text(json.dumps(questions))
    for run in ("r1", "r2"):
        (tmp_path / run).mkdir()
        for cond in E.CONDITIONS:
            (tmp_path / run / f"{cond}.json").write_text(json.dumps([{"task_id": t, "response": f"{run} {cond} {t}", "duration_sec": 1.5} for t in ("t1", "t2", "other")]))
    dirs = [str(tmp_path / "r1"), str(tmp_path / "r2")]
    rubric, results, out = E.load_questions(spark, str(tmp_path / "q.json")), E.load_results(spark, dirs), str(tmp_path / "out")
    assert J.write_blind(results, rubric, out, 7, dirs) == {"tasks": 2, "responses": 8, "per_task": 4}
    known, responses = (json.loads((tmp_path / "out" / n).read_text()) for n in (J.MAP, J.RESPONSES))
    assert known["seed"] == 7 and known["result_dirs"] == dirs and sorted(known["map"]["t1"]) == list("ABCD")
    assert all(responses[t][k] == f"{who['run']} {who['condition']} {t}" for t, labels in known["map"].items() for k, who in labels.items())
    template = json.loads((tmp_path / "out" / J.TEMPLATE).read_text())
    assert template["t2"]["C"] == {"criteria_scores": [None, None], "total": None, "notes": ""}
    exp = next(k for k, w in known["map"]["t1"].items() if w == {"run": "r1", "condition": "exp"})
    ctrl = next(k for k, w in known["map"]["t1"].items() if w == {"run": "r2", "condition": "ctrl"})
    J.apply_scores(spark, out, rubric, {("t1", exp): [9.0, 0.5], ("t1", ctrl): [None, 1.0]})
    lines = J.report(spark, out, rubric)
    assert len(lines) == 2 + 8 + 4 + 1 and "exp     score   3.0/4.0 (75.0%)  [1 resp]  time=1.5s" in lines[-1]
    judgment = json.loads((tmp_path / "out" / J.JUDGMENT).read_text())
    assert judgment["t1"][exp]["total"] == 3 and judgment["t1"][ctrl]["total"] is None and judgment["_meta"]["condition_totals"] == {"exp": {"score": 3.0, "max": 4.0, "count": 1, "secs": 1.5}}
    with pytest.raises(ValueError, match="no results"):
        J.write_blind(results.where("task_id = 'other'"), rubric, out, 7, dirs)


def test_more_responses_than_letters(spark):
    many = spark.createDataFrame([("t", f"r{i}", "exp") for i in range(27)], "task_id string, run string, condition string")
    with pytest.raises(Exception, match="more than 26"):
        E.blind(many, 1).collect()


def test_scores(spark):
    texts = ['```json\n{"a": 1}\n```', 'so: {"a": 2} ok', "none", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", S.parse_scores(F.col("t"), "a long").alias("p")).orderBy("i")
    assert [r.p and r.p.a for r in rows.collect()] == [1, 2, None, None, None]
    clamped = spark.createDataFrame([(-1.0, 3), (2.5, 3), (3.5, 3), (1.5, 3)], "s double, p long").select(S.clamp_score(F.col("s"), F.col("p")).alias("c"))
    assert [r.c for r in clamped.collect()] == [0, 2, 3, 2]


def test_trim_value(spark):
    rows = spark.createDataFrame([(" \t x\n ",), ("a" * 201,), ("a" * 198 + "€" * 3,), ("",)], "t string").select(S.trim_value(F.col("t")).alias("v")).collect()
    assert [r.v for r in rows] == ["x", "a" * 200 + "…", "a" * 198 + "…", ""]


def test_signature(spark):
    sources = ["/* { */ // x\nint f(void) { }", "int f(void);", "  // only\nstatic int\ng(void)\n{}"]
    rows = spark.createDataFrame([(s,) for s in sources], "s string").select(S.function_signature(F.col("s")).alias("v")).collect()
    assert [r.v for r in rows] == ["int f(void)", "int f(void);", "static int\ng(void)"]


def test_judge_prompt(spark):
    row = spark.createDataFrame([("q", [("c", 2)], "r")], "q string, c array<struct<criterion:string,points:long>>, r string").select(E.judge_prompt(F.col("q"), F.col("c"), F.col("r")).alias("p")).first()
    assert "1. c (2 points)" in row.p and "Question:\nq" in row.p
