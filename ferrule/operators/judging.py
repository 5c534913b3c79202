"""Files of a blind comparison: responses under letters, the map that tells whose they are, scores and the report.

A comparison has a response a task, run and condition, so the files are small and are
written by the driver; the choice of letters and the totals are DataFrame plans.
"""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions.scalars import clamp_score
from ferrule.operators import evaluation as E

#: Names of the files (fixed values).
MAP, TEMPLATE, RESPONSES, JUDGMENT = "blinding_map.json", "judgment_template.json", "responses.json", "judgment.json"
_JUDGED = "task_id string, label string, run string, condition string, criteria_scores array<double>, total double, notes string"


def _write(folder: str, name: str, value: Any) -> None:
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, ensure_ascii=False)


def write_blind(results: DataFrame, rubric: DataFrame, folder: str, seed: int, result_dirs: list[str]) -> dict[str, int]:
    """Writes MAP, TEMPLATE and RESPONSES for the tasks that have a rubric; returns tasks, responses and responses a task."""
    sizes = rubric.groupBy("task_id").agg(F.count("*").alias("criteria"))
    labelled = E.blind(results, seed).join(sizes, "task_id")
    rows = labelled.orderBy("task_id", "label").collect()
    if not rows:
        raise ValueError("no results for the questions in these folders")
    whose, template, responses = {}, {}, {}
    for r in rows:
        whose.setdefault(r["task_id"], {})[r["label"]] = {"run": r["run"], "condition": r["condition"]}
        template.setdefault(r["task_id"], {})[r["label"]] = {"criteria_scores": [None] * r["criteria"], "total": None, "notes": ""}
        responses.setdefault(r["task_id"], {})[r["label"]] = r["response"]
    os.makedirs(folder, exist_ok=True)
    _write(folder, MAP, {"seed": seed, "result_dirs": result_dirs, "map": whose})
    _write(folder, TEMPLATE, template)
    _write(folder, RESPONSES, responses)
    return {"tasks": len(whose), "responses": len(rows), "per_task": len(rows) // len(whose)}


def judged_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, Any]]:
    """(task_id, label, run, condition, criteria_scores, total, notes) of a filled template, and what MAP says; who isn't known is `?`."""
    with open(os.path.join(folder, MAP), encoding="utf-8") as f:
        known = json.load(f)
    with open(os.path.join(folder, TEMPLATE), encoding="utf-8") as f:
        template = json.load(f)
    rows = []
    for task, labels in template.items():
        for label, given in labels.items():
            who = (known["map"].get(task) or {}).get(label) or {}
            scores, total = given.get("criteria_scores"), given.get("total")
            rows.append((task, label, who.get("run") or "?", who.get("condition") or "?", None if scores is None else [None if s is None else float(s) for s in scores], None if total is None else float(total), given.get("notes") or ""))
    return spark.createDataFrame(rows, _JUDGED), known


def apply_scores(spark: SparkSession, folder: str, rubric: DataFrame, answers: dict[tuple[str, str], list[float | None]]) -> None:
    """Fills the template's scores for (task, label), each clamped to its criterion's points."""
    points = {(r["task_id"], r["place"]): r["points"] for r in rubric.select("task_id", "place", "points").collect()}
    given = [(task, label, i, None if s is None else float(s), points[task, i]) for (task, label), scores in answers.items() for i, s in enumerate(scores) if (task, i) in points]
    frame = spark.createDataFrame(given, "task_id string, label string, place int, score double, points long").withColumn("clamped", F.when(F.col("score").isNotNull(), clamp_score(F.col("score"), F.col("points"))))
    with open(os.path.join(folder, TEMPLATE), encoding="utf-8") as f:
        template = json.load(f)
    for r in frame.collect():
        template[r["task_id"]][r["label"]]["criteria_scores"][r["place"]] = r["clamped"]
    _write(folder, TEMPLATE, template)


def report(spark: SparkSession, folder: str, rubric: DataFrame, results: DataFrame | None = None) -> list[str]:
    """Writes JUDGMENT and returns the report's lines: a row a response, then the totals by condition, sorted."""
    judged, known = judged_rows(spark, folder)
    empty = spark.createDataFrame([], "task_id string, run string, condition string, duration_sec double")
    results = results if results is not None else E.load_results(spark, known["result_dirs"]) if known.get("result_dirs") else empty
    # a score of a criterion counts by its whole part
    whole = judged.withColumn("criteria_scores", F.transform("criteria_scores", lambda s: s.cast("long")))
    totals = E.condition_totals(whole, rubric, results).orderBy("condition").collect()
    scored = whole.withColumn("score", E.response_total(F.col("criteria_scores"), F.col("total"))).join(E.rubric_points(rubric), "task_id")
    rows = scored.orderBy("task_id", "label").collect()
    raw = {(r["task_id"], r["label"]): r for r in judged.collect()}
    out: dict[str, Any] = {}
    lines = [f"{'Task':<6}  {'Run':<24}  {'Cond':<6}  {'Score':>10}"]
    rule = "-" * len(lines[0])
    lines.append(rule)
    for r in rows:
        given = raw[r["task_id"], r["label"]]
        out.setdefault(r["task_id"], {})[r["label"]] = {"condition": r["condition"], "run": r["run"], "criteria_scores": given["criteria_scores"], "total": r["score"], "notes": r["notes"]}
        score = f"{'?' if r['score'] is None else r['score']}/{r['max_points']}"
        lines.append(f"{r['task_id']:<6}  {r['run']:<24}  {r['condition']:<6}  {score:>10}")
    lines += [rule, "", "CONDITION TOTALS", ""]
    for t in totals:
        lines.append(f"  {t['condition']:<6}  score {float(t['score']):>5.1f}/{float(t['max_score']):.1f} ({t['percent']:.1f}%)  [{t['responses']} resp]  time={t['seconds']:.1f}s")
    sums = {t["condition"]: {"score": float(t["score"]), "max": float(t["max_score"]), "count": t["responses"], "secs": t["seconds"]} for t in totals}
    _write(folder, JUDGMENT, out | {"_meta": {"seed": known.get("seed"), "result_dirs": known.get("result_dirs") or [], "condition_totals": sums}})
    return lines
