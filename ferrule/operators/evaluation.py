"""Summary of a blind comparison: questions, results, blinding map and judged scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ferrule.functions.scalars import percent

#: The two conditions of a run, by file name.
CONDITIONS = ("exp", "ctrl")
QUESTION = "id string, question string, rubric array<struct<criterion:string,points:bigint>>"
RESULT = "task_id string, condition string, question string, response string, duration_sec double, timestamp string"


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, question, place, criterion, points): one row a criterion."""
    rows = spark.read.schema(QUESTION).option("multiLine", "true").json(path)
    return rows.select(F.col("id").alias("task_id"), "question", F.posexplode("rubric").alias("place", "r")).select("task_id", "question", "place", "r.criterion", "r.points")


def load_results(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(task_id, run, condition, response, duration_sec) of {exp,ctrl}.json in each run's folder.

    A file holds a list or a single object; records without an id are left out, a null
    response is empty and a null duration 0.
    """
    paths = [f"{d.rstrip('/')}/{c}.json" for d in folders for c in CONDITIONS]
    glob = [p.rsplit("/", 1)[0] + "/{" + ",".join(CONDITIONS) + "}.json" for p in paths[:: len(CONDITIONS)]]
    rows = spark.read.schema(RESULT).option("multiLine", "true").json(glob).withColumn("__file", F.input_file_name())
    return result_rows(rows.withColumn("run", F.regexp_extract("__file", r"([^/]+)/[^/]+$", 1)).withColumn("condition", F.regexp_extract("__file", r"([^/]+)\.json$", 1)))


def result_rows(rows: DataFrame) -> DataFrame:
    named = rows.where(F.col("task_id").isNotNull() & (F.col("task_id") != ""))
    return named.select("task_id", "run", "condition", F.coalesce("response", F.lit("")).alias("response"), F.coalesce("duration_sec", F.lit(0.0)).alias("duration_sec"))


def blind(results: DataFrame, seed: int) -> DataFrame:
    """Adds `label`: letters in a seeded order within each task; more than 26 responses of a task have no letters."""
    ranked = results.withColumn("place", F.row_number().over(W.partitionBy("task_id").orderBy(F.xxhash64(F.lit(seed), "task_id", "run", "condition"), "run", "condition")))
    letter = F.when(F.col("place") <= 26, F.char(F.lit(64) + F.col("place")))
    return ranked.withColumn("label", F.coalesce(letter, F.raise_error(F.lit("more than 26 responses of one task")))).drop("place")


def rubric_points(rubric: DataFrame) -> DataFrame:
    return rubric.groupBy("task_id").agg(F.sum("points").cast("long").alias("max_points"))


def response_total(scores, total):
    """Sum of the criteria's scores if all are given, else the given total, rounded half to even; null if neither."""
    # a missing list, and an empty one, have no sum
    whole = F.coalesce((F.size(scores) > 0) & F.forall(scores, lambda s: s.isNotNull()), F.lit(False))
    return F.when(whole, F.aggregate(scores, F.lit(0).cast("long"), lambda a, s: a + s.cast("long"))).otherwise(F.bround(total, 0).cast("long"))


def condition_totals(judged: DataFrame, rubric: DataFrame, stats: DataFrame) -> DataFrame:
    """condition, score, max_score, responses, seconds, percent over judged responses that have a total.

    judged: (task_id, run, condition, criteria_scores, total). Tasks without a rubric are
    left out; a response without timing adds no seconds.
    """
    first = stats.groupBy("task_id", "run", "condition").agg(F.min("duration_sec").alias("duration_sec"))
    rows = judged.withColumn("score", response_total(F.col("criteria_scores"), F.col("total"))).where("score IS NOT NULL")
    rows = rows.join(rubric_points(rubric), "task_id").join(first, ["task_id", "run", "condition"], "left")
    sums = rows.groupBy("condition").agg(
        F.sum("score").alias("score"), F.sum("max_points").alias("max_score"), F.count("*").alias("responses"), F.sum(F.coalesce("duration_sec", F.lit(0.0))).alias("seconds")
    )
    return sums.withColumn("percent", percent(F.col("score"), F.col("max_score")))


def task_counts(results: DataFrame) -> DataFrame:
    """responses, tasks and responses a task, rounded down; no tasks give 0."""
    counts = results.agg(F.count("*").alias("responses"), F.count_distinct("task_id").alias("tasks"))
    return counts.withColumn("per_task", F.when(F.col("tasks") > 0, F.expr("responses div tasks")).otherwise(F.lit(0).cast("long")))


def judge_prompt(question, criteria, response):
    """The text a judge is asked with: question, numbered criteria, response and the form of the answer."""
    numbered = F.transform(criteria, lambda c, i: F.format_string("%d. %s (%d points)", i + 1, c["criterion"], c["points"]))
    return F.concat_ws("\n\n", F.concat(F.lit("Question:\n"), question), F.concat(F.lit("Criteria:\n"), F.array_join(numbered, "\n")), F.concat(F.lit("Response:\n"), response), F.lit('Answer with JSON: {"criteria_scores": [...], "notes": "..."}'))
