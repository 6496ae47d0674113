"""Scoring runs and modelling them as a dimension and a fact table."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from inkwell.functions import fixed
from inkwell.functions.text import is_correct
from inkwell.operators.ordering import dense_index, exact_sample
from inkwell.operators.skew import broadcast_if_small, join_unique
from inkwell.session import stage
from inkwell.sources.tables import load, max_id

RUN_KEY = ["ModelName", "ModelTemperature", "RunStyle", "RunDate"]
SCORED = ["RowId", "OpenAIAnswer", "ExtractedAnswer", "ModelName", "ModelTemperature", "RunStyle", "IndCorrect", "RunDate"]


def join_answers(answers: DataFrame, keys: DataFrame, left_on: str = "RowId", right_on: str = "Id") -> DataFrame:
    """Inner join on differently named keys; the right key is dropped and null keys never match."""
    return join_unique(answers, keys.withColumnRenamed(right_on, left_on), left_on)


def run_literals(df: DataFrame, model: str, temperature: float, style: str | Column, run_date: datetime.date) -> DataFrame:
    return df.withColumns(
        {
            "ModelName": F.lit(model),
            "ModelTemperature": F.lit(temperature),
            "RunStyle": F.lit(style) if isinstance(style, str) else style,
            "RunDate": F.lit(run_date),
        }
    )


def score_run(
    answers: DataFrame,
    keys: DataFrame,
    run_date: datetime.date,
    style: str | Column,
    model: str = fixed.MODEL_NAME,
    temperature: float = fixed.MODEL_TEMPERATURE,
) -> DataFrame:
    """(RowId, OpenAIAnswer) against (Id, ExtractedAnswer): one scored row per answered key."""
    joined = join_answers(answers, keys).withColumn("OpenAIAnswer", F.col("OpenAIAnswer").cast("double"))
    labelled = run_literals(joined, model, temperature, style, run_date)
    return labelled.withColumn("IndCorrect", is_correct(F.col("OpenAIAnswer"), F.col("ExtractedAnswer"))).select(*SCORED)


def run_accuracy(scored: DataFrame) -> DataFrame:
    counts = scored.groupBy(*RUN_KEY).agg(
        F.sum("IndCorrect").cast("long").alias("CorrectCounts"), F.count(F.lit(1)).alias("TotalCounts")
    )
    share = F.col("CorrectCounts").cast("double") / F.col("TotalCounts").cast("double")
    return counts.withColumn("ModelAccuracy", share * 100)


def global_accuracy(scored: DataFrame) -> DataFrame:
    """One row; null when nothing was scored."""
    return scored.agg((F.avg(F.col("IndCorrect").cast("double")) * 100).alias("accuracy"))


def dim_runs(scored: DataFrame, dim_idx: int = 0) -> DataFrame:
    """One row per run. Keys continue after `dim_idx` in the order of the run's natural key.

    The window sorts finished runs, not scored rows.
    """
    number = F.row_number().over(Window.orderBy(*[F.asc_nulls_first(c) for c in RUN_KEY]))
    dim = run_accuracy(scored).withColumn("ModelId", number + F.lit(dim_idx).cast("long"))
    return dim.select("ModelId", "ModelName", "ModelTemperature", "RunStyle", "ModelAccuracy", "RunDate")


def fact_runs(scored: DataFrame, dim: DataFrame, fact_idx: int = 0) -> DataFrame:
    """One row per scored answer, pointing at its run, numbered after `fact_idx`. Best given a staged dim, which is read twice."""
    runs = broadcast_if_small(dim.select("ModelId", *[F.col(c).alias(f"_{c}") for c in RUN_KEY]))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in RUN_KEY]
    matched = scored.join(runs, same).select("ModelId", "RowId", "OpenAIAnswer", "ExtractedAnswer", "IndCorrect")
    return dense_index(matched, ["ModelId", "RowId"], "Id", fact_idx + 1)


def model_runs(scored: DataFrame, dim_idx: int = 0, fact_idx: int = 0) -> tuple[DataFrame, DataFrame]:
    """(dim, fact) of stacked runs.

    Scored rows are narrow and are staged: the answer texts behind them are read and parsed once.
    """
    kept = stage(scored, "scored")
    dim = stage(dim_runs(kept, dim_idx), "dim")
    return dim, fact_runs(kept, dim, fact_idx)


def append_dim_fact(spark: SparkSession, scored: DataFrame, dim_table: str, fact_table: str) -> None:
    """Append a batch of runs. Keys continue from the stored maxima; those of facts are new and unique by that, those of runs are checked."""
    dim_idx = max_id(spark.table(dim_table), "ModelId").first()["Id"]
    fact_idx = max_id(spark.table(fact_table), "Id").first()["Id"]
    dim, fact = model_runs(scored, dim_idx, fact_idx)
    load(spark, dim, dim_table, overwrite=False, keys=["ModelId"])
    load(spark, fact, fact_table, overwrite=False)


def leaderboard(dim: DataFrame) -> DataFrame:
    """Finished runs, newest and best first; the name of the style decides ties."""
    order = [F.desc("RunDate"), F.desc("ModelAccuracy"), F.asc("RunStyle")]
    return dim.withColumn("position", F.row_number().over(Window.orderBy(*order))).orderBy("position")


def qa_sample(questions: DataFrame, keys: DataFrame, n: int = fixed.TEST_SAMPLE, seed: int = fixed.TEST_SEED) -> tuple[DataFrame, DataFrame]:
    """The same seeded ids from the question table and from the key table."""
    chosen = exact_sample(questions, "Id", n, seed)
    ids = broadcast_if_small(chosen.select("Id"))
    return chosen.select("Id", "QuestionAsked"), keys.join(ids, "Id", "left_semi").select("Id", "ExtractedAnswer")


def before_after(before: DataFrame, after: DataFrame, question_id: str) -> DataFrame:
    """Two models' answers to the same questions side by side."""
    left = before.withColumnRenamed("answer", "before_answer")
    right = after.select(question_id, F.col("answer").alias("after_answer"))
    joined = join_unique(left, right, question_id)
    return joined.withColumn("changed", ~F.col("before_answer").eqNullSafe(F.col("after_answer")))
