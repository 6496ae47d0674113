"""Generate, extract, judge, retry and grade, as tables of attempts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from inkwell.functions import fixed
from inkwell.functions.text import extract_code, verdict
from inkwell.session import stage

# two steps per attempt, one for grading
MAX_ATTEMPTS = (fixed.GRAPH_STEP_LIMIT - 1) // 2

Step = Callable[[DataFrame], DataFrame]


def judged(attempts: DataFrame) -> DataFrame:
    """Code and verdicts out of the raw answer and judge texts."""
    return attempts.withColumns(
        {"code": extract_code(F.col("answer")), "relevance": verdict(F.col("relevance")), "quality": verdict(F.col("quality"))}
    )


def first_relevant_attempt(attempts: DataFrame, limit: int = MAX_ATTEMPTS) -> DataFrame:
    """Per (question, variant) the first attempt judged relevant within the limit.

    Pairs without one stay as unresolved rows with a null attempt. A partial aggregate keeps one
    row per pair and task before the shuffle.
    """
    record = F.struct("attempt", "answer", F.col("quality").alias("judgement"))
    accepted = F.when((verdict(F.col("relevance")) == "yes") & (F.col("attempt") <= limit), record)
    chosen = attempts.groupBy("question_id", "variant").agg(
        F.min(accepted).alias("first"), F.count(F.lit(1)).alias("n_attempts")
    )
    quality = F.when(F.col("first").isNull(), F.lit("unresolved")).otherwise(verdict(F.col("first.judgement")))
    return chosen.select(
        "question_id",
        "variant",
        F.col("first.attempt").alias("attempt"),
        extract_code(F.col("first.answer")).alias("code"),
        quality.alias("quality"),
        "n_attempts",
    )


def single_pass(attempts: DataFrame) -> DataFrame:
    """The first attempt as it is, without a relevance gate."""
    return judged(attempts.filter(F.col("attempt") == 1)).select("question_id", "variant", "code", "quality")


def variant_matrix(results: DataFrame, variants: list[str]) -> DataFrame:
    """One row per question, one quality column per variant."""
    return results.groupBy("question_id").agg(
        *[F.max(F.when(F.col("variant") == v, F.col("quality"))).alias(v) for v in variants]
    )


def retry_loop(questions: DataFrame, generate: Step, judge: Step, grade: Step, limit: int = MAX_ATTEMPTS) -> DataFrame:
    """Live loop over a table of questions (question_id, variant, question).

    `generate` adds an answer, `judge` a relevance text and `grade` a quality text to the rows it
    gets. Every round is written to the shared folder and carries unresolved rows only.
    """
    open_rows, resolved = questions, []
    for attempt in range(1, limit + 1):
        tried = generate(open_rows.withColumn("attempt", F.lit(attempt)))
        tried = judge(tried.withColumn("code", extract_code(F.col("answer"))))
        tried = stage(tried.withColumn("relevance", verdict(F.col("relevance"))), "attempts")
        resolved.append(tried.filter(F.col("relevance") == "yes"))
        open_rows = tried.filter(F.col("relevance") != "yes").select(*questions.columns)
        if open_rows.isEmpty():
            break
    # all resolved rows in one piece, graded once and staged, so that reading the result does not grade again
    accepted = resolved[0]
    for part in resolved[1:]:
        accepted = accepted.unionByName(part)
    graded = stage(grade(accepted).withColumn("quality", verdict(F.col("quality"))), "graded")
    columns = ["question_id", "variant", "attempt", "code", "quality"]
    done = graded.select(*columns)
    unresolved = open_rows.select(
        "question_id", "variant", F.lit(None).cast("int").alias("attempt"), F.lit(None).cast("string").alias("code"), F.lit("unresolved").alias("quality")
    )
    return done.unionByName(unresolved)
