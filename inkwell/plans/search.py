"""Prompt search: score candidate sentences, keep the best of each round, feed the history back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkwell.functions import fixed
from inkwell.functions.prompts import first_search_prompt, history_search_prompt
from inkwell.functions.text import candidate_lines, extract_number, is_correct
from inkwell.operators.skew import join_unique
from inkwell.session import stage

Propose = Callable[[str], str]
Answer = Callable[[DataFrame], DataFrame]


def parse_candidates(replies: DataFrame, reply_col: str) -> DataFrame:
    """One row per proposed sentence, with its 0-based place in the reply."""
    lines = F.posexplode_outer(candidate_lines(F.col(reply_col))).alias("place", "candidate")
    return replies.select(*[c for c in replies.columns if c != reply_col], lines).filter(F.col("candidate").isNotNull())


def with_candidates(questions: DataFrame, candidates: list[tuple[int, str]]) -> DataFrame:
    """Every question under every proposed sentence of a round; the list is a handful of literals."""
    listed = F.array(*[F.struct(F.lit(r).alias("round"), F.lit(c).alias("candidate")) for r, c in candidates])
    return questions.select("*", F.inline(listed))


def candidate_scores(answered: DataFrame, keys: DataFrame) -> DataFrame:
    """Accuracy per (round, candidate) from (Id, round, candidate, response) and (Id, ExtractedAnswer)."""
    return scores_of(join_unique(answered, keys, "Id"))


def scores_of(known: DataFrame) -> DataFrame:
    """Accuracy per (round, candidate) of answers that carry their key: (round, candidate, response, ExtractedAnswer)."""
    correct = is_correct(extract_number(F.col("response")), F.col("ExtractedAnswer")).cast("double")
    return known.groupBy("round", "candidate").agg((F.avg(correct) * 100).alias("score"), F.count(F.lit(1)).alias("n_answers"))


def best_per_round(scores: DataFrame) -> DataFrame:
    """Highest score of each round; the larger text decides ties."""
    best = F.max(F.struct("score", "candidate")).alias("best")
    return scores.groupBy("round").agg(best).select("round", F.col("best.candidate").alias("candidate"), F.col("best.score").alias("score"))


def history_text(ascending: bool = False) -> Column:
    """Aggregate of (score, candidate, round) rows into `Sentence / Score` lines, best first by default."""
    direction = "ASC" if ascending else "DESC"
    return F.expr(
        "listagg(concat('Sentence: ', candidate, '\\nScore: ', cast(score as string)), '\\n') "
        f"WITHIN GROUP (ORDER BY score {direction}, round ASC)"
    )


def history_prompt(history: DataFrame, group_cols: list[str] | None = None, ascending: bool = False) -> DataFrame:
    """The next proposal prompt from the best sentences so far; no history gives the first prompt."""
    lines = history.groupBy(*(group_cols or [])).agg(history_text(ascending).alias("lines"))
    prompt = F.when(F.col("lines").isNull(), first_search_prompt()).otherwise(history_search_prompt(F.col("lines")))
    return lines.withColumn("prompt", prompt).drop("lines")


def prompt_search(
    spark: SparkSession,
    questions: DataFrame,
    keys: DataFrame,
    propose: Propose,
    answer: Answer,
    rounds: int = fixed.SEARCH_ROUNDS,
) -> DataFrame:
    """Run the search: (round, candidate, score), one row per round, best first.

    `propose` maps a prompt to a reply with one sentence per line. `answer` adds a response column
    to (Id, QuestionAsked, round, candidate) rows. Only a round's winner and its score come back to
    the driver, so rounds do not pile up lineage.
    """
    schema = "round int, candidate string, score double"
    history: list[tuple[int, str, float]] = []
    for number in range(1, rounds + 1):
        prompt = history_prompt(spark.createDataFrame(history, schema)).first()["prompt"]
        reply = spark.createDataFrame([(propose(prompt),)], "reply string")
        proposed = [(number, r["candidate"]) for r in parse_candidates(reply, "reply").orderBy("place").collect()]
        if not proposed:
            continue
        # staged, so that measuring and joining do not ask again
        answered = stage(answer(with_candidates(questions, proposed)), "answered")
        winner = best_per_round(candidate_scores(answered, keys)).first()
        if winner is not None:
            history.append((winner["round"], winner["candidate"], winner["score"]))
    return spark.createDataFrame(history, schema).orderBy(F.desc("score"), F.asc("round"))
