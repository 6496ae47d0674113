"""Scores of candidates over all questions, and answers read from odd texts."""

import random

from pyspark.sql import functions as F

from inkwell.catalog import evaluation
from inkwell.operators.bm25 import bm25_topk
from inkwell.functions.text import DROPPED, NUMBER, extract_number, strip_blanks


def test_scores_of_candidates_need_no_join(spark):
    plan = evaluation._scores(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def stepwise(text):
    """The number of an answer, each step by itself."""
    tail = strip_blanks(F.element_at(F.split(text, "####"), -1))
    cleaned = strip_blanks(F.regexp_replace(tail, DROPPED, ""))
    last_line = strip_blanks(F.substring_index(F.regexp_replace(cleaned, r"-?\.?\z", ""), "\n", -1))
    return F.coalesce(F.replace(F.regexp_extract(last_line, NUMBER, 0), F.lit("_"), F.lit("")).try_cast("double"), F.lit(0.0))


def test_shorter_steps_read_the_same_numbers(spark):
    drawn = random.Random(7)
    parts = ["#", "##", "####", "#####", "########", "5", "-3", ".", "1_000", "\n", " ", "\t", "\u2003", "abc", "$", "(", ")", ",", "x7", "1.5"]
    texts = [(None,), ("",), ("####",), ("#####5",), ("1#### 2####",)] + [("".join(drawn.choices(parts, k=drawn.randint(1, 8))),) for _ in range(4000)]
    found = spark.createDataFrame(texts, "text string").withColumns({"short": extract_number(F.col("text")), "long": stepwise(F.col("text"))})
    assert found.filter(~F.col("short").eqNullSafe(F.col("long"))).collect() == []


def test_bm25_deals_pairs_over_tasks(spark):
    docs = spark.createDataFrame([(n, f"common word{n % 7}") for n in range(300)], "id long, text string")
    questions = spark.createDataFrame([(n, "common") for n in range(20)], "id long, text string")
    names = dict(question_id="id", question_text="text", doc_id="id", doc_text="text")
    dealt = bm25_topk(questions, docs, 3, **names, task_pairs=100)
    assert "hashpartitioning(match_id" in dealt._jdf.queryExecution().toString() and ", 61)" in dealt._jdf.queryExecution().toString()
    assert sorted(dealt.collect()) == sorted(bm25_topk(questions, docs, 3, **names).collect())
