import random

import duckdb
from pyspark.sql import functions as F

from inkwell.catalog.standins import extract_number_sql
from inkwell.functions import fixed, prompts, text as tx

NUMBERS = {
    "#### 72": 72, "The answer #### 1,234.": 1234, "$5.50 ####$5.50": 5.5, "no hash 42": 42, "####-7": -7, "####12-": 12,
    "####3\n": 3, "#### 1/2": 12, "abc": 0, "#### 5 apples.": 5, "####1.2.3": 0, "####7\n####8\n9": 9, "50%": 50, "#### 1e5": 15,
    "####*9*": 0, "": 0, "####": 0, "5.": 5, "#### 3.0": 3, "x####4####5": 5, "####.5": 0.5, "####+6": 6, "#### 12 -": 12,
    "1_000": 1000, "1__0": 0, "_1": 0, "#####5": 0, "####7\n\t8": 8, " ####  9 　": 9, "####1\x1e": 1, "####5\t6": 0,
    "####--5": 0, "####5-.": 5, "####5.-": 5, "20.120-713.313-310.1025": 0, "####- 5": -5,
}


def evaluate(spark, values, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in frame.orderBy("i").select(expression(F.col("v"))).collect()]


def test_extract_number(spark):
    found = evaluate(spark, list(NUMBERS), tx.extract_number)
    assert dict(zip(NUMBERS, found)) == {k: float(v) for k, v in NUMBERS.items()}
    assert evaluate(spark, [None], tx.extract_number) == [0.0]


def test_number_text_is_that_of_the_sql(spark):
    """Large and small doubles too: `1.0E7` would lose its E as a unit and read as 1.07."""
    draw = random.Random(2)
    values = [0.0, -0.0, 0.01, 560.21, 1e7, 12345678.9, 1e15, 1e16, 1.5e17, -2.5e300, 2.5e-300, 0.001, 0.00099, 1e-4, 9.9e-5, 1.5e-7, 0.1 + 0.2, 1e100, 123456789012345.6, float("inf"), float("-inf"), float("nan")]
    values += [draw.choice((-1, 1)) * float(f"{draw.randrange(1, 10**9)}e{draw.randrange(-16, 10)}") for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(values)), "i int, v double").select("i", tx.number_text(F.col("v")).alias("t"))
    frame = frame.select("i", "t", tx.extract_number(F.concat(F.lit("12:00 ####"), "t", F.lit("-"))).alias("n"))
    connection = duckdb.connect()
    for row in frame.collect():
        text, number = connection.execute(f"SELECT v::VARCHAR, {extract_number_sql("'12:00 ####' || v || '-'")} FROM (SELECT ?::DOUBLE AS v)", [values[row["i"]]]).fetchone()
        assert (row["t"], row["n"]) == (text, number)


def test_answer_key(spark):
    texts = ["steps #### 72", "#### 1,080", "a #### 4 #### 5", "no key", None, "#### x"]
    assert evaluate(spark, texts, tx.answer_key) == [72.0, 1080.0, 4.0, None, None, None]


def test_candidates(spark):
    reply = "[Let us compute]\n\n1. [Step by step] \n[a]b]\n[]\r\n[[x] "
    expected = [line for line in (p.strip("[]").rstrip() for p in reply.split("\n")) if line]
    assert evaluate(spark, [reply], tx.candidate_lines) == [expected]


def test_verdict(spark):
    texts = ["Yes", " no.\n", "Needs improvement: x", "maybe", None, "YES it does", ""]
    assert evaluate(spark, texts, tx.verdict) == ["yes", "no", "needs improvement", "unknown", "unknown", "yes", "unknown"]


def test_verdict_is_a_whole_word(spark):
    words = ["Not sure", "None of it", "Yesterday it ran", "**Yes**", "'no'", '"No" it is', "(yes)", "yes_man", "No-one knows", "no't", "Yes!", "`needs improvement`: x", "needs improvements", "noël", "yes1", "\u201cYes\u201d"]
    expected = ["unknown", "unknown", "unknown", "yes", "no", "no", "yes", "unknown", "unknown", "unknown", "yes", "needs improvement", "unknown", "unknown", "unknown", "yes"]
    assert evaluate(spark, words, tx.verdict) == expected


def test_code(spark):
    texts = ["a\n```python\nx = 1\n```\nb\n```\ny\n```", "plain", None, "```\nunclosed"]
    assert evaluate(spark, texts, tx.extract_code) == ["x = 1\n\ny\n", "plain", None, "```\nunclosed"]


def test_concat(spark):
    frame = spark.createDataFrame([("a", None), ("a", "b")], "x string, y string")
    strict = [r[0] for r in frame.select(tx.concat_strict(F.col("x"), F.col("y"))).collect()]
    lenient = [r[0] for r in frame.select(tx.concat_lenient(F.col("x"), F.col("y"))).collect()]
    assert strict == [None, "a b"] and lenient == ["a ", "a b"]


def test_chat_messages(spark):
    frame = spark.createDataFrame([(s,) for s in fixed.RUN_STYLES], "style string")
    rows = frame.select("style", prompts.chat_messages(F.lit("q?"), F.col("style")).alias("m")).collect()
    roles = {r["style"]: [m["role"] for m in r["m"]] for r in rows}
    assert roles == {"Basic Prompting": ["user"], "Role-based Prompting": ["user", "system"], "Chain of Thought Prompting": ["user", "system"], "OPRO": ["user"]}
    chain = next(r for r in rows if r["style"].startswith("Chain"))["m"][1]["content"]
    assert chain.endswith("provide an answer.\nq?") and chain.count("\n") == 1
    shown = frame.select(prompts.chat_messages(F.lit("q?"), F.lit("Chain of Thought Prompting"), F.lit("Q: 1+1"))[1]["content"]).first()[0]
    assert shown.endswith("q?\nQ: 1+1")


def test_prompts(spark):
    row = spark.range(1).select(
        prompts.rag_prompt(F.lit("q"), F.lit(True), F.lit("ctx")).alias("with_context"),
        prompts.rag_prompt(F.lit("q"), F.lit(False), F.lit("ctx")).alias("without"),
        prompts.grader_prompt(F.lit("q"), F.lit("a")).alias("relevance"),
        prompts.grader_prompt(F.lit(None).cast("string"), F.lit("a")).alias("quality"),
        prompts.tuning_record(F.lit("Q"), F.lit("A")).alias("record"),
        prompts.first_search_prompt().alias("first"),
        prompts.grader_messages(F.lit(None).cast("string"), F.lit("a"))[0]["content"].alias("grader"),
        prompts.extraction_messages(F.lit("a"))[1]["content"].alias("extraction"),
    ).first()
    assert row["with_context"] == "Context: ctx\nSolve this problem using Python coding language.\nQuestion: q"
    assert row["without"] == "Solve this problem using Python coding language.\nQuestion: q"
    assert row["relevance"].endswith("extracted Python code.\nQuestion: q\nAnswer: a")
    assert row["quality"].endswith("production readiness.\na")
    assert "language.\nQ <|im_end|>\n            \n<|im_start|>assistant\nA<|im_end|>\n            " in row["record"]
    assert row["first"].count("Ground truth answer:") == 5
    assert row["grader"].startswith("You are a senior software engineer")
    assert row["extraction"].endswith("remain intact.\nQuestion: a\nAnswer: a")
