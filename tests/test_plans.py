import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from inkwell.catalog.evaluation import DIM_CONFIG, FACT_CONFIG
from inkwell.plans import attempts as at, corpora, retrieval, runs, search
from inkwell.session import fresh_path
from inkwell.sources import tables

DAY = datetime.date(2024, 1, 2)


def answers(spark, pairs):
    return spark.createDataFrame(pairs, "RowId long, OpenAIAnswer double")


@pytest.fixture(scope="module")
def keys(spark):
    return spark.createDataFrame([(1, 5.0), (2, 7.0), (3, None), (4, 9.0)], "Id long, ExtractedAnswer double")


def test_score_run(spark, keys):
    scored = runs.score_run(answers(spark, [(1, 5.0), (2, 8.0), (3, 0.0), (99, 1.0), (None, 5.0)]), keys, DAY, "OPRO")
    assert {(r["RowId"], r["IndCorrect"]) for r in scored.collect()} == {(1, 1), (2, 0), (3, 0)}
    assert scored.columns == runs.SCORED
    assert round(runs.global_accuracy(scored).first()[0], 4) == 33.3333
    assert runs.global_accuracy(scored.limit(0)).first()[0] is None


def test_dim_and_fact(spark, keys):
    first = runs.score_run(answers(spark, [(1, 5.0), (2, 8.0)]), keys, DAY, "B style")
    second = runs.score_run(answers(spark, [(1, 5.0), (4, 9.0)]), keys, DAY, "A style")
    stacked = tables.union_runs([first, second])
    dim = runs.dim_runs(stacked, 10)
    assert [(r["ModelId"], r["RunStyle"], r["ModelAccuracy"]) for r in dim.orderBy("ModelId").collect()] == [(11, "A style", 100.0), (12, "B style", 50.0)]
    fact = runs.fact_runs(stacked, dim, 100).orderBy("Id").collect()
    assert [(r["Id"], r["ModelId"], r["RowId"]) for r in fact] == [(101, 11, 1), (102, 11, 4), (103, 12, 1), (104, 12, 2)]


def test_append_twice(spark, keys):
    tag = uuid.uuid4().hex
    dim_table, fact_table = f"d_{tag}", f"f_{tag}"
    tables.create_table(spark, dim_table, DIM_CONFIG, "Column_Name", location=fresh_path(spark, "d"))
    tables.create_table(spark, fact_table, FACT_CONFIG, "Column_Name", location=fresh_path(spark, "f"))
    for style in ("x", "y"):
        runs.append_dim_fact(spark, runs.score_run(answers(spark, [(1, 5.0), (2, 8.0)]), keys, DAY, style), dim_table, fact_table)
    assert sorted(r["ModelId"] for r in spark.table(dim_table).collect()) == [1, 2]
    facts = spark.table(fact_table)
    assert sorted(r["Id"] for r in facts.collect()) == [1, 2, 3, 4]
    assert facts.join(spark.table(dim_table), "ModelId", "left_anti").count() == 0


def test_pivot(spark):
    names = {"user": "QuestionAsked", "system": "QuestionInput", "assistant": "OutputAnswer"}
    frame = spark.createDataFrame([(0, "user", "q"), (0, "assistant", "a"), (5, "user", "only")], "c long, kind string, text string")
    wide = corpora.pivot_messages(frame, "c", "kind", "text", names).orderBy("Id").collect()
    assert [tuple(r) for r in wide] == [(1, "q", None, "a"), (6, "only", None, None)]
    with pytest.raises(ValueError):
        corpora.pivot_messages(frame.unionByName(frame.limit(1)), "c", "kind", "text", names)


def test_exchanges_use_every_message(spark):
    names = {"user": "QuestionAsked", "system": "QuestionInput", "assistant": "OutputAnswer"}
    rows = [(0, 0, "system", "s"), (0, 1, "user", "u1"), (0, 2, "assistant", "a1"), (0, 3, "user", "u2"), (1, 0, "user", "u3"), (1, 1, "user", "u4"), (1, 2, "assistant", "a4"), (1, 3, "assistant", "a5"), (2, 0, "system", "alone")]
    frame = spark.createDataFrame(rows, "c long, t long, kind string, text string")
    wide = [tuple(r)[1:] for r in corpora.exchanges(frame, "c", "t", "kind", "text", names).orderBy("Id").collect()]
    assert wide == [("u1", "s", "a1"), ("u2", "s", None), ("u3", None, None), ("u4", None, "a4"), (None, None, "a5"), (None, "alone", None)]
    assert sum(x is not None for r in wide for x in (r[0], r[2])) + len({r[1] for r in wide} - {None}) == len(rows)
    with pytest.raises(ValueError):
        corpora.exchanges(frame.unionByName(frame.filter("text = 'u1'")), "c", "t", "kind", "text", names)


def test_graded_once(spark, tmp_path):
    questions = spark.createDataFrame([(i, "v", f"q{i}") for i in range(6)], "question_id long, variant string, question string")

    @F.udf("string")
    def asked(number):
        (tmp_path / f"{number}-{uuid.uuid4().hex}").write_text("")
        return "Yes"

    grade = lambda df: df.withColumn("quality", asked("question_id"))
    done = at.retry_loop(questions, lambda df: df.withColumn("answer", F.lit("x")), lambda df: df.withColumn("relevance", F.lit("**Yes**")), grade)
    assert done.count() == 6 and len(done.collect()) == 6 and len(list(tmp_path.iterdir())) == 6


def test_context_keeps_rank_and_blank(spark):
    hits = spark.createDataFrame([(1, 10, 0.9, 2), (1, 11, 0.95, 1)], "query_id long, match_id long, score double, rank int")
    docs = spark.createDataFrame([(10, "ten\n\nparts"), (11, "eleven")], "id long, text string")
    asked = spark.createDataFrame([(1,), (2,)], "q long")
    contexts = retrieval.build_context(retrieval.fetch_documents(hits, docs, "id"), asked, "q").orderBy("q").collect()
    assert [r["context"] for r in contexts] == ["eleven\n\nten\n\nparts", ""]


def test_rerank(spark):
    rows = spark.createDataFrame([(1, "a", 0.1, 1), (1, "b", 0.5, 2), (1, "c", 0.5, 3)], "query_id long, match_id string, s double, rank int")
    best = retrieval.rerank(rows, F.col("s"), 2).orderBy("new_rank").collect()
    assert [r["match_id"] for r in best] == ["b", "c"]
    assert retrieval.rerank(rows, F.col("s"), None).count() == 3


def attempt_rows(spark):
    rows = [(1, "v", a, f"```\ncode{a}\n```", "yes" if a == 3 else "no", "Yes") for a in range(1, 6)]
    rows += [(2, "v", a, "x", "yes" if a == 25 else "no", "No") for a in range(1, 31)]
    return spark.createDataFrame(rows, "question_id long, variant string, attempt int, answer string, relevance string, quality string")


def test_attempts(spark):
    out = {r["question_id"]: r for r in at.first_relevant_attempt(attempt_rows(spark)).collect()}
    assert (out[1]["attempt"], out[1]["code"], out[1]["quality"]) == (3, "code3\n", "yes")
    assert (out[2]["attempt"], out[2]["code"], out[2]["quality"]) == (None, None, "unresolved")
    single = {r["question_id"]: r["code"] for r in at.single_pass(attempt_rows(spark)).collect()}
    assert single == {1: "code1\n", 2: "x"}
    assert at.MAX_ATTEMPTS == 24


def test_retry_loop(spark):
    questions = spark.createDataFrame([(i, "v", f"q{i}") for i in range(6)], "question_id long, variant string, question string")
    seen = []

    def generate(df):
        seen.append(df.count())
        return df.withColumn("answer", F.concat("question", F.lit("#"), F.col("attempt").cast("string")))

    judge = lambda df: df.withColumn("relevance", F.when(F.col("attempt") > F.col("question_id"), "yes").otherwise("no"))
    grade = lambda df: df.withColumn("quality", F.lit("Needs improvement"))
    out = {r["question_id"]: r for r in at.retry_loop(questions, generate, judge, grade, limit=4).collect()}
    assert seen == [6, 5, 4, 3]
    assert {q: r["attempt"] for q, r in out.items()} == {0: 1, 1: 2, 2: 3, 3: 4, 4: None, 5: None}
    assert out[0]["quality"] == "needs improvement" and out[5]["quality"] == "unresolved" and out[2]["code"] == "q2#3"


def test_prompt_search(spark):
    questions = spark.createDataFrame([(i, f"q{i}") for i in range(10)], "Id long, QuestionAsked string")
    keys = spark.createDataFrame([(i, float(i)) for i in range(10)], "Id long, ExtractedAnswer double")
    prompts = []

    def propose(prompt):
        prompts.append(prompt)
        return "[weak]\n\n[strong %d]" % len(prompts)

    def answer(rows):
        good = F.when(F.col("candidate").startswith("strong"), F.col("Id") < 7 + F.col("round")).otherwise(F.col("Id") < 2)
        return rows.withColumn("response", F.when(good, F.concat(F.lit("#### "), F.col("Id").cast("string"))).otherwise(F.lit("#### -1")))

    history = search.prompt_search(spark, questions, keys, propose, answer, rounds=3).collect()
    assert [(r["round"], r["candidate"], r["score"]) for r in history] == [(3, "strong 3", 100.0), (2, "strong 2", 90.0), (1, "strong 1", 80.0)]
    assert "Ground truth answer:" in prompts[0] and "Ground truth answer:" not in prompts[1]
    assert "Sentence: strong 2\nScore: 90.0\nSentence: strong 1\nScore: 80.0\n" in prompts[2]
    assert search.best_per_round(spark.createDataFrame([(1, "a", 5.0), (1, "b", 5.0)], "round int, candidate string, score double")).first()["candidate"] == "b"


def test_before_after(spark):
    before = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id long, answer string")
    after = spark.createDataFrame([(1, "a"), (2, "b"), (3, "x")], "id long, answer string")
    assert {r["id"]: r["changed"] for r in runs.before_after(before, after, "id").collect()} == {1: False, 2: True, 3: True}


@pytest.mark.parametrize("bytes_each, alike", [(256 << 20, 1000), (40, 2)])
def test_contexts_of_parts_equal_those_of_a_join(spark, monkeypatch, bytes_each, alike):
    """Ids that repeat, null and empty texts, questions without a hit or an id, and many with the same closest document; a text once went to each hit."""
    monkeypatch.setattr(retrieval, "PART_BYTES", bytes_each)
    monkeypatch.setattr(retrieval, "QUESTIONS_OF_A_MATCH", alike)
    docs = spark.createDataFrame([(n, f"text {n} é" * 3) for n in range(12)] + [(20, None), (21, ""), (3, "twice"), (None, "none")], "id long, text string")
    hits = [(q, m, 1.0, r + 1) for q in range(30) for r, m in enumerate([0 if q < 20 else q % 12, 20, q % 5 + 6, 21])] + [(31, 20, 1.0, 1), (32, 3, 1.0, 1), (32, 5, 1.0, 2), (32, 5, 1.0, 3)]
    hits = spark.createDataFrame(hits, "query_id long, match_id long, score double, rank int")
    asked = spark.createDataFrame([(q, f"q{q}") for q in [*range(33), 4, 40]] + [(None, "no id")], "q long, note string")
    found = retrieval.joined_contexts(hits, docs, asked, "q", "id")
    assert found.columns == ["q", "note", "context"]
    whole = retrieval.build_context(retrieval.fetch_documents(hits.filter("query_id <> 32"), docs, "id"), asked, "q").filter("q IS NULL OR q <> 32")
    rows = lambda df: sorted((r["q"] is None, r["q"] or 0, r["note"], r["context"]) for r in df.collect())
    assert rows(found.filter("q IS NULL OR q <> 32")) == rows(whole)
    twice = found.filter("q = 32").first()["context"].split("\n\n")
    assert sorted(twice[:2]) == sorted(["twice", "text 3 é" * 3]) and twice[2:] == ["text 5 é" * 3] * 2
    assert retrieval.joined_contexts(hits.limit(0), docs, asked, "q", "id").filter("context = ''").count() == asked.count()


def test_a_text_goes_once_to_a_part(spark):
    docs = spark.createDataFrame([(n, f"text {n}") for n in range(4)], "id long, text string")
    hits = spark.createDataFrame([(q, m, 1.0, m + 1) for q in range(50) for m in range(4)], "query_id long, match_id long, score double, rank int")
    asked = spark.createDataFrame([(q,) for q in range(50)], "q long")
    found = retrieval.joined_contexts(hits, docs, asked, "q", "id")
    assert {r["context"] for r in found.collect()} == {"\n\n".join(f"text {n}" for n in range(4))} and found.count() == 50
    sent = found._jdf.queryExecution().optimizedPlan().toString()
    assert "listagg" not in sent and "packed" in sent
