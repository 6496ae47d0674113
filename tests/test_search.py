import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.operators import bm25, knn, rounds
from inkwell.operators.closest import Rows, matches
from inkwell.operators.embed import _parts, embed, hashed_words_encoder
from inkwell.session import stage

DIM = 8


@pytest.fixture(scope="module")
def vectors(spark):
    """Clustered vectors of which a third are copies of one, with a null and a zero vector."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, DIM))
    rows = []
    for i in range(300):
        point = centres[0] if i % 3 == 0 else centres[i % 6] + 0.2 * rng.normal(size=DIM)
        rows.append((i, [float(x) for x in point.astype(np.float32)]))
    rows += [(300, None), (301, [0.0] * DIM)]
    return spark.createDataFrame(rows, "id long, v array<float>"), rows


def brute(rows, k, near=lambda a, b: True):
    usable = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v is not None and any(v)]
    out = set()
    for qi, q in usable:
        scored = [(-round(float(q @ c / math.sqrt((q @ q) * (c @ c))), 6), ci) for ci, c in usable if ci != qi and near(qi, ci)]
        out |= {(qi, ci, -s, p + 1) for p, (s, ci) in enumerate(sorted(scored)[:k])}
    return out


def found(df):
    return {(r["query_id"], r["match_id"], r["score"], r["rank"]) for r in df.collect()}


OPTIONS = dict(query_id="id", query_vec="v", corpus_id="id", corpus_vec="v", skip_same=True)


@pytest.mark.parametrize(
    "how", [{}, {"max_broadcast_queries": 0, "corpus_chunk": 16, "query_chunk": 8, "pivots": 5}, {"max_broadcast_queries": 0, "pivots": 1}]
)
@pytest.mark.parametrize("k", [1, 5])
def test_exact_search(spark, vectors, how, k):
    frame, rows = vectors
    assert found(knn.knn_join(frame, frame, k, **OPTIONS, **how)) == brute(rows, k)


@pytest.mark.parametrize("how", [{}, {"max_broadcast_queries": 0}])
def test_search_in_empty_corpus(spark, vectors, how):
    frame, _ = vectors
    assert knn.knn_join(frame, frame.limit(0), 3, **OPTIONS, **how).count() == 0
    assert knn.knn_join(frame.limit(0), frame, 3, **OPTIONS, **how).count() == 0


@pytest.mark.parametrize("how", [{}, {"max_broadcast_queries": 0, "pivots": 3, "corpus_chunk": 8}])
def test_damaged_vectors_match_nothing_and_hide_nothing(spark, how):
    rows = [(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(20)]
    bad = [(50, [1.0]), (51, [0.0, 1.0, 0.0, 1.0]), (52, None), (53, [float("inf"), 1.0, 1.0]), (54, [float("nan"), 1.0, 1.0]), (55, [0.0] * 3), (56, [None, 1.0, 1.0]), (57, [])]
    frame = spark.createDataFrame(rows + bad, "id long, v array<double>").coalesce(1)
    assert found(knn.knn_join(frame, frame, 4, **OPTIONS, **how)) == brute(rows, 4)
    assert found(knn.knn_bucketed(frame, frame, 4, **OPTIONS, dim=3, tables=1, bits=0)) == brute(rows, 4)


def test_very_large_values_keep_their_direction(spark):
    frame = spark.createDataFrame([(0, [1e200, 0.0]), (1, [1e-200, 1e-200]), (2, [0.0, 3.0])], "id long, v array<double>")
    assert {(r["query_id"], r["match_id"]): r["score"] for r in knn.knn_join(frame, frame, 2, **OPTIONS).collect()}[0, 1] == 0.707107


def test_probes_raise_recall(spark, vectors):
    frame, _ = vectors
    exact = knn.knn_join(frame, frame, 5, **OPTIONS)
    shares = [knn.recall(knn.knn_bucketed(frame, frame, 5, **OPTIONS, dim=DIM, tables=2, bits=6, probes=p), exact).agg(F.avg("recall")).first()[0] for p in (0, 3)]
    assert shares[1] > shares[0]


def test_text_ids(spark, vectors):
    frame, rows = vectors
    named = frame.filter("id < 40").select(F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("id"), "v")
    for how in ({}, {"max_broadcast_queries": 0, "pivots": 3, "corpus_chunk": 8}):
        hits = {(int(q[1:]), int(m[1:]), s, r) for q, m, s, r in found(knn.knn_join(named, named, 3, **OPTIONS, **how))}
        assert hits == brute([r for r in rows if r[0] < 40], 3)


def test_fewer_vectors_than_k(spark, vectors):
    frame, rows = vectors
    few = [r for r in rows if r[0] < 4]
    for how in ({}, {"max_broadcast_queries": 0, "pivots": 2}):
        assert found(knn.knn_join(frame.filter("id < 4"), frame.filter("id < 4"), 10, **OPTIONS, **how)) == brute(few, 10)


def test_bucketed_search(spark, vectors):
    frame, rows = vectors
    tables, bits = 3, 3
    places = {}
    for i, v in rows:
        if v is not None and any(v):
            places[i] = [tuple(knn.plane_signs(t, bits, DIM) @ np.array(v) >= 0) for t in range(tables)]
    near = lambda a, b: any(x == y for x, y in zip(places[a], places[b]))
    hits = knn.knn_bucketed(frame, frame, 5, **OPTIONS, dim=DIM, tables=tables, bits=bits, corpus_chunk=16, query_chunk=16)
    assert found(hits) == brute(rows, 5, near)
    exact = knn.knn_join(frame, frame, 5, **OPTIONS)
    assert knn.recall(hits, exact).agg(F.avg("recall")).first()[0] >= 0.8


def test_a_large_cell_is_sent_a_few_times(spark, monkeypatch):
    """Chunks grow with a cell, so neither side is copied once for every few rows of the other; a task stays bounded."""
    draw, sent = np.random.default_rng(5), []
    rows = spark.createDataFrame([(i, draw.standard_normal(DIM).tolist()) for i in range(2000)], "id long, v array<double>")
    monkeypatch.setattr(knn, "stage", lambda df, label: sent.append(label) or stage(df, label))
    asked, whole = (stage(knn.packed(rows.select(F.col("id").alias(name), F.col("v").alias("vec"), F.lit(0).alias("cell")), DIM), "rows") for name in ("query_id", "match_id"))
    for held, most in ((knn.HELD_VALUES, 4 * 4), (4000, 4 * 4), (1600, 10 * 10)):
        monkeypatch.setattr(knn, "HELD_VALUES", held)
        found = knn.block_matches(asked, whole, 3, DIM, True, corpus_chunk=16, query_chunk=8)
        assert 2000 * 3 < found.count() <= 2000 * 3 * math.isqrt(most)
    assert "cell-sizes" in sent


def test_single_precision_hides_no_match():
    """Scores that differ in the seventh digit, many copies, and a floor that matches just reach."""
    draw = np.random.default_rng(11)
    base = draw.standard_normal(48)
    rows = np.concatenate([base + 1e-4 * draw.standard_normal((1500, 48)), np.repeat(base[None], 900, axis=0), draw.standard_normal((700, 48))])
    unit = rows / np.sqrt((rows * rows).sum(axis=1))[:, None]
    ids = draw.permutation(len(unit))
    queries, corpus = Rows.of(ids[::9], unit[::9]), Rows.of(ids, unit)
    scores = np.rint(unit[::9] @ unit.T * 1e6) / 1e6
    for floor in (None, np.full(len(queries), 1.0)):
        frame = pd.concat(matches(queries, corpus, 4, True, floor))
        found = set(zip(frame["query_id"], frame["match_id"], frame["score"]))
        for row, q in enumerate(ids[::9]):
            best = sorted((-s, i) for s, i in zip(scores[row], ids) if i != q and (floor is None or s >= 1.0))[:4]
            assert {(q, i, -s) for s, i in best} == {x for x in found if x[0] == q}


TEXTS = [
    (0, "the cat sat on the mat"), (1, "The dog sat. The dog ran!"), (2, "a quick brown fox"), (3, ""), (4, None),
    (5, "the the the the"), (6, "cat cat dog fox mat"), (7, "THE cat's mat, été"),
] + [(10 + i, "the common words of a copied text") for i in range(6)]
QUESTIONS = [(0, "cat on the mat"), (1, "the dog"), (2, "été fox fox"), (3, "unknown zebra"), (4, None), (5, "copied text")]


def brute_bm25(k):
    words = {i: re.findall("[a-z0-9]+", t.lower()) for i, t in TEXTS if t is not None}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(t for w in words.values() for t in set(w))
    out = set()
    for q, text in QUESTIONS:
        terms = set(re.findall("[a-z0-9]+", (text or "").lower()))
        scored = []
        for d, w in words.items():
            tf = Counter(w)
            score = sum(
                math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in terms if tf[t]
            )
            if score > 0:
                scored.append((-round(score, 6), d))
        out |= {(q, d, -s, p + 1) for p, (s, d) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("how", [{}, {"max_broadcast_terms": 3, "hot_rows": 3}])
def test_bm25(spark, how):
    docs = spark.createDataFrame(TEXTS, "id long, text string")
    questions = spark.createDataFrame(QUESTIONS, "qid long, text string")
    hits = bm25.bm25_topk(questions, docs, 3, question_id="qid", question_text="text", doc_id="id", doc_text="text", **how)
    assert found(hits) == brute_bm25(3)


def test_many_questions_shuffle_few_rows(spark):
    """Scores are summed where the documents are: the only exchange above them carries k rows per question and task."""
    docs = spark.createDataFrame([(i, f"common w{i % 7} x{i}") for i in range(400)], "id long, text string")
    asked = spark.createDataFrame([(i, f"common w{i % 7}") for i in range(50)], "qid long, text string")
    hits = bm25.bm25_topk(asked, docs, 2, question_id="qid", question_text="text", doc_id="id", doc_text="text")
    assert hits.count() == 100
    plan = hits._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("BroadcastHashJoin")]
    assert "WindowGroupLimit" in top and top.count("Exchange") == 1 and "hashpartitioning(query_id" in top


def test_rescore_equals_topk(spark):
    docs = spark.createDataFrame(TEXTS, "id long, text string")
    questions = spark.createDataFrame(QUESTIONS, "qid long, text string")
    options = dict(question_id="qid", question_text="text", doc_id="id", doc_text="text")
    hits = bm25.bm25_topk(questions, docs, 4, **options)
    again = bm25.bm25_rescore(hits, questions, docs, **options)
    assert again.filter("bm25 <> score").count() == 0 and again.count() == hits.count()
    strange = spark.createDataFrame([(3, 2)], "query_id long, match_id long")
    assert bm25.bm25_rescore(strange, questions, docs, **options).first()["bm25"] == 0.0


def test_embedding(spark):
    frame = spark.createDataFrame([(0, None), (1, "a b a"), (5, None), (2, ""), (3, None), (6, "a b a")], "id int, t string").coalesce(1)
    rows = {r["id"]: r["values"] for r in embed(frame, "t", make_encoder=lambda: hashed_words_encoder(16)).collect()}
    assert abs(sum(x * x for x in rows[1]) - 1) < 1e-6 and len(rows[1]) == 16
    assert rows[2] == [0.0] * 16 and rows[6] == rows[1]
    assert rows[0] is None and rows[5] is None and rows[3] is None


def test_other_encoder_is_made_once_per_task(spark):
    def make():
        return lambda texts: np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

    rows = embed(spark.createDataFrame([("abc",), ("a",)], "t string"), "t", make_encoder=make, batch_size=1).collect()
    assert sorted(r["values"] for r in rows) == [[1.0, 1.0], [3.0, 1.0]]


def test_long_texts_are_encoded_in_parts():
    texts = pa.array(["a" * n for n in (10, 0, 90, 5, 5, 300, 1)])
    parts = list(_parts(texts, 3, 100))
    assert parts == [(0, 3), (3, 5), (5, 6), (6, 7)] and list(_parts(texts.slice(0, 0), 3, 100)) == []


@pytest.mark.parametrize("how", [{"pivots": 6}, {"pivots": 2}])
def test_rounds_of_blocks_equal_exact_search(spark, vectors, monkeypatch, how):
    """Cells in several blocks, the hot one dealt over some of them; a query once went to a shuffle for every cell it reached."""
    frame, rows = vectors
    monkeypatch.setattr(knn, "HELD_VALUES", 200)
    plans = []
    monkeypatch.setattr(knn, "in_rounds", lambda asked, *rest: plans.append(asked) or rounds.in_rounds(asked, *rest))
    hits = knn.knn_join(frame, frame, 4, **OPTIONS, max_broadcast_queries=0, **how)
    assert found(hits) == brute(rows, 4)
    assert plans[0].count() == 300  # a row for each usable query, whatever it reaches
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_dealt_blocks_hold_no_more_than_told():
    first, parts, n = rounds.dealt(np.array([3, 4, 25, 0, 9, 2]), 10)
    assert (first.tolist(), parts.tolist(), n) == ([0, 0, 1, 4, 4, 5], [1, 1, 3, 1, 1, 1], 6)
    assert rounds.dealt(np.array([5]), 10)[2] == 1 and rounds.dealt(np.array([30]), 10)[2] == 3
