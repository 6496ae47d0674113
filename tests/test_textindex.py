"""The stored inverted index against the search that reads the texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.operators.bm25 import bm25_topk
from inkwell.operators.textindex import TextIndex
from inkwell.session import fresh_path

ASK = {"question_id": "item", "question_text": "question"}


@pytest.fixture(scope="module")
def docs(spark):
    draw = np.random.default_rng(1)
    words = [f"w{k}" for k in range(400)]
    shares = 1 / np.arange(1, 401)
    rows = [(i, " ".join(draw.choice(words, draw.integers(5, 60), p=shares / shares.sum()))) for i in range(1500)]
    rows += [(5000 + i, "w3 w3 w17 same text") for i in range(700)]  # a third of all rows is one text
    rows += [(9000, None), (9001, ""), (9002, "rare words alone")]
    return spark.createDataFrame(rows, "doc long, body string")


@pytest.fixture(scope="module")
def index(spark, docs):
    return TextIndex.create(spark, fresh_path(spark, "text-index"), docs, "doc", "body", range_docs=8)


@pytest.fixture(scope="module")
def questions(spark):
    draw = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{int(x)}" for x in draw.integers(0, 400, 5))) for i in range(30)]
    rows += [(100, "w0 w1 w2"), (101, "same rare"), (102, "nowhere"), (103, None), (104, ""), (105, "words"), (106, "w0 w0 w0 nowhere")]
    return spark.createDataFrame(rows, "item long, question string")


def listed(found):
    return sorted(tuple(r) for r in found.select("query_id", "match_id", "score", "rank").collect())


@pytest.mark.parametrize("k, first", [(1, 1), (5, 8), (40, 2)])
def test_equals_the_search_over_texts(docs, index, questions, k, first):
    expected = listed(bm25_topk(questions, docs, k, doc_id="doc", doc_text="body", **ASK))
    assert listed(index.search(questions, k, first_ranges=first, **ASK)) == expected and expected


def test_texts_are_not_read_and_blocks_are_skipped(spark, index, questions):
    again = TextIndex(spark, index.path)
    found = again.search(questions, 5, **ASK)
    assert all(index.path in f or "text-index" in f for f in found.inputFiles())
    shares = {r["query_id"]: r for r in again.skipped(questions, 5, **ASK).collect()}
    assert all(0 <= r["skipped"] <= r["blocks"] for r in shares.values())
    assert sum(r["skipped"] for r in shares.values()) > 0.3 * sum(r["blocks"] for r in shares.values())


def test_bounds_hold(index, questions):
    weighted = index._weighted(questions, "item", "question", 1000)
    bounds = index._bounds(weighted)
    scores = index._scored(weighted, bounds).withColumn("range", F.pmod(F.xxhash64("match_id"), F.lit(index.ranges)))
    worst = scores.join(bounds, ["query_id", "range"]).filter("score > bound + 1e-6")
    assert scores.count() > 0 and worst.isEmpty()


def test_few_terms_open_few_partitions(spark, index):
    one = spark.createDataFrame([(1, "rare")], "item long, question string")
    found = index._postings(index._weighted(one, "item", "question", 1000))
    assert found.select("bucket").distinct().count() == 1 and found.select("_metadata.file_path").distinct().count() == 1
    assert "PartitionFilters: [" in found._jdf.queryExecution().executedPlan().toString()


def test_no_documents(spark, questions):
    empty = spark.createDataFrame([], "doc long, body string")
    index = TextIndex.create(spark, fresh_path(spark, "text-index"), empty, "doc", "body")
    assert index.search(questions, 3, **ASK).count() == 0 and index.skipped(questions, 3, **ASK).count() == 0
