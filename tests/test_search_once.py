"""Joins that measure their sides do not run a search again."""

from functools import partial

import pandas as pd
import pytest

from inkwell.catalog import retrieval as catalog
from inkwell.operators import skew
from inkwell.plans import retrieval

ROWS = 40


@pytest.fixture
def counted(spark):
    """(hits that count how often their rows are made, the counter)."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(len(batch))
            yield pd.DataFrame({"query_id": batch["id"], "match_id": (batch["id"] + 1) % ROWS, "score": 0.5, "rank": 1})

    return spark.range(ROWS).mapInPandas(run, "query_id long, match_id long, score double, rank long"), made


@pytest.mark.parametrize("broadcast_rows", [1, skew.BROADCAST_ROWS])
def test_agreement_searches_once(spark, counted, monkeypatch, broadcast_rows):
    hits, made = counted
    monkeypatch.setattr(retrieval, "join_unique", partial(skew.join_unique, max_broadcast_rows=broadcast_rows))
    labels = spark.range(ROWS).selectExpr("id AS vec_id", "int(id % 2) AS label")
    rows = retrieval.neighbour_agreement(hits, labels, "vec_id", "label").collect()
    assert len(rows) == ROWS and all(r["agreement"] == 0.0 and r["match_labels"] == str(1 - r["label"]) for r in rows)
    assert made.value == ROWS


def test_recall_of_buckets_searches_once(spark, counted, monkeypatch):
    exact, made = counted
    monkeypatch.setattr(catalog, "_self_hits", lambda *_: exact)
    assert catalog.knn_lsh(spark, "/root/testdata/sf0.001").count() > 0
    assert made.value == ROWS
