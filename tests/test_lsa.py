"""The learned encoder against numpy's SVD of the whole weighted matrix."""

import numpy as np
import pytest

from inkwell.functions.text import token_bytes
from inkwell.operators import knn
from inkwell.operators.embed import embed
from inkwell.operators.lsa import encoder_of, fit, rows_of

TOPICS = [[f"{letter}{k}" for k in range(12)] for letter in "abcd"]


def texts(n, seed=0):
    draw = np.random.default_rng(seed)
    shares = [0.4, 0.3, 0.2, 0.1]
    return [" ".join(draw.choice(TOPICS[t], 14)) + " shared" for t in draw.choice(4, n, p=shares)] + [None, "", "once-only-zzz"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(texts(300))), "doc long, body string").repartition(5)


def test_subspace_equals_numpy(docs):
    model = fit(docs, "body", 4)
    row, term, value = rows_of(texts(300), model.places, model.weights)
    whole = np.zeros((303, len(model.places)))
    whole[row, term] = value
    _, values, vectors = np.linalg.svd(whole, full_matrices=False)
    assert np.allclose(model.values, values[:4], rtol=1e-6)
    assert np.linalg.svd(vectors[:4] @ model.vectors)[1].min() > 1 - 1e-6
    assert b"zzz" not in model.places and len(model.places) <= 50


def test_weights_count_documents(docs):
    model = fit(docs, "body", 2)
    n = sum(t is not None for t in texts(300))
    df = sum(b"a0" in token_bytes(t or "") for t in texts(300))
    assert np.isclose(model.weights[model.places[b"a0"]], np.log(n / df) + 1)


def test_vectors_find_the_topic(spark, docs):
    model = fit(docs, "body", 4)
    make = encoder_of(docs, model)
    corpus = embed(docs.filter("doc < 300"), "body", make_encoder=make)
    asked = embed(spark.createDataFrame([(k, " ".join(t[:2])) for k, t in enumerate(TOPICS)], "q long, body string"), "body", make_encoder=make)
    hits = knn.knn_join(asked, corpus, 5, query_id="q", query_vec="values", corpus_id="doc", corpus_vec="values").collect()
    found = texts(300)
    assert len(hits) == 20 and all(found[h["match_id"]].split()[0][0] == "abcd"[h["query_id"]] for h in hits)


def test_fewer_terms_than_dimensions_and_no_texts(spark):
    few = spark.createDataFrame([(1, "x y"), (2, "x y y"), (3, None)], "doc long, body string")
    model = fit(few, "body", 6)
    assert model.vectors.shape == (2, 6) and embed(few, "body", make_encoder=encoder_of(few, model)).filter("size(values) = 6").count() == 2
    none = fit(few.filter("doc > 5"), "body", 3)
    assert none.vectors.shape == (0, 3)
