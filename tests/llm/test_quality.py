import zlib

import numpy as np
import pytest

from inkwell.llm.quality import FEATURES, Model, drop_low_quality, feature_matrix, features, fit, score, train


def good(k):
    draw = np.random.default_rng(k)
    return " ".join(f"word{draw.integers(0, 300)}" for _ in range(40 + k % 60)) + "."


def bad(k):
    draw = np.random.default_rng(k)
    return [" ".join(["spam"] * (30 + k % 40)), "!! ".join(f"W{draw.integers(0, 300)}" for _ in range(40)).upper(), " | ".join(f"w{draw.integers(0, 300)}" for _ in range(40))][k % 3]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, bad(i) if i % 4 == 0 else good(i)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(900)] + [(None, 1), (3, None), (7, 5), (5000, 1)], "doc_id long, quality int")
    return docs, labels


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    found = score(docs, train(docs, labels)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r.held_out]
    assert len(held) > 200 and np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)


def test_held_out_labels_are_not_read(corpus):
    docs, labels = corpus
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    first, second = (sorted((r.doc_id, r.score) for r in score(docs, train(docs, x)).collect()) for x in (labels, other))
    assert first == second


def test_pairs_learn_what_single_features_cannot():
    draw = np.random.default_rng(0)
    matrix = draw.random((4000, 3))
    labels = ((matrix[:, 0] > 0.5) ^ (matrix[:, 1] > 0.5)).astype(float)
    model = fit(matrix, labels)
    assert (0, 1) in model.pairs and np.mean((model.scores(matrix) >= 0.5) == labels) > 0.95
    additive = Model(model.intercept, model.cuts, model.tables)
    assert np.mean((additive.scores(matrix) >= 0.5) == labels) < 0.7


def test_score_is_the_sum_of_its_bins():
    draw = np.random.default_rng(1)
    matrix = draw.random((500, 4))
    model = fit(matrix, (matrix[:, 0] + 0.3 * draw.random(500) > 0.6).astype(float))
    for row, p in zip(matrix[:20], model.scores(matrix[:20])):
        bins = [int(np.searchsorted(c, x, side="right")) for c, x in zip(model.cuts, row)]
        total = model.intercept + sum(t[b] for t, b in zip(model.tables, bins))
        total += sum(g[model.coarse[i][bins[i]], model.coarse[j][bins[j]]] for (i, j), g in zip(model.pairs, model.grids))
        assert p == pytest.approx(1 / (1 + np.exp(-total)))


def test_features_of_blocks_equal_the_whole(monkeypatch):
    text = "One two two three.\nOne two two three.\n" * 50
    whole = features(text)
    monkeypatch.setattr("inkwell.llm.words.BLOCK_BYTES", 16)
    assert features(text) == whole and len(whole) == len(FEATURES)
    assert np.isfinite(feature_matrix([None, "", " \n", "é"])).all()


def test_awkward_and_empty(spark, awkward, nothing, corpus):
    _, labels = corpus
    empty = labels.filter("false")
    for model, expected in ((train(awkward, empty), 0.5), (train(nothing, labels), 0.5)):
        found = score(awkward, model).collect()
        assert len(found) == 10 and all(r.score == expected and r.predicted == 1 for r in found)
    model = train(*corpus)
    found = score(awkward, model).collect()
    assert [r.score for r in found if r.doc_id in (1, 2)] == [model.scores(feature_matrix([""]))[0]] * 2
    kept = drop_low_quality(awkward, model)
    assert kept.dtypes == awkward.dtypes and kept.count() == sum(r.predicted for r in found)
    assert score(nothing, model).collect() == [] and drop_low_quality(nothing, model).collect() == []
