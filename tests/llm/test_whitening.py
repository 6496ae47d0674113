"""Whitening against numpy's eigenvectors."""

import math

import numpy as np
import pytest

from inkwell.llm import queries
from inkwell.llm.whitening import whiten


def brute(vectors, components=4):
    """Per sound vector: (deviation, projections), with eigenvalue shares; the fit uses distinct vectors once."""
    x = [[math.floor(256 * c) for c in v] for v in vectors]
    fit = np.array(sorted(set(map(tuple, x))))
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    values, columns = values[::-1][:components], columns[:, ::-1][:, :components]
    whitened = (np.array(x) - sums / n) @ columns / np.sqrt(values)
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return n, deviation, whitened, values / (centred**2).sum() * n


def check(rows, vectors, tolerance=1e-9):
    n, deviation, whitened, explained = brute(vectors)
    k = whitened.shape[1]
    by_key = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(rows) == len(by_key) == k * len(vectors)
    for c in range(k):
        mine = np.array([by_key[i, c + 1]["whitened"] for i in range(len(vectors))])
        sign = np.sign(mine @ whitened[:, c])
        assert np.abs(sign * mine - whitened[:, c]).max() < tolerance * np.abs(mine).max()
        for i in range(len(vectors)):
            row = by_key[i, c + 1]
            assert (row["n"], row["deviation"]) == (n, deviation[i])
            assert abs(row["explained"] / explained[c] - 1) < 1e-9
            assert row["identity_error"] < 1e-9


def frame(spark, vectors):
    return spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")


def test_query_equals_numpy(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    names = {r["vec_id"]: k for k, r in enumerate(sorted(rows, key=lambda r: r["vec_id"]))}
    vectors = [r["embedding"] for r in sorted(rows, key=lambda r: r["vec_id"])]
    found = [{**r.asDict(), "vec_id": names[r["vec_id"]]} for r in queries.QUERIES["op12_whitening"](spark, sf_dir).collect()]
    check(found, vectors)


@pytest.mark.parametrize("decay", [0.5, 0.9, 1.0])
def test_spectra_and_copies(spark, decay):
    random = np.random.default_rng(3)
    vectors = (random.standard_normal((150, 40)) * decay ** np.arange(40) * 20 + 7).tolist()
    vectors += [vectors[0]] * 60
    check(whiten(frame(spark, vectors)).collect(), vectors)


def test_repeated_eigenvalues_span_the_same_space(spark):
    """Two equal largest values: any basis of their plane will do, so lengths are compared."""
    corners = [[float(s * (j == k) * w) for j in range(6)] for k, w in enumerate((9, 9, 5, 4, 2, 1)) for s in (1, -1)]
    rows = whiten(frame(spark, corners)).collect()
    n, deviation, whitened, explained = brute(corners)
    for i in range(len(corners)):
        mine = {r["component"]: r for r in rows if r["vec_id"] == i}
        assert math.isclose(sum(mine[c]["whitened"] ** 2 for c in (1, 2)), (whitened[i, :2] ** 2).sum(), abs_tol=1e-9)
        assert [mine[c]["deviation"] for c in (1, 2, 3, 4)] == [deviation[i]] * 4
        assert np.allclose([mine[c]["explained"] for c in (1, 2, 3, 4)], explained)
    assert rows[0]["identity_error"] < 1e-9


def test_damaged_vectors_and_fewer_dimensions(spark):
    good = [[1.0, 2.0], [3.0, 5.5], [-1.25, 0.1], [2.0, 2.0], [-0.0, 1e-9]]
    damaged = [None, [], [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0], [1.0, 2.0, 3.0]]
    rows = whiten(frame(spark, good + damaged)).collect()
    check(rows, good)
    assert {r["component"] for r in rows} == {1, 2}


def test_no_variance_no_rows(spark):
    assert whiten(frame(spark, [[1.0, 2.0]] * 5)).count() == 0
    assert whiten(frame(spark, [])).count() == 0
    line = whiten(frame(spark, [[float(k), 2.0 * k, 0.0] for k in range(9)])).collect()
    assert {r["component"] for r in line} == {1} and len(line) == 9


def test_far_values_and_clashing_columns(spark):
    vectors = [[1e30, 1.0], [-1e30, 2.0], [0.5, 3.0]]
    rows = frame(spark, vectors).selectExpr("*", "1 AS id", "2 AS x", "'n' AS n", "0 AS component", "1.0 AS whitened", "'m' AS _metadata")
    found = whiten(rows).collect()
    assert len(found) >= 3 and all(r["deviation"] is None for r in found if r["vec_id"] < 2)
    nulls = spark.createDataFrame([(None, [1.0, 2.0]), (None, [2.0, 1.0]), (3, [5.0, 1.0]), (3, [5.0, 1.0])], "vec_id long, embedding array<float>")
    assert len(whiten(nulls).collect()) == 8
