"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation with distributed products."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from inkwell.session import stage

#: Entries become floor(SCALE * c).
SCALE = 256
COMPONENTS = 4
#: Residual, as a share of the largest value, at which a component counts as found.
TOLERANCE = 1e-13
SEED = 12
BATCH_ROWS = 4096


class Fit(NamedTuple):
    """Vectors of the fit list, per-dimension sums, unit components by falling eigenvalue, and the eigenvalues."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def quantised(vector: Column) -> Column:
    """floor(SCALE * c) of each entry as long; null when the vector or an entry is null or not finite."""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.when(good & (F.size(vector) > 0), F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE)))


def remaining(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the rows with sound vectors of the commonest length (of equally common ones the longest)."""
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), quantised(F.col(f"`{vector_col}`")).alias("x")).filter(F.col("x").isNotNull())
    sizes = rows.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    return rows.filter(F.size("x") == (top["size"] if top else 0))


def matrices(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[np.ndarray]:
    """The x vectors of each batch as rows of longs, few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS).column("x").flatten().to_numpy().reshape(-1, dimensions)


def summed(rows: DataFrame, dimensions: int, size: int, part) -> np.ndarray:
    """The sum over all vectors of `part(matrix)`, an array of `size` doubles.

    Each task adds up what it reads and Spark adds the tasks', entry by entry, so the driver gets `size` numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for matrix in matrices(batches, dimensions):
            total += part(matrix)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["k", "value"])

    found = rows.mapInArrow(run, "k long, value double").groupBy("k").agg(F.sum("value").alias("value")).collect()
    result = np.zeros(size)
    for row in found:
        result[row["k"]] = row["value"]
    return result


def exact_sums(rows: DataFrame, dimensions: int) -> tuple[int, list[int]]:
    """How many vectors there are and their exact sums per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, [0] * dimensions
        for matrix in matrices(batches, dimensions):
            count += len(matrix)
            fits = len(matrix) == 0 or max(-int(matrix.min()), int(matrix.max())) < 1 << 48
            part = matrix.sum(axis=0).tolist() if fits else [sum(c) for c in matrix.T.tolist()]
            total = [a + b for a, b in zip(total, part)]
        values = pa.array([str(v) for v in [*total, count]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimensions + 1)), values], names=["k", "value"])

    found = rows.mapInArrow(run, "k long, value string").groupBy("k").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    sums = [0] * (dimensions + 1)
    for row in found.collect():
        sums[row["k"]] = int(row["value"])
    return sums[-1], sums[:-1]


def _orthogonal(vector: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The part of a vector outside an orthonormal basis (rows), taken twice."""
    for _ in range(2):
        vector = vector - basis.T @ (basis @ vector)
    return vector


def bidiagonalised(
    rows: DataFrame, dimensions: int, mean: np.ndarray, scale: float, outside: np.ndarray, wanted: int, tolerance: float, random: np.random.Generator
) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as rows) of the centred fit list outside the given orthonormal rows.

    Golub-Kahan-Lanczos: A v = alpha u + beta u', A'u = alpha v + beta v'. A step is one distributed pass over the vectors, which
    multiplies each by the new direction and adds the vectors up again under the products. A left vector u has a number
    for every row of the fit list; it is A w with a w of one number for each dimension, so rows recompute their share
    of u and nothing of the length of the corpus is kept. Both sides are reorthogonalised in full, left ones through
    A'u. Ends when `wanted` vectors are found to the tolerance, or with the space.
    """
    v = _orthogonal(random.standard_normal(dimensions), outside)
    right, left, images, alphas, betas = [v / np.linalg.norm(v)], [], [], [], []
    limit = dimensions - len(outside)
    beta, largest = 0.0, 0.0
    while True:
        direction = right[-1] - (beta * left[-1] if left and beta else 0.0)
        for _ in range(2):
            for w, image in zip(left, images):  # u_j . (A q) = (A' u_j) . q
                direction = direction - (image @ direction) * w

        def product(matrix: np.ndarray, q: np.ndarray = direction) -> np.ndarray:
            centred = (matrix - mean) / scale
            p = centred @ q
            return np.append(centred.T @ p, p @ p)

        total = summed(rows, dimensions, dimensions + 1, product)
        alpha = float(np.sqrt(max(total[-1], 0.0)))
        largest = max(largest, alpha)
        if alpha <= 1e-14 * largest or alpha == 0.0:
            alpha, image, w = 0.0, np.zeros(dimensions), np.zeros(dimensions)
        else:
            image, w = total[:-1] / alpha, direction / alpha
        alphas.append(alpha)
        left.append(w)
        images.append(image)
        rest = _orthogonal(image - alpha * right[-1], np.array([*outside, *right]))
        beta = float(np.linalg.norm(rest))
        bidiagonal = np.diag(alphas) + np.diag(betas, 1)
        p, values, q = np.linalg.svd(bidiagonal)
        done = len(right) == limit
        found = min(wanted, len(values))
        residual = beta * np.abs(p[-1, :found])
        if done or (len(right) >= wanted and (residual <= tolerance * values[0]).all() and beta > 1e-12 * values[0]):
            return values, q @ np.array(right)
        if beta <= 1e-12 * max(largest, 1e-300):  # the space of the start is used up: go on outside it
            rest, beta = _orthogonal(random.standard_normal(dimensions), np.array([*outside, *right])), 0.0
        right.append(rest / np.linalg.norm(rest))
        betas.append(beta)


def leading(rows: DataFrame, dimensions: int, mean: np.ndarray, scale: float, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest singular values of the centred vectors and their right vectors as rows.

    One start finds one vector of each repeated value. So unless the run used up all dimensions, further starts go on
    outside what is found until the largest value there, to three digits, is below the last one.
    """
    random = np.random.default_rng(SEED)
    values, vectors = bidiagonalised(rows, dimensions, mean, scale, np.zeros((0, dimensions)), wanted, TOLERANCE, random)
    whole = len(values) == dimensions
    values, vectors = values[:wanted], vectors[:wanted]
    outside = vectors
    while not whole and len(outside) < dimensions:
        more, found = bidiagonalised(rows, dimensions, mean, scale, outside, 1, 1e-3, random)
        if more[0] < values[-1] * (1 - 1e-3):
            break
        more, found = bidiagonalised(rows, dimensions, mean, scale, outside, 1, TOLERANCE, random)
        outside = np.concatenate([outside, found[:1]])
        order = np.argsort(-np.append(values, more[0]), kind="stable")[:wanted]
        if wanted <= len(values) and len(values) in order or len(values) < wanted:
            values, vectors = np.append(values, more[0])[order], np.concatenate([vectors, found[:1]])[order]
        else:
            break
    return values, vectors


def fit(rows: DataFrame, components: int = COMPONENTS) -> tuple[Fit, DataFrame]:
    """The whitening of staged rows (id, x), and the staged fit list: each distinct x once."""
    listed = stage(rows.select("x").distinct(), "whitening-list")
    first = listed.first()
    dimensions = len(first["x"]) if first else 0
    if not dimensions:
        return Fit(0, [], np.zeros((0, 0)), np.zeros(0), 0.0), listed
    n, sums = exact_sums(listed, dimensions)
    mean = np.array([s / n for s in sums])
    spread = float(summed(listed, dimensions, 1, lambda m: np.array([((m - mean) ** 2).sum()]))[0])
    if spread == 0.0:
        return Fit(n, sums, np.zeros((0, dimensions)), np.zeros(0), 0.0), listed
    values, vectors = leading(listed, dimensions, mean, float(np.sqrt(spread)), min(components, dimensions))
    kept = values > 1e-7 * values[0]
    return Fit(n, sums, vectors[kept], values[kept] ** 2 * spread / n, spread / n), listed


def identity_error(listed: DataFrame, found: Fit) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    mean, k = np.array([s / found.n for s in found.sums]), len(found.eigenvalues)
    weights = found.components.T / np.sqrt(found.eigenvalues)

    def part(matrix: np.ndarray) -> np.ndarray:
        white = (matrix - mean) @ weights
        return np.concatenate([white.sum(axis=0), (white.T @ white).ravel()])

    total = summed(listed, len(mean), k + k * k, part) / found.n
    covariance = total[k:].reshape(k, k) - np.outer(total[:k], total[:k])
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per sound vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, of another than the commonest length (of equally common ones the longest), or
    holds null or non-finite entries are dropped. Entries become longs x = floor(256 c), saturated; the fit uses each
    distinct x once, so copies do not count. `deviation` is null where it passes the range of long. Components without
    variance have no rows, so a table of one distinct vector gives none, like an empty table. Null and repeated ids
    are kept row by row; other columns are not read.
    """
    rows = stage(remaining(vectors, id_col, vector_col), "whitening-rows")
    found, listed = fit(rows, components)
    count = len(found.eigenvalues)
    error = identity_error(listed, found) if count else 0.0
    dimensions = len(found.sums)
    mean = np.array([s / found.n for s in found.sums]) if count else np.zeros(0)
    weights = found.components.T / np.sqrt(found.eigenvalues) if count else np.zeros((0, 0))
    explained = (found.eigenvalues / found.trace).tolist() if count else []
    largest_sum = max(map(abs, found.sums), default=0)

    def deviations(matrix: np.ndarray) -> list[int | None]:
        most = found.n * max(-int(matrix.min()), int(matrix.max()), 0) + largest_sum
        if most * most * dimensions < 1 << 63:
            return ((matrix * found.n - np.array(found.sums)) ** 2).sum(axis=1).tolist()
        exact = [sum((found.n * x - s) ** 2 for x, s in zip(row, found.sums)) for row in matrix.tolist()]
        return [d if d < 1 << 63 else None for d in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows if count else 0, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                matrix = part.column("x").flatten().to_numpy().reshape(-1, dimensions)
                white = (matrix - mean) @ weights
                index = np.repeat(np.arange(len(matrix)), count)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(index)),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(matrix))),
                        pa.array(np.full(len(index), found.n)),
                        pa.array(deviations(matrix), pa.int64()).take(pa.array(index)),
                        pa.array(white.ravel()),
                        pa.array(np.tile(explained, len(matrix))),
                        pa.array(np.full(len(index), error)),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    id_type = dict(rows.dtypes)["id"]
    schema = f"id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
