"""A text encoder learned from a corpus: term weights and a randomised truncated SVD over all documents."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from inkwell.functions.text import token_bytes, tokens
from inkwell.operators.embed import Encoder
from inkwell.operators.skew import few_tasks
from inkwell.session import stage

#: The most frequent terms are kept, at most so many: the driver and the tasks hold a row of numbers for each.
MOST_TERMS = 20_000
LEAST_DOCUMENTS = 2
#: Directions carried beyond those asked for, and passes over the documents that sharpen them.
OVERSAMPLE = 16
PASSES = 4
SEED = 5
BLOCK_TERMS = 512
BATCH_TEXTS = 512
#: Numbers of a matrix of texts and terms.
PART_CELLS = 4_000_000


class Model(NamedTuple):
    """Places and weights of terms, a row of `vectors` for each, and the singular values."""

    places: dict[bytes, int]
    weights: np.ndarray
    vectors: np.ndarray
    values: np.ndarray


def weighted_terms(docs: DataFrame, text_col: str, most_terms: int = MOST_TERMS, least_documents: int = LEAST_DOCUMENTS) -> tuple[dict[bytes, int], np.ndarray]:
    """(place of each term, its weight log(n / documents with it) + 1), ties by the term."""
    words = docs.filter(F.col(text_col).isNotNull()).select(F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term"))
    counted = words.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= least_documents)
    kept = counted.orderBy(F.desc("df"), "term").limit(most_terms).collect()
    n = docs.filter(F.col(text_col).isNotNull()).count()
    return {r["term"].encode(): k for k, r in enumerate(kept)}, np.array([np.log(n / r["df"]) + 1 for r in kept])


def rows_of(texts: list[str | None], places: dict[bytes, int], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, value) of the texts: counts times weights, each text scaled to length 1."""
    row, term, value = [], [], []
    for k, text in enumerate(texts):
        found = Counter(p for p in map(places.get, token_bytes(text or "")) if p is not None)
        if found:
            at = np.fromiter(found, np.int64, len(found))
            own = np.fromiter(found.values(), np.float64, len(found)) * weights[at]
            row.append(np.full(len(at), k))
            term.append(at)
            value.append(own / np.sqrt((own * own).sum()))
    if not row:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(row), np.concatenate(term), np.concatenate(value)


def projected(texts: list[str | None], places: dict[bytes, int], weights: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The texts' rows times `directions`, and the rows."""
    row, term, value = rows_of(texts, places, weights)
    result = np.zeros((len(texts), directions.shape[1]))
    np.add.at(result, row, value[:, None] * directions[term])
    return result, (row, term, value)


def coded(docs: DataFrame, text_col: str, places: dict[bytes, int]) -> DataFrame:
    """(term, times), staged: the places of each text's known terms and how often they occur; texts without any are left out.

    Every pass reads these instead of the texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_TEXTS):
                texts = batch.column("text").slice(at, BATCH_TEXTS).to_pylist()
                counts = [Counter(p for p in map(shared.value.get, token_bytes(t or "")) if p is not None) for t in texts]
                counts = [c for c in counts if c]
                ends = pa.array(np.cumsum([0, *map(len, counts)]).astype(np.int32))
                lists = [pa.array(np.fromiter((x for c in counts for x in part(c)), np.int32)) for part in (Counter.keys, Counter.values)]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, x) for x in lists], names=["term", "times"])

    return stage(docs.select(F.col(text_col).alias("text")).mapInArrow(run, "term array<int>, times array<int>"), "lsa-rows")


def add_rows(total: np.ndarray, batch: pa.RecordBatch, weights: np.ndarray, directions: np.ndarray) -> None:
    """Adds A'A times `directions` of the coded texts to `total`, in matrices of some texts and the terms that they hold."""
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("term")).to_numpy(zero_copy_only=False))])
    terms, times = (batch.column(c).flatten().to_numpy() for c in ("term", "times"))
    step = max(1, PART_CELLS // len(total))
    for start in range(0, batch.num_rows, step):
        bounds = ends[start : start + step + 1]
        here, lengths = slice(bounds[0], bounds[-1]), np.diff(bounds)
        value = times[here] * weights[terms[here]]
        value /= np.repeat(np.sqrt(np.add.reduceat(value * value, bounds[:-1] - bounds[0])), lengths)
        known, at = np.unique(terms[here], return_inverse=True)
        matrix = np.zeros((len(lengths), len(known)))
        matrix[np.repeat(np.arange(len(lengths)), lengths), at] = value
        total[known] += matrix.T @ (matrix @ directions[known])


def _back_and_forth(rows: DataFrame, weights: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """A'A times `directions` over all coded documents.

    Tasks add up their documents and send blocks of terms; blocks meet sorted and are added one after the other, so no
    task holds more than one of them and the driver gets one result.
    """
    shared = rows.sparkSession.sparkContext.broadcast((weights, directions))
    n, width = directions.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, width))
        for batch in batches:
            add_rows(total, batch, *shared.value)
        for block in range(0, n, BLOCK_TERMS):
            part = total[block : block + BLOCK_TERMS]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part.tobytes()], pa.binary())], names=["block", "part"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None
        for batch in batches:
            for block, part in zip(batch.column("block").to_pylist(), batch.column("part").to_pylist()):
                if block != last and last is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([total.tobytes()], pa.binary())], names=["block", "part"])
                total = np.frombuffer(part).copy() if block != last else total + np.frombuffer(part)
                last = block
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([total.tobytes()], pa.binary())], names=["block", "part"])

    schema = "block long, part binary"
    parts = few_tasks(rows).mapInArrow(add_up, schema)
    result = np.zeros((n, width))
    for r in parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, schema).collect():  # one row per block
        part = np.frombuffer(r["part"]).reshape(-1, width)
        result[r["block"] : r["block"] + len(part)] = part
    return result


def fit(docs: DataFrame, text_col: str, dimensions: int, most_terms: int = MOST_TERMS, passes: int = PASSES, seed: int = SEED) -> Model:
    """The leading right singular vectors of the weighted documents, which cover every document with a text.

    The texts are read twice, for the weights and to be coded. A random start is multiplied by A'A in `passes` + 1 distributed passes, with a QR step of the bounded term side in between.
    """
    places, weights = weighted_terms(docs, text_col, most_terms)
    if not places:
        return Model(places, weights, np.zeros((0, dimensions), np.float32), np.zeros(0))
    width = min(len(places), dimensions + OVERSAMPLE)
    rows = coded(docs, text_col, places)
    basis, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(places), width)))
    for _ in range(passes):
        basis, _ = np.linalg.qr(_back_and_forth(rows, weights, basis))
    values, turn = np.linalg.eigh(basis.T @ _back_and_forth(rows, weights, basis))
    order = np.argsort(-values)[:dimensions]
    vectors = basis @ turn[:, order]
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)  # one sign for every run
    padded = np.zeros((len(places), dimensions), np.float32)
    padded[:, : len(order)] = vectors
    return Model(places, weights, padded, np.sqrt(np.maximum(values[order], 0)))


def encoder_of(docs: DataFrame, model: Model) -> Callable[[], Encoder]:
    """A maker of encoders for `embed`: texts to unit vectors; texts without a known term give zeros."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Encoder:
        own = shared.value

        def encode(texts: list[str]) -> np.ndarray:
            found, _ = projected(texts, own.places, own.weights, own.vectors)
            length = np.sqrt((found * found).sum(axis=1, keepdims=True))
            return (found / np.where(length > 0, length, 1)).astype(np.float32)

        return encode

    return make
