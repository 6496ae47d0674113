"""Sampled SentencePiece segmentations without replacement, and their decoding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from inkwell.llm.lattice import Pieces, best_segmentations, build, decode_ids, edge_ids, row_key
from inkwell.llm.words import text_slices

SAMPLES = 2
SEED = 42
SLICE_BYTES = 1 << 20

_PIECES: dict[tuple[str, float], Pieces] = {}


def pieces_of(path: str, sharpness: float) -> Pieces:
    """One table of pieces per worker process and model."""
    if (path, sharpness) not in _PIECES:
        _PIECES[path, sharpness] = Pieces(path, sharpness)
    return _PIECES[path, sharpness]


def log_inclusion(log_p: float, threshold: float) -> float:
    """Log of the probability 1 - exp(-exp(log_p - threshold)) that a segmentation's noisy value is over the threshold."""
    if threshold == -np.inf:
        return 0.0
    excess = log_p - threshold
    return float(excess) if excess < -30 else float(np.log(-np.expm1(-np.exp(min(excess, 700.0)))))


def segmentations(pieces: Pieces, texts: list[str | None], names: list[object], samples: int, seed: int) -> Iterator[tuple[int, int, np.ndarray, float, float, float]]:
    """(number of the text, sample, ids, log probability, noisy value, log inclusion) for a bounded list of texts."""
    codes = [pieces.codes(t or "") for t in texts]
    ends = np.cumsum([len(c) for c in codes])
    whole = np.concatenate([*codes, np.zeros(0, np.int64)])
    if not len(whole):
        yield from ((k, 0, np.zeros(0, np.int32), 0.0, 0.0, 0.0) for k in range(len(names)))
        return
    starts = pieces.starts(whole)
    starts[ends[ends < len(whole)]] = True
    cuts = np.flatnonzero(starts)
    lattice = build(pieces, whole, cuts)
    bounds = np.searchsorted(cuts, np.concatenate([[0], ends]))
    for k, (paths, threshold) in enumerate(best_segmentations(lattice, bounds, [row_key(name, seed) for name in names], samples)):
        for path in paths:
            yield k, path.sample, edge_ids(pieces, lattice, path.edges), path.log_p, path.value, log_inclusion(path.log_p, threshold)
        if not paths:
            yield k, 0, np.zeros(0, np.int32), 0.0, 0.0, 0.0


def sample_segmentations(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, seed: int = SEED, sharpness: float = 1.0,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Up to `samples` distinct segmentations of every whole text: one row each.

    Columns: id, sample (0 has the largest noisy value), ids (little-endian 32-bit piece ids), n_pieces,
    log_prob, perturbed, log_inclusion, exact (the ids decode to the very text). Probabilities are of the
    piece model over the whole text. The noise is seeded by the id, so equal ids with equal texts get equal samples.
    Null and empty texts have one empty segmentation, texts with fewer segmentations than asked get
    all of theirs. A task works on about `slice_bytes` of text at a time, one text at least. Null ids are a key like any other; an empty table gives no rows; other columns are not read.
    """
    read = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_type = dict(read.dtypes)["id"]
    names = [id_col, "sample", "ids", "n_pieces", "log_prob", "perturbed", "log_inclusion", "exact"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what earlier steps left in a worker that is used again
        pieces = pieces_of(model_path, sharpness)
        for batch in text_slices(batches, "text", slice_bytes):
            texts = batch.column("text").to_pylist()
            rows = [
                (k, sample, ids.tobytes(), len(ids), log_p, value, inclusion, decode_ids(pieces, ids) == (texts[k] or ""))
                for k, sample, ids, log_p, value, inclusion in segmentations(pieces, texts, batch.column("id").to_pylist(), samples, seed)
            ]
            owner, *columns = zip(*rows)
            kinds = [pa.int32(), pa.binary(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(owner)), *[pa.array(c, t) for c, t in zip(columns, kinds)]], names=names)

    schema = f"`{id_col}` {id_type}, sample int, ids binary, n_pieces int, log_prob double, perturbed double, log_inclusion double, exact boolean"
    return read.mapInArrow(run, schema)


def decoded(ids: Column, model_path: str) -> Column:
    """The text of a column of little-endian 32-bit piece ids; null stays null."""

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        pieces = pieces_of(model_path, 1.0)
        return pa.array([None if v is None else decode_ids(pieces, np.frombuffer(v, "<i4")) for v in values.to_pylist()], pa.string())

    return run(ids)
