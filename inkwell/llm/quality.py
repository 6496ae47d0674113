"""Text quality by a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees leaves one lookup table per feature and per chosen pair; a score is
the sum of the entries of a text's bins.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from inkwell.llm.words import text_slices, word_blocks

#: At most about so many labelled rows are fitted (a uniform sample by hash beyond that).
SAMPLE_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 120
RATE = 0.15
LEAF_WEIGHT = 1.0

FEATURES = [
    "log_bytes", "log_words", "word_bytes", "distinct_words", "repeated_neighbours", "most_frequent", "upper", "digits", "ends", "exclaims",
    "bars", "symbols", "brackets", "non_ascii", "controls", "line_words", "repeated_lines",
]
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digits": b"0123456789",
    "ends": b".,;:?",
    "exclaims": b"!",
    "bars": b"|",
    "symbols": b"#$%&*+=@^_~\\/",
    "brackets": b"<>[]{}()\"'`",
    "non_ascii": bytes(range(128, 256)),
    "controls": bytes([*range(0, 9), *range(14, 32), 127]),
}
_MEMBERS = np.array([[byte in chars for chars in CLASSES.values()] for byte in range(256)], np.float64)


def features(text: str | None) -> list[float]:
    """The features of one whole text; shares are of its bytes or words, zero when it has none."""
    raw = (text or "").encode()
    histogram = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = histogram @ _MEMBERS / max(1, len(raw))
    words = repeats = word_bytes = 0
    counts: Counter[bytes] = Counter()
    last = b""
    for block in word_blocks(text, lower=False):
        words += len(block)
        word_bytes += sum(map(len, block))
        repeats += sum(map(eq, block, block[1:])) + (block[:1] == [last])
        last = block[-1] if block else last
        counts.update(block)
    lines = [line for line in raw.split(b"\n") if line]
    n = max(1, words)
    return [
        np.log1p(len(raw)), np.log1p(words), word_bytes / n, len(counts) / n, repeats / n, max(counts.values(), default=0) / n, *shares,
        np.log1p(words / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)),
    ]


def feature_matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _step(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The best tree of at most four leaves over ordered bins: one cut, then one more on each side."""

    def cut(low: int, high: int) -> tuple[float, int]:
        g, h = np.cumsum(gradient[low:high]), np.cumsum(weight[low:high])
        if high - low < 2:
            return 0.0, high
        left, right = g[:-1] ** 2 / (h[:-1] + LEAF_WEIGHT), (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + LEAF_WEIGHT)
        gain = left + right - g[-1] ** 2 / (h[-1] + LEAF_WEIGHT)
        best = int(np.argmax(gain))
        return float(gain[best]), low + best + 1

    bins = len(gradient)
    middle = cut(0, bins)[1]
    edges = sorted({0, cut(0, middle)[1], middle, cut(middle, bins)[1], bins})
    values = np.zeros(bins)
    for low, high in zip(edges, edges[1:]):
        values[low:high] = gradient[low:high].sum() / (weight[low:high].sum() + LEAF_WEIGHT)
    return values


def _quarter_step(gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """The best tree over a grid with one cut on each axis, and its gain."""
    g, h = (np.cumsum(np.cumsum(x, 0), 1) for x in (gradient, weight))
    whole_g, whole_h = g[-1, -1], h[-1, -1]
    parts = [
        (g[:-1, :-1], h[:-1, :-1]),
        (g[:-1, -1:] - g[:-1, :-1], h[:-1, -1:] - h[:-1, :-1]),
        (g[-1:, :-1] - g[:-1, :-1], h[-1:, :-1] - h[:-1, :-1]),
    ]
    parts.append((whole_g - sum(p[0] for p in parts), whole_h - sum(p[1] for p in parts)))
    gain = sum(a**2 / (b + LEAF_WEIGHT) for a, b in parts)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    values = np.zeros_like(gradient)
    spots = [(slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))]
    for spot, (a, b) in zip(spots, parts):
        values[spot] = a[i, j] / (b[i, j] + LEAF_WEIGHT)
    return values, float(gain[i, j])


@dataclass
class Model:
    """Cut points and lookup tables; everything a score needs, a few kilobytes."""

    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)

    def scores(self, matrix: np.ndarray) -> np.ndarray:
        """Probabilities of label 1, by adding the entries of each row's bins."""
        logit = np.full(len(matrix), self.intercept)
        bins = [np.searchsorted(c, matrix[:, k], side="right") for k, c in enumerate(self.cuts)]
        for b, table in zip(bins, self.tables):
            logit += table[b]
        for (i, j), grid in zip(self.pairs, self.grids):
            logit += grid[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return _sigmoid(logit)


def fit(matrix: np.ndarray, labels: np.ndarray) -> Model:
    """Fit the model; with one class or no rows the score is the smoothed share of label 1."""
    positive, n = int(labels.sum()), len(labels)
    model = Model(intercept=float(np.log((positive + 1) / (n - positive + 1))))
    if not 0 < positive < n:
        return model
    inner = np.linspace(0, 1, BINS + 1)[1:-1]
    model.cuts = [np.unique(np.quantile(matrix[:, k], inner, method="higher")) for k in range(matrix.shape[1])]
    bins = [np.searchsorted(c, matrix[:, k], side="right") for k, c in enumerate(model.cuts)]
    sizes = [len(c) + 1 for c in model.cuts]
    model.tables = [np.zeros(s) for s in sizes]
    logit = np.full(n, model.intercept)
    for _ in range(ROUNDS):
        for k, b in enumerate(bins):
            p = _sigmoid(logit)
            values = RATE * _step(np.bincount(b, labels - p, sizes[k]), np.bincount(b, p * (1 - p), sizes[k]))
            model.tables[k] += values
            logit += values[b]
    model.coarse = [np.arange(s) * PAIR_BINS // s for s in sizes]
    rough = [c[b] for c, b in zip(model.coarse, bins)]

    def grid_of(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p, at = _sigmoid(logit), rough[i] * PAIR_BINS + rough[j]
        return tuple(np.bincount(at, x, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for x in (labels - p, p * (1 - p)))

    varied = [k for k, s in enumerate(sizes) if s > 1]
    ranked = sorted(itertools.combinations(varied, 2), key=lambda pair: -_quarter_step(*grid_of(*pair))[1])
    model.pairs = ranked[:PAIRS]
    model.grids = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    for _ in range(ROUNDS // 2):
        for k, (i, j) in enumerate(model.pairs):
            values = RATE * _quarter_step(*grid_of(i, j))[0]
            model.grids[k] += values
            logit += values[rough[i], rough[j]]
    return model


def held_out(id_col: str, folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the id as text falls into the fold; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % folds == fold, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS
) -> Model:
    """Fit on the labelled documents outside the held-out fold, about `sample_rows` of them at most.

    Only the features of the sample come to the driver. Labels other than 0 and 1, null ids and labels
    without a document are passed over, a label given twice counts once. Should one id name very many documents, at most
    twice `sample_rows` of them are fitted.
    """
    usable = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").alias("_label"))
    usable = usable.filter(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out("_id")).distinct()
    share = min(1.0, sample_rows / max(1, usable.count()))
    drawn = usable.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(drawn), "_id").select("text", "_label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            matrix = feature_matrix(batch.column("text").to_pylist())
            found = pa.array(list(matrix), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("_label").cast(pa.int32()), found], names=["label", "features"])

    found = sorted((r["label"], r["features"]) for r in rows.mapInArrow(run, "label int, features array<double>").limit(2 * sample_rows).collect())
    matrix = np.array([f for _, f in found], np.float64).reshape(-1, len(FEATURES))
    return fit(matrix, np.array([y for y, _ in found], np.float64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    The score reads the text alone. Null counts as empty, and an empty text has a score like any other.
    Rows with null or repeated ids are scored as they are; an empty table gives no rows; other
    columns are not read.
    """
    read = docs.select(F.col(f"`{id_col}`").alias("id"), held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    id_type = dict(read.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            found = model.scores(feature_matrix(batch.column("text").to_pylist()))
            columns = [batch.column("id"), batch.column("held_out"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "held_out", "score", "predicted"])

    return read.mapInArrow(run, f"`{id_col}` {id_type}, held_out boolean, score double, predicted int")


def drop_low_quality(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents, all columns, whose score is at least `least`; each row is judged by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text_col):
            found = model.scores(feature_matrix(batch.column(text_col).to_pylist()))
            yield batch.filter(pa.array(found >= least))

    return docs.mapInArrow(run, docs.schema)
