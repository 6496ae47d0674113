"""Unit vectors as tasks hold them, and the k best matches of a block of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from inkwell.operators.topk import SCORE_DIGITS, TopK

#: Rows of a block of queries, of a tile of the corpus, and of a tile before every query has k matches.
BLOCK, TILE, FIRST_TILE = 2048, 1024, 256
#: Numbers of one matrix of vectors taken out of a batch.
SLICE_CELLS = 1_000_000
_UNITS = 10**SCORE_DIGITS


def unit_rows(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of usable vectors, their unit rows) from a list column, without an object per row.

    Usable is a vector of `dim` finite numbers that are not all zero. Anything else, null, shorter,
    longer, or with a null, NaN or infinite value in it, matches nothing.
    """
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    present = np.flatnonzero(lengths == dim)
    if len(present) == 0 or dim == 0:
        return present[:0], np.empty((0, dim))
    kept = vectors if len(present) == len(vectors) else vectors.take(pa.array(present))
    stacked = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(present), dim)
    largest = np.abs(stacked).max(axis=1)
    usable = np.isfinite(largest) & (largest > 0)
    stacked = stacked[usable] / largest[usable, None]
    return present[usable], stacked / np.sqrt((stacked * stacked).sum(axis=1))[:, None]


def slices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose vectors fill a matrix of bounded size."""
    step = max(1, SLICE_CELLS // max(1, dim))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


class Rows:
    """Unit rows by their entries other than zero: those of row r are values[ends[r] : ends[r + 1]], at `places`."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, places: np.ndarray, values: np.ndarray, dim: int):
        self.ids, self.ends, self.places, self.values, self.dim = ids, ends, places, values, dim

    @classmethod
    def packed(cls, ids: np.ndarray, at: pa.Array, of: pa.Array, dim: int) -> Rows:
        """Rows of two list columns, the places and the values of usable vectors."""
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(at).to_numpy(zero_copy_only=False))]).astype(np.int64)
        places, values = at.flatten().to_numpy(zero_copy_only=False), of.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if len(ids):
            lengths = np.diff(ends)
            values /= np.repeat(np.maximum.reduceat(np.abs(values), ends[:-1]), lengths)
            values /= np.repeat(np.sqrt(np.add.reduceat(values * values, ends[:-1])), lengths)
        return cls(ids, ends, places, values, dim)

    @classmethod
    def of(cls, ids: np.ndarray, unit: np.ndarray) -> Rows:
        row, place = np.nonzero(unit)
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(unit)))]).astype(np.int64)
        return cls(ids, ends, place.astype(np.int16), unit[row, place], unit.shape[1])

    def __len__(self) -> int:
        return len(self.ids)

    def take(self, chosen: np.ndarray) -> Rows:
        lengths = np.diff(self.ends)[chosen]
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        flat = np.repeat(self.ends[chosen] - ends[:-1], lengths) + np.arange(ends[-1])
        return Rows(self.ids[chosen], ends, self.places[flat], self.values[flat], self.dim)

    def part(self, start: int, stop: int) -> Rows:
        ends = self.ends[start : stop + 1]
        return Rows(self.ids[start:stop], ends - ends[0], self.places[ends[0] : ends[-1]], self.values[ends[0] : ends[-1]], self.dim)

    def dense(self) -> np.ndarray:
        out = np.zeros((len(self), self.dim))
        out[np.repeat(np.arange(len(self)), np.diff(self.ends)), self.places] = self.values
        return out

    def without_copies(self, kept: int) -> Rows:
        """Of equal rows only the `kept` smallest ids, as no others can be among so many best matches."""
        places = self.first_copies(kept)
        return self if len(places) == len(self) else self.take(places)

    def first_copies(self, kept: int) -> np.ndarray:
        """The places of the rows that `without_copies` keeps. Two 64-bit hashes decide."""
        if len(self) <= kept:
            return np.arange(len(self))
        names = []
        for odd in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9):
            mixed = (self.values.view(np.uint64) ^ ((self.places.astype(np.uint64) + np.uint64(1)) * np.uint64(0x94D049BB133111EB))) * np.uint64(odd)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
            names.append(np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), self.ends[:-1]))
        order = np.lexsort((self.ids, *names))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (names[0][order][1:] != names[0][order][:-1]) | (names[1][order][1:] != names[1][order][:-1])
        first = np.flatnonzero(fresh)
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        return np.sort(order[place < kept])


class Closest:
    """The k best matches of a block of unit rows among rows that come in tiles.

    Single precision rules pairs out, with room for all its rounding; scores that count are computed in double precision.
    `floor` holds a score for each row that its matches have to reach, `best` what they have met before, and `length` bounds
    the rows of the other side, which need not be unit ones.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int, skip_same: bool, floor: np.ndarray | None = None, best: TopK | None = None, length: float = 1.0):
        self.ids, self.rows, self.single, self.skip_same = ids, rows, rows.astype(np.float32), skip_same
        self.best = TopK(len(ids), k, floor) if best is None else best
        self.room = 1.0 / _UNITS + 6e-8 * (rows.shape[1] + 8) * max(1.0, length)
        self.first = max(FIRST_TILE, 2 * k)

    def add(self, ids: np.ndarray, rows: np.ndarray, who: np.ndarray | None = None) -> None:
        """Rows against all queries, or those at the places `who`."""
        who = np.arange(len(self.ids)) if who is None else who
        at = 0
        while len(who) and at < len(ids):
            low = self.best.floor[who]
            step = TILE if np.isfinite(low).all() else self.first
            names, tile = ids[at : at + step], rows[at : at + step]
            at += step
            if step == TILE:
                single = self.single if len(who) == len(self.ids) else self.single[who]
                reached = np.flatnonzero(single @ tile.astype(np.float32).T >= (low - self.room).astype(np.float32)[:, None])
                if len(reached) <= len(who) * len(names) // 16:
                    self._few(who[reached // len(names)], reached % len(names), names, tile)
                    continue
            for start in range(0, len(names), FIRST_TILE):
                self._all(who, names[start : start + FIRST_TILE], tile[start : start + FIRST_TILE])

    def _few(self, query: np.ndarray, match: np.ndarray, names: np.ndarray, tile: np.ndarray) -> None:
        if self.skip_same and len(query):
            apart = self.ids[query] != names[match]
            query, match = query[apart], match[apart]
        if len(query):
            step = max(1, SLICE_CELLS // max(1, tile.shape[1]))
            parts = [np.einsum("ij,ij->i", self.rows[query[s : s + step]], tile[match[s : s + step]]) for s in range(0, len(query), step)]
            self.best.merge(query, np.rint(np.concatenate(parts) * _UNITS) / _UNITS, names[match])

    def _all(self, who: np.ndarray, names: np.ndarray, tile: np.ndarray) -> None:
        scores = self.rows[who] @ tile.T
        if self.skip_same:
            scores[self.ids[who][:, None] == names[None, :]] = -np.inf
        top = TopK(len(who), self.best.k, self.best.floor[who])
        top.add(scores, names)
        top.settle()
        if top.ids is not None:
            self.best.merge(who[top.rows], top.scores, top.ids)

    def frame(self) -> pd.DataFrame:
        return self.best.frame(self.ids)


def blocks(ids: np.ndarray, rows: np.ndarray, k: int, skip_same: bool, length: float = 1.0) -> list[Closest]:
    return [Closest(ids[s : s + BLOCK], rows[s : s + BLOCK], k, skip_same, length=length) for s in range(0, len(ids), BLOCK)]


def matches(queries: Rows, corpus: Rows, k: int, skip_same: bool, floor: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
    """The k best of the corpus for each query, block by block."""
    corpus = corpus.without_copies(k + skip_same)
    for start in range(0, len(queries), BLOCK):
        block = queries.part(start, start + BLOCK)
        best = Closest(block.ids, block.dense(), k, skip_same, None if floor is None else floor[start : start + BLOCK])
        for at in range(0, len(corpus), TILE):
            tile = corpus.part(at, at + TILE)
            best.add(tile.ids, tile.dense())
        yield best.frame()
