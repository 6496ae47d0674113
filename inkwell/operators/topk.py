"""The k best matches per query, kept while batches of scores stream through a task."""

from __future__ import annotations

import numpy as np
import pandas as pd

SCORE_DIGITS = 6
_UNITS = 10**SCORE_DIGITS
_NO_MATCH = np.iinfo(np.int64).min


class TopK:
    """Best k (score, id) per query: higher rounded scores first, smaller ids on ties; none under a given floor."""

    def __init__(self, n_queries: int, k: int, floor: np.ndarray | None = None):
        self.n_queries = n_queries
        self.k = k
        self.rows = np.empty(0, dtype=np.int64)
        self.scores = np.empty(0, dtype=np.float64)
        self.ids: np.ndarray | None = None
        self.floor = np.full(n_queries, -np.inf) if floor is None else floor.astype(np.float64)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of all queries against a batch of ids; -inf marks no match.

        Only queries whose floor can be reached are looked at, and each gives at most k rows: the
        key holds the rounded score and, below it, the place of the id, so copies cannot pile up.
        """
        width = scores.shape[1]
        if width == 0 or self.n_queries == 0:
            return
        live = np.flatnonzero(np.fmax.reduce(scores, axis=1) >= self.floor - 1.0 / _UNITS)  # a NaN is no match and hides none
        by_id = np.argsort(ids, kind="stable")
        part, ids = scores[live][:, by_id], ids[by_id]
        matched = np.isfinite(part)
        units = np.rint(np.where(matched, part, 0.0) * _UNITS).astype(np.int64)
        key = np.where(matched, units * width + np.arange(width - 1, -1, -1), _NO_MATCH)
        kept = min(self.k, width)
        columns = np.argpartition(key, width - kept, axis=1)[:, width - kept :]
        chosen = np.take_along_axis(matched, columns, axis=1).ravel()
        rows = np.repeat(live, kept)[chosen]
        columns, units = columns.ravel()[chosen], np.take_along_axis(units, columns, axis=1).ravel()[chosen]
        self.merge(rows, units / _UNITS, ids[columns])

    def merge(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take further matches (query row, rounded score, id) in any order.

        Once every query has k, they wait until sorting them in is worth its time; until then the floors are low, never high.
        """
        reached = scores >= self.floor[rows]
        self.waiting.append((rows[reached], scores[reached], ids[reached]))
        if sum(len(w[0]) for w in self.waiting) >= max(self.n_queries, len(self.rows) // 4) or not np.isfinite(self.floor).all():
            self.settle()

    def settle(self) -> None:
        """Sort in the matches that wait."""
        if not self.waiting:
            return
        known = [(self.rows, self.scores, self.ids)] if self.ids is not None else []
        rows, scores, ids = (np.concatenate(x) for x in zip(*known, *self.waiting))
        self.waiting = []
        order = np.lexsort((ids, -scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        best = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < self.k
        self.rows, self.scores, self.ids = rows[best], scores[best], ids[best]
        counts = np.bincount(self.rows, minlength=self.n_queries)
        full = counts >= self.k
        self.floor[full] = np.maximum(self.floor[full], self.scores[np.cumsum(counts)[full] - 1])

    def frame(self, query_ids: np.ndarray) -> pd.DataFrame:
        self.settle()
        ids = self.ids if self.ids is not None else np.empty(0, dtype=object)
        return pd.DataFrame({"query_id": query_ids[self.rows], "match_id": ids, "score": self.scores})
