"""Hierarchical index over fingerprints in Gray order, for all pairs within a Hamming distance.

Pure numpy helpers for one bounded block of fingerprints, arrays of shape (n, words) of uint64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FANOUT = 16
PAIRS_AT_ONCE = 2048
SMALL_RUN = 48


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The position of each 64-bit word in the reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def gray_order(codes: np.ndarray) -> np.ndarray:
    return np.lexsort(gray_rank(codes).T[::-1])


def levels(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(pattern, shared) per level, leaves first.

    An upper node stands for FANOUT consecutive nodes; `shared` masks the bits on which all its
    fingerprints agree and `pattern` holds them. Neighbours in Gray order differ in few bits, so upper
    nodes share many.
    """
    low, high = codes, codes
    result = [(codes, np.full_like(codes, ~np.uint64(0)))]
    while len(low) > 1:
        starts = np.arange(0, len(low), FANOUT)
        low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
        result.append((low, ~(low ^ high)))
    return result


def _differences(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Differing bits among those shared inside both nodes: a lower bound for all their members."""
    total = np.zeros(len(i), np.int32)
    for w in range(a[0].shape[1]):
        total += np.bitwise_count((a[0][i, w] ^ b[0][j, w]) & a[1][i, w] & b[1][j, w])
    return total


def close_pairs(a: np.ndarray, b: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) with at most `radius` differing bits between a and b; within a (i < j) when b is None.

    Both sides should be in Gray order. Walks both trees from their tops: the differences of a pair of
    nodes only grow on the way down, so a pair over the radius is dropped with all below it.
    """
    tree_a = levels(a)
    tree_b = tree_a if b is None else levels(b)
    depth = max(len(tree_a), len(tree_b)) - 1
    at = lambda tree, k: tree[min(k, len(tree) - 1)]  # noqa: E731  a shorter tree waits at its top
    stack = [(depth, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        near = _differences(at(tree_a, level), at(tree_b, level), i, j) <= radius
        i, j = i[near], j[near]
        if not len(i):
            continue
        if level == 0:
            if b is None:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j
            continue
        for start in range(0, len(i), PAIRS_AT_ONCE):
            x, y = _below(i[start : start + PAIRS_AT_ONCE], j[start : start + PAIRS_AT_ONCE], level, tree_a, tree_b)
            if b is None:
                x, y = x[x <= y], y[x <= y]
            stack.append((level - 1, x, y))


def _below(i: np.ndarray, j: np.ndarray, level: int, tree_a: list, tree_b: list) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of children of each pair of nodes."""
    fan_a, fan_b = (FANOUT if level < len(t) else 1 for t in (tree_a, tree_b))
    x = (i[:, None] * fan_a + np.arange(fan_a)).repeat(fan_b, axis=1).ravel()
    y = np.tile(j[:, None] * fan_b + np.arange(fan_b), (1, fan_a)).ravel()
    size_a, size_b = len(tree_a[min(level - 1, len(tree_a) - 1)][0]), len(tree_b[min(level - 1, len(tree_b) - 1)][0])
    inside = (x < size_a) & (y < size_b)
    return x[inside], y[inside]


def run_pairs(runs: np.ndarray, codes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Close pairs inside many short runs of equal `runs` values at once, by distance between places."""
    index = np.arange(len(runs) - 1)
    for step in range(1, SMALL_RUN):
        index = index[index < len(runs) - step]
        index = index[runs[index] == runs[index + step]]
        if not len(index):
            return
        total = np.zeros(len(index), np.int32)
        for w in range(codes.shape[1]):
            total += np.bitwise_count(codes[index, w] ^ codes[index + step, w])
        near = index[total <= radius]
        if len(near):
            yield near, near + step


class Forest:
    """Connected members of a block: pairs are merged as they come, so no pair is kept."""

    def __init__(self, size: int) -> None:
        self.root = np.arange(size)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            a, b = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
            np.minimum.at(self.root, b, a)
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(member, root) of every member that is not its own root."""
        member = np.flatnonzero(self.root != np.arange(len(self.root)))
        return member, self.root[member]
