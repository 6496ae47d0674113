"""Recompression of word sequences inside one bounded block, with numpy.

Rounds name maximal runs of equal symbols, then pairs of neighbours from a left and a right class. A name is a hash
of what it stands for and of nothing else, so equal stretches anywhere in a corpus get equal symbols inside, without
any exchange between blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import xxhash

#: Multipliers of a 64-bit mixer, a pair of them for each lane of a name.
FACTORS = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
FINISH = np.uint64(0x94D049BB133111EB)
RUN, CLASS = np.uint64(0x52A9F1D3), np.uint64(0x7C1B6E55)
MOST_ROUNDS = 96
FAR = 1 << 40


class Symbols(NamedTuple):
    """Symbols in order: name lanes, chunk, words [start, end) stood for, words [low, high) that decided the name.

    `low` and `high` are beyond any word where the edge of the chunk took part.
    """

    names: list[np.ndarray]
    chunk: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def take(self, index: np.ndarray) -> "Symbols":
        return Symbols([n[index] for n in self.names], *(x[index] for x in self[1:]))


def mixed(x: np.ndarray, y: np.ndarray | np.uint64, lane: int) -> np.ndarray:
    first, second = (np.uint64(f) for f in FACTORS[lane])
    with np.errstate(over="ignore"):
        z = (x ^ (x >> np.uint64(31))) * first + y * second
        z = (z ^ (z >> np.uint64(29))) * FINISH
    return z ^ (z >> np.uint64(32))


def word_names(words: list[bytes], lanes: int) -> list[np.ndarray]:
    digest = xxhash.xxh3_128_digest if lanes == 2 else xxhash.xxh3_64_digest
    whole = np.frombuffer(b"".join(map(digest, words)), np.uint64).reshape(-1, lanes)
    return [np.ascontiguousarray(whole[:, k]) for k in range(lanes)]


def _beside(symbols: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(low, high) of the left and of the right neighbour of each symbol; far away at the edges of a chunk."""
    n, inner = len(symbols.chunk), symbols.chunk[1:] == symbols.chunk[:-1]
    left_low, left_high = np.full(n, -FAR), np.full(n, -FAR)
    right_low, right_high = np.full(n, FAR), np.full(n, FAR)
    left_low[1:], left_high[1:] = np.where(inner, symbols.low[:-1], -FAR), np.where(inner, symbols.high[:-1], -FAR)
    right_low[:-1], right_high[:-1] = np.where(inner, symbols.low[1:], FAR), np.where(inner, symbols.high[1:], FAR)
    return left_low, left_high, right_low, right_high


def _runs(s: Symbols) -> tuple[Symbols, np.ndarray]:
    """Maximal runs of one symbol as one, and which of them are new. A run ends where both neighbours differ, so these decide too."""
    same = s.chunk[1:] == s.chunk[:-1]
    for name in s.names:
        same &= name[1:] == name[:-1]
    left_low, left_high, right_low, right_high = _beside(s)
    if not same.any():
        low = np.minimum(np.minimum(s.low, left_low), right_low)
        high = np.maximum(np.maximum(s.high, right_high), left_high)
        return s._replace(low=low, high=high), np.zeros(len(s.chunk), bool)
    first = np.concatenate([[True], ~same])
    heads = np.flatnonzero(first)
    tails = np.concatenate([heads[1:], [len(first)]]) - 1
    count = (tails - heads + 1).astype(np.uint64)
    long = count > 1
    names = [np.where(long, mixed(n[heads], count ^ RUN, k), n[heads]) for k, n in enumerate(s.names)]
    low = np.minimum(np.minimum(np.minimum.reduceat(s.low, heads), left_low[heads]), right_low[tails])
    high = np.maximum(np.maximum(np.maximum.reduceat(s.high, heads), right_high[tails]), left_high[heads])
    return Symbols(names, s.chunk[heads], s.start[heads], s.end[tails], low, high), long


def _pairs(s: Symbols, number: int) -> tuple[Symbols, np.ndarray]:
    """A left symbol before a right one becomes a pair. Only the two decide that; one left alone also depends on whom it did not pair with."""
    right = (mixed(s.names[0], np.uint64(number) ^ CLASS, 0) >> np.uint64(63)).astype(bool)
    opens = np.zeros(len(right), bool)
    opens[:-1] = ~right[:-1] & right[1:] & (s.chunk[1:] == s.chunk[:-1])
    closes = np.concatenate([[False], opens[:-1]])
    left_low, left_high, right_low, right_high = _beside(s)
    alone_left, alone_right = ~right & ~opens, right & ~closes
    low = np.where(alone_right, np.minimum(s.low, left_low), np.where(alone_left, np.minimum(s.low, right_low), s.low))
    high = np.where(alone_left, np.maximum(s.high, right_high), np.where(alone_right, np.maximum(s.high, left_high), s.high))
    at = np.flatnonzero(opens)
    names = [n.copy() for n in s.names]
    end = s.end.copy()
    for k, n in enumerate(s.names):
        names[k][at] = mixed(n[at], n[at + 1], k)
    end[at] = s.end[at + 1]
    low[at], high[at] = np.minimum(s.low[at], s.low[at + 1]), np.maximum(s.high[at], s.high[at + 1])
    keep = np.flatnonzero(~closes)
    return Symbols(names, s.chunk, s.start, end, low, high).take(keep), opens[keep]


def created(names: list[np.ndarray], chunk: np.ndarray, place: np.ndarray, within: int | None = None) -> Iterator[Symbols]:
    """The symbols that each step creates, rounds upwards, until every chunk is one symbol.

    With `within`, until no symbol is left whose name was decided by at most that many words.
    """
    s = Symbols(names, chunk, place, place + 1, place, place + 1)
    for number in range(MOST_ROUNDS):
        if len(s.chunk) < 2 or not (s.chunk[1:] == s.chunk[:-1]).any():
            return
        for step in range(2):
            s, new = _runs(s) if step == 0 else _pairs(s, number)
            if new.any():
                yield s.take(np.flatnonzero(new))
        if within is not None and not (s.high - s.low <= within).any():
            return


def window_names(names: list[np.ndarray], size: int) -> list[np.ndarray]:
    """The name of the `size` words from each place on, by doubling."""
    result = []
    for k, word in enumerate(names):
        whole, reach, power, length = None, 0, word, 1
        while True:
            if size & length:
                part = power[reach:]
                whole = part if whole is None else mixed(whole[: len(part)], part[: len(whole)], k)
                reach += length
            if reach == size:
                break
            power = mixed(power[:-length], power[length:], k)
            length *= 2
        result.append(whole)
    return result
