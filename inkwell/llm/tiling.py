"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inkwell.llm.frames import FILE, ROW, keyed, scan_of
from inkwell.llm.words import BLOCK_BYTES, SPACE, text_slices
from inkwell.session import stage

WORD = re.compile(r"\w+")
LEAST_MATCH = 5
COVERAGE = 0.5
ITEM_BLOCK_BYTES = 16 << 20
#: Places of equal seeds that are made at once, or those of one seed of a text if these are more.
PAIRS_AT_ONCE = 1 << 17
#: Fixed value: the base of the rolling hash, modulo 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15)


def plain_words(text: str | None) -> Iterator[list[str]]:
    """Lower-case words of letters, digits and underscores of a whole text, block by block."""
    raw, at = (text or "").encode(), 0
    while at < len(raw):
        end = at + BLOCK_BYTES
        if end < len(raw):
            cut = SPACE.search(raw, end)
            end = cut.start() if cut else len(raw)
        yield WORD.findall(raw[at:end].decode().lower())
        at = end


def rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of `size` ids."""
    total = np.zeros(max(0, len(ids) - size + 1), np.uint64)
    wide = ids.astype(np.uint64) + np.uint64(1)
    for k in range(size):
        total = total * BASE + wide[k : k + len(total)]
    return total


def runs_of(owner: np.ndarray, places: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Maximal runs of equal seeds as rows (owner, diagonal, first place, last place), in order."""
    diagonal = places - others
    order = np.lexsort((places, diagonal, owner))
    p, d, o = places[order], diagonal[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(o) != 0) | (np.diff(d) != 0) | (np.diff(p) != 1)]))
    ends = np.concatenate([new[1:], [len(p)]]) - 1
    return np.stack([o[new], d[new], p[new], p[ends]], axis=1)


def joined(parts: list[np.ndarray]) -> np.ndarray:
    """Runs of consecutive stretches of a text as the runs of all of it."""
    runs = np.concatenate(parts)
    if len(parts) == 1 or not len(runs):
        return runs
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    goes_on = (runs[1:, :2] == runs[:-1, :2]).all(axis=1) & (runs[1:, 2] == runs[:-1, 3] + 1)
    first = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    last = np.concatenate([first[1:], [len(runs)]]) - 1
    return np.column_stack([runs[first, :3], runs[last, 3]])


def tile(runs: list[tuple[int, int, int]], text_size: int, item_size: int, least: int) -> list[tuple[int, int, int]]:
    """Non-overlapping tiles (length, place in the text, place in the item), longest first.

    Of equally long matches the first in the text goes first, then the first in the item. A match that
    meets a mark goes back as its unmarked parts of at least `least` words.
    """
    text_marks, item_marks = np.zeros(text_size, bool), np.zeros(item_size, bool)
    heap = [(-n, p, q) for n, p, q in runs]
    heapq.heapify(heap)
    tiles = []
    while heap:
        n, p, q = heapq.heappop(heap)
        n = -n
        marked = text_marks[p : p + n] | item_marks[q : q + n]
        if not marked.any():
            text_marks[p : p + n] = True
            item_marks[q : q + n] = True
            tiles.append((n, p, q))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[1], marked.view(np.int8), [1]])))
        for start, end in zip(edges[::2], edges[1::2]):
            if end - start >= least:
                heapq.heappush(heap, (-int(end - start), p + int(start), q + int(start)))
    return tiles


class Items:
    """The words, seeds and lengths of one block of test items."""

    def __init__(self, items: list[tuple[object, str | None]], least: int) -> None:
        self.vocabulary: dict[str, int] = {}
        self.names, self.words, self.least = [], [], []
        seeds: dict[int, list[tuple[int, int, int]]] = {}
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for block in plain_words(text) for w in block]
            if not ids:
                continue
            size = min(least, len(ids))
            for place, value in enumerate(rolling(np.array(ids), size).tolist()):
                seeds.setdefault(size, []).append((value, len(self.names), place))
            self.names.append(name)
            self.words.append(np.array(ids))
            self.least.append(size)
        lengths = np.array([len(w) for w in self.words], np.int64)
        self.line = np.concatenate(self.words) if self.words else np.zeros(0, np.int64)
        self.offsets = np.cumsum(lengths) - lengths
        self.seeds = {}
        for size, found in seeds.items():
            found.sort()
            self.seeds[size] = (np.array([f[0] for f in found], np.uint64), np.array([f[1] for f in found]), np.array([f[2] for f in found]))

    def matches(self, text: str | None) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(item number, words of the text, tiles) of every item that shares a seed with a whole text.

        Places of equal seeds are made for a bounded number of pairs at a time, of which only their runs are kept.
        """
        get = self.vocabulary.get
        blocks = [np.fromiter(map(get, block, itertools.repeat(-1)), np.int64, len(block)) for block in plain_words(text)]
        ids = np.concatenate(blocks) if blocks else np.zeros(0, np.int64)
        runs: dict[int, list[np.ndarray]] = {}
        for size, (values, items, places) in self.seeds.items():
            if len(ids) < size:
                continue
            unknown = np.concatenate([[0], np.cumsum(ids < 0)])
            at = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(at):
                continue
            hashes = np.zeros(len(at), np.uint64)
            for k in range(size):
                hashes = hashes * BASE + (ids[at + k].astype(np.uint64) + np.uint64(1))
            first, last = np.searchsorted(values, hashes, "left"), np.searchsorted(values, hashes, "right")
            met = np.flatnonzero(last > first)
            counts = (last - first)[met]
            cuts = np.flatnonzero(np.diff((np.cumsum(counts) - counts) // PAIRS_AT_ONCE)) + 1
            for part in np.split(np.arange(len(met)), cuts):
                if not len(part):
                    continue
                own, n = met[part], counts[part]
                spot = np.repeat(at[own], n)
                rank = np.arange(len(spot)) - np.repeat(np.cumsum(n) - n, n)
                entry = np.repeat(first[own], n) + rank
                owner, place = items[entry], places[entry]
                same = np.ones(len(spot), bool)  # a hash only proposes
                for k in range(size):
                    same &= ids[spot + k] == self.line[self.offsets[owner] + place + k]
                if same.any():
                    runs.setdefault(size, []).append(runs_of(owner[same], spot[same], place[same]))
        for size, parts in runs.items():
            found = joined(parts)
            cuts = np.flatnonzero(np.diff(found[:, 0])) + 1
            for own in np.split(found, cuts):
                item = int(own[0, 0])
                spans = [(last - first + size, first, first - d) for _, d, first, last in own.tolist()]
                yield item, len(ids), tile(spans, len(ids), len(self.words[item]), size)

    def best(self, text: str | None, least_coverage: float = COVERAGE) -> tuple[float, object, int, int, list]:
        """(coverage, item, tiles, tiled words) of the most covered item, equal ones by the smaller id, null last; and all items held."""
        top = (0.0, None, 0, 0)
        key, held = None, []
        for item, _, tiles in self.matches(text):
            covered = sum(n for n, _, _ in tiles)
            share, name = covered / len(self.words[item]), self.names[item]
            rank = (-share, name is None, name if name is not None else 0)
            if key is None or rank < key:
                key, top = rank, (share, name, len(tiles), covered)
            if tiles and share >= least_coverage:
                held.append(name)
        return (*top, held)


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int = ITEM_BLOCK_BYTES) -> Iterator[list[tuple[object, str | None]]]:
    """The test items in blocks of about `block_bytes`, one block at a time on the driver."""
    rows = benchmark.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{text_col}`").alias("text")).distinct()
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = 1 + 2 * (total // block_bytes)
    for block in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block) if blocks > 1 else rows
        yield sorted(((r["item"], r["text"]) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))


def coverage(rows: DataFrame, items: list[tuple[object, str | None]], item_type: str, least_match: int, least_coverage: float = COVERAGE) -> DataFrame:
    """`rows` with `text` replaced by coverage, item, tiles and tiled_words of the best item of the block, and all items held."""
    others = [c for c in rows.columns if c != "text"]
    schema = ", ".join([f"`{c}` {t}" for c, t in rows.dtypes if c != "text"] + ["coverage double", f"item {item_type}", "tiles int", "tiled_words int", f"items array<{item_type}>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Items(items, least_match)
        for batch in text_slices(batches, "text"):
            found = [index.best(t, least_coverage) for t in batch.column("text").to_pylist()]
            kind = pa.string() if item_type == "string" else pa.int64()
            names = pa.array([f[1] for f in found], kind)
            new = [pa.array([f[0] for f in found], pa.float64()), names, pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int32()), pa.array([f[4] for f in found], pa.list_(kind))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + new, names=others + ["coverage", "item", "tiles", "tiled_words", "items"])

    return rows.mapInArrow(run, schema)


def tiled(
    rows: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", least_match: int = LEAST_MATCH, block_bytes: int = ITEM_BLOCK_BYTES,
    least_coverage: float = COVERAGE,
) -> DataFrame:
    """`rows` (unique by their columns but text) with their best item and all items held over all blocks of the benchmark.

    Every document meets every item through shared seeds of `least_match` words inside its own task;
    no text is shuffled. A benchmark larger than a block takes a pass for each block, whose best items are
    compared afterwards.
    """
    item_type = "string" if dict(benchmark.dtypes)[item_col] == "string" else "long"
    items = benchmark.withColumn(item_col, F.col(f"`{item_col}`").cast(item_type))
    passes = []
    for block in item_blocks(items, item_col, item_text_col, block_bytes):
        passes.append(coverage(rows, block, item_type, least_match, least_coverage))
        if len(passes) > 1:
            passes[-2:] = [stage(p, "tiling-pass") for p in passes[-2:]]
    if len(passes) == 1:
        return passes[0]
    keys = [c for c in rows.columns if c != "text"]
    whole = passes[0]
    for more in passes[1:]:
        whole = whole.union(more)
    rank = F.struct((-F.col("coverage")).alias("c"), F.col("item").isNull().alias("no_item"), "item", "tiles", "tiled_words")
    best = whole.groupBy(*keys).agg(F.min(rank).alias("best"), F.flatten(F.collect_list("items")).alias("items"))
    return best.select(*keys, (-F.col("best.c")).alias("coverage"), "best.item", "best.tiles", "best.tiled_words", "items")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least_match: int = LEAST_MATCH,
    least_coverage: float = COVERAGE,
    block_bytes: int = ITEM_BLOCK_BYTES,
) -> DataFrame:
    """One row per document: id, contaminated, coverage, the best item, its tiles and tiled words, and the ids of all items held.

    Words are runs of letters, digits and underscores in lower case. A document holds an item when tiles of at
    least `least_match` words, in any order, cover `least_coverage` of the item's words. Items shorter
    than that are matched as a whole; items without words never match. Texts that are null or empty
    have coverage 0 and no item. Rows with null or repeated ids are judged each by itself; an empty table gives
    no rows, an empty benchmark coverage 0; other columns are not read.
    """
    scan = scan_of(docs)
    rows = keyed(scan, F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = tiled(rows, benchmark, item_col, item_text_col, least_match, block_bytes, least_coverage)
    return found.select(
        F.col("id").alias(id_col), (F.size("items") > 0).alias("contaminated"), "coverage", F.col("item").alias(item_col), "tiles", "tiled_words", F.sort_array("items").alias("items")
    )


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least_match: int = LEAST_MATCH,
    least_coverage: float = COVERAGE,
    block_bytes: int = ITEM_BLOCK_BYTES,
) -> DataFrame:
    """The documents, all columns, that hold no test item; one pass for each block of the benchmark."""
    kept = docs
    for items in item_blocks(benchmark, item_col, item_text_col, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], items: list[tuple[object, str | None]] = items) -> Iterator[pa.RecordBatch]:
            index = Items(items, least_match)
            for batch in text_slices(batches, text_col):
                found = [index.best(t, least_coverage) for t in batch.column(text_col).to_pylist()]
                yield batch.filter(pa.array([not f[4] for f in found], pa.bool_()))

        kept = stage(kept, "tiling-kept") if kept is not docs else kept
        kept = kept.mapInArrow(run, docs.schema)
    return kept
