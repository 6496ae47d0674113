"""Substring dedup: word windows that occur more than once anywhere are removed, found by recompression."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from inkwell.llm.frames import FILE, ROW, keyed, scan_of
from inkwell.llm.recompress import Symbols, created, window_names, word_names
from inkwell.llm.words import text_slices, word_blocks
from inkwell.operators.skew import HOT_ROWS, join_unique
from inkwell.session import stage

#: Words of the shortest symbol that is counted.
LEAST_WORDS = 4
CHUNK_WORDS = 1 << 17
KEYS = ["file", "row"]


class Block(NamedTuple):
    """Chunks of several texts: their words, and for each chunk its text, first place, fresh words' first place and size."""

    words: list[bytes]
    text: np.ndarray
    base: np.ndarray
    fresh: np.ndarray
    size: np.ndarray

    def chunk(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.size)), self.size)

    def place(self) -> np.ndarray:
        starts = np.cumsum(self.size) - self.size
        return np.arange(len(self.words)) - np.repeat(starts - self.base, self.size)


def blocks(texts: list[str | None], window: int, asked: list[np.ndarray] | None = None) -> Iterator[Block]:
    """Texts in chunks that overlap by window - 1 words, many chunks in a block; each window lies in one chunk only as a whole with a fresh last word.

    With `asked`, the (first, last) ranges of windows of each text, only the stretches of these windows, each a chunk.
    """
    words: list[bytes] = []
    rows: list[tuple[int, int, int, int]] = []
    for number, text in enumerate(texts):
        carried, seen = [], 0
        for block in word_blocks(text, lower=False):
            for at in range(0, len(block), CHUNK_WORDS):
                part = block[at : at + CHUNK_WORDS]
                whole, base = carried + part, seen - len(carried)
                if asked is None:
                    words += whole
                    rows.append((number, base, seen, len(whole)))
                else:
                    end = base + len(whole) - window
                    low = np.searchsorted(asked[number][:, 1], base)
                    high = np.searchsorted(asked[number][:, 0], end, "right")
                    for first, last in asked[number][low:high].tolist():
                        first, last = max(first, base), min(last, end)
                        words += whole[first - base : last - base + window]
                        rows.append((number, first, first, last - first + window))
                seen += len(part)
                carried = whole[len(whole) - window + 1 :] if len(whole) >= window else whole
                if len(words) >= CHUNK_WORDS:
                    yield Block(words, *np.array(rows).T)
                    words, rows = [], []
    if rows:
        yield Block(words, *np.array(rows).T)


def _column(values: list[np.ndarray], kind: type = np.int64) -> np.ndarray:
    return np.concatenate(values) if values else np.zeros(0, kind)


def deciding(block: Block, window: int) -> Iterator[tuple[np.ndarray, Symbols]]:
    """(text, symbols) of at least LEAST_WORDS words whose names are decided inside one window."""
    names = word_names(block.words, 1)
    for found in created(names, block.chunk(), block.place(), within=window):
        good = (found.end - found.start >= LEAST_WORDS) & (found.high - found.low <= window) & (found.high > block.fresh[found.chunk])
        if good.any():
            found = found.take(np.flatnonzero(good))
            yield block.text[found.chunk], found


def long_symbols(block: Block, names: list[np.ndarray], window: int) -> Iterator[tuple[np.ndarray, Symbols]]:
    """(text, symbols) of at least a whole window."""
    for found in created(names, block.chunk(), block.place()):
        good = found.end - found.start >= window
        if good.any():
            found = found.take(np.flatnonzero(good))
            yield block.text[found.chunk], found


def marked(ranges: np.ndarray, size: int) -> np.ndarray:
    """Places inside any of the (first, last) ranges; both ends belong to it."""
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, np.clip(ranges[:, 0], 0, size), 1)
    np.add.at(steps, np.clip(ranges[:, 1] + 1, 0, size), -1)
    return np.cumsum(steps[:-1]) > 0


def ranges_of(marks: np.ndarray) -> np.ndarray:
    """The (first, last) ranges of true places."""
    edges = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1], axis=1)


def _rows(batch: pa.RecordBatch, columns: dict[str, list[np.ndarray]], owner: list[np.ndarray]) -> pa.RecordBatch:
    """The keys of each row's text beside the columns."""
    index = pa.array(_column(owner))
    return pa.RecordBatch.from_arrays(
        [batch.column(c).take(index) for c in KEYS] + [pa.array(_column(v)) for v in columns.values()], names=[*KEYS, *columns]
    )


def rare_symbols(rows: DataFrame, window: int) -> DataFrame:
    """(file, row, name, spot) of the symbols decided inside a window, and one row (name null, spot = words) for each text.

    `spot` packs the first window that holds all deciding words with the number of such windows, less one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            sizes = np.zeros(len(texts), np.int64)
            for block in blocks(texts, window):
                np.maximum.at(sizes, block.text, block.base + block.size)
                owner, columns = [], {"name": [], "spot": []}
                for text, found in deciding(block, window):
                    first = np.maximum(found.high - window, 0)
                    owner.append(text)
                    columns["name"].append(found.names[0].view(np.int64))
                    columns["spot"].append(first * 64 + (found.low - first))
                if owner:
                    yield _rows(batch, columns, owner)
            index = np.arange(len(texts))
            whole = _rows(batch, {"spot": [sizes]}, [index])
            yield pa.RecordBatch.from_arrays([*whole.columns[:2], pa.nulls(len(texts), pa.int64()), whole.column(2)], names=[*KEYS, "name", "spot"])

    return rows.mapInArrow(run, "file long, row long, name long, spot long")


def open_windows(symbols: DataFrame, window: int) -> DataFrame:
    """(file, row, windows) of the texts with windows that no unique symbol settles; `windows` holds (first, last) ranges.

    A symbol found once in the corpus cannot lie inside a window found twice. Names are counted with partial sums per
    task, and a name that is counted once carries its own place, so nothing is joined by name.
    """
    own = [F.when(F.col("name").isNull(), F.col(k)).alias(f"own_{k}") for k in KEYS]
    counted = symbols.groupBy("name", *own).agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in (*KEYS, "spot")])
    single = counted.filter("n = 1")
    size = F.max(F.when(F.col("name").isNull(), F.col("spot"))).alias("words")
    spots = F.collect_list(F.when(F.col("name").isNotNull(), F.col("spot"))).alias("spots")
    texts = single.groupBy(*KEYS).agg(size, spots).filter(F.col("words") >= window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            offsets, flat = batch.column("spots").offsets.to_numpy(), batch.column("spots").values.to_numpy()
            for k, words in enumerate(batch.column("words").to_pylist()):
                spots = flat[offsets[k] : offsets[k + 1]]
                settled = marked(np.stack([spots >> 6, (spots >> 6) + (spots & 63)], axis=1), words - window + 1)
                found.append(ranges_of(~settled).ravel())
            yield _with_ranges(batch, found, "windows")

    return texts.mapInArrow(run, "file long, row long, windows array<long>").filter(F.size("windows") > 0)


def _with_ranges(batch: pa.RecordBatch, found: list[np.ndarray], name: str) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(_column(found).astype(np.int64)))
    return pa.RecordBatch.from_arrays([batch.column(c) for c in KEYS] + [lists], names=[*KEYS, name])


def _open_ranges(batch: pa.RecordBatch, column: str = "windows") -> list[np.ndarray]:
    return [np.array(r or [], np.int64).reshape(-1, 2) for r in batch.column(column).to_pylist()]


def shared_symbols(rows: DataFrame, window: int) -> DataFrame:
    """(file, row, firsts) of each distinct symbol of a window or more in the stretches of open windows: where it stands first.

    `firsts` holds (start, end, whether it stands elsewhere too) in a row. Whoever is not among the firsts repeats one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            for block in blocks(batch.column("text").to_pylist(), window, _open_ranges(batch)):
                owner, columns = [], {c: [] for c in ("name", "more", "start", "end")}
                for text, found in long_symbols(block, word_names(block.words, 2), window):
                    owner.append(text)
                    values = (found.names[0].view(np.int64), found.names[1].view(np.int64), found.start, found.end)
                    for c, value in zip(columns, values):
                        columns[c].append(value)
                if owner:
                    yield _rows(batch, columns, owner)

    symbols = rows.mapInArrow(run, "file long, row long, name long, more long, start long, end long")
    place = F.struct(*KEYS, "start", "end")
    firsts = symbols.groupBy("name", "more").agg(F.min(place).alias("p"), F.count(F.lit(1)).alias("n"))
    entry = F.array("p.start", "p.end", (F.col("n") > 1).cast("long"))
    return firsts.groupBy("p.file", "p.row").agg(F.flatten(F.collect_list(entry)).alias("firsts"))


def named_windows(rows: DataFrame, window: int) -> DataFrame:
    """(file, row, name, more, place, weight) of the open windows, those inside a repeated long symbol at its first place only.

    There they weigh 2, as they are known to repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            ranges = _open_ranges(batch)
            sizes = [int(r[-1, 1]) + 1 if len(r) else 0 for r in ranges]
            firsts = [np.array(f or [], np.int64).reshape(-1, 3) for f in batch.column("firsts").to_pylist()]
            known = [{(s, e) for s, e, _ in f.tolist()} for f in firsts]
            doubled = [marked(np.stack([f[:, 0], f[:, 1] - window], axis=1)[f[:, 2] > 0], n) for f, n in zip(firsts, sizes)]
            for block in blocks(batch.column("text").to_pylist(), window, ranges):
                names = word_names(block.words, 2)
                again: dict[int, list[tuple[int, int]]] = {}
                for text, found in long_symbols(block, names, window):
                    for t, s, e in zip(text.tolist(), found.start.tolist(), found.end.tolist()):
                        if (s, e) not in known[t]:
                            again.setdefault(t, []).append((s, e - window))
                owner, columns = [], {c: [] for c in ("name", "more", "place", "weight")}
                chunk_starts = np.cumsum(block.size) - block.size
                for t, base, at, size in zip(block.text.tolist(), block.base.tolist(), chunk_starts.tolist(), block.size.tolist()):
                    n = size - window + 1
                    places = np.flatnonzero(~marked(np.array(again[t]) - base, n)) if t in again else np.arange(n)
                    if not len(places):
                        continue
                    lanes = window_names([x[at : at + n + window - 1] for x in names], window)
                    owner.append(np.full(len(places), t))
                    values = (lanes[0][places].view(np.int64), lanes[1][places].view(np.int64), places + base, 1 + doubled[t][places + base].astype(np.int64))
                    for name, value in zip(columns, values):
                        columns[name].append(value)
                if owner:
                    yield _rows(batch, columns, owner)

    return rows.mapInArrow(run, "file long, row long, name long, more long, place long, weight long")


def repeated_windows(scan: DataFrame, text: Column, window: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(file, row, windows), staged: the (first, last) ranges of windows of each text that occur anywhere else too."""
    rows = texts_of(scan, text)
    still = stage(open_windows(rare_symbols(rows, window), window), "substring-open")
    meet = lambda side: join_unique(rows, side, KEYS, hot_rows=hot_rows, stable_left=True)
    firsts = stage(shared_symbols(meet(still), window), "substring-firsts")
    asked = stage(join_unique(still, firsts, KEYS, "left", hot_rows=hot_rows, stable_left=True), "substring-asked")
    counted = named_windows(meet(asked), window).groupBy("name", "more").agg(
        F.sum("weight").alias("n"), *[F.min(c).alias(c) for c in (*KEYS, "place")]
    )
    single = stage(counted.filter("n = 1").groupBy(*KEYS).agg(F.collect_list("place").alias("single")), "substring-single")
    both = join_unique(still, single, KEYS, "left", hot_rows=hot_rows, stable_left=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for ranges, single in zip(_open_ranges(batch), batch.column("single").to_pylist()):
                marks = marked(ranges, int(ranges[:, 1].max()) + 1)
                marks[np.array(single or [], np.int64)] = False
                found.append(ranges_of(marks).ravel())
            yield _with_ranges(batch, found, "windows")

    return stage(both.mapInArrow(run, "file long, row long, windows array<long>").filter(F.size("windows") > 0), "substring-repeats")


def texts_of(scan: DataFrame, text: Column, *others: Column) -> DataFrame:
    """(file, row, text) with a file as the 64-bit hash of its path; further columns besides."""
    rows = keyed(scan, text.cast("string").alias("text"), *others)
    return rows.select(F.xxhash64(FILE).alias("file"), F.col(ROW).alias("row"), "text", *[c for c in rows.columns if c not in (FILE, ROW, "text")])


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept (the words left, joined by one space).

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A word goes when a window of `window` consecutive words covers it whose
    sequence also starts anywhere else, in the same document or another; windows are judged on the input alone, so every copy goes.
    Null and empty texts have no words; shorter ones than a window lose none. Repeated rows are documents of their
    own, so their windows repeat; null and repeated ids are kept as they are. Texts of any length are read in chunks of
    bounded size. An empty table gives no rows; other columns are not read.
    """
    scan = scan_of(docs)
    text = F.col(f"`{text_col}`")
    repeats = repeated_windows(scan, text, window, hot_rows)
    rows = texts_of(scan, text, F.col(f"`{id_col}`").alias("id"))
    id_type = dict(rows.dtypes)["id"]
    met = join_unique(rows, repeats, KEYS, "left", hot_rows=hot_rows, stable_left=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            n_words, n_removed, kept = [], [], []
            for text, ranges in zip(batch.column("text").to_pylist(), _open_ranges(batch)):
                words = [w for block in word_blocks(text, lower=False) for w in block]
                left = words
                if len(ranges):
                    gone = marked(ranges + np.array([0, window - 1]), len(words))
                    left = [words[k] for k in np.flatnonzero(~gone)]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            columns = [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "n_removed", "kept"])

    found = met.mapInArrow(run, f"id {id_type}, n_words long, n_removed long, kept string")
    return found.withColumnRenamed("id", id_col)
