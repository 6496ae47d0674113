"""SimHash fingerprints linked through a hierarchical index in Gray order."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from inkwell.llm.components import components
from inkwell.llm.hamming import SMALL_RUN, Forest, close_pairs, run_pairs
from inkwell.llm.words import text_slices, word_blocks
from inkwell.operators.skew import HOT_ROWS, join_unique
from inkwell.session import stage

#: The seed of the shingle hash.
SEED = 42
CHUNK = 2048
PAIRS_PER_TASK = 64


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every run of `words` words, joined by spaces; of the whole sequence when it is shorter."""
    parts, carried = [], []
    for block in word_blocks(text):
        run = carried + block
        if len(run) >= words:
            shingles = map(b" ".join, zip(*(run[k:] for k in range(words))))
            parts.append(b"".join([xxhash.xxh64_digest(s, SEED) for s in shingles]))
        carried = run[len(run) - words + 1 :] if len(run) >= words else run
    if not parts and carried:
        parts.append(xxhash.xxh64_digest(b" ".join(carried), SEED))
    return np.frombuffer(b"".join(parts), ">u8").astype(np.uint64)


def remixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64-bit word of a wider hash; word 0 is the hash itself."""
    if k == 0:
        return hashes
    z = hashes + np.uint64((0x9E3779B97F4A7C15 * k) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(hashes: np.ndarray, width: int = 1) -> list[int]:
    """`width` words whose bits are 1 when set in over half of the hashes; zero without hashes."""
    result = []
    for k in range(width):
        counts = np.zeros(64, np.int64)
        mixed = remixed(hashes, k)
        for start in range(0, len(mixed), 1 << 16):
            bits = np.unpackbits(mixed[start : start + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            counts += bits.sum(axis=0, dtype=np.int32)
        result.append(int(np.packbits(2 * counts > len(mixed)).view(">i8")[0]))
    return result


def fingerprints(rows: DataFrame, words: int, width: int, distinct: bool) -> DataFrame:
    """`rows` with `text` replaced by the fingerprint words f0, f1, ... (long)."""
    others = [c for c in rows.columns if c != "text"]
    schema = ", ".join([f"`{c}` {t}" for c, t in rows.dtypes if c != "text"] + [f"f{k} long" for k in range(width)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            found = []
            for text in batch.column("text").to_pylist():
                hashes = shingle_hashes(text, words)
                found.append(fingerprint(np.unique(hashes) if distinct else hashes, width))
            codes = np.array(found, np.int64).reshape(-1, width)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in others] + [pa.array(codes[:, k]) for k in range(width)],
                names=others + [f"f{k}" for k in range(width)],
            )

    return rows.mapInArrow(run, schema)


def pigeonhole_masks(radius: int, blocks: int | None = None) -> list[list[int]]:
    """Masks over 64 bits of which two fingerprints within `radius` agree on at least one.

    The bits are cut into `blocks` (radius + 1 at least); radius many differences leave
    blocks - radius of them untouched, so every choice of that many is a mask. More blocks mean more
    copies of each fingerprint and smaller buckets: take one more for each 2^13-fold corpus beyond 10^8.
    """
    blocks = blocks or radius + 1
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [[sum(chosen)] for chosen in itertools.combinations(parts, blocks - radius)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _gray(code: Column) -> Column:
    """The rank in Gray order, high bits first; the sign bit is flipped so that ranks sort as unsigned."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def candidates(distinct: DataFrame, masks: list[list[int]], width: int) -> DataFrame:
    """Each fingerprint once per mask, sorted by bucket and Gray rank, with no bucket bound to one task.

    A range shuffle cuts large buckets between tasks.
    """
    words = [F.col(f"f{k}") for k in range(width)]
    keys = [
        F.xxhash64(F.lit(t), *[w.bitwiseAND(F.lit(_signed(m))) for w, m in zip(words, mask) if m]) for t, mask in enumerate(masks)
    ]
    spread = distinct.select(F.explode(F.array(*keys)).alias("bucket"), "node", *words)
    order = ["bucket", *[_gray(w) for w in words]]
    return spread.repartitionByRange(*order).sortWithinPartitions(*order)


LINKS = "a long, b long, bucket long, chunk long, low array<long>, high array<long>, nodes binary, codes binary"


def _links(batches: Iterator[pa.RecordBatch], width: int, radius: int) -> Iterator[pa.RecordBatch]:
    """Links inside each chunk of a bucket as member and root, and the chunks whose bucket goes on elsewhere.

    Input is sorted by bucket and Gray rank. Short buckets are compared many at once; long ones are
    cut into chunks, each searched through its tree. Memory holds one batch and one chunk.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bucket", pa.int64()), ("chunk", pa.int64()), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64())), ("nodes", pa.binary()), ("codes", pa.binary())])
    task = TaskContext.get().partitionId() << 32
    state = {"chunk": 0, "first": True}

    def found(nodes: np.ndarray, forest: Forest) -> Iterator[pa.RecordBatch]:
        member, root = forest.edges()
        if len(member):
            rest = [pa.nulls(len(member), schema.field(c).type) for c in schema.names[2:]]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[member]), pa.array(nodes[root]), *rest], schema=schema)

    def long_run(bucket: int, nodes: np.ndarray, codes: np.ndarray, is_open: bool) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(nodes), CHUNK):
            own, part = nodes[start : start + CHUNK], codes[start : start + CHUNK]
            forest = Forest(len(own))
            for i, j in close_pairs(part, None, radius):
                forest.link(i, j)
            yield from found(own, forest)
            if is_open or len(nodes) > CHUNK:
                state["chunk"] += 1
                low, high = np.bitwise_and.reduce(part).view(np.int64), np.bitwise_or.reduce(part).view(np.int64)
                row = {"bucket": bucket, "chunk": task + state["chunk"], "low": low.tolist(), "high": high.tolist(), "nodes": own.tobytes(), "codes": part.tobytes()}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    def whole_runs(buckets: np.ndarray, nodes: np.ndarray, codes: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.diff(buckets)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(buckets)]])
        is_long = ends - starts > SMALL_RUN
        is_long[0] |= state["first"]
        is_long[-1] |= last
        for k in np.flatnonzero(is_long):
            is_open = (k == 0 and state["first"]) or (k == len(starts) - 1 and last)
            yield from long_run(int(buckets[starts[k]]), nodes[starts[k] : ends[k]], codes[starts[k] : ends[k]], is_open)
        state["first"] = False
        short = np.repeat(~is_long, ends - starts)
        if short.any():
            forest = Forest(int(short.sum()))
            for i, j in run_pairs(buckets[short], codes[short], radius):
                forest.link(i, j)
            yield from found(nodes[short], forest)

    held = None
    for batch in batches:
        new = (
            batch.column("bucket").to_numpy(),
            batch.column("node").to_numpy(),
            np.stack([batch.column(f"f{k}").to_numpy().view(np.uint64) for k in range(width)], axis=1),
        )
        held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new))
        if not len(held[0]):
            continue
        end = int(np.searchsorted(held[0], held[0][-1]))
        if end:
            yield from whole_runs(*(x[:end] for x in held), last=False)
            held = tuple(x[end:] for x in held)
        while len(held[0]) > CHUNK:  # a bucket larger than a batch goes out in chunks, all marked as going on
            yield from long_run(int(held[0][0]), held[1][:CHUNK], held[2][:CHUNK], True)
            held, state["first"] = tuple(x[CHUNK:] for x in held), True
    if held is not None and len(held[0]):
        yield from whole_runs(*held, last=True)


def _cross_links(batches: Iterator[pa.RecordBatch], width: int, radius: int) -> Iterator[pa.RecordBatch]:
    """Links between two chunks of one bucket, as member and root."""
    for batch in batches:
        for row in batch.to_pylist():
            a, b = (np.frombuffer(row[c], np.uint64).reshape(-1, width) for c in ("codes", "other_codes"))
            nodes = np.concatenate([np.frombuffer(row[c], np.int64) for c in ("nodes", "other_nodes")])
            forest = Forest(len(nodes))
            for i, j in close_pairs(a, b, radius):
                forest.link(i, j + len(a))
            member, root = forest.edges()
            if len(member):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[member]), pa.array(nodes[root])], names=["a", "b"])


def near_links(distinct: DataFrame, masks: list[list[int]], width: int, radius: int) -> DataFrame:
    """(a, b): a spanning set of the links between nodes within `radius` bits that share a bucket.

    Chunks of a bucket that spans several meet through one row each, their shared pattern; pairs of
    chunks whose patterns differ in more bits than the radius are pruned whole.
    """
    spread = candidates(distinct, masks, width)
    found = stage(spread.mapInArrow(lambda batches: _links(batches, width, radius), LINKS), "simhash-links")
    chunks = found.filter(F.col("chunk").isNotNull())
    nodes = chunks.select("bucket", "chunk", "low", "high")
    other = nodes.select("bucket", *[F.col(c).alias(f"other_{c}") for c in ("chunk", "low", "high")])
    apart = F.lit(0)
    for k in range(width):
        low, high, low2, high2 = (F.col(c)[k] for c in ("low", "high", "other_low", "other_high"))
        shared = F.bitwise_not(low.bitwiseXOR(high)).bitwiseAND(F.bitwise_not(low2.bitwiseXOR(high2)))
        apart = apart + F.bit_count(low.bitwiseXOR(low2).bitwiseAND(shared))
    pairs = nodes.join(other, "bucket").filter((F.col("chunk") < F.col("other_chunk")) & (apart <= radius)).select("chunk", "other_chunk")
    pairs = stage(pairs, "simhash-chunk-pairs")
    first = chunks.select("chunk", "nodes", "codes")
    second = chunks.select(F.col("chunk").alias("other_chunk"), F.col("nodes").alias("other_nodes"), F.col("codes").alias("other_codes"))
    met = pairs.join(first, "chunk").join(second, "other_chunk").repartition(1 + pairs.count() // PAIRS_PER_TASK)
    crossing = met.mapInArrow(lambda batches: _cross_links(batches, width, radius), "a long, b long")
    return found.filter(F.col("chunk").isNull()).select("a", "b").union(crossing)


def grouped(rows: DataFrame, masks: list[list[int]], width: int, radius: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Staged rows (id, f0, ...) with `component` (a node) and `component_id` (its smallest id).

    Equal fingerprints become one node first, so copies never meet in pairs.
    """
    words = [f"f{k}" for k in range(width)]
    distinct = rows.groupBy(*words).agg(F.min("id").alias("low")).withColumn("node", F.monotonically_increasing_id())
    distinct = stage(distinct, "simhash-nodes")
    labels = stage(components(near_links(distinct, masks, width, radius), hot_rows), "simhash-labels")
    linked = stage(distinct.join(labels, "node"), "simhash-linked")
    lows = stage(linked.groupBy("component").agg(F.min("low").alias("component_id")), "simhash-lows")
    named = join_unique(linked, lows, "component", hot_rows=hot_rows, stable_left=True).select("node", "component", "component_id")
    whole = distinct.join(named, "node", "left").select(
        *words,
        F.coalesce("component", "node").alias("component"),
        F.when(F.col("component").isNull(), F.col("low")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return join_unique(rows, stage(whole, "simhash-whole"), words, hot_rows=hot_rows, stable_left=True)


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, blocks: int | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id reachable).

    64-bit fingerprints over all runs of `words` words, repeats included; fingerprints within
    `radius` bits are linked, exactly. Null and empty texts have the fingerprint zero, linked like any
    other. Rows with equal ids are rows of their own; null ids never name a component unless all its
    ids are null. An empty table gives no rows; other columns are not read.
    """
    read = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = stage(fingerprints(read, words, 1, distinct=False), "simhash-rows")
    found = grouped(rows, pigeonhole_masks(radius, blocks), 1, radius, hot_rows)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
