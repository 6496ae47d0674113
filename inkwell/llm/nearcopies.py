"""Near copies of documents: shingle sets that meet in a prefix, verified by Jaccard similarity."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from inkwell.llm.components import components
from inkwell.llm.frames import FILE, ROW, keyed, scan_of, without
from inkwell.llm.simhash import fingerprint, near_links, pigeonhole_masks, shingle_hashes
from inkwell.llm.words import text_slices
from inkwell.operators.skew import HOT_ROWS, join_unique, repeated, salted
from inkwell.session import stage

#: Eighths of the hash values that come first in the order of shingles, by their number of sets; the rest follow by hash.
FIRST_EIGHTHS = 2
#: Cells of a profile for each shingle of its set, the fewest cells and the bits of the most.
SHINGLE_CELLS, LEAST_CELLS, MOST_BITS = 8, 64, 15
#: Sets of a shingle that meet pair by pair; beyond it they meet in packs of PACK, by profile.
SMALL_GROUP = 32
PACK = 128
#: Columns of a matrix of a pack's shingles.
CELLS = 8192
HUB_PAIRS = 256
#: Fingerprints of sets that differ in at most so many bits are linked through the Gray-order index, before sets are compared.
RADIUS = 4


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def places(size: int, similarity: float) -> int:
    """Shingles of the prefix in which a set of this size meets every set of the similarity."""
    return size - math.ceil(size * similarity - 1e-9) + 1 if size else 0


def profile(hashes: np.ndarray) -> bytes:
    """Which of 2^k ranges of hash values, interleaved, hold shingles, a bit for each; empty when one holds 256 or more.

    Shingles in cells that another set leaves empty are not common to both, so a profile rules out pairs without their sets,
    and with several cells for each shingle few others stay.
    """
    cells = 1 << min(1 << MOST_BITS, max(LEAST_CELLS, SHINGLE_CELLS * len(hashes))).bit_length() - 1
    counts = np.bincount((hashes >> np.uint64(64 - MOST_BITS)).astype(np.int64) & (cells - 1), minlength=cells)
    return np.packbits(counts > 0).tobytes() if counts.max(initial=0) < 256 else b""


def offered(hashes: np.ndarray, similarity: float) -> tuple[np.ndarray, int]:
    """(shingles, how many of them come first): all those of the first part of the order, and of the rest what the prefix may reach."""
    first = (hashes & np.uint64(7)) < FIRST_EIGHTHS
    head = hashes[first]
    more = max(0, places(len(hashes), similarity) - len(head))
    return np.concatenate([head, hashes[~first][:more]]), len(head)


def described(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """`rows` with `text` replaced by size, digest, fingerprint and profile of its shingle set and the shingles that may be in its prefix."""
    others = [c for c in rows.columns if c != "text"]
    names = [*others, "size", "digest", "f0", "profile", "first", "shingles"]
    schema = ", ".join([f"`{c}` {t}" for c, t in rows.dtypes if c != "text"] + ["size long, digest binary, f0 long, profile binary, first long, shingles array<long>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            sizes, digests, codes, profiles, firsts, lists = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                hashes = shingle_set(text, words)
                own, first = offered(hashes, similarity)
                sizes.append(len(hashes))
                digests.append(hashlib.md5(hashes.tobytes()).digest())
                codes.append(fingerprint(hashes)[0])
                profiles.append(profile(hashes))
                firsts.append(first)
                lists.append(own.view(np.int64))
            ends = pa.array(np.cumsum([0, *map(len, lists)]).astype(np.int32))
            shingles = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(lists)))
            new = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(np.array(codes, np.int64)), pa.array(profiles, pa.binary()), pa.array(firsts, pa.int64()), shingles]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + new, names=names)

    return rows.mapInArrow(run, schema)


def prefixes(rows: DataFrame, again: DataFrame, similarity: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(shingle, node, size), staged: of each set the prefix in which any two sets of the similarity meet.

    Any fixed order of shingles loses no pair. Here those with small last bits come first, rarest first, so that stock
    passages are seldom in a prefix although the counts of a quarter of the shingles are all that is shuffled; the
    rest follow by hash. Shingles of a single set fill places but meet nothing, so they are left out. `again` names
    the nodes that repeat a set; they count but have no prefix.
    """
    each = rows.select("node", "first", F.posexplode("shingles").alias("at", "shingle")).select("shingle", "node", (F.col("at") >= F.col("first")).alias("rest"))
    shared = stage(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1"), "near-shared")
    # the counts tell which shingles are hot
    hot = shared.filter(F.col("sets") > hot_rows).select(F.xxhash64("shingle").alias("_hot_hash"), F.ceil(F.col("sets") / hot_rows).cast("int").alias("_salts"))
    if hot.isEmpty():
        met = each.join(shared, "shingle")
    else:
        met = salted(each, hot, ["shingle"]).join(repeated(shared, hot, ["shingle"]), ["shingle", "_salt"]).drop("_salt")
    own = met.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("rest", "sets", "shingle"))).alias("own"))
    own = own.join(rows.select("node", "size", "first"), "node")
    head, rest = F.filter("own", lambda x: ~x.getField("rest")), F.filter("own", lambda x: x.getField("rest"))
    most = F.least(F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1, F.col("first"))
    taken = F.greatest(most - (F.col("first") - F.size(head)), F.lit(0)).cast("int")
    chosen = own.select("node", "size", F.explode(F.concat(F.slice(head, F.lit(1), taken), rest)).alias("one")).select("one.shingle", "node", "size")
    chosen = stage(chosen, "near-prefix")
    if again.isEmpty():
        return chosen
    left = join_unique(chosen, again, "node", "left", hot_rows=hot_rows, stable_left=True)
    return stage(left.filter(F.col("again").isNull()).drop("again"), "near-prefix")


def most_common(sizes: np.ndarray, a: np.ndarray, other_sizes: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An upper bound of the common shingles of each set of a with each of b, profiles of equal width as 64-bit words."""
    both = np.stack([np.bitwise_count(row & b).sum(axis=1, dtype=np.int64) for row in a])
    spare, other_spare = (n - np.bitwise_count(x).sum(axis=1, dtype=np.int64) for n, x in ((sizes, a), (other_sizes, b)))
    return both + np.minimum(spare[:, None], other_spare[None, :])


def folded(profiles: list[bytes], width: int) -> np.ndarray:
    """Profiles of any widths as rows of `width` bytes, in 64-bit words."""
    return np.stack([np.bitwise_or.reduce(np.frombuffer(p, np.uint64).reshape(-1, width // 8), axis=0) for p in profiles])


def may_be_alike(sizes: np.ndarray, profiles: list[bytes], other_sizes: np.ndarray, other_profiles: list[bytes], similarity: float) -> np.ndarray:
    """The matrix of pairs that sizes and profiles do not rule out."""
    most = np.minimum(sizes[:, None], other_sizes[None, :])
    known, other_known = (np.array([len(p) > 0 for p in x], bool) for x in (profiles, other_profiles))
    if known.any() and other_known.any():
        width = min(len(p) for p in [*profiles, *other_profiles] if p)
        bound = most_common(sizes[known], folded([p for p in profiles if p], width), other_sizes[other_known], folded([p for p in other_profiles if p], width))
        at = np.ix_(known, other_known)
        most[at] = np.minimum(most[at], bound)
    return most >= similarity * (sizes[:, None] + other_sizes[None, :] - most) - 1e-9


def not_ruled_out(pairs: DataFrame, nodes: DataFrame, similarity: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The pairs (a, b) that sizes and profiles do not rule out, staged."""
    needed = stage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-needed")
    facts = stage(join_unique(nodes.select("node", "size", "profile"), needed, "node", "left_semi", hot_rows=hot_rows, stable_left=True), "near-facts")
    met = pairs
    for side in ("a", "b"):
        met = join_unique(met, facts.withColumnsRenamed({"node": side, "size": f"size_{side}", "profile": f"profile_{side}"}), side, hot_rows=hot_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("size_a", "profile_a", "size_b", "profile_b")]
            good = [
                n >= m * similarity - 1e-9 and m >= n * similarity - 1e-9 and bool(may_be_alike(np.array([n]), [p], np.array([m]), [q], similarity)[0, 0])
                for n, p, m, q in zip(*columns)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return stage(met.mapInArrow(run, "a long, b long"), "near-proposed")


def alike(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, similarity: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The staged pairs (a, b) whose shingle sets have at least this Jaccard similarity, staged.

    Only the texts of these pairs travel, compressed, which is a third of their sets. That of `a` is sent once for each
    HUB_PAIRS of its pairs, so a hub is neither copied for every member nor bound to one task.
    """
    needed = stage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-needed")
    wanted = stage(join_unique(nodes.select("node", FILE, ROW), needed, "node", "left_semi", hot_rows=hot_rows, stable_left=True), "near-wanted")
    met = join_unique(texts, wanted, [FILE, ROW], hot_rows=hot_rows, stable_left=True).select("node", "text")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in text_slices(batches, "text"):
            found = [packer.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], names=["node", "packed"])

    sent = stage(met.mapInArrow(packed, "node long, packed binary"), "near-compared")
    hubs = stage(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB_PAIRS).alias("parts")), "near-hubs")
    dealt = join_unique(pairs, hubs, "a", hot_rows=hot_rows, stable_left=True)
    dealt = stage(dealt.select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")), "near-dealt")
    left = dealt.join(sent.withColumnsRenamed({"node": "b", "packed": "of_b"}), "b")
    right = dealt.select("a", "part").distinct().join(sent.withColumnsRenamed({"node": "a", "packed": "of_a"}), "a")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor()
        unpacked = lambda packed: shingle_set(opened.decompress(packed).decode(), words)
        last, own = None, np.zeros(0, np.uint64)
        for whole in batches:
            for batch in text_slices(iter([whole]), "of_b", 1 << 20):
                good = []
                for a, of_a, of_b in zip(*(batch.column(c).to_pylist() for c in ("a", "of_a", "of_b"))):
                    if a != last:
                        last, own = a, unpacked(of_a)
                    other = unpacked(of_b)
                    common = len(np.intersect1d(own, other, assume_unique=True))
                    good.append(common >= (len(own) + len(other) - common) * similarity - 1e-9)
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = left.join(right, ["a", "part"]).select("a", "b", "of_a", "of_b")
    return stage(both.mapInArrow(compared, "a long, b long"), "near-links")


def across(placed: DataFrame, nodes: DataFrame, similarity: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs (a, b), staged, of different components that share a shingle of `placed` and are not ruled out.

    The sets of a rare shingle meet pair by pair; at most SMALL_GROUP of them, so pairs grow with the rows. The others
    meet in packs.
    """
    counts = stage(placed.groupBy("shingle").agg((F.count(F.lit(1)) > SMALL_GROUP).alias("many")), "near-group-sizes")
    placed = stage(join_unique(placed, counts, "shingle", hot_rows=hot_rows, stable_left=True), "near-groups")
    few = placed.filter(~F.col("many")).select("shingle", "node", "size", "component")
    other = few.select("shingle", *[F.col(c).alias(f"other_{c}") for c in ("node", "size", "component")])
    sizes = F.least("size", "other_size") >= F.greatest("size", "other_size") * similarity - 1e-9
    apart = (F.col("node") < F.col("other_node")) & (F.col("component") != F.col("other_component")) & sizes
    near = few.join(other, "shingle").filter(apart).select(F.col("node").alias("a"), F.col("other_node").alias("b")).distinct()
    near = not_ruled_out(stage(near, "near-met-apart"), nodes, similarity, hot_rows)
    many = stage(placed.filter("many").drop("many"), "near-large-groups")
    return near if many.isEmpty() else stage(near.union(in_packs(many, nodes, similarity, hot_rows)).distinct(), "near-proposed")


def met_before(lists: pa.ListArray, other_lists: pa.ListArray) -> np.ndarray:
    """The matrix of pairs whose lists have a shingle in common."""
    (ends, flat), (other_ends, other_flat) = ((x.offsets.to_numpy(), x.values.to_numpy()) for x in (lists, other_lists))
    flat, other_flat = flat[ends[0] : ends[-1]], other_flat[other_ends[0] : other_ends[-1]]
    common, found = np.intersect1d(flat, other_flat), np.zeros((len(lists), len(other_lists)), bool)
    for start in range(0, len(common), CELLS):
        part, held = common[start : start + CELLS], []
        for values, bounds in ((flat, ends), (other_flat, other_ends)):
            at = np.minimum(np.searchsorted(part, values), len(part) - 1)
            row, known = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), part[at] == values
            matrix = np.zeros((len(bounds) - 1, len(part)), np.float32)
            matrix[row[known], at[known]] = 1
            held.append(matrix)
        found |= held[0] @ held[1].T > 0
    return found


def in_packs(placed: DataFrame, nodes: DataFrame, similarity: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs (a, b) of different components that share a shingle of `placed` and are not ruled out.

    The sets of a shingle go in packs by size class, whose neighbours alone can be similar; two packs are compared at once by
    profiles, so no pair leaves the task that is ruled out. Sets that share several shingles are compared at the first of
    them alone: a set brings those of its shingles that come before.
    """
    level = F.floor(F.log("size") / math.log(1 / similarity)) if similarity < 1 else F.col("size")
    placed = stage(placed.withColumn("level", level), "near-levels")
    counts = stage(placed.groupBy("shingle", "level").agg(F.ceil(F.count(F.lit(1)) / PACK).alias("packs")), "near-packs")
    dealt = join_unique(placed, counts, ["shingle", "level"], hot_rows=hot_rows, stable_left=True)
    dealt = dealt.withColumn("pack", F.pmod(F.xxhash64("node"), F.col("packs"))).select("shingle", "level", "pack", "node", "component")
    lists = placed.groupBy("node").agg(F.sort_array(F.collect_set("shingle")).alias("all"))
    facts = stage(lists.join(nodes.select("node", "size", "profile"), "node"), "near-listed")
    full = join_unique(stage(dealt, "near-dealt"), facts, "node", hot_rows=hot_rows, stable_left=True)
    before = F.slice("all", F.lit(1), (F.array_position("all", F.col("shingle")) - 1).cast("int")).alias("before")
    packed = full.groupBy("shingle", "level", "pack").agg(F.collect_list(F.struct("node", "component", "size", "profile", before)).alias("own"))
    packed = stage(packed, "near-packed")
    other = packed.select("shingle", F.col("level").alias("other_level"), F.col("pack").alias("other_pack"), F.col("own").alias("others"))
    near = other.withColumn("level", F.explode(F.array("other_level", F.col("other_level") - 1)))
    once = (F.col("other_level") != F.col("level")) | (F.col("pack") <= F.col("other_pack"))
    met = packed.join(near, ["shingle", "level"]).filter(once).select("own", "others")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for at in range(batch.num_rows):  # two packs at a time are objects
                own, others = (batch.column(c)[at].values for c in ("own", "others"))
                node, other_node = (x.field("node").to_numpy() for x in (own, others))
                component, other_component = (x.field("component").to_numpy() for x in (own, others))
                if component.min() == component.max() == other_component.min() == other_component.max():
                    continue
                open_pairs = (component[:, None] != other_component[None, :]) & ~met_before(own.field("before"), others.field("before"))
                rows, columns = np.flatnonzero(open_pairs.any(axis=1)), np.flatnonzero(open_pairs.any(axis=0))
                if not len(rows):
                    continue
                sizes, other_sizes = own.field("size").to_numpy()[rows], others.field("size").to_numpy()[columns]
                profiles, other_profiles = (x.field("profile").take(pa.array(k)).to_pylist() for x, k in ((own, rows), (others, columns)))
                good = may_be_alike(sizes, profiles, other_sizes, other_profiles, similarity)
                i, j = np.nonzero(good & open_pairs[np.ix_(rows, columns)])
                i, j = rows[i], columns[j]
                a.append(np.minimum(node[i], other_node[j]))
                b.append(np.maximum(node[i], other_node[j]))
            if a:  # a pair of one pack comes both ways round
                pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def by_fingerprint(nodes: DataFrame, again: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs (a, b), staged, that link the sets whose fingerprints lie within RADIUS bits of each other, found in Gray order.

    Equal fingerprints are linked to their smallest node, the others as `near_links` spans them.
    """
    own = nodes.select("node", "f0")
    if not again.isEmpty():
        own = join_unique(own, again, "node", "left", hot_rows=hot_rows).filter(F.col("again").isNull()).drop("again")
    own = stage(own, "near-fingerprints")
    distinct = stage(own.groupBy("f0").agg(F.min("node").alias("low")), "near-distinct-fingerprints")
    equal = join_unique(own, distinct, "f0", hot_rows=hot_rows, stable_left=True).filter("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    close = near_links(distinct.withColumnRenamed("low", "node"), pigeonhole_masks(RADIUS), 1, RADIUS).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return stage(equal.union(close).filter("a <> b").distinct(), "near-by-fingerprint")


def similar_sets(nodes: DataFrame, again: DataFrame, texts: DataFrame, words: int, similarity: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, component), staged, of the distinct sets linked by a Jaccard similarity of at least `similarity`, every link verified.

    Sets are first linked by their fingerprints through the Gray-order index. That may miss pairs, so the sets that share a
    shingle of their prefixes and are in different components meet its smallest node next, one pair for each member, and
    then all pairs that are still in different components meet.
    """
    close = by_fingerprint(nodes, again, hot_rows)
    linked = alike(not_ruled_out(close, nodes, similarity, hot_rows), nodes, texts, words, similarity, hot_rows)
    early = stage(components(linked, hot_rows), "near-early-labels")
    prefix = prefixes(nodes, again, similarity, hot_rows)
    lows = stage(prefix.groupBy("shingle").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "near-lows")
    met = stage(join_unique(prefix, lows, "shingle", hot_rows=hot_rows, stable_left=True), "near-met")
    stars = stage(met.filter("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct(), "near-stars")
    for side in ("a", "b"):
        stars = join_unique(stars, early.withColumnsRenamed({"node": side, "component": f"of_{side}"}), side, "left", hot_rows=hot_rows)
    stars = stage(stars.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b"), "near-stars-apart")
    links = stage(linked.union(alike(not_ruled_out(stars, nodes, similarity, hot_rows), nodes, texts, words, similarity, hot_rows)), "near-verified")
    labels = stage(components(links, hot_rows), "near-labels")
    placed = join_unique(met.drop("low"), labels, "node", "left", hot_rows=hot_rows, stable_left=True)
    placed = stage(placed.select("shingle", "node", "size", F.coalesce("component", "node").alias("component")), "near-placed")
    apart = placed.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("shingle")
    left = join_unique(placed, stage(apart, "near-apart"), "shingle", hot_rows=hot_rows, stable_left=True)
    more = across(stage(left, "near-left"), nodes, similarity, hot_rows)
    return stage(components(links.union(alike(more, nodes, texts, words, similarity, hot_rows)), hot_rows), "near-labels")


def drop_near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    similarity: float = 0.8,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The documents, all columns, with one of each group of near copies: the smallest id, nulls last.

    Similarity is the Jaccard similarity of the sets of `words`-word shingles, held as 64-bit hashes. All pairs at
    `similarity` or more are linked and no others; a group is what links connect. Equal sets are one node.
    Rows without words are one group, as their sets are equal.
    """
    scan = scan_of(docs)
    text: Column = F.col(f"`{text_col}`").cast("string")
    whole = keyed(scan, F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"))
    rows = stage(described(whole, words, similarity).withColumn("node", F.monotonically_increasing_id()), "near-sets")
    lows = rows.groupBy("digest").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    own = rows.select("id", FILE, ROW, "digest", "node")
    joined = join_unique(own, stage(lows, "near-equal-lows"), "digest", "left", hot_rows=hot_rows, stable_left=True)
    own = stage(joined.select("id", FILE, ROW, F.coalesce("low", "node").alias("set"), "node"), "near-nodes")
    again = stage(own.filter(F.col("set") != F.col("node")).select("node", F.lit(True).alias("again")), "near-again")
    nodes = rows.filter(F.col("size") > 0)
    labels = similar_sets(nodes, again, keyed(scan, text.alias("text")), words, similarity, hot_rows).withColumnRenamed("node", "set")
    named = join_unique(own, labels, "set", "left", hot_rows=hot_rows, stable_left=True)
    found = stage(named.select("id", FILE, ROW, F.coalesce("component", "set").alias("component")), "near-found")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", FILE, ROW)
    groups = found.groupBy("component").agg(F.min(place).alias("stays"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = join_unique(found, stage(groups.select("component", "stays"), "near-stays"), "component", hot_rows=hot_rows, stable_left=True)
    dropped = met.filter((F.col(f"stays.{FILE}") != F.col(FILE)) | (F.col(f"stays.{ROW}") != F.col(ROW)))
    return without(scan, stage(dropped.select(FILE, ROW), "near-dropped"))
