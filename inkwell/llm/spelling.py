"""Spelling variants: words one edit apart, found through an index of variable-length grams."""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inkwell.llm.words import text_slices
from inkwell.operators.skew import HOT_ROWS, join_unique
from inkwell.session import stage

#: Of the runs whose checksum this divides, one code point is deleted.
DELETED_OF = 97
LEAST_LENGTH, LEAST_COUNT, LEAST_RATIO = 5, 3, 2
SHORTEST, LONGEST = 2, 5
#: A gram goes on being lengthened while it holds over one in so many of all places, so at most as many do at each length.
PLACES_PER_GRAM = 20_000
HELD_WORDS = 400_000
PART_BYTES = 1 << 20

#: Letters of the contract to themselves, A-Z in lower case, all other bytes of Latin-1 to a space.
LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256)
)


def utf8(word: bytes) -> bytes:
    return word if word.isascii() else word.decode("latin-1").encode()


def runs(text: str | None) -> Iterator[list[bytes]]:
    """The maximal runs `[A-Za-z\\u00C0-\\u00FF]+` of a whole text in Latin-1, A-Z in lower case, part by part."""
    raw = (text or "").encode("latin-1", "replace").translate(LETTERS)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PART_BYTES)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def add_words(counts: Counter, doc_id: object, text: str | None, least_length: int) -> None:
    """Count the words of a text, after the deletions."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for part in runs(text):
        for run, n in Counter(part).items():
            h = zlib.crc32(utf8(run), start)
            if h % DELETED_OF == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least_length:
                counts[run] += n


def word_counts(docs: DataFrame, id_col: str, text_col: str, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n) over the whole corpus; tasks send sums of what they hold, and hold a bounded number of words."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def sent(counts: Counter) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in counts], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in text_slices(batches, "text"):
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                add_words(counts, doc_id, text, least_length)
            if len(counts) > HELD_WORDS:
                yield sent(counts)
                counts = Counter()
        yield sent(counts)

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_grams(words: DataFrame) -> frozenset[str]:
    """The grams that are lengthened: those at more than one in PLACES_PER_GRAM of the places of all words.

    At most PLACES_PER_GRAM for each of LONGEST - SHORTEST lengths, whatever the corpus, so the driver and the tasks hold them.
    """
    places = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    sizes = F.array(*[F.lit(k) for k in range(SHORTEST, LONGEST)])
    each = words.select(F.concat(F.lit("^"), "word", F.lit("$")).alias("padded"), F.explode(sizes).alias("size"))
    each = each.filter(F.length("padded") >= F.col("size"))
    starts = F.sequence(F.lit(1), F.length("padded") - F.col("size") + 1)
    grams = each.select(F.explode(F.transform(starts, lambda p: F.substring(F.col("padded"), p, F.col("size")))).alias("gram"))
    counted = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("places"))
    return frozenset(r["gram"] for r in counted.filter(F.col("places") > max(1, places // PLACES_PER_GRAM)).select("gram").collect())


def decomposed(word: str, frequent: frozenset[str]) -> list[int]:
    """The length of the gram at each place of `^word$`: as short as can be, lengthened while it is a frequent one."""
    padded = f"^{word}$"
    sizes = []
    for p in range(len(padded) - SHORTEST + 1):
        size = SHORTEST
        while size < LONGEST and p + size < len(padded) and padded[p : p + size] in frequent:
            size += 1
        sizes.append(size)
    return sizes


def most_affected(sizes: list[int]) -> int:
    """The most grams that one edit can change: those that hold the edited place or reach over the gap of an insertion.

    A gram's length depends on its own letters alone, so no other gram changes.
    """
    steps = [0] * (len(sizes) + LONGEST + 1)
    for p, size in enumerate(sizes):
        steps[p] += 1
        steps[p + size] -= 1
    # place 0 is the opening mark and the last one the closing mark; a gap inside a gram is less than a place
    return max(itertools.islice(itertools.accumulate(steps), 1, len(sizes)))


def postings(words: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(word, n, length, side, anchor): the index entries through which any two words one edit apart meet.

    Of a word with G grams an edit leaves G - A, A the most it can affect; both words keep these. So the A + 1 rarest
    grams of each hold the rarest one that both keep. The edit lies after that gram or before it, so the words agree up to
    its end or from its start on: that stretch is the entry's anchor, as a hash.
    """
    frequent = frequent_grams(words)
    schema = "word string, n long, place int, size int, gram string, taken int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                sizes, padded = decomposed(word, frequent), f"^{word}$"
                taken = most_affected(sizes) + 1
                for p, size in enumerate(sizes):
                    for column, value in zip(rows, (word, n, p, size, padded[p : p + size], taken)):
                        column.append(value)
                if len(rows[0]) > 100_000:
                    yield entries(rows)
                    rows = ([], [], [], [], [], [])
            yield entries(rows)

    def entries(rows: tuple[list, ...]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds)], names=["word", "n", "place", "size", "gram", "taken"])

    grams = stage(words.mapInArrow(run, schema), "spelling-grams")
    counts = stage(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("places")), "spelling-gram-counts")
    met = join_unique(grams, counts, "gram", hot_rows=hot_rows, stable_left=True)
    own = met.groupBy("word", "n", "taken").agg(F.sort_array(F.collect_list(F.struct("places", "gram", "place", "size"))).alias("own"))
    chosen = own.select("word", "n", F.inline(F.slice("own", F.lit(1), F.col("taken"))))
    padded, end = F.concat(F.lit("^"), "word", F.lit("$")), F.col("place") + F.col("size")
    before = F.when(end < F.length(padded), F.struct(F.lit(0).alias("side"), F.xxhash64(F.substring(padded, F.lit(1), end)).alias("anchor")))
    after = F.when(F.col("place") > 0, F.struct(F.lit(1).alias("side"), F.xxhash64(F.substring(padded, F.col("place") + 1, F.length(padded))).alias("anchor")))
    found = chosen.select("word", "n", F.length("word").alias("length"), F.explode(F.array(before, after)).alias("at"))
    return found.filter(F.col("at").isNotNull()).select("word", "n", "length", "at.side", "at.anchor").distinct()


def near_pairs(words: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(a, n_a, b, n_b), staged: each two words that differ by one inserted, deleted or replaced code point, once."""
    entries = stage(postings(words, hot_rows), "spelling-postings")
    own = entries.select("side", "anchor", "length", F.col("word").alias("a"), F.col("n").alias("n_a"))
    same = entries.select("side", "anchor", "length", F.col("word").alias("b"), F.col("n").alias("n_b"), F.lit(True).alias("equal"))
    shorter = same.select("side", "anchor", (F.col("length") + 1).alias("length"), "b", "n_b", F.lit(False).alias("equal"))
    other = same.union(shorter)
    keys = [own[c] == other[c] for c in ("side", "anchor", "length")]
    once = ~other["equal"] | (own["a"] < other["b"])
    pairs = own.join(other, [*keys, once, F.levenshtein(own["a"], other["b"], 1) == 1])
    return stage(pairs.select("a", "n_a", "b", "n_b").distinct(), "spelling-pairs")


def with_roots(words: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Words (word, form, ...) with `root`, the last of the forms.

    Each round replaces every root by the root of it. Counts at least double with each form, so a chain has as many
    links as the largest count has bits, and rounds grow with the logarithm of that.
    """
    known = stage(words.select("word", F.coalesce("form", "word").alias("root")), "spelling-roots")
    while True:
        nexts = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stage(join_unique(known, nexts, "root", hot_rows=hot_rows, stable_left=True), "spelling-roots")
        known = moved.select("word", F.col("next").alias("root"))
        if moved.filter("root <> next").isEmpty():
            return join_unique(words, known, "word", hot_rows=hot_rows, stable_left=True)


def spelling_forms(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    least_ratio: int = LEAST_RATIO,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per word of the corpus: word, form, root (string); n, n_near, form_n (long).

    Words are runs of Latin letters, A-Z in lower case, some of them with a code point deleted as the contract says, of
    `least_length` code points and `least_count` occurrences or more; `least_length` must not be below LONGEST, so that some
    gram always escapes an edit. A word's form is its near word of largest n (ties: smallest) when that n is at least
    `least_ratio` times its own, else null. Null and empty texts have no words, a null id counts as an empty one, repeated rows
    count each; texts of any length are read in parts. Empty tables give no rows; other columns are not read.
    """
    if least_length < LONGEST:
        raise ValueError(f"words of fewer than {LONGEST} code points may keep no gram")
    counted = word_counts(docs, id_col, text_col, least_length)
    words = stage(counted.filter(F.col("n") >= least_count), "spelling-words")
    pairs = near_pairs(words, hot_rows)
    sides = pairs.union(pairs.select("b", "n_b", "a", "n_a")).toDF("word", "n", "b", "n_b")
    best = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("m"), "b")).alias("best"))
    best = stage(best.select("word", "n_near", F.col("best.b").alias("b"), (-F.col("best.m")).alias("n_b")), "spelling-best")
    met = join_unique(words, best, "word", "left", hot_rows=hot_rows, stable_left=True)
    taken = F.col("n_b") >= F.col("n") * least_ratio
    forms = met.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("b")).alias("form"), F.when(taken, F.col("n_b")).alias("form_n")
    )
    return with_roots(stage(forms, "spelling-forms"), hot_rows).select("word", "form", "root", "n", "n_near", "form_n")
