"""Text scores by a word count model and by a causal self-attention model over subword ids."""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from inkwell.llm.attention import BEGIN, BLOCK, CLASSES, SIZE, Scorer, Vocabulary, fresh, train
from inkwell.llm.tokenfile import END_ID, encoder
from inkwell.llm.words import text_slices, word_blocks
from inkwell.operators.skew import HOT_ROWS, join_unique
from inkwell.session import stage

WINDOW = 2 * BLOCK + 1
#: The first fit on the driver sees at most so many windows; the later rounds see all.
FIRST_WINDOWS = 8_192
FIRST_EPOCHS = 4
ROUNDS = 1
WINDOWS_PER_SHARD = 8_192
SHARDS_PER_TASK = 4
#: The most frequent words, at most so many, are looked up inside tasks; all others are joined.
FREQUENT_WORDS = 150_000
HELD_WORDS = 200_000
#: Words whose ids a task keeps besides those of the frequent ones.
RARE_WORDS = 50_000
STEPS_PER_DOUBLING = 8


def is_held_out(id_col: str, folds: int = 7, fold: int = 2) -> Column:
    """Whether crc32 of the id as text falls into the fold; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % folds == fold, F.lit(False))


def _windows(ids: np.ndarray, end_id: int) -> np.ndarray:
    """All windows over the begin mark, the ids of a text and its end id: each id is a goal in exactly one.

    The first place of a window is the last one of the window before it.
    """
    line = np.concatenate([[-2], ids, [end_id]]).astype(np.int32)
    n = -(-(len(line) - 1) // (WINDOW - 1))
    line = np.concatenate([line, np.full(n * (WINDOW - 1) + 1 - len(line), -1, np.int32)])
    return np.lib.stride_tricks.sliding_window_view(line, WINDOW)[:: WINDOW - 1]


def _packed(windows: np.ndarray) -> pa.Array:
    """A binary value for each row."""
    ends = np.arange(len(windows) + 1, dtype=np.int32) * np.int32(4 * WINDOW)
    return pa.Array.from_buffers(pa.binary(), len(windows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(windows))])


def gather(rows: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Word counts per task and the training windows that cover all texts: (word, n, window), staged.

    Counts are summed inside a task as far as HELD_WORDS words allow, then sent on, so memory is bounded.
    The null word stands for the end of a text.
    """
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64()), ("window", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        texts = 0

        def flushed() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64()), pa.nulls(len(counts), pa.binary())], schema=schema)
            counts.clear()
            return found

        encode = encoder(tokenizer_path, RARE_WORDS)
        for batch in text_slices(batches, "text", 1 << 20):
            words = [[w for block in word_blocks(text) for w in block] for text in batch.column("text").to_pylist()]
            for own in words:
                counts.update(own)
            texts += len(words)
            ids_of = encode.ids_of([w for own in words for w in own])
            lines = [np.frombuffer(b"".join(map(ids_of.__getitem__, own)), encode.dtype) for own in words]
            windows = np.concatenate([_windows(ids, end_id) for ids in lines])
            for start in range(0, len(windows), WINDOWS_PER_SHARD):
                part = _packed(windows[start : start + WINDOWS_PER_SHARD])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.binary()), pa.nulls(len(part), pa.int64()), part], schema=schema)
            if len(counts) > HELD_WORDS:
                yield flushed()
        yield flushed()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.array([texts], pa.int64()), pa.nulls(1, pa.binary())], schema=schema)

    return stage(rows.mapInArrow(run, "word binary, n long, window binary"), "lm-corpus")


def frequency_cut(counts: DataFrame, most: int) -> int:
    """The smallest count such that at most `most` words have it or more.

    Counts are grouped in steps of which STEPS_PER_DOUBLING double them: a few hundred rows for the driver.
    """
    step = F.floor(F.log2(F.col("n").cast("double")) * STEPS_PER_DOUBLING)
    found = sorted(((r["step"], r["words"], r["least"]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).collect()), reverse=True)
    total, cut = 0, None
    for _, words, least in found:
        total += words
        if total > most:
            break
        cut = least
    return cut if cut is not None else (1 << 62)


def word_ids(counts: DataFrame, tokenizer_path: str) -> DataFrame:
    """(word, ids, n): the token ids of each counted word, staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path, RARE_WORDS)
        for batch in batches:
            found = own.encode_words(batch.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(found, pa.binary()), batch.column("n")], names=["word", "ids", "n"])

    return stage(counts.select("word", "n").mapInArrow(run, "word binary, ids binary, n long"), "lm-word-ids")


def _flat(batch: pa.RecordBatch, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids of a batch of words, whether each begins its word, and its count, without an object per word."""
    column = batch.column("ids").cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    width = np.dtype(dtype).itemsize
    data = column.buffers()[2]
    ids = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(dtype).astype(np.int64) if data else np.zeros(0, np.int64)
    starts, lengths = (ends[:-1] - ends[0]) // width, np.diff(ends) // width
    first = np.zeros(len(ids), bool)
    first[starts[lengths > 0]] = True
    return ids, first, np.repeat(batch.column("n").to_numpy(), lengths)


def build_vocabulary(words: DataFrame, tokenizer_path: str, texts: int, end_id: int = END_ID) -> Vocabulary:
    """Classes and the count model from the ids and counts of all words.

    Two passes over the staged ids of the distinct words. The driver gets at most one row per id of the
    tokenizer, then one per context and class.
    """
    dtype = encoder(tokenizer_path).dtype
    size = max(encoder(tokenizer_path).tokenizer.get_vocab_size(), end_id + 1)
    ends = np.zeros(size, bool)
    ends[: len(encoder(tokenizer_path).ends_word)] = encoder(tokenizer_path).ends_word
    words = words.select("ids", "n")

    def count_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, opening = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            ids, first, n = _flat(batch, dtype)
            opens = first | ends[np.concatenate([ids[:1], ids[:-1]])]
            total += np.bincount(ids, n, minlength=size).astype(np.int64)
            opening += np.bincount(ids[opens], n[opens], minlength=size).astype(np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen]), pa.array(opening[seen])], names=["id", "n", "first"])

    found = words.mapInArrow(count_ids, "id long, n long, first long").groupBy("id").agg(F.sum("n").alias("n"), F.sum("first").alias("first")).toArrow()
    total, opening = np.zeros(size, np.int64), np.zeros(size, np.int64)
    total[found["id"].to_numpy()], opening[found["id"].to_numpy()] = found["n"].to_numpy(), found["first"].to_numpy()
    total[end_id] += texts
    opening[end_id] += texts
    vocabulary = Vocabulary.from_counts(total, opening, ends)

    def count_successions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joint = np.zeros((CLASSES + 1) * CLASSES)
        for batch in batches:
            ids, first, n = _flat(batch, dtype)
            context = np.where(first, BEGIN, vocabulary.contexts(np.concatenate([ids[:1], ids[:-1]])))
            joint += np.bincount(context * CLASSES + vocabulary.class_of[ids], n, minlength=len(joint))
        seen = np.flatnonzero(joint)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(joint[seen])], names=["place", "n"])

    found = words.mapInArrow(count_successions, "place long, n double").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    joint = np.zeros((CLASSES + 1) * CLASSES)
    joint[found["place"].to_numpy()] = found["n"].to_numpy()
    joint[BEGIN * CLASSES + vocabulary.class_of[end_id]] += texts
    shares = np.bincount(vocabulary.class_of, total + 1.0, minlength=CLASSES)
    return vocabulary.with_successions(joint.reshape(CLASSES + 1, CLASSES), shares / shares.sum())


def _window_rows(windows: list[bytes]) -> np.ndarray:
    return np.array([np.frombuffer(w, np.int32) for w in windows], np.int64).reshape(-1, WINDOW)


def fit(windows: DataFrame, vocabulary: Vocabulary, first_windows: int = FIRST_WINDOWS, rounds: int = ROUNDS) -> np.ndarray:
    """Parameters after a first fit on a bounded seeded sample and `rounds` over the windows of all texts.

    In each round every shard of at most WINDOWS_PER_SHARD windows trains on from the shared parameters, and
    the parameters of all shards are averaged in Spark, weighted by their windows. Tasks and shards grow with the corpus; a
    task holds one shard and sends one parameter vector, and the driver gets one.
    """
    flat, total = fresh(), windows.count()
    if not total:
        return flat
    share = min(1.0, first_windows / total)
    drawn = windows.filter(F.pmod(F.xxhash64("window"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).limit(2 * first_windows)
    first = sorted(bytes(r["window"]) for r in drawn.collect())
    flat = train(flat, vocabulary, _window_rows(first), FIRST_EPOCHS, seed=1)
    dealt = windows.repartition(-(-total // (SHARDS_PER_TASK * WINDOWS_PER_SHARD)))
    for turn in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], flat: np.ndarray = flat, turn: int = turn) -> Iterator[pa.RecordBatch]:
            summed, weight, held = np.zeros(SIZE), 0, []

            def trained(part: list[bytes]) -> np.ndarray:
                found = train(flat, vocabulary, _window_rows(sorted(part)), 1, seed=100 + turn, rate=0.002)
                return found.astype(np.float64) * len(part)

            for batch in batches:
                held += batch.column("window").to_pylist()
                while len(held) >= WINDOWS_PER_SHARD:
                    part, held = held[:WINDOWS_PER_SHARD], held[WINDOWS_PER_SHARD:]
                    summed, weight = summed + trained(part), weight + len(part)
            if held:
                summed, weight = summed + trained(held), weight + len(held)
            if weight:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(SIZE), pa.int32()), pa.array(summed), pa.array(np.full(SIZE, float(weight)))], names=["place", "value", "weight"])

        trained = dealt.mapInArrow(run, "place int, value double, weight double")
        mean = trained.groupBy("place").agg((F.sum("value") / F.sum("weight")).alias("value")).toArrow()
        flat = np.zeros(SIZE, np.float32)
        flat[mean["place"].to_numpy()] = mean["value"].to_numpy()
    return flat


SCORED = "row long, id {id_type}, held_out boolean, n_tokens long, n_known long, log_sum double, score double, word binary, n long"


def lm_scores(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    frequent_words: int = FREQUENT_WORDS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts have A-Z lowered, null counts as empty. The base model takes words and one end per text with add-one
    smoothing; counts cover every training text. `score` is the log10 probability of the
    text's subword ids and its end under the attention model. The end counts as a token with the training texts as
    its count. Rows with null ids train the models; repeated ids are rows of their own; an empty table gives no rows, and without
    training texts the base score is 0. Other columns are not read.

    The commonest words are looked up inside tasks, at most `frequent_words` by construction; the others
    leave as one row per text and word and meet their counts in a join that salts hot words.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    read = docs.select(F.col(f"`{id_col}`").alias("id"), is_held_out(id_col).alias("held_out"), text.alias("text"))
    corpus = gather(read.filter(~F.col("held_out")).select("text"), tokenizer_path, end_id)
    texts = corpus.filter("word IS NULL AND n IS NOT NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counts = stage(corpus.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")
    words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    train_tokens, types = words + texts, distinct + (texts > 0)
    counted = word_ids(counts, tokenizer_path)
    vocabulary = build_vocabulary(counted, tokenizer_path, texts, end_id)
    flat = fit(corpus.filter("window IS NOT NULL").select("window"), vocabulary)
    cut = frequency_cut(counts, frequent_words)
    # at most frequent_words rows
    frequent = counted.filter(F.col("n") >= cut).select("word", "ids", F.log10(F.col("n") + 1).alias("log")).toArrow()
    frequent = (frequent["word"].to_pylist(), [*frequent["ids"].to_pylist(), b""], frequent["log"].to_numpy())
    shared = spark.sparkContext.broadcast((frequent, vocabulary, flat))
    id_type = dict(read.dtypes)["id"]
    per_token, end_log = math.log10(train_tokens + types + 1), math.log10(texts + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (words, ids_of, logs_of), own_vocabulary, own_flat = shared.value
        place_of = dict(zip(words, range(len(words)))).get
        scorer, encode = Scorer(own_vocabulary, own_flat), encoder(tokenizer_path, RARE_WORDS)
        end = np.array([end_id])
        names = ["row", "id", "held_out", "n_tokens", "n_known", "log_sum", "score", "word", "n"]
        for batch in text_slices(batches, "text", 1 << 20):
            rows, base, sequences, rare = batch.column("row").to_pylist(), [], [], []
            words = [[w for block in word_blocks(text) for w in block] for text in batch.column("text").to_pylist()]
            places = [list(map(place_of, own, itertools.repeat(-1))) for own in words]
            strange = [[w for w, k in zip(own, found) if k < 0] if -1 in found else [] for own, found in zip(words, places)]
            new = encode.ids_of([w for others in strange for w in others])
            for row, own, found, others in zip(rows, words, places, strange):
                pieces = list(map(ids_of.__getitem__, found))  # the last place is empty
                known = np.array(found, np.int64)
                for k, word in zip(np.flatnonzero(known < 0).tolist(), others):
                    pieces[k] = new[word]
                known = known[known >= 0]
                rare += [(row, w, c) for w, c in Counter(others).items()]
                base.append((len(own) + 1, len(known) + int(texts > 0), end_log + float(logs_of[known].sum())))
                sequences.append(np.concatenate([np.frombuffer(b"".join(pieces), encode.dtype).astype(np.int64), end]))
            scores = scorer.log10(sequences)
            columns = list(zip(*base))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), batch.column("held_out"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()), pa.array(scores), pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.int64())],
                names=names,
            )
            if rare:
                r, w, c = zip(*rare)
                empty = [pa.nulls(len(r), batch.column("id").type), pa.nulls(len(r), pa.bool_()), pa.nulls(len(r), pa.int64()), pa.nulls(len(r), pa.int64()), pa.nulls(len(r), pa.float64()), pa.nulls(len(r), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), *empty, pa.array(w, pa.binary()), pa.array(c, pa.int64())], names=names)

    scored = read.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, SCORED.format(id_type=id_type))
    scored = stage(scored, "lm-scored")
    rare_counts = counts.filter(F.col("n") < cut).select("word", F.log10(F.col("n") + 1).alias("log_count"))
    met = join_unique(scored.filter("word IS NOT NULL").select("row", "word", "n"), rare_counts, "word", hot_rows=hot_rows, stable_left=True)
    more = met.groupBy("row").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.col("log_count")).alias("more_logs"))
    whole = scored.filter("word IS NULL").drop("word", "n").join(more, "row", "left")
    log_sum = F.col("log_sum") + F.coalesce("more_logs", F.lit(0.0))
    return whole.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (log_sum - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
        "score",
    )
