"""Token ids in files: one zstandard frame per document, a shared dictionary, and an offset index.

A token file is a folder of three Parquet tables, so that any store Spark writes to can hold it and a
lost task is written again by Spark's own commit:

- `dictionary`: one row with the dictionary, its SHA-256, and the integer type of the ids;
- `blocks`: rows of consecutive documents: the part and the ids before the block within its part, the document
  ids, their token counts, the end offset of each frame, the dictionary's hash, and the frames;
- `starts`: the ids before each part.
"""

from __future__ import annotations

import hashlib
import json
import string
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from inkwell.llm.words import byte_blocks, text_slices
from inkwell.operators.skew import broadcast_if_small
from inkwell.session import fresh_path, stage

END_ID = 2
SAMPLE_DOCS = 2_000
SAMPLE_CHARS = 16_384
DICTIONARY_BYTES = 64 * 1024
LEVEL = 3
BLOCK_BYTES = 256 * 1024
SLICE_BYTES = 4 << 20
#: Words that a worker keeps in arrays for whole texts, and in a dictionary for single words.
KNOWN_WORDS = 1_000_000
CACHED_WORDS = 50_000
WORDS_PER_CALL = 2_000
MARKS = string.punctuation.encode()
#: Lower-case letters before this one (Latin-1) are single characters that normalising leaves as they are.
LATIN_END = "\u0100"


def _byte_letters() -> dict[int, int]:
    """The letters that byte-level tokenizers write for bytes: themselves if printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 0x100 + k for k, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


def words_stand_alone(definition: dict) -> bool:
    """Whether white space only separates: the ids of a text are those of its words in order.

    True when the normaliser works on single characters or drops runs of white space, and the pieces
    are matches of a pattern that names white space only to exclude it, with all else removed.
    """
    normalizer = definition.get("normalizer") or {}
    steps = normalizer.get("normalizers", [normalizer] if normalizer else [])
    known = all(s["type"] in ("NFC", "Lowercase") or s == {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "} for s in steps)
    pre = (definition.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if not known or not pre or pre[0]["type"] != "Split" or definition.get("post_processor"):
        return False
    pattern = pre[0]["pattern"].get("Regex", " ")
    leaves_out = not any(c in pattern.replace("[^\\s", "") for c in (" ", "\\s", "\\S", ".", "\\W", "\\P"))
    rest = all(p["type"] == "ByteLevel" and not p["add_prefix_space"] and not p["use_regex"] for p in pre[1:])
    plain = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in definition.get("added_tokens", []))
    return pre[0]["behavior"] == "Removed" and pre[0]["invert"] and leaves_out and rest and plain


class WordIds:
    """The ids of many words in a few arrays: 128-bit digests in order, and each word's stretch of one array of ids.

    Some 30 bytes a word, where a dictionary of byte strings takes 150. Full, it forgets the words that were not asked
    for since it was last full, or all when that is not half of them.
    """

    def __init__(self, dtype: str, most: int) -> None:
        self.most = most
        self.high, self.low = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.size, self.used = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
        self.ids = np.zeros(0, dtype)

    @staticmethod
    def digests(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)
        return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])

    def places(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Where each digest stands; -1 for an unknown one."""
        at = np.searchsorted(self.high, high)
        inside = np.minimum(at, max(0, len(self.high) - 1))
        known = (at < len(self.high)) & (self.high[inside] == high) & (self.low[inside] == low) if len(self.high) else np.zeros(len(high), bool)
        self.used[inside[known]] = True
        return np.where(known, inside, -1)

    def add(self, high: np.ndarray, low: np.ndarray, ids: list[bytes]) -> None:
        """Further words, none of them known. Two digests with equal first halves would hide one another: the later one is left out."""
        if len(self.high) + len(high) > self.most:
            self._forget()
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.ids.itemsize
        start = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), self.ids.dtype)])
        order = np.argsort(high, kind="stable")
        at = np.searchsorted(self.high, high[order])
        new = np.ones(len(order), bool)
        new[1:] = np.diff(high[order]) != 0
        if len(self.high):
            new &= self.high[np.minimum(at, len(self.high) - 1)] != high[order]
        order, at = order[new], at[new]
        self.high, self.low = np.insert(self.high, at, high[order]), np.insert(self.low, at, low[order])
        self.start, self.size = np.insert(self.start, at, start[order]), np.insert(self.size, at, size[order].astype(np.int32))
        self.used = np.insert(self.used, at, True)

    def _forget(self) -> None:
        kept = np.flatnonzero(self.used)
        kept = kept if 2 * len(kept) <= self.most else kept[:0]
        self.ids = self.stretch(kept)
        self.high, self.low, self.size = self.high[kept], self.low[kept], self.size[kept]
        self.start, self.used = np.cumsum(self.size, dtype=np.int64) - self.size, np.zeros(len(kept), bool)

    def stretch(self, places: np.ndarray) -> np.ndarray:
        """The ids of the words at these places in turn."""
        size = self.size[places]
        ends = np.cumsum(size, dtype=np.int64)
        return self.ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[places] - (ends - size), size)]


class Encoder:
    """Whole texts to little-endian id bytes with a file of the tokenizers library.

    When words stand alone, a distinct word is encoded once and its ids are kept, for a bounded number of words. Else
    every text is encoded as it is. Both give the library's ids for the whole text.
    """

    def __init__(self, path: str, cached_words: int = CACHED_WORDS) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            definition = json.load(file)
        self.by_words = words_stand_alone(definition)
        self.special = [t["content"].encode() for t in definition.get("added_tokens", [])]
        self.by_words &= all(len(s.split()) == 1 and s.strip() == s for s in self.special) and bool(self.special)
        self.dtype = id_type(self.tokenizer)
        self.typecode = "H" if self.dtype == "<u2" else "I"
        self.by_words &= sys.byteorder == "little"
        self.cached_words = cached_words
        self.cache: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.tails: dict[bytes, bytes] = {}
        self.known = WordIds(self.dtype, KNOWN_WORDS)
        self.model = self.tokenizer.model
        suffix = getattr(self.model, "end_of_word_suffix", None)
        self.by_words &= bool(suffix)
        self.ends_word = np.array([(self.tokenizer.id_to_token(i) or "").endswith(suffix or " ") for i in range(self.tokenizer.get_vocab_size())])

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _learn(self, words: list[bytes]) -> None:
        """Keep the ids of some words, each by the cheapest exact way.

        Letters and the marks behind them are pieces of their own. Lower-case ASCII letters pass the
        normaliser as they are, and so do lower-case Latin letters in one character, so both go to the library's
        model directly; other letters in one call with spaces between, told apart by the ids that end a
        word; all the rest with a special token between.
        """
        spaced, rest = [], []
        for word in words:
            core = word.rstrip(MARKS)
            if core.isalpha():
                self.cache[word] = self._letters(core.lower()) + self._tail(word[len(core) :])
            elif core and (text := core.decode()).isalpha():
                if text.islower() and max(text) < LATIN_END:
                    self.cache[word] = self._tokenized(text.encode().decode("latin-1").translate(BYTE_LETTERS)) + self._tail(word[len(core) :])
                else:
                    spaced.append((word, core))
            else:
                rest.append(word)
        for start in range(0, len(spaced), WORDS_PER_CALL):
            part = spaced[start : start + WORDS_PER_CALL]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(c.decode() for _, c in part)], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(part):  # some letter became more than a letter
                rest += [word for word, _ in part]
                continue
            for (word, core), low, high in zip(part, [0, *ends.tolist()], ends.tolist()):
                self.cache[word] = ids[low:high].tobytes() + self._tail(word[len(core) :])
        self._learn_marked(rest)

    def _letters(self, core: bytes) -> bytes:
        known = self.cache.get(core)
        return self._tokenized(core.decode()) if known is None else known

    def _tokenized(self, letters: str) -> bytes:
        return array(self.typecode, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _tail(self, tail: bytes) -> bytes:
        if tail and tail not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            self.tails[tail] = self._plain(tail.decode()).tobytes()
        return self.tails[tail] if tail else b""

    def _learn_marked(self, words: list[bytes]) -> None:
        """Many words in one call, with a special token between them, which the library cuts out first."""
        mark = self.special[0].decode()
        mark_id = self.tokenizer.token_to_id(mark)
        simple = []
        for word in words:
            if any(s in word for s in self.special):
                self.cache[word] = self._plain(word.decode()).tobytes()
            else:
                simple.append(word)
        for start in range(0, len(simple), WORDS_PER_CALL):
            part = simple[start : start + WORDS_PER_CALL]
            ids = self._plain(mark.join(w.decode() for w in part))
            edges = [-1, *np.flatnonzero(ids == mark_id).tolist(), len(ids)]
            for word, low, high in zip(part, edges, edges[1:]):
                self.cache[word] = ids[low + 1 : high].tobytes()

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of some distinct words, which are not kept."""
        kept, self.cache = self.cache, {}
        if self.by_words:
            self._learn(words)
        else:
            self.cache = {w: self._plain(w.decode()).tobytes() for w in words}
        found, self.cache = [self.cache[w] for w in words], kept
        return found

    def ids_of(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of some words that stand alone, kept for the next time."""
        if not self.by_words:
            return {w: self._plain(w.decode()).tobytes() for w in set(words)}
        if len(self.cache) > self.cached_words:
            self.old, self.cache = self.cache, {}
        cache, old, wanted = self.cache, self.old, set(words)
        self._learn([w for w in wanted if w not in old and w not in cache])
        cache.update([(w, old[w]) for w in wanted if w in old])
        return {w: cache[w] for w in wanted}

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of whole texts. All words that are new to any of them are encoded together."""
        if not self.by_words:
            return [self._plain(text or "").tobytes() for text in texts]
        # the normaliser lowers case anyway, but a special token is found before that
        lowers = [not any(s[:1].decode() in (text or "") for s in self.special) for text in texts]
        found: list[list[bytes]] = [[] for _ in texts]
        owner, blocks, held = [], [], 0
        for number, (text, lower) in enumerate(zip(texts, lowers)):
            for block in byte_blocks(text, lower):
                owner.append(number), blocks.append(block)
                held += len(block)
                if held >= SLICE_BYTES:
                    for k, ids in zip(owner, self._encoded(blocks)):
                        found[k].append(ids)
                    owner, blocks, held = [], [], 0
        for k, ids in zip(owner, self._encoded(blocks)):
            found[k].append(ids)
        return [b"".join(parts) for parts in found]

    def _encoded(self, blocks: list[bytes]) -> list[bytes]:
        """The ids of blocks of whole words. Arrow splits and numbers the words; Python sees each distinct one once."""
        if not blocks:
            return []
        texts = pc.ascii_trim_whitespace(pa.array(blocks, pa.binary()).cast(pa.string()))
        words = pc.ascii_split_whitespace(texts)
        numbered = words.flatten().dictionary_encode()
        whole = numbered.dictionary
        cores = pc.ascii_rtrim(whole, MARKS.decode())
        # marks behind letters are pieces of their own
        tailed = pc.and_(pc.less(pc.binary_length(cores), pc.binary_length(whole)), pc.utf8_is_alpha(cores)).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(tailed)
        tails = [word[len(core) :] for word, core in zip(whole.take(pa.array(at)).to_pylist(), cores.take(pa.array(at)).to_pylist())]
        pieces = pa.concat_arrays([pa.array(["", *tails], pa.string()), pc.if_else(pa.array(tailed), cores, whole)]).dictionary_encode()
        place = pieces.indices.to_numpy()
        split = np.zeros((len(whole), 2), np.int32)
        split[:, 0] = place[len(at) + 1 :]
        split[at, 1] = place[1 : len(at) + 1]
        arena, start, size = self._pieces(pieces.dictionary.cast(pa.binary()).to_pylist())
        line = split[numbered.indices.to_numpy()].ravel()
        sizes = size[line]
        ends = np.cumsum(sizes)
        ids = arena[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start[line] - (ends - sizes), sizes)]
        lasts = np.concatenate([[0], ends[1::2]])[words.offsets.to_numpy()] * ids.itemsize
        data = ids.tobytes()
        return [data[low:high] for low, high in zip(lasts[:-1].tolist(), lasts[1:].tolist())]

    def _pieces(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size) of distinct words, known ones looked up and new ones encoded and kept."""
        high, low = WordIds.digests(words)
        places = self.known.places(high, low)
        old, new = np.flatnonzero(places >= 0), np.flatnonzero(places < 0)
        fresh = self.encode_words([words[k] for k in new])
        arena = np.concatenate([self.known.stretch(places[old]), np.frombuffer(b"".join(fresh), self.dtype)])
        size = np.zeros(len(words), np.int64)
        size[old] = self.known.size[places[old]]
        size[new] = np.fromiter(map(len, fresh), np.int64, len(fresh)) // arena.itemsize
        order = np.concatenate([old, new])
        start = np.zeros(len(words), np.int64)
        start[order] = np.cumsum(size[order]) - size[order]
        self.known.add(high[new], low[new], fresh)
        return arena, start, size


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, cached_words: int = CACHED_WORDS) -> Encoder:
    """One encoder per worker process, file and size."""
    if (path, cached_words) not in _ENCODERS:
        _ENCODERS[path, cached_words] = Encoder(path, cached_words)
    return _ENCODERS[path, cached_words]


def id_type(tokenizer: Tokenizer, end_id: int = END_ID) -> str:
    return "<u2" if max(tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_AUTO)


def train_dictionary(rows: DataFrame, tokenizer_path: str, end_id: int = END_ID, sample_docs: int = SAMPLE_DOCS) -> bytes:
    """A dictionary from the id arrays of about `sample_docs` texts of at most SAMPLE_CHARS characters.

    The texts are a uniform sample by hash, so the driver gets a bounded amount. Empty when there is too little
    to train on, as for an empty table.
    """
    short = rows.filter(F.length("text") <= SAMPLE_CHARS).select("id", "text")
    share = min(1.0, sample_docs / max(1, short.count()))
    drawn = short.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        end = np.array([end_id], own.dtype).tobytes()
        for batch in text_slices(batches, "text", SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array([ids + end for ids in own.encode_many(batch.column("text").to_pylist())], pa.binary())], names=["ids"])

    # a hot null or repeated id is drawn whole or not at all, so the number is bounded once more
    samples = sorted(bytes(r["ids"]) for r in drawn.select("text").mapInArrow(run, "ids binary").limit(2 * sample_docs).collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _frames(batches: Iterator[pa.RecordBatch], tokenizer_path: str, end_id: int, dictionary: bytes) -> Iterator[pa.RecordBatch]:
    own = encoder(tokenizer_path)
    end = np.array([end_id], own.dtype).tobytes()
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary) if dictionary else None)
    width = np.dtype(own.dtype).itemsize
    for batch in text_slices(batches, "text", SLICE_BYTES):
        counts, frames = [], []
        for ids in own.encode_many(batch.column("text").to_pylist()):
            ids += end
            counts.append(len(ids) // width)
            frames.append(packer.compress(ids))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), pa.array(frames, pa.binary())], names=["id", "n_tokens", "frame"])


BLOCKS = "part int, block int, first_start long, n_tokens long, first_id long, last_id long, ids array<long>, counts binary, ends binary, dictionary_sha256 string, data binary"


def _blocks(batches: Iterator[pa.RecordBatch], digest: str) -> Iterator[pa.RecordBatch]:
    """Consecutive sorted documents packed into blocks of about BLOCK_BYTES, one document at least."""
    part = TaskContext.get().partitionId()
    types = {"part": pa.int32(), "block": pa.int32(), "first_start": pa.int64(), "n_tokens": pa.int64(), "first_id": pa.int64(), "last_id": pa.int64(), "ids": pa.list_(pa.int64()), "counts": pa.binary(), "ends": pa.binary(), "dictionary_sha256": pa.string(), "data": pa.binary()}
    schema = pa.schema(list(types.items()))
    block = start = held = 0
    ids, counts, frames = [], [], []

    def packed() -> pa.RecordBatch:
        known = [i for i in ids if i is not None]
        row = {
            "part": part, "block": block, "first_start": start, "n_tokens": sum(counts), "first_id": min(known, default=None), "last_id": max(known, default=None),
            "ids": ids, "counts": np.array(counts, "<i8").tobytes(), "ends": np.cumsum([len(f) for f in frames], dtype="<i8").tobytes(),
            "dictionary_sha256": digest, "data": b"".join(frames),
        }
        return pa.RecordBatch.from_pylist([row], schema=schema)

    for batch in batches:
        for i, n, frame in zip(*(batch.column(c).to_pylist() for c in ("id", "n_tokens", "frame"))):
            ids.append(i), counts.append(n), frames.append(frame)
            held += len(frame)
            if held >= BLOCK_BYTES:
                yield packed()
                block, start, held = block + 1, start + sum(counts), 0
                ids, counts, frames = [], [], []
    if ids:
        yield packed()


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, sample_docs: int = SAMPLE_DOCS
) -> None:
    """Write a token file of all documents in ascending id order, each with `end_id` after its own ids.

    Null texts count as empty and have the end id alone. Null ids come first; rows with equal ids stay
    apart, in the order of their scan. An empty table gives a file without blocks. Other columns
    are not read. Only compressed frames are shuffled; a document is one row, whatever its length.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    dictionary = train_dictionary(rows, tokenizer_path, end_id, sample_docs)
    digest = hashlib.sha256(dictionary).hexdigest()
    dtype = id_type(Tokenizer.from_file(tokenizer_path), end_id)
    spark.createDataFrame([(digest, bytearray(dictionary), dtype)], "sha256 string, data binary, id_type string").write.parquet(f"{path}/dictionary")
    frames = rows.mapInArrow(lambda batches: _frames(batches, tokenizer_path, end_id, dictionary), "id long, n_tokens long, frame binary")
    frames = stage(frames.withColumn("place", F.monotonically_increasing_id()), "token-frames")
    placed = frames.repartitionByRange("id", "place").sortWithinPartitions("id", "place").select("id", "n_tokens", "frame")
    placed.mapInArrow(lambda batches: _blocks(batches, digest), BLOCKS).write.parquet(f"{path}/blocks")
    parts = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file, so this window never sorts documents
    parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start")).write.parquet(f"{path}/starts")


def _open(spark: SparkSession, path: str) -> tuple[DataFrame, bytes, str, str]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    data = bytes(row["data"])
    if hashlib.sha256(data).hexdigest() != row["sha256"]:
        raise ValueError(f"the dictionary of {path} is damaged")
    starts = spark.read.schema("part int, part_start long").parquet(f"{path}/starts")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").join(broadcast_if_small(starts), "part")
    return blocks.withColumn("start", F.col("part_start") + F.col("first_start")), data, row["sha256"], row["id_type"]


def _documents(batches: Iterator[pa.RecordBatch], dictionary: bytes, digest: str, dtype: str, wanted: set[int] | None) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(id, start, ids) of the documents of each block; of the wanted ones only their frames are read."""
    unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary) if dictionary else None)
    for batch in batches:
        for row in batch.to_pylist():
            if row["dictionary_sha256"] != digest:
                raise ValueError("a block was packed with another dictionary")
            counts, ends = np.frombuffer(row["counts"], "<i8"), np.frombuffer(row["ends"], "<i8")
            starts = row["start"] + np.cumsum(counts) - counts
            data = memoryview(row["data"])
            for k, name in enumerate(row["ids"]):
                if wanted is None or name in wanted:
                    ids = np.frombuffer(unpacker.decompress(data[ends[k - 1] if k else 0 : ends[k]]), dtype)
                    if len(ids) != counts[k]:
                        raise ValueError(f"document {name} has {len(ids)} ids, not {counts[k]}")
                    yield name, int(starts[k]), ids


def read_tokens(spark: SparkSession, path: str, only: list[int] | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, start, ids) of a token file, or of the documents named in `only`.

    For a few documents the blocks that can hold them are found by their first and last id, and
    only the frames of those documents are decompressed.
    """
    blocks, dictionary, digest, dtype = _open(spark, path)
    if only is not None:
        near = F.lit(False)
        for name in only:
            near = near | ((F.col("first_id") <= name) & (F.col("last_id") >= name))
        blocks = blocks.filter(near)
    wanted = None if only is None else set(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, start, ids in _documents(batches, dictionary, digest, dtype, wanted):
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([start], pa.int64()), pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))], names=[id_col, "start", "ids"])

    return blocks.select("start", "ids", "counts", "ends", "dictionary_sha256", "data").mapInArrow(run, f"`{id_col}` long, start long, ids array<long>")


def token_digests(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document of a token file: id, start, n_tokens, ids_crc32 of its ids as unsigned 32-bit integers."""
    blocks, dictionary, digest, dtype = _open(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(n, s, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for n, s, ids in _documents(iter([batch]), dictionary, digest, dtype, None)]
            columns = list(zip(*found)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[id_col, "start", "n_tokens", "ids_crc32"])

    return blocks.select("start", "ids", "counts", "ends", "dictionary_sha256", "data").mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def encoded_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write all documents to a new token file in the shared folder and read its digests back."""
    path = fresh_path(docs.sparkSession, "token-file")
    write_tokens(docs, path, tokenizer_path, id_col, text_col, end_id)
    return token_digests(docs.sparkSession, path, id_col)
