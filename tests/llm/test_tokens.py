import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from inkwell.llm.tokenfile import Encoder, encoder, read_tokens, token_digests, words_stand_alone, write_tokens
from inkwell.session import fresh_path

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


ODD = [
    "a<|startoftext|>b <|endoftext|>", "<|StartOfText|>", "İstanbul ΣΑΣ ß ﬁ", "it's We'll don't'", "École é éx", "１２３ abc123 a1b2. ...", "x y z\x1cq\x85w", "漢字 한국어",
    "Ⅷ ªº ʰ ǅ ǆ", "THE. the, The!?..", "a‍b naïve co-op", "🙂👍🏽", " \t\n", "", "́ ́a", "a.b,c;d", "?!?! ...a",
]


@pytest.mark.parametrize("text", ODD)
def test_words_give_the_ids_of_the_whole_text(text):
    assert np.frombuffer(encoder(PATH).encode(text), encoder(PATH).dtype).tolist() == ids_of(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tAaBbéÉß'sdll.,!<|>09́"), st.characters(codec="utf-8")), max_size=60))
def test_any_text_gives_the_ids_of_the_whole_text(text):
    assert np.frombuffer(encoder(PATH).encode(text), encoder(PATH).dtype).tolist() == ids_of(text)


def test_a_small_cache_changes_nothing():
    own, text = Encoder(PATH, cached_words=5), "one two three one two four five six seven one. Two, three! é è à"
    assert np.frombuffer(own.encode(text) + own.encode(text), own.dtype).tolist() == ids_of(text) * 2


def test_other_tokenizers_encode_whole_texts():
    own = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    text = "Two  spaces\n\nand lines"
    assert not own.by_words and np.frombuffer(own.encode(text), own.dtype).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
    assert not words_stand_alone({"normalizer": None, "pre_tokenizer": None})


def check(spark, docs, path):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    expected, start = [], 0
    for name, text in rows:
        ids = ids_of(text) + [2]
        expected.append((name, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = sorted((tuple(r) for r in token_digests(spark, path).collect()), key=lambda r: r[1])
    assert found == expected


def test_round_trip_of_awkward_documents(spark, awkward, monkeypatch):
    monkeypatch.setattr("inkwell.llm.tokenfile.BLOCK_BYTES", 64)
    path = fresh_path(spark, "test-tokens")
    write_tokens(awkward.repartition(3), path, PATH)
    check(spark, awkward.select("doc_id", "text"), path)
    found = {r.doc_id: r.ids for r in read_tokens(spark, path, only=[7, 8, 99]).collect()}
    assert found == {7: ids_of(awkward.filter("doc_id = 7").first().text) + [2], 8: ids_of("x") + [2]}


def test_dictionary_is_trained_shared_and_checked(spark):
    draw = np.random.default_rng(0)
    rows = [(int(i), " ".join(f"{a}{b}" for a, b in zip(draw.choice(["the", "of", "and", "less"], 30), draw.choice(["", "re", "ing"], 30)))) for i in draw.permutation(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path, plain = fresh_path(spark, "test-tokens"), fresh_path(spark, "test-tokens")
    write_tokens(docs, path, PATH)
    check(spark, docs, path)
    row = spark.read.parquet(f"{path}/dictionary").first()
    assert len(row["data"]) > 0 and {r[0] for r in spark.read.parquet(f"{path}/blocks").select("dictionary_sha256").collect()} == {row["sha256"]}
    size = lambda p: spark.read.parquet(f"{p}/blocks").selectExpr("sum(octet_length(data)) s").first()["s"]
    write_tokens(docs, plain, PATH, sample_docs=0)
    assert size(path) < 0.8 * size(plain)
    spark.createDataFrame([("0" * 64, bytearray(row["data"]), "<u2")], "sha256 string, data binary, id_type string").write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(ValueError, match="damaged"):
        read_tokens(spark, path)


def test_empty_table(spark, nothing):
    path = fresh_path(spark, "test-tokens")
    write_tokens(nothing, path, PATH)
    assert token_digests(spark, path).collect() == [] and read_tokens(spark, path).collect() == []
