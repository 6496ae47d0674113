"""Substring dedup against brute force over all windows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from inkwell.llm import queries, substrings
from inkwell.llm.recompress import created, window_names, word_names
from inkwell.llm.substrings import blocks, without_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, window):
    """(words, removed, kept) of each text."""
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    result = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        result.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return result


def found(spark, texts, window, **more):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = without_repeats(docs, window=window, **more).collect()
    return [(r["n_words"], r["n_removed"], r["kept"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    expected = {d["doc_id"]: b for d, b in zip(docs, brute([d["text"] for d in docs], 35))}
    rows = queries.QUERIES["op13_substring_dedup"](spark, sf_dir).collect()
    assert len(rows) == len(docs) and sum(r["n_removed"] for r in rows) > 0
    for r in rows:
        n_words, n_removed, kept = expected[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n_words, n_removed, hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("window", [1, 2, 7, 35])
def test_runs_periods_and_overlaps(spark, window):
    random = np.random.default_rng(window)
    stock = " ".join(f"s{i}" for i in range(60))
    texts = ["a " * 100, "a " * 36, "b " + "a " * 35, "a b " * 50, "c a b " * 30, stock, "x " + stock + " y", stock[:80], None, "", " \n ", "a"]
    texts += [" ".join(random.choice(list("abc"), 80)) for _ in range(6)]
    texts += [" ".join(random.choice([f"w{i}" for i in range(300)], 120)) + " " + " ".join(stock.split()[5:50]) for _ in range(4)]
    assert found(spark, texts, window, hot_rows=10) == brute(texts, window)


def test_no_repeats_at_all(spark):
    texts = [" ".join(f"d{k}w{i}" for i in range(90)) for k in range(5)]
    assert found(spark, texts, 35) == brute(texts, 35)


def test_chunks_of_long_texts(spark, monkeypatch):
    texts = [" ".join(f"w{i * i % 997}" for i in range(3000)), " ".join(f"w{i * i % 997}" for i in range(500, 2500)), "q " * 700]
    monkeypatch.setattr(substrings, "CHUNK_WORDS", 50)
    parts = list(blocks(texts, 35))
    assert len(parts) > 50 and sum(int((b.size - (b.fresh - b.base)).sum()) for b in parts) == 3000 + 2000 + 700
    rows = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "file long, row long, text string")
    tasks = list(substrings.rare_symbols(rows, 35).groupBy("name").count().collect())
    assert tasks
    assert found(spark, texts, 35) == brute(texts, 35)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=12, max_size=40), st.lists(st.sampled_from("abcd"), max_size=9), st.lists(st.sampled_from("abcd"), max_size=9))
def test_equal_stretches_get_equal_symbols(middle, before, after):
    """A symbol decided inside a stretch is there whatever surrounds it."""

    def inside(words, low, high):
        names = word_names([w.encode() for w in words], 2)
        every = created(names, np.zeros(len(words), int), np.arange(len(words)))
        return {
            (s - low, e - low, int(a), int(b))
            for found in every
            for a, b, s, e, first, last in zip(*found.names, found.start, found.end, found.low, found.high)
            if low <= first and last <= high
        }

    alone = inside(middle, 0, len(middle))
    framed = inside(before + middle + after, len(before), len(before) + len(middle))
    assert alone <= framed


def test_window_names_tell_windows_apart():
    words = [w.encode() for w in "a b c a b d a b c a b d a b".split()]
    for size in (1, 2, 3, 5, 7, 11):
        lanes = window_names(word_names(words, 2), size)
        names = list(zip(*(lane.tolist() for lane in lanes)))
        texts = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
        assert len(names) == len(texts)
        assert all((a == b) == (s == t) for a, s in zip(names, texts) for b, t in zip(names, texts))


def test_awkward_documents(spark, awkward, nothing):
    rows = without_repeats(awkward, hot_rows=3).collect()
    texts = [r["text"] for r in awkward.select("text").collect()]
    assert sorted((r["n_words"], r["n_removed"], r["kept"]) for r in rows) == sorted(brute(texts, 35))
    small = sorted((r["n_words"], r["n_removed"], r["kept"]) for r in without_repeats(awkward, window=7).collect())
    assert small == sorted(brute(texts, 7)) and any(n == 7 and gone == 7 for n, gone, _ in small)
    assert without_repeats(nothing).count() == 0
