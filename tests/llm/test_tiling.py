import re
import tracemalloc

import numpy as np
import pytest

from inkwell.llm import tiling
from inkwell.llm.tiling import Items, decontaminate, drop_contaminated, rolling, tile


def slow_tiles(text, item, least):
    """Greedy string tiling by comparing every pair of places in every round."""
    a, b = re.findall(r"\w+", (text or "").lower()), re.findall(r"\w+", (item or "").lower())
    least = min(least, len(b)) or 1
    marks_a, marks_b, tiles = [False] * len(a), [False] * len(b), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not marks_a[i + n] and not marks_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return tiles, len(b)
        n, i, j = best
        tiles.append(best)
        marks_a[i : i + n] = marks_b[j : j + n] = [True] * n


@pytest.mark.parametrize("seed", range(12))
def test_tiles_equal_brute_force(seed):
    draw = np.random.default_rng(seed)
    item = [f"w{draw.integers(0, 6)}" for _ in range(30)]
    text = [f"w{draw.integers(0, 7)}" for _ in range(60)] + item[15:] + ["x"] + item[:15] + [f"w{draw.integers(0, 3)}" for _ in range(30)]
    index = Items([(1, " ".join(item))], 4)
    found = [tiles for _, _, tiles in index.matches(" ".join(text))]
    assert (found[0] if found else []) == slow_tiles(" ".join(text), " ".join(item), 4)[0]


def test_reordered_passages_are_covered():
    item = " ".join(f"q{i}" for i in range(40))
    words = item.split()
    text = "Before. " + " ".join(words[25:]) + ", then " + " ".join(words[:10]).upper() + " and " + " ".join(words[10:25]) + "!"
    assert Items([(7, item)], 5).best(text) == (1.0, 7, 3, 40, [7])


def test_rolling_hash_and_trimmed_tiles():
    ids = np.array([3, 1, 4, 1, 4, 1])
    assert len(set(rolling(ids, 2).tolist())) == 3 and len(rolling(ids, 9)) == 0
    assert tile([(6, 0, 0), (5, 4, 10)], 20, 20, 3) == [(6, 0, 0), (3, 6, 12)]


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, " ".join(f"item{i}" for i in range(20))), (2, "The same text, twice the same row."), (3, "two words"), (4, None), (5, ""), (6, "...")]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("block_bytes", [1 << 20, 64])
def test_awkward_documents(spark, awkward, benchmark, block_bytes):
    more = spark.createDataFrame([(50, "so " + " ".join(f"ITEM{i}," for i in range(9, 20)) + " end"), (51, " ".join(f"item{i}" for i in range(9)))], "doc_id long, text string")
    docs = awkward.unionByName(more, allowMissingColumns=True)
    found = decontaminate(docs, benchmark, block_bytes=block_bytes)
    rows = {(r.doc_id, r.contaminated, round(r.coverage, 6), r.item_id, r.tiles) for r in found.collect()}
    assert found.count() == 12
    assert rows == {
        (None, False, 0.0, None, 0), (1, False, 0.0, None, 0), (2, False, 0.0, None, 0), (3, False, 0.0, None, 0), (4, False, 0.0, None, 0), (5, True, 1.0, 2, 1),
        (6, True, 1.0, 2, 1), (7, False, 0.0, None, 0), (8, False, 0.0, None, 0), (50, True, 0.55, 1, 1), (51, False, 0.45, 1, 1),
    }
    kept = drop_contaminated(docs, benchmark, block_bytes=block_bytes)
    assert kept.dtypes == docs.dtypes and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, [None, 1, 2, 3, 4, 51, 7, 8]))


@pytest.mark.parametrize("block_bytes", [1 << 20, 64])
def test_all_items_of_a_document_are_told(spark, benchmark, block_bytes):
    text = "The same text, twice the same row. And " + " ".join(f"item{i}" for i in range(12)) + " two words"
    docs = spark.createDataFrame([(1, text), (2, "nothing")], "doc_id long, text string")
    found = {r.doc_id: r for r in decontaminate(docs, benchmark, block_bytes=block_bytes).collect()}
    assert found[1]["items"] == [1, 2, 3] and found[1].contaminated and found[1].item_id == 2
    assert found[2]["items"] == [] and not found[2].contaminated


def test_short_items_match_whole(spark, benchmark):
    docs = spark.createDataFrame([(1, "here are Two words indeed"), (2, "two or three words")], "doc_id long, text string")
    assert {r.doc_id: r.item_id for r in decontaminate(docs, benchmark).collect()} == {1: 3, 2: None}


def test_empty_tables(spark, awkward, nothing, benchmark):
    assert decontaminate(nothing, benchmark).collect() == [] and drop_contaminated(nothing, benchmark).collect() == []
    found = decontaminate(awkward, benchmark.filter("false")).collect()
    assert len(found) == 10 and not any(r.contaminated or r.coverage for r in found)
    assert drop_contaminated(awkward, benchmark.filter("false")).count() == 10


def test_a_repeated_word_stays_bounded():
    """50,000 equal words against an item of 400: a pair of places for each of them would take gigabytes."""
    tracemalloc.start()
    share, name, tiles, covered, _ = Items([(1, "a " * 400), (2, "b " * 3 + "a " * 30)], 5).best("a " * 50_000)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (share, name, tiles, covered) == (1.0, 1, 1, 400) and most < 300 << 20


def test_runs_over_several_stretches(monkeypatch):
    monkeypatch.setattr(tiling, "PAIRS_AT_ONCE", 7)
    for seed in range(8):
        test_tiles_equal_brute_force(seed)
