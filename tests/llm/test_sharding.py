import zlib
from collections import Counter

import pytest

from inkwell.llm.sharding import _accepted, propagate, shard_documents


def check_law(found, total, shards):
    counts = Counter(r.shard for r in found)
    assert len(found) == total and max(counts.values()) - min(counts[s] for s in range(shards)) <= 1
    for shard, n in counts.items():
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(n))


def test_awkward_documents(awkward):
    found = shard_documents(awkward, shards=4, hot_rows=2).collect()
    check_law(found, 10, 4)
    texts = Counter((r.doc_id, r.text or "") for r in awkward.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter(
        {(i, len(t.encode()) + 1, zlib.crc32(t.encode())): n for (i, t), n in texts.items()}
    )
    assert {r.law for r in found} == {"rows"} and {r.grown_shard for r in found} == {None}


def test_small_groups_stay_together(spark):
    rows = [(i, f"text {i % 120}" if i < 360 else f"single {i}") for i in range(1000)]
    found = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).collect()
    check_law(found, 1000, 8)
    places = {}
    for r in found:
        if r.doc_id < 360:
            places.setdefault(r.doc_id % 120, set()).add(r.shard)
    assert sum(len(s) > 1 for s in places.values()) <= 7


def test_group_larger_than_a_shard_fills_few(spark):
    rows = [(i, "hot" if i < 400 else f"single {i}") for i in range(1200)]
    found = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=12, hot_rows=50).collect()
    check_law(found, 1200, 12)
    assert len({r.shard for r in found if r.doc_id < 400}) <= 8


def test_nodes_in_several_groups_follow_the_majority(spark):
    links = spark.createDataFrame([(n, g) for g in range(3) for n in range(10)], "node long, grp int")
    assert propagate(links, 100, shards=4, rounds=8).select("shard").distinct().count() == 1


def test_quotas_bound_moves():
    shares = _accepted({(0, 1): 10, (1, 0): 4, (2, 1): 10}, [5, 8, 5], 12)
    assert shares[0 * 3 + 1] * 10 + shares[2 * 3 + 1] * 10 <= 4 + 4 + 1e-9 and shares[1 * 3 + 0] == 1.0


def test_empty_table(nothing):
    assert shard_documents(nothing).collect() == []


@pytest.mark.parametrize("shards", [1, 3])
def test_few_documents(spark, shards):
    found = shard_documents(spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string"), shards=shards).collect()
    check_law(found, 2, shards)
