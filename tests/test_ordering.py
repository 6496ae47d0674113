import hashlib

import pytest
from pyspark.sql import functions as F

from inkwell.operators import ordering
from inkwell.operators.skew import hot_keys, is_small, join_unique, salted
from inkwell.session import stage
from inkwell.session import fresh_path


def by_hash(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_dense_index(spark, parts):
    # one value of the leading column holds a third of the rows
    frame = spark.range(1000).repartition(parts).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("a"), "id")
    rows = ordering.dense_index(frame, ["a", "id"], "n", 5).collect()
    ordered = sorted(rows, key=lambda r: (r["a"], r["id"]))
    assert [r["n"] for r in ordered] == list(range(5, 1005))


def test_dense_index_empty(spark):
    assert ordering.dense_index(spark.range(0), ["id"], "n").count() == 0


def test_scan_index_over_files_and_filter(spark):
    path = fresh_path(spark, "indexed")
    spark.range(0, 1000, 1, 5).write.parquet(path)
    frame = spark.read.parquet(path)
    indexed = ordering.scan_with_row_index(frame)
    assert sorted(r["Id"] for r in indexed.collect()) == list(range(1, 1001))
    kept = ordering.scan_with_row_index(frame, "Row").filter("id >= 500").collect()
    known = {r["id"]: r["Row"] for r in ordering.scan_with_row_index(frame, "Row").collect()}
    assert len(kept) == 500 and all(known[r["id"]] == r["Row"] for r in kept)


@pytest.mark.parametrize("settled", [100_000, 20])
def test_exact_sample(spark, monkeypatch, settled):
    monkeypatch.setattr(ordering, "SETTLED_ROWS", settled)
    frame = spark.range(5000)
    rows = [r["id"] for r in ordering.exact_sample(frame, "id", 300, 3825).collect()]
    assert sorted(rows) == sorted(by_hash(range(5000), 3825)[:300])
    again = [r["id"] for r in ordering.exact_sample(frame.repartition(13), "id", 300, 3825).collect()]
    assert sorted(again) == sorted(rows)


def test_sample_limits(spark):
    with pytest.raises(ValueError):
        ordering.exact_sample(spark.range(5), "id", 6, 1)
    assert ordering.seeded_limit(spark.range(5), "id", 6, 1).count() == 5
    assert ordering.seeded_limit(spark.range(5), "id", 0, 1).count() == 0
    assert ordering.seeded_limit(spark.range(0), "id", 3, 1).count() == 0


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 1003])
def test_split(spark, n):
    labels = {r["id"]: r["DataSplit"] for r in ordering.train_val_test_split(spark.range(n), "id", 42).collect()}
    order = by_hash(range(n), 42)
    train, val = int(0.8 * n), int(0.1 * n)
    expected = {i: "Training" if p < train else "Validation" if p < train + val else "Testing" for p, i in enumerate(order)}
    assert labels == expected


@pytest.mark.parametrize("settled", [100_000, 10])
def test_holdout(spark, monkeypatch, settled):
    monkeypatch.setattr(ordering, "SETTLED_ROWS", settled)
    monkeypatch.setattr(ordering, "SLICES", 16)
    ids = [i * i - 500 for i in range(400)]
    frame = spark.createDataFrame([(i,) for i in ids], "id long")
    for n in (1, 37, 400, 500):
        corpus, tail = ordering.holdout(frame, "id", n)
        assert sorted(r["id"] for r in tail.collect()) == sorted(ids)[-n:]
        assert corpus.count() == max(0, 400 - n)
    corpus, tail = ordering.holdout(frame, "id", 0)
    assert corpus.count() == 400 and tail.count() == 0


def test_null_ids_are_in_the_corpus_or_refused(spark):
    frame = spark.createDataFrame([(1,), (2,), (None,), (3,)], "id long")
    corpus, tail = ordering.holdout(frame, "id", 1)
    assert sorted(str(r["id"]) for r in corpus.collect()) == ["1", "2", "None"] and [r["id"] for r in tail.collect()] == [3]
    for draw in (lambda: ordering.exact_sample(frame, "id", 1, 1), lambda: ordering.seeded_limit(frame, "id", 1, 1), lambda: ordering.train_val_test_split(frame, "id", 1)):
        with pytest.raises(ValueError, match="null id"):
            draw()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_join_with_hot_key(spark, how, broadcast_rows):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") % 40).cast("long").alias("k"), "id")
    right = spark.range(0, 40, 2).union(spark.range(1, 2)).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    expected = sorted(left.join(right, "k", how).collect(), key=str)
    found = join_unique(left, right, "k", how, max_broadcast_rows=broadcast_rows, hot_rows=100)
    assert sorted(found.collect(), key=str) == expected


def test_salts_follow_the_count_of_each_key(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    hot = {r["_hot_hash"]: r["_salts"] for r in hot_keys(left, ["k"], 100).collect()}
    assert list(hot.values()) == [10]


def test_equal_rows_spread_over_salts(spark):
    left = stage(spark.range(1000).select(F.lit(1).alias("k"), F.lit("same").alias("v")), "equal-rows")
    found = salted(left, hot_keys(left, ["k"], 100), ["k"]).groupBy("_salt").count().collect()
    assert len(found) == 10 and max(r["count"] for r in found) <= 200


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_hot_and_null_keys_join_once(spark, how):
    left = spark.createDataFrame([(1, i) for i in range(500)] + [(None, i) for i in range(300)] + [(2, 0), (3, 0)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, w string")
    found = join_unique(left, right, "k", how, max_broadcast_rows=0, hot_rows=100)
    assert found.count() == {"inner": 501, "left": 802, "left_semi": 501}[how]
    assert found.filter("k = 1").distinct().count() == 500


@pytest.mark.parametrize("value", ["map('k', repeat('x', 100000))", "array(repeat('x', 100000))", "named_struct('a', named_struct('b', repeat('x', 100000)))", "array(map(1, repeat('x', 100000)))"])
def test_nested_values_are_measured(spark, value):
    assert not is_small(spark.range(1).selectExpr(f"{value} AS v"), max_bytes=50_000)
    assert is_small(spark.range(1).selectExpr(f"{value} AS v"), max_bytes=200_000)
