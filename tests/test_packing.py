"""Packing of records into sequences."""

import random

import pytest
from hypothesis import given, settings, strategies as st

from inkwell.operators.packing import first_fit, pack, token_counts

from pyspark.sql import functions as F


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80), st.integers(50, 90), st.integers(1, 9))
def test_first_fit_fills_no_bin_over_the_limit(sizes, limit, most_open):
    chosen, fills = first_fit(sizes, limit, most_open)
    assert len(chosen) == len(sizes) and all(f <= limit for f in fills)
    assert [sum(s for s, b in zip(sizes, chosen) if b == k) for k in range(len(fills))] == fills


@pytest.mark.parametrize("parts, carried", [(1, 10_000), (7, 10_000), (20, 40)])
def test_every_record_once_and_well_filled(spark, parts, carried):
    random.seed(parts)
    rows = [(k, random.randint(1, 900), "x") for k in range(3000)] + [(9001, 5000, "too long"), (9002, None, "none"), (9003, 0, "empty"), (9004, 2048, "full")]
    records = spark.createDataFrame(rows, "Id long, n int, item string").repartition(parts)
    found = pack(records, "Id", "n", 2048, carried=carried).collect()
    assert sorted(r["Id"] for r in found) == sorted(r[0] for r in rows) and found[0]["item"]
    sequences = {}
    for r in found:
        if r["Id"] in (9001, 9002):
            assert r["sequence"] is None and r["place"] is None
        else:
            sequences.setdefault(r["sequence"], []).append(r)
    for own in sequences.values():
        total = sum(r["n"] for r in own)
        assert total <= 2048 and {r["sequence_tokens"] for r in own} == {total}
        assert sorted(r["place"] for r in own) == list(range(1, len(own) + 1))
    used = sum(r["n"] for own in sequences.values() for r in own)
    assert used / (2048 * len(sequences)) > (0.93 if carried > 1000 else 0.85)


def test_empty_tables_and_counts(spark):
    empty = spark.createDataFrame([], "Id long, n int")
    assert pack(empty, "Id", "n", 10).count() == 0
    texts = spark.createDataFrame([("a b",), (None,), ("",)], "t string")
    counted = texts.select(token_counts(F.col("t"), lambda: lambda values: [len(v.split()) for v in values]).alias("n")).collect()
    assert [r["n"] for r in counted] == [2, 0, 0]
