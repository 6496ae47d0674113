"""Learned vectors: texts are coded once, and the passes add up the coded rows."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from inkwell.operators import lsa


def test_texts_are_read_twice_whatever_the_passes(spark):
    """Weights and coding read the texts; the passes read the coded rows, in parts of any size, with equal results."""
    reads, made = spark.sparkContext.accumulator(0), []

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        reads.add(len(texts))
        return texts

    texts = [(k, None if k == 7 else " ".join(f"w{k * j % 23}" for j in range(k % 9))) for k in range(60)]
    docs = spark.createDataFrame(texts, "doc long, text string").coalesce(1).withColumn("text", read.asNondeterministic()("text"))
    for passes in (1, 4):
        before = reads.value
        lsa.fit(docs, "text", 4, passes=passes)
        made.append(reads.value - before)
    assert made[0] == made[1] > 0


def test_coded_rows_add_up_in_parts(monkeypatch):
    draw = np.random.default_rng(3)
    lists = [draw.choice(12, draw.integers(1, 6), replace=False).tolist() for _ in range(20)]
    times = [draw.integers(1, 4, len(x)).tolist() for x in lists]
    batch = pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int32())) for x in (lists, times)], names=["term", "times"]).slice(2, 17)
    weights, directions, matrix = draw.random(12) + 1, draw.standard_normal((12, 5)), np.zeros((17, 12))
    for k, (x, n) in enumerate(zip(lists[2:19], times[2:19])):
        matrix[k, x] = np.array(n) * weights[x]
    matrix /= np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    for part in (1, 36, 4_000_000):
        monkeypatch.setattr(lsa, "PART_CELLS", part)
        total = np.zeros((12, 5))
        lsa.add_rows(total, batch, weights, directions)
        assert np.allclose(total, matrix.T @ matrix @ directions, atol=1e-12)
