"""A text index is dealt by term once: counts alone are staged, and the blocks of a term lie in one file, with equal frequencies."""

from collections import Counter

from pyspark.sql import functions as F

from inkwell.operators import textindex
from inkwell.session import fresh_path, stage


def test_postings_are_dealt_once(spark, monkeypatch):
    texts = [(i, f"common w{i % 7} x{i % 11} w{i % 7}") for i in range(300)]
    docs, staged = spark.createDataFrame(texts, "doc long, body string"), []
    monkeypatch.setattr(textindex, "stage", lambda df, label: staged.append(label) or stage(df, label))
    path = fresh_path(spark, "text-index")
    textindex.TextIndex.create(spark, path, docs, "doc", "body", range_docs=8)
    assert staged == ["text-index-counts"]
    rows = spark.read.parquet(f"{path}/postings").select("term", "bucket", "docs", F.col("_metadata.file_path").alias("file")).collect()
    assert all(len({r["file"] for r in rows if r["term"] == t}) == 1 for t in {r["term"] for r in rows})
    expected = Counter(t for _, text in texts for t in set(text.split()))
    assert {r["term"]: r["df"] for r in spark.read.parquet(f"{path}/terms").collect()} == expected
    held = Counter()
    for r in rows:
        held[r["term"]] += len(r["docs"])
    assert held == expected
    assert {r["term"]: r["bucket"] for r in rows} == {r["term"]: r["bucket"] for r in spark.read.parquet(f"{path}/terms").collect()}
