import pytest
from pyspark.sql import functions as F

from inkwell.llm.frames import FILE, ROW, ascii_lower, keyed, scan_of, without
from inkwell.llm.words import text_slices, word_blocks
from inkwell.session import stage

import pyarrow as pa


def test_scans_are_read_in_place_and_mixed_frames_are_staged(spark):
    scan = stage(spark.range(20).withColumn("text", F.lit("x")), "test-scan")
    other = stage(spark.range(5), "test-other")
    assert scan_of(scan) is scan and scan_of(scan.filter("id > 3")).count() == 16
    for mixed in (scan.union(scan), scan.join(other.withColumnRenamed("id", "k"), F.col("id") % 5 == F.col("k")), scan.withColumn("e", F.explode(F.array(F.lit(1), F.lit(2)))), spark.range(3)):
        rows = keyed(scan_of(mixed))
        assert rows.distinct().count() == rows.count() == mixed.count()


@pytest.mark.parametrize("column", ["id", FILE.strip("_")])
def test_without_drops_rows_by_place(spark, column):
    rows = [(1, "a"), (1, "a"), (None, None), (None, None), (2, "b")]
    scan = stage(spark.createDataFrame(rows, f"`{column}` long, text string"), "test-scan")
    marked = keyed(scan, F.col("text")).groupBy("text").agg(F.max(F.struct(FILE, ROW)).alias("last")).select(f"last.{FILE}", f"last.{ROW}")
    found = without(scan, marked)
    assert found.columns == scan.columns and sorted(map(str, (tuple(r) for r in found.collect()))) == ["(1, 'a')", "(None, None)"]


def test_ascii_lower(spark):
    assert spark.createDataFrame([("AbÉZ İ",)], "t string").select(ascii_lower(F.col("t"))).first()[0] == "abÉz İ"


def test_words_and_slices(monkeypatch):
    monkeypatch.setattr("inkwell.llm.words.BLOCK_BYTES", 5)
    text = "One  two\tthree\x0bfour\x85five six é" + "x" * 50
    assert [w for b in word_blocks(text) for w in b] == text.encode().lower().split()
    assert list(word_blocks(None)) == list(word_blocks("")) == []
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 4, None, "b" * 9, "", "c" * 3, "d" * 3]})
    assert [b.num_rows for b in text_slices(iter([batch]), "text", 6)] == [2, 1, 3]
    assert list(text_slices(iter([batch.slice(0, 0)]), "text")) == []
