"""Costly writes are dealt over all cores."""

from __spark_entry__ import queries
from inkwell.operators.skew import tasks_of_scan


def test_a_file_of_one_row_group_is_compressed_by_more_than_one_task(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert given.rdd.getNumPartitions() == 1
    written = queries()["parquet_roundtrip"](spark, "/root/testdata/sf0.001")
    assert len(written.inputFiles()) == min(given.count(), spark.sparkContext.defaultParallelism)
    assert written.exceptAll(given).isEmpty() and given.exceptAll(written).isEmpty()


def test_large_scans_get_a_task_for_so_many_bytes(spark):
    given = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    assert tasks_of_scan(given, 100_000) > 100
