"""Key filters against a look-up in the whole table."""

import uuid

import pytest
from pyspark.sql import functions as F

from inkwell.session import fresh_path
from inkwell.sources import keyfilter, tables
from inkwell.sources.keyfilter import KeyFilters


@pytest.fixture
def table(spark):
    name = f"filtered_{uuid.uuid4().hex}"
    tables.create_table(spark, name, [{"Column_Name": "k", "Column_Type": "Integer", "New_Name": "k"}, {"Column_Name": "part", "Column_Type": "String", "New_Name": "part"}], location=fresh_path(spark, "filtered"))
    yield name
    spark.sql(f"DROP TABLE {name}")


def rows(spark, low, high, part="a"):
    return spark.range(low, high).select(F.col("id").cast("int").alias("k"), F.lit(part).alias("part"))


def test_only_files_that_may_hold_a_key_are_read(spark, table):
    filters = KeyFilters(spark, table, ["k", "part"])
    tables.load(spark, rows(spark, 0, 4000).repartitionByRange(20, "k"), table, keys=["k", "part"], filters=filters)
    assert filters.refresh() == 0 and spark.table(table).count() == 4000
    files, total = filters.files_for(rows(spark, 10, 20))
    assert total == 20 and 1 <= len(files) <= 3
    assert sorted(r["k"] for r in filters.taken(rows(spark, 3990, 4010)).collect()) == list(range(3990, 4000))
    assert filters.files_for(rows(spark, 10, 20, "b"))[0] == [] or len(filters.files_for(rows(spark, 10, 20, "b"))[0]) < 3
    assert filters.taken(rows(spark, 5000, 5001)).count() == 0


def test_appends_stop_at_stored_keys_and_filter_new_files(spark, table):
    filters = KeyFilters(spark, table, ["k"])
    for low in (0, 100, 200):
        tables.load(spark, rows(spark, low, low + 100), table, overwrite=False, keys=["k"], filters=filters)
    with pytest.raises(ValueError, match="already stored"):
        tables.load(spark, rows(spark, 299, 310), table, overwrite=False, keys=["k"], filters=filters)
    assert spark.table(table).count() == 300
    tables.load(spark, rows(spark, 0, 50), table, keys=["k"], filters=filters)  # overwriting takes the old filters away
    assert filters.taken(rows(spark, 40, 60)).count() == 10
    tables.load(spark, rows(spark, 290, 310), table, overwrite=False, keys=["k"], filters=filters)
    assert spark.table(table).count() == 70


def test_files_without_filters_and_large_batches(spark, table, monkeypatch):
    filters = KeyFilters(spark, table, ["k"])
    assert filters.files_for(rows(spark, 0, 5)) == ([], 0) and filters.taken(rows(spark, 0, 5)).count() == 0
    tables.load(spark, rows(spark, 0, 100).coalesce(1), table)
    assert filters.taken(rows(spark, 90, 110)).count() == 10  # not filtered yet: read
    filters.refresh()
    monkeypatch.setattr(keyfilter, "is_small", lambda df: False)
    files, total = filters.files_for(rows(spark, 5000, 5001))
    assert len(files) == total == 1


def test_large_files_have_several_filters(spark, table, monkeypatch):
    monkeypatch.setattr(keyfilter, "SLICE_KEYS", 64)
    filters = KeyFilters(spark, table, ["k"])
    tables.load(spark, rows(spark, 0, 1000).coalesce(1), table, keys=["k"], filters=filters)
    assert filters._stored().count() == 16
    assert filters.taken(rows(spark, 0, 1000)).count() == 1000
    wrong = sum(len(filters.files_for(rows(spark, k, k + 1))[0]) for k in range(2000, 2010))
    assert wrong <= 3


def test_null_keys_are_not_found(spark, table):
    filters = KeyFilters(spark, table, ["k"])
    nulls = spark.createDataFrame([(None, "x"), (1, "y")], "k int, part string")
    tables.load(spark, nulls, table)
    filters.refresh()
    assert [r["k"] for r in filters.taken(nulls).collect()] == [1]
