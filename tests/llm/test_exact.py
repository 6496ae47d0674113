import hashlib

from inkwell.llm.exact import DigestIndex, drop_exact_copies, exact_dedup
from inkwell.session import fresh_path


def index(spark):
    return DigestIndex(spark, fresh_path(spark, "test-index"), buckets=4)


def bare(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\f\r")


def test_rows_of_awkward_documents(spark, awkward):
    found = exact_dedup(awkward, index(spark), hot_rows=2).collect()
    assert len(found) == 10
    by_hash = {}
    for row in awkward.select("doc_id", "text").collect():
        by_hash.setdefault(hashlib.sha256(bare(row.text).encode()).hexdigest(), []).append((-len(row.text or ""), row.doc_id is None, row.doc_id))
    for row in found:
        group = sorted(by_hash[row.text_sha256])
        assert (row.keep_id, row.group_size) == (group[0][2], len(group))
    assert sum(r.kept for r in found) == len(by_hash)
    assert [r.kept for r in found if r.doc_id in (1, 2, 3)].count(True) == 1


def test_longest_then_smallest_id_stays(spark):
    docs = spark.createDataFrame([(9, "a b"), (3, "ab"), (7, "a b"), (None, "a  b"), (None, "ab ")], "doc_id long, text string")
    found = exact_dedup(docs, index(spark)).collect()
    assert {r.keep_id for r in found} == {None} and sum(r.kept for r in found) == 1
    found = exact_dedup(docs.dropna(), index(spark)).collect()
    assert {r.keep_id for r in found} == {7} and [r.doc_id for r in found if r.kept] == [7]


def test_second_batch_meets_the_first(spark):
    seen = index(spark)
    first = spark.createDataFrame([(1, "one"), (2, "two"), (3, "two")], "doc_id long, text string")
    second = spark.createDataFrame([(4, "t w o"), (5, "three")], "doc_id long, text string")
    exact_dedup(first, seen).collect()
    found = {r.doc_id: r for r in exact_dedup(second, seen).collect()}
    assert (found[4].kept, found[4].keep_id, found[4].group_size) == (False, 2, 3)
    assert found[5].kept and seen.table().count() == 3
    again = DigestIndex(spark, spark.sql(f"DESCRIBE EXTENDED {seen.name}").filter("col_name = 'Location'").first()[1], buckets=4)
    assert again.table().count() == 3


def test_stored_side_is_not_shuffled(spark):
    seen = index(spark)
    exact_dedup(spark.createDataFrame([(1, "one")], "doc_id long, text string"), seen).collect()
    groups = spark.createDataFrame([(bytearray(b"x"),)], "digest binary").repartition(4, "digest")
    plan = groups.join(seen.table().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    stored = plan[plan.index("SortMergeJoin") :].split("FileScan")[0].rsplit("+- Sort", 1)[1]
    assert "Bucketed: true" in plan and "Exchange" not in stored


def test_empty_table(spark, nothing):
    assert exact_dedup(nothing, index(spark)).collect() == []
    assert drop_exact_copies(nothing, index(spark)).columns == nothing.columns


def test_all_columns_stay(spark, awkward):
    found = drop_exact_copies(awkward, index(spark))
    assert found.dtypes == awkward.dtypes and found.count() == 7
