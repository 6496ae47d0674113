"""Exact deduplication against a persistent digest index, by DataFrame operations alone."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkwell.llm.frames import FILE, ROW, WHITE, keyed, scan_of, without
from inkwell.operators.skew import HOT_ROWS, join_unique
from inkwell.session import stage

BUCKETS = 32


def normal(text: Column) -> Column:
    """The text without any character of `[\\x20\\x09-\\x0D]`; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


class DigestIndex:
    """Digests of all texts seen so far, as a table bucketed and sorted by digest in a folder.

    One row per distinct text: digest, the row that stays (`keep_id`, its code points `keep_chars`,
    `keep_row` within its batch), the number of rows that first batch had, and the batch. Batches
    only append, so a failed load is repeated from its batch. The number of buckets belongs to the
    folder and has to be given again when it is opened; about one for each GB of digests.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.buckets = spark, buckets
        self.name = f"inkwell_digests_{hashlib.sha256(path.encode()).hexdigest()[:24]}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, keep_chars INT, keep_row BIGINT, "
            f"group_size BIGINT, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS "
            f"LOCATION '{path}'"
        )

    def table(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def append(self, groups: DataFrame) -> None:
        """Add the groups (unique digests) whose digest the index does not hold yet.

        A sort-merge anti-join: the stored side is read by buckets and not shuffled.
        """
        new = groups.join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        placed = new.repartition(self.buckets, "digest").sortWithinPartitions("digest")
        placed.select("digest", "keep_id", "keep_chars", "keep_row", "group_size", "batch").write.insertInto(self.name)


def text_rows(scan: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Narrow staged rows: id, digest, code points, a row number, and the place in the scan."""
    text = F.col(f"`{text_col}`")
    rows = keyed(
        scan,
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.unhex(F.sha2(normal(text), 256)).alias("digest"),
        F.length(F.coalesce(text, F.lit(""))).alias("chars"),
    )
    return stage(rows.withColumn("row", F.monotonically_increasing_id()), "digest-rows")


def decide(rows: DataFrame, index: DigestIndex, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The staged rows with keep_id, group_size and kept, after adding their texts to the index.

    Per digest the aggregate keeps one value per task before the shuffle, so a text with a third of
    all rows sends one row per task; the way back to the rows salts such digests.
    """
    batch = uuid.uuid4().hex
    best = F.max(F.struct("chars", (-F.col("id")).alias("minus_id"), (-F.col("row")).alias("minus_row"))).alias("best")
    groups = rows.groupBy("digest").agg(best, F.count(F.lit(1)).alias("group_size"))
    groups = groups.select(
        "digest",
        (-F.col("best.minus_id")).alias("keep_id"),
        F.col("best.chars").alias("keep_chars"),
        (-F.col("best.minus_row")).alias("keep_row"),
        "group_size",
        F.lit(batch).alias("batch"),
    )
    groups = stage(groups, "digest-groups")
    index.append(groups)
    known = index.table().withColumnRenamed("group_size", "first_size")
    own = F.col("batch") == batch
    stays = groups.select("digest", "group_size").join(known.hint("merge"), "digest").select(
        "digest",
        "keep_id",
        F.when(own, F.col("keep_row")).alias("keep_row"),
        (F.col("group_size") + F.when(own, 0).otherwise(F.col("first_size"))).alias("group_size"),
    )
    found = join_unique(rows, stage(stays, "digest-verdicts"), "digest", hot_rows=hot_rows, stable_left=True)
    return found.withColumn("kept", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)))


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per document: its id, keep_id, group_size, kept and text_sha256 (lowercase hex).

    Texts are equal when identical after deleting white space `[\\x20\\x09-\\x0D]`. Of equal texts the
    one with the most code points stays, then the smallest id; a null id loses to any other, and of
    rows equal in all of this one stays. Texts that an earlier batch put into the index keep that
    batch's row, and all their new rows go. Null and empty texts form one group; an empty table gives
    no rows; columns other than the two named are not read.
    """
    found = decide(text_rows(scan_of(docs), id_col, text_col), index, hot_rows)
    return found.select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, without the rows that `exact_dedup` would not keep."""
    scan = scan_of(docs)
    found = decide(text_rows(scan, id_col, text_col), index)
    return without(scan, found.filter(~F.col("kept")).select(FILE, ROW))
