"""Reuse of costly computed columns, keyed by the content they were computed from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from inkwell.operators.skew import HOT_ROWS, broadcast_if_small, join_unique


def with_content_key(df: DataFrame, text_col: str, key_col: str = "content_key") -> DataFrame:
    return df.withColumn(key_col, F.md5(F.col(text_col)))


def missing_from_cache(df: DataFrame, cache: DataFrame, text_col: str) -> DataFrame:
    """Distinct texts without a cached value: (content_key, text).

    Copies of a text collapse before the shuffle, so a text that fills a third of the table is
    one row per task.
    """
    texts = df.filter(F.col(text_col).isNotNull()).select(text_col)
    distinct = with_content_key(texts, text_col).select("content_key", text_col).distinct()
    return distinct.join(broadcast_if_small(cache.select("content_key")), "content_key", "left_anti")


def one_per_key(cache: DataFrame) -> DataFrame:
    """One row per key: the smallest of its values, should two runs have appended the same key."""
    values = [c for c in cache.columns if c != "content_key"]
    picked = cache.groupBy("content_key").agg(F.min(F.struct(*values)).alias("_value"))
    return picked.select("content_key", *[F.col("_value").getField(c).alias(c) for c in values])


def compute_or_reuse(
    df: DataFrame,
    text_col: str,
    cache_path: str,
    compute: Callable[[DataFrame], DataFrame],
    hot_rows: int = HOT_ROWS,
    tasks: int | None = None,
) -> DataFrame:
    """Attach the cached column to every row, computing and appending only what is missing.

    `compute` takes (content_key, text) rows and returns (content_key, <value columns>). The missing texts
    are dealt over `tasks` tasks (four for each core by default): an explicit number, which adaptive execution
    does not merge however small the texts are.
    """
    spark = df.sparkSession
    empty = compute(with_content_key(df.limit(0), text_col).select("content_key", text_col))
    schema = empty.schema
    empty.write.mode("append").parquet(cache_path)
    cache = spark.read.schema(schema).parquet(cache_path)
    missing = missing_from_cache(df, cache, text_col).repartition(tasks or 4 * spark.sparkContext.defaultParallelism)
    compute(missing).write.mode("append").parquet(cache_path)
    filled = one_per_key(spark.read.schema(schema).parquet(cache_path))
    return join_unique(with_content_key(df, text_col), filled, "content_key", "left", hot_rows=hot_rows).drop("content_key")
