"""Catalog tables: create, load, read, delete and scripts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkwell.operators.skew import broadcast_if_small
from inkwell.session import fresh_path, stage
from inkwell.sources.keyfilter import KeyFilters
from inkwell.sources.schema import require_unique, table_schema


def create_table(
    spark: SparkSession,
    table: str,
    config: list[dict],
    column_key: str = "New_Name",
    rebuild: bool = False,
    location: str | None = None,
) -> None:
    """Create a Parquet table from a configuration if it is missing; optionally drop it first."""
    if rebuild:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table_schema(config, column_key))
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet{where}")


def read_columns(spark: SparkSession, table: str, columns: list[str]) -> DataFrame:
    return spark.table(table).select(*columns)


def sql_query(spark: SparkSession, text: str, args: dict | None = None, **frames: DataFrame) -> DataFrame:
    """Run a query as a frame. Values are bound as :name and frames as {name}, never spliced in."""
    return spark.sql(text, args=args, **frames)


def _in_table_order(spark: SparkSession, df: DataFrame, table: str) -> DataFrame:
    """Columns in the table's order and types: loads go by position."""
    fields = spark.table(table).schema.fields
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def load(
    spark: SparkSession,
    df: DataFrame,
    table: str,
    *,
    overwrite: bool = True,
    keys: list[str] | None = None,
    chunk_rows: int | None = None,
    filters: KeyFilters | None = None,
) -> None:
    """Replace or extend a table. With `keys`, a null or repeated key stops the load first.

    The check groups the batch alone; an append then looks the batch's keys up among the stored ones, which
    are not shuffled while the batch's keys are measured small. With `filters` on the keys only files that may
    hold one of them are read. `chunk_rows` bounds the rows per file.
    """
    ordered = _in_table_order(spark, df, table)
    if keys:
        own = stage(ordered.select(*keys), "load-keys")
        require_unique(own, keys)
        if not overwrite:
            stored = filters.taken(own) if filters else spark.table(table).select(*keys).join(broadcast_if_small(own), keys, "left_semi")
            taken = stored.limit(5).collect()
            if taken:
                raise ValueError(f"key {keys} is already stored: {[r.asDict() for r in taken]}")
    writer = ordered.write.mode("overwrite" if overwrite else "append")
    if chunk_rows:
        writer = writer.option("maxRecordsPerFile", chunk_rows)
    writer.insertInto(table)
    if filters:
        filters.refresh()


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """The rows that a DELETE with this predicate would leave: an unknown outcome keeps the row."""
    return df.filter(~F.coalesce(predicate, F.lit(False)))


def point_at(spark: SparkSession, table: str, version: DataFrame, path: str | None = None) -> str:
    """Write a new version of a table to a folder of its own and let the table point there.

    One write; until the table points at the whole new folder it keeps the old one, which
    readers that have begun can finish. Returns the folder.
    """
    path = path or fresh_path(spark, "table-version")
    version.write.parquet(path)
    spark.sql(f"ALTER TABLE {table} SET LOCATION '{path}'")
    spark.catalog.refreshTable(table)
    return path


def replace_after_delete(spark: SparkSession, table: str, predicate: Column, new_rows: DataFrame) -> str:
    """Delete by predicate, then insert, as a new version of the table. Returns its folder."""
    kept = delete_where(spark.table(table), predicate)
    return point_at(spark, table, kept.unionByName(_in_table_order(spark, new_rows, table)))


def split_statements(script: str) -> list[str]:
    """Statements of a script; semicolons inside quotes and comments do not end one."""
    token = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;", re.S)
    statements, start, kept = [], 0, []
    for match in token.finditer(script):
        text = match.group()
        if text == ";":
            statements.append("".join(kept) + script[start : match.start()])
            start, kept = match.end(), []
        elif text.startswith("--") or text.startswith("/*"):
            kept.append(script[start : match.start()] + " ")
            start = match.end()
    statements.append("".join(kept) + script[start:])
    return [s.strip() for s in statements if s.strip()]


def run_script(spark: SparkSession, script: str) -> None:
    for statement in split_statements(script):
        spark.sql(statement)


def union_runs(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def max_id(df: DataFrame, column: str) -> DataFrame:
    """One row: the largest id, 0 for an empty table."""
    return df.agg(F.coalesce(F.max(column), F.lit(0)).cast("long").alias("Id"))


#: Bytes of files that a task compresses at the highest levels, some tens of seconds of work.
WRITTEN_BYTES = 8 << 20


def write_parquet(df: DataFrame, path: str, level: int = 22, tasks: int | None = None) -> None:
    """Parquet with zstd. High levels cost far more than reading the rows, so few rows are best dealt over `tasks` tasks."""
    frame = df.repartition(tasks) if tasks else df
    frame.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
