"""Typed Parquet scans driven by a configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.operators.ordering import scan_with_row_index
from inkwell.sources.schema import read_schema, rename_map


def scan_typed(spark: SparkSession, path: str, config: list[dict]) -> DataFrame:
    """Read only the declared columns, with the declared types."""
    return spark.read.schema(read_schema(config)).parquet(path)


def scan_renamed(spark: SparkSession, path: str, config: list[dict]) -> DataFrame:
    return scan_typed(spark, path, config).withColumnsRenamed(rename_map(config))


def scan_indexed(spark: SparkSession, path: str, config: list[dict], index_col: str = "Id") -> DataFrame:
    """Typed scan whose rows are numbered from 1 in file order before any filter, then renamed."""
    return scan_with_row_index(scan_typed(spark, path, config), index_col).withColumnsRenamed(rename_map(config))
