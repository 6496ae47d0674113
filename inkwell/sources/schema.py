"""Schemas declared as configuration lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

READ_TYPES: dict[str, T.DataType] = {
    "String": T.StringType(),
    "Integer": T.LongType(),
    "Datetime": T.TimestampNTZType(),
    "Float": T.DoubleType(),
}
TABLE_TYPES: dict[str, T.DataType] = {**READ_TYPES, "Datetime": T.DateType()}


def source_columns(config: list[dict]) -> list[dict]:
    return [c for c in config if not c.get("Source_Exclude", False)]


def read_schema(config: list[dict]) -> T.StructType:
    """What to read: declared, non-excluded columns; unknown type names are strings."""
    return T.StructType(
        [T.StructField(c["Column_Name"], READ_TYPES.get(c["Column_Type"], T.StringType())) for c in source_columns(config)]
    )


def table_schema(config: list[dict], column_key: str = "New_Name") -> T.StructType:
    """What to store: every declared column, datetimes as dates."""
    return T.StructType([T.StructField(c[column_key], TABLE_TYPES.get(c["Column_Type"], T.StringType())) for c in config])


def rename_map(config: list[dict]) -> dict[str, str]:
    return {c["Column_Name"]: c["New_Name"] for c in source_columns(config)}


def key_columns(config: list[dict], column_key: str = "New_Name") -> list[str]:
    return [c[column_key] for c in config if c.get("Primary_Key", False)]


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that are null or occur more than once, with their count."""
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter((F.col("n_rows") > 1) | missing)


def require_unique(df: DataFrame, keys: list[str]) -> None:
    bad = key_violations(df, keys).limit(5).collect()
    if bad:
        raise ValueError(f"key {keys} is null or repeated: {[r.asDict() for r in bad]}")
