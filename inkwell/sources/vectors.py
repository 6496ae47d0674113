"""Vector records and vector tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkwell.operators.skew import broadcast_if_small
from inkwell.session import stage
from inkwell.sources.tables import point_at


def vector_record(record_id: Column, values: Column, metadata: dict[str, Column]) -> list[Column]:
    """The columns of a vector record: id as text, values, and text metadata."""
    pairs = [part for name, value in metadata.items() for part in (F.lit(name), value.cast("string"))]
    return [
        record_id.cast("string").alias("id"),
        values.cast("array<float>").alias("values"),
        F.create_map(*pairs).alias("metadata"),
    ]


def latest_per_id(batch: DataFrame, order_col: str) -> DataFrame:
    """Last write per id. A partial aggregate keeps one row per id and task before the shuffle.

    A null order comes before any other; of equal orders the record whose JSON text has the larger md5 stays.
    """
    rest = [c for c in batch.columns if c not in ("id", order_col)]
    order = F.struct(F.col(order_col).isNotNull(), F.col(order_col), F.md5(F.to_json(F.struct(*rest))))
    return batch.groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("_last")).select("id", *[F.col(f"_last.{c}").alias(c) for c in rest])


def upsert(stored: DataFrame, batch: DataFrame, order_col: str) -> DataFrame:
    """The stored records with the batch written over them by id."""
    latest = latest_per_id(batch, order_col)
    kept = stored.join(broadcast_if_small(batch.select("id").distinct()), "id", "left_anti")
    return kept.select(*stored.columns).unionByName(latest.select(*stored.columns))


def upsert_table(spark: SparkSession, table: str, batch: DataFrame, order_col: str) -> str:
    """Write a batch over a stored vector table as its next version. Returns the folder."""
    return point_at(spark, table, upsert(spark.table(table), stage(batch, "vector-batch"), order_col))


def wrong_dimension(df: DataFrame, dim: int, values_col: str = "values") -> DataFrame:
    """Records that an index of this dimension refuses: no vector, wrong length, or a null inside."""
    values = F.col(values_col)
    bad = values.isNull() | (F.size(values) != dim) | F.exists(values, lambda x: x.isNull())
    return df.filter(F.coalesce(bad, F.lit(True)))


def rebuild_vectors(df: DataFrame, path: str, dim: int, values_col: str = "values") -> None:
    """Overwrite a vector table; any refused record stops the rebuild."""
    refused = wrong_dimension(df, dim, values_col).limit(1).count()
    if refused:
        raise ValueError(f"records without a full vector of dimension {dim}")
    df.write.mode("overwrite").parquet(path)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for a zero vector."""
    x, y = a.cast("array<double>"), b.cast("array<double>")

    def dot(u: Column, v: Column) -> Column:
        return F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda acc, p: acc + p)

    norm = F.sqrt(dot(x, x) * dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm)
