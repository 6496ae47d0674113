"""Record files that arrive in a folder, written over a stored vector index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from inkwell.operators.vectorindex import VectorIndex
from inkwell.sources.vectors import latest_per_id


def arrivals(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files of a folder, each read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _done(index: VectorIndex) -> DataFrame:
    return index.spark.read.schema("stream string, batch long").parquet(f"{index.path}/batches")


def _is_done(index: VectorIndex, stream: str, batch: int) -> bool:
    folder = index.spark._jvm.org.apache.hadoop.fs.Path(f"{index.path}/batches")
    if not folder.getFileSystem(index.spark._jsc.hadoopConfiguration()).exists(folder):
        return False
    return not _done(index).filter((F.col("stream") == stream) & (F.col("batch") == batch)).isEmpty()


def upsert_stream(records: DataFrame, index: VectorIndex, checkpoint: str, order_col: str, stream: str = "records") -> StreamingQuery:
    """Start writing all records that are there over the index, batch by batch, and then stop by itself.

    Of records with one id in a batch the one of the largest `order_col` stays; later batches win over earlier ones.
    A finished batch is noted beside the index by its number, so one that comes again after a restart is not
    written twice; one that broke off is written again, which an upsert allows. State is in the checkpoint: the next
    start goes on where this one ended.
    """

    def write(batch: DataFrame, number: int) -> None:
        if _is_done(index, stream, number) or batch.isEmpty():
            return
        index.upsert(latest_per_id(batch, order_col))
        note = index.spark.createDataFrame([(stream, number)], "stream string, batch long")
        note.coalesce(1).write.mode("append").parquet(f"{index.path}/batches")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
