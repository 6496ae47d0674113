"""Bloom filters of a table's keys, one per file, kept beside the table."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkwell.operators.skew import broadcast_if_small, is_small
from inkwell.session import stage

HASHES = 6
BITS_PER_KEY = 12
#: Keys of a file that share one filter; a larger file has several, told apart by a hash of the key.
SLICE_KEYS = 1 << 20
SCHEMA = "file string, slice int, slices int, bits long, entries array<struct<word:long,bits:long>>"


def _name(path: str) -> str:
    """A file's path without scheme and escapes, as Spark gives both."""
    return unquote(urlparse(path).path)


def _hash(keys: list[str], number: int) -> Column:
    return F.xxhash64(*keys, F.lit(number))


class KeyFilters:
    """Filters of one table's key columns, in `_keys` inside its folder, where readers of the table do not look."""

    def __init__(self, spark: SparkSession, table: str, keys: list[str]) -> None:
        self.spark, self.table, self.keys = spark, table, list(keys)
        described = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter("col_name = 'Location'").first()
        self.folder = f"{described['data_type'].rstrip('/')}/_keys"

    def _stored(self) -> DataFrame:
        """The filters so far; of a file that was filtered twice, as by a broken-off run, both say the same."""
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.folder)
        except AnalysisException:
            return self.spark.createDataFrame([], SCHEMA)

    def _files(self) -> dict[str, str]:
        return {_name(f): f for f in self.spark.table(self.table).inputFiles()}

    def _asked(self, batch: DataFrame) -> DataFrame:
        """The batch's keys in the table's types, as hashes of equal numbers of other types differ."""
        kinds = dict(self.spark.table(self.table).dtypes)
        return batch.select(*[F.col(k).cast(kinds[k]).alias(k) for k in self.keys])

    def refresh(self) -> int:
        """Filter the files that have no filter yet; returns how many. Filters of files that are gone are never asked."""
        self.spark.catalog.refreshTable(self.table)
        files = self._files()
        known = {_name(r["file"]) for r in self._stored().select("file").distinct().collect()}  # one row per file
        new = sorted(path for name, path in files.items() if name not in known)
        if new:
            self._filtered(self.spark.read.parquet(*new)).write.mode("append").parquet(self.folder)
        return len(new)

    def _filtered(self, rows: DataFrame) -> DataFrame:
        """(file, slice, slices, bits, entries): bits are set by a distributed or over the hashes of the keys."""
        keyed = rows.select(F.col("_metadata.file_path").alias("file"), *self.keys)
        # one row per file
        sizes = stage(keyed.groupBy("file").agg(F.count(F.lit(1)).alias("n")), "key-files")
        slices = F.ceil(F.col("n") / SLICE_KEYS).cast("int")
        bits = F.ceil(F.col("n") / slices * BITS_PER_KEY / 64).cast("long") * 64
        shape = broadcast_if_small(sizes.select("file", slices.alias("slices"), bits.alias("bits")))
        own = F.pmod(_hash(self.keys, HASHES), F.col("slices")).cast("int").alias("slice")
        places = F.explode(F.array(*[F.pmod(_hash(self.keys, k), F.col("bits")) for k in range(HASHES)])).alias("place")
        set_bits = keyed.join(shape, "file").select("file", "slices", "bits", own, places)
        word, bit = F.floor(F.col("place") / 64).alias("word"), F.expr("shiftleft(1L, cast(place % 64 AS int))")
        words = set_bits.groupBy("file", "slice", "slices", "bits", word).agg(F.bit_or(bit).alias("set"))
        return words.groupBy("file", "slice", "slices", "bits").agg(F.collect_list(F.struct("word", F.col("set").alias("bits"))).alias("entries")).select(
            "file", "slice", "slices", "bits", "entries"
        )

    def files_for(self, batch: DataFrame) -> tuple[list[str], int]:
        """(files that may hold a key of the batch, files in all). Files without a filter may hold any.

        A batch that is too large to be looked up filter by filter may be anywhere.
        """
        files = self._files()
        asked = stage(self._asked(batch).select(*[_hash(self.keys, k).alias(f"h{k}") for k in range(HASHES + 1)]).distinct(), "key-hashes")
        if not is_small(asked):
            return sorted(files.values()), len(files)
        hashes = np.stack([c.to_numpy() for c in asked.toArrow().columns], axis=1).reshape(-1, HASHES + 1)
        shared = self.spark.sparkContext.broadcast(hashes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for part in batches:
                names, hits = part.column("file").to_pylist(), []
                for k, (number, slices, bits) in enumerate(zip(*(part.column(c).to_pylist() for c in ("slice", "slices", "bits")))):
                    entries = part.column("entries")[k].values
                    words = np.zeros(bits // 64, np.uint64)
                    words[entries.field("word").to_numpy()] = entries.field("bits").to_numpy().view(np.uint64)
                    chosen = own[np.mod(own[:, HASHES], slices) == number, :HASHES]
                    place = np.mod(chosen, bits)
                    is_set = words[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)
                    hits.append(bool(is_set.all(axis=1).any()))
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(hits, pa.bool_())], names=["file", "hit"])

        found = self._stored().mapInArrow(run, "file string, hit boolean").groupBy("file").agg(F.max("hit").alias("hit")).collect()
        told = {_name(r["file"]): r["hit"] for r in found}
        return sorted(path for name, path in files.items() if told.get(name, True)), len(files)

    def taken(self, batch: DataFrame) -> DataFrame:
        """The keys of the batch that are stored, from the files that may hold one; equal to a look-up in the whole table."""
        asked = stage(self._asked(batch), "key-batch")
        files, _ = self.files_for(asked)
        stored = self.spark.table(self.table).select(*self.keys)
        if not files:
            return stored.filter(F.lit(False))
        read = self.spark.read.schema(self.spark.table(self.table).schema).parquet(*files).select(*self.keys)
        return read.join(broadcast_if_small(asked), self.keys, "left_semi")
