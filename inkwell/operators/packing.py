"""Records packed into sequences of at most so many tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from inkwell.operators.skew import join_unique
from inkwell.session import stage

#: Sequences that a task keeps open; the fullest is closed when there is one more.
OPEN = 64
#: Sequences left open that one task packs together.
CARRIED = 10_000

Counter = Callable[[list[str]], list[int]]


def token_counts(text: Column, make_counter: Callable[[], Counter], batch_size: int = 1000) -> Column:
    """Tokens of each text by an injected counter, made once per task; null texts have none."""

    @F.arrow_udf("int")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = make_counter()
        for texts in batches:
            values = [t or "" for t in texts.to_pylist()]
            yield pa.array([n for at in range(0, len(values), batch_size) for n in counter(values[at : at + batch_size])], pa.int32())

    return count(text)


def first_fit(sizes: list[int], limit: int, most_open: int) -> tuple[list[int], list[int]]:
    """(bin of each item, fill of each bin): an item goes to the first open bin with room, else to a new one."""
    chosen, fills, still = [], [], []
    for size in sizes:
        at = next((b for b in still if fills[b] + size <= limit), None)
        if at is None:
            at = len(fills)
            fills.append(0)
            still.append(at)
        fills[at] += size
        chosen.append(at)
        if fills[at] == limit:
            still.remove(at)
        elif len(still) > most_open:
            still.remove(max(still, key=lambda b: fills[b]))
    return chosen, fills


def _binned(rows: DataFrame, limit: int, most_open: int, largest_first: bool) -> DataFrame:
    """(item, size, bin, fill so far of the bin at the end) of rows (item, size), each task by itself, staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 40
        taken = list(batches)  # numbers alone
        items = [i for b in taken for i in b.column("item").to_pylist()]
        sizes = np.array([s for b in taken for s in b.column("size").to_pylist()], np.int64)
        order = np.argsort(-sizes, kind="stable") if largest_first else np.arange(len(sizes))
        chosen, fills = first_fit(sizes[order].tolist(), limit, most_open)
        yield pa.RecordBatch.from_arrays(
            [pa.array([items[k] for k in order], pa.int64()), pa.array(sizes[order]), pa.array(np.array(chosen, np.int64) + task), pa.array(np.array(fills, np.int64)[chosen] if chosen else np.zeros(0, np.int64))],
            names=["item", "size", "bin", "fill"],
        )

    return stage(rows.select("item", "size").mapInArrow(run, "item long, size long, bin long, fill long"), "packing")


def pack(records: DataFrame, id_col: str, tokens_col: str, limit: int, carried: int = CARRIED, most_open: int = OPEN) -> DataFrame:
    """Records (unique ids) with `sequence`, `place` in it (from 1) and `sequence_tokens`.

    Every task packs its records by first fit. Sequences that are not nearly full are then packed together as wholes,
    `carried` of them in a task, largest first, until one task can hold what is left; so no task ever sees more than its share of the
    records or `carried` sequences. Records over the limit, or without a count, have no sequence.
    """
    numbered = stage(records.withColumn("_item", F.monotonically_increasing_id()), "packing-records")
    size = F.greatest(F.col(tokens_col).cast("long"), F.lit(0))
    fitting = numbered.filter(F.col(tokens_col) <= limit).select(F.col("_item").alias("item"), size.alias("size"))
    placed = _binned(fitting, limit, most_open, largest_first=False).select("item", "size", F.col("bin").alias("sequence"), "fill")
    while True:
        loose = placed.groupBy("sequence").agg(F.max("fill").alias("fill")).filter(F.col("fill") < 0.95 * limit)
        loose = stage(loose.select(F.col("sequence").alias("item"), F.col("fill").alias("size")), "packing-loose")
        count = loose.count()
        tasks = -(-count // carried)
        if count < 2:
            break
        merged = _binned(loose.repartition(tasks, "item"), limit, carried, largest_first=True)
        moved = merged.select(F.col("item").alias("sequence"), (-F.col("bin") - 1).alias("_bin"), F.col("fill").alias("_fill"))
        met = join_unique(placed, moved, "sequence", "left", stable_left=True)
        # new names are below zero and old ones not, turn by turn
        placed = stage(met.select("item", "size", F.coalesce("_bin", "sequence").alias("sequence"), F.coalesce("_fill", "fill").alias("fill")), "packing-placed")
        names = stage(placed.select("sequence").distinct().withColumn("_name", F.monotonically_increasing_id()), "packing-names")
        placed = join_unique(placed, names, "sequence", stable_left=True).select("item", "size", F.col("_name").alias("sequence"), "fill")
        placed = stage(placed, "packing-placed")
        if tasks <= 1 or merged.select("bin").distinct().count() > 0.9 * count:
            break
    order = Window.partitionBy("sequence").orderBy("item")
    named = placed.select(F.col("item").alias("_item"), "sequence", F.row_number().over(order).alias("place"), F.col("fill").alias("sequence_tokens"))
    return join_unique(numbered, stage(named, "packing-named"), "_item", "left", stable_left=True).drop("_item")
