"""Row numbers, seeded samples, splits and hold-outs without sorting a table in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from inkwell.operators.skew import broadcast_if_small
from inkwell.session import stage

SLICES = 4096
SETTLED_ROWS = 100_000


def scan_with_row_index(reader_df: DataFrame, index_col: str = "Id", offset: int = 1) -> DataFrame:
    """Number the rows of a Parquet scan in file order, 1-based by default.

    The position inside a file comes from the scan itself, so no sort or shuffle of the rows is
    needed and a later filter cannot change a row's number. Only one start position per file is
    computed; files are ordered by name.
    """
    columns = reader_df.columns
    rows = reader_df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_pos"))
    sizes = reader_df.select(F.col("_metadata.file_path").alias("_file")).groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    # one row per file, so this window sorts file names and never data rows
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = rows.join(broadcast_if_small(starts), "_file")
    return numbered.select((F.col("_start") + F.col("_pos") + F.lit(offset)).alias(index_col), *columns)


def dense_index(df: DataFrame, order_cols: list[str], index_col: str = "Id", offset: int | Column = 1) -> DataFrame:
    """Number the rows of any frame densely in the given total order.

    Rows are range partitioned on all order columns, sorted inside each partition and staged once in
    the shared folder together with their partition and position; the partition counts then give
    each partition's start. One shuffle, no single-task window over the rows.
    """
    shift = F.lit(offset) if isinstance(offset, int) else offset
    columns = df.columns
    placed = (
        df.repartitionByRange(*[F.col(c) for c in order_cols])
        .sortWithinPartitions(*order_cols)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_mono", F.monotonically_increasing_id())
    )
    staged = stage(placed, "dense-index")
    sizes = staged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per shuffle partition
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    position = F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    return staged.join(F.broadcast(starts), "_part").select(
        (F.col("_start") + position + shift).cast("long").alias(index_col), *columns
    )


def seeded_hash(seed: int | float | str, id_col: str) -> Column:
    """A random-looking order key that any engine can reproduce: md5 of `seed:id`."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def _hash_cut(keyed: DataFrame, rank: int, level_one: dict[str, int]) -> tuple[str, object]:
    """The (hash, id) pair at a 1-based rank of the hash order.

    Counts by hash prefix narrow the search to one prefix with few rows; only those are sorted.
    Each round brings back at most 4096 counts.
    """
    prefix, remaining, counts = "", rank, level_one
    while True:
        for piece in sorted(counts):
            if remaining <= counts[piece]:
                break
            remaining -= counts[piece]
        prefix, size = prefix + piece, counts[piece]
        inside = keyed.filter(F.col("_hash").startswith(prefix))
        if size <= SETTLED_ROWS or len(prefix) >= 30:
            row = inside.orderBy("_hash", "_id").limit(remaining).orderBy(F.desc("_hash"), F.desc("_id")).first()
            return row["_hash"], row["_id"]
        counts = _prefix_counts(inside, len(prefix))


def _prefix_counts(keyed: DataFrame, skip: int) -> dict[str, int]:
    piece = F.substring("_hash", skip + 1, 3).alias("piece")
    return {r["piece"]: r["n"] for r in keyed.groupBy(piece).agg(F.count(F.lit(1)).alias("n")).collect()}


def hash_cuts(
    df: DataFrame, id_col: str, seed: int | float | str, ranks: Callable[[int], list[int]]
) -> tuple[int, list[tuple[str, object] | None]]:
    """Row count and the (hash, id) pairs at the ranks that `ranks(row count)` asks for."""
    keyed = df.select(seeded_hash(seed, id_col).alias("_hash"), F.col(id_col).alias("_id"))
    level_one = _prefix_counts(keyed, 0)
    if None in level_one:
        raise ValueError(f"{level_one[None]} rows have a null {id_col}, which has no place in a seeded order")
    total = sum(level_one.values())
    return total, [_hash_cut(keyed, r, level_one) if 0 < r <= total else None for r in ranks(total)]


def _up_to(cut: tuple[str, object] | None, seed: int | float | str, id_col: str) -> Column:
    if cut is None:
        return F.lit(False)
    key = seeded_hash(seed, id_col)
    return (key < F.lit(cut[0])) | ((key == F.lit(cut[0])) & (F.col(id_col) <= F.lit(cut[1])))


def exact_sample(df: DataFrame, id_col: str, n: int, seed: int | float | str) -> DataFrame:
    """Exactly n rows without replacement; an error when the table has fewer. Ids must be unique.

    The sample is a plain filter against the n-th smallest hash: the wide rows are never shuffled.
    """
    total, (cut,) = hash_cuts(df, id_col, seed, lambda _: [n])
    if n > total:
        raise ValueError(f"sample of {n} asked from {total} rows")
    return df.filter(_up_to(cut, seed, id_col))


def seeded_limit(df: DataFrame, id_col: str, n: int, seed: int | float | str) -> DataFrame:
    """The first n rows of the seeded order, or all rows when there are fewer."""
    _, (cut,) = hash_cuts(df, id_col, seed, lambda total: [min(n, total)])
    return df.filter(_up_to(cut, seed, id_col))


def train_val_test_split(
    df: DataFrame,
    id_col: str,
    seed: int | float | str,
    label_col: str = "DataSplit",
    train_share: float = 0.8,
    val_share: float = 0.1,
) -> DataFrame:
    """Label rows Training / Validation / Testing with exact group sizes, as a projection."""

    def ends(total: int) -> list[int]:
        train_end = int(train_share * total)
        return [train_end, train_end + int(val_share * total)]

    _, (train_cut, val_cut) = hash_cuts(df, id_col, seed, ends)
    return df.withColumn(
        label_col,
        F.when(_up_to(train_cut, seed, id_col), F.lit("Training"))
        .when(_up_to(val_cut, seed, id_col), F.lit("Validation"))
        .otherwise(F.lit("Testing")),
    )


def _integer_cut(df: DataFrame, id_col: str, n: int) -> int | None:
    """The n-th largest value of a unique integer column, by counting ever finer value ranges."""
    ids = df.select(F.col(id_col).cast("long").alias("_id"))
    total, low, high = ids.agg(F.count("_id"), F.min("_id"), F.max("_id")).first()
    if n >= total:
        return low
    remaining, size = n, total
    while size > SETTLED_ROWS and high > low:
        width = max(1, -(-(high - low + 1) // SLICES))
        inside = ids.filter(F.col("_id").between(low, high))
        slices = inside.groupBy(F.expr(f"(_id - {low}L) div {width}L").alias("s")).agg(F.count(F.lit(1)).alias("n"))
        for s, count in sorted(((r["s"], r["n"]) for r in slices.collect()), reverse=True):
            if remaining <= count:
                break
            remaining -= count
        low, high, size = low + s * width, min(high, low + (s + 1) * width - 1), count
    inside = ids.filter(F.col("_id").between(low, high))
    return inside.orderBy(F.desc("_id")).limit(remaining).agg(F.min("_id")).first()[0]


def holdout(df: DataFrame, id_col: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(corpus, tail): the tail is the n rows with the largest unique integer ids.

    Rows without an id are in the corpus. Both parts are filters on the id, which a Parquet scan can use to skip row groups.
    """
    if n <= 0:
        return df, df.filter(F.lit(False))
    cut = _integer_cut(df, id_col, n)
    if cut is None:
        return df, df
    return df.filter(F.col(id_col).isNull() | (F.col(id_col) < F.lit(cut))), df.filter(F.col(id_col) >= F.lit(cut))

