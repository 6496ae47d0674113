"""Size-checked broadcasts and joins that survive a key holding a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from inkwell.session import stage

BROADCAST_BYTES = 64 * 1024 * 1024
BROADCAST_ROWS = 1_000_000
HOT_ROWS = 1_000_000
HOT_KEY_BOUND = 1_000_000
TASKS_PER_CORE = 8
MERGED_TASK_BYTES = 2 * 1024**3
MAX_TASKS = 1_000_000
SPREAD_BYTES_PER_CORE = 16 * 1024 * 1024
FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.NullType)


def _sum_over(values: Column, element: T.DataType) -> Column:
    """Bytes of all elements of an array, 8 for each besides."""
    if isinstance(element, FIXED_WIDTH):
        return 8 * F.greatest(F.size(values), F.lit(0)).cast("long")
    total = F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + 8 + _width(x, element))
    return F.coalesce(total, F.lit(0).cast("long"))


def _width(value: Column, kind: T.DataType) -> Column:
    """Measured bytes of a value of any nested type; null when the type cannot be measured."""
    if isinstance(kind, FIXED_WIDTH):
        return F.lit(8).cast("long")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.lit(8).cast("long") + F.coalesce(F.octet_length(value), F.lit(0)).cast("long")
    if isinstance(kind, T.ArrayType):
        return F.lit(8).cast("long") + _sum_over(value, kind.elementType)
    if isinstance(kind, T.MapType):
        keys, values = F.map_keys(value), F.map_values(value)
        return F.lit(8).cast("long") + _sum_over(keys, kind.keyType) + _sum_over(values, kind.valueType)
    if isinstance(kind, T.StructType):
        total = F.lit(8).cast("long")
        for field in kind.fields:
            total = total + _width(value.getField(field.name), field.dataType)
        return total
    return F.lit(None).cast("long")


def _row_bytes(schema: T.StructType) -> Column:
    total = F.lit(0).cast("long")
    for field in schema.fields:
        total = total + _width(F.col(f"`{field.name}`"), field.dataType)
    return total


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure a frame with distributed aggregates; nothing is funnelled into one task.

    The row count comes first: it reads no columns, and settles the question for large tables.
    Maps, arrays and structs are measured through all their levels. A type that cannot be measured
    is not small.
    """
    rows = df.count()
    if rows > max_rows:
        return False
    if all(isinstance(f.dataType, FIXED_WIDTH) for f in df.schema.fields):
        return rows * 8 * len(df.schema.fields) <= max_bytes
    width = _row_bytes(df.schema)
    total, measured = df.agg(F.coalesce(F.sum(width), F.lit(0)), F.count(width)).first()
    return measured == rows and total <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df


def planned_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate: the file sizes for a scan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread_small_input(df: DataFrame, *keys: str) -> DataFrame:
    """Give every core a share of a small source before costly per-row work.

    A file with one row group is read by one task whatever the core count. Sources with enough
    data for every core are left as they are, so large tables are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if planned_bytes(df) < cores * SPREAD_BYTES_PER_CORE else df


def tasks_of_scan(df: DataFrame, bytes_each: int) -> int:
    """Tasks that deal a scan evenly where work per byte is costly: one for every core, and one for so many bytes of its files.

    Splits follow row groups, of which a large file may have few, and may be dealt unevenly over the cores.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, min(MAX_TASKS, planned_bytes(df) // bytes_each + 1))


def few_tasks(df: DataFrame) -> DataFrame:
    """Merge input splits where every task returns a result of its own, so that these stay few.

    No shuffle. The size sets a lower bound, because an elastic cluster may report few cores before
    it has grown; sources with fewer splits are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    by_size = min(MAX_TASKS, planned_bytes(df) // MERGED_TASK_BYTES + 1)
    return df.coalesce(max(TASKS_PER_CORE * cores, by_size))


def hot_keys(left: DataFrame, on: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """(_hot_hash, _salts) of the keys with more than `hot_rows` rows: one salt for each `hot_rows`.

    Keys are named by a 64-bit hash, so a row is 12 bytes whatever the key. At most
    total / hot_rows keys can qualify; beyond 10^12 rows the threshold rises so that there are never
    more than HOT_KEY_BOUND of them. Null keys count as a key, so a left join spreads them too.
    """
    counts = left.groupBy(F.xxhash64(*on).alias("_hot_hash")).agg(F.count(F.lit(1)).alias("_n"))
    hot_rows = max(hot_rows, -(-left.count() // HOT_KEY_BOUND))
    salts = F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int")
    return counts.filter(F.col("_n") > hot_rows).select("_hot_hash", salts.alias("_salts"))


def salted(df: DataFrame, hot: DataFrame, on: list[str]) -> DataFrame:
    """Rows of hot keys dealt over their salts by position, so equal rows spread as well.

    Positions must not change when a task runs again: `df` has to be a scan or a staged table.
    """
    marked = df.withColumn("_hot_hash", F.xxhash64(*on)).join(F.broadcast(hot), "_hot_hash", "left")
    salt = F.pmod(F.monotonically_increasing_id(), F.coalesce("_salts", F.lit(1))).cast("int")
    return marked.withColumn("_salt", salt).drop("_hot_hash", "_salts")


def repeated(df: DataFrame, hot: DataFrame, on: list[str]) -> DataFrame:
    """The other side of a salted join: rows of hot keys once for each salt."""
    marked = df.withColumn("_hot_hash", F.xxhash64(*on)).join(F.broadcast(hot), "_hot_hash", "left")
    every = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    return marked.withColumn("_salt", F.explode(every)).drop("_hot_hash", "_salts")


def join_unique(
    left: DataFrame,
    right: DataFrame,
    on: str | list[str],
    how: str = "inner",
    *,
    max_broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
    stable_left: bool = False,
) -> DataFrame:
    """Join a frame of any key distribution with a frame that is unique on the key.

    A measured-small right side is broadcast. Otherwise keys that hold more than `hot_rows` left
    rows are dealt by position over ceil(n / hot_rows) shuffle keys, and only their right rows are
    repeated. `how` is inner, left or left_semi. `stable_left` says that the left side is a scan or
    staged already; else it is staged when it holds a hot key.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if is_small(right, max_broadcast_rows):
        return left.join(F.broadcast(right), keys, how)
    hot = hot_keys(left, keys, hot_rows)
    if not stable_left:
        hot = stage(hot, "hot-keys")
        if hot.isEmpty():
            return left.join(right, keys, how)
        left = stage(left, "hot-left")
    joined = salted(left, hot, keys).join(repeated(right, hot, keys), [*keys, "_salt"], how)
    return joined.drop("_salt")
