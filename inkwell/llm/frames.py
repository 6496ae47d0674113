"""Row keys and tables shared by the operators."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkwell.operators.skew import join_unique
from inkwell.session import stage

#: The white space of the text contracts, `[\x20\x09-\x0D]`.
WHITE = " \t\n\x0b\f\r"
FILE, ROW = "_scan_file", "_scan_row"
#: What a column goes by in a staged scan when its own name is that of Spark's file positions.
OWN, POSITIONS = "_scan_own", "_metadata"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; all other characters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Plan steps that make several rows of one or mix sources; a file position no longer names a row above them.
MIXING = ("Join", "Generate", "Union", "Expand", "Sample", "Aggregate")


def scan_of(df: DataFrame) -> DataFrame:
    """The frame itself when it is a file scan, which knows its rows by file and position; else staged.

    A column that hides the file positions by its name goes by another name inside; `without` gives it back.
    """
    hiding = {c: OWN + c for c in df.columns if c.lower() == POSITIONS}
    if hiding:
        return stage(df.withColumnsRenamed(hiding), "scan")
    if any(step in line for line in df._jdf.queryExecution().analyzed().toString().split("\n") for step in MIXING):
        return stage(df, "scan")
    try:
        df.select("_metadata.row_index")
    except AnalysisException:
        return stage(df, "scan")
    return df


def keyed(scan: DataFrame, *columns: Column) -> DataFrame:
    """The asked columns with each row's file and position, equal whenever the scan is read again."""
    return scan.select(*columns, F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))


def without(scan: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of a scan whose (file, position) is not among `dropped`; null and repeated ids are no matter.

    The dropped keys are broadcast when measured small; else both sides meet by key, which is unique.
    """
    columns = scan.columns
    marks = dropped.select(FILE, ROW, F.lit(True).alias("_scan_dropped"))
    whole = keyed(scan, F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_scan_columns"))
    kept = join_unique(whole, marks, [FILE, ROW], "left", stable_left=True).filter(F.col("_scan_dropped").isNull())
    names = {c: c.removeprefix(OWN) if c.lower() == OWN + POSITIONS else c for c in columns}
    return kept.select(*[F.col("_scan_columns").getField(c).alias(name) for c, name in names.items()])
