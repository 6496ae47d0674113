"""Awkward documents that every operator has to take."""

import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} of{i % 13} the" for i in range(70_000))
TEXTS = [
    (None, "A text without an id, and some words."),
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\f\r "),
    (4, LONG),
    (5, "The same text, twice the same row."),
    (5, "The same text, twice the same row."),
    (6, "the same text,twice\tthe same row."),
    (7, "é ▁ ñ \u2028 漢字 <|endoftext|> don't 123 🙂"),
    (8, "x"),
]
EXTRA = ["id", "row", "n", "node", "grp", "shard", "slot", "f0", "item", "component", "digest", "word", "score", "_salt", "_scan_file", "lang", "held_out", "coverage", "_metadata", "size", "file"]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with names that operators use inside."""
    frame = spark.createDataFrame(TEXTS, "doc_id long, text string")
    for k, name in enumerate(EXTRA):
        frame = frame.withColumn(name, F.lit(None).cast("string") if k % 2 else F.lit(k))
    return frame.withColumn("nested", F.array(F.struct(F.lit(1).alias("text"))))


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.filter(F.lit(False))
