"""Text reports of question and answer pairs, and reading their questions back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# fixed values: the report format
RULE = "==============="
QUESTION_PREFIX = "Question: "
ANSWER_PREFIX = "Answer: "

RECORD_END = "\x1e"


def report_text(question: Column, answer: Column) -> Column:
    return F.concat(
        F.lit(QUESTION_PREFIX), question, F.lit(f"\n{RULE}\n{ANSWER_PREFIX}"), answer, F.lit("\n\n")
    )


def write_reports(df: DataFrame, path: str, run_col: str, question_col: str, answer_col: str) -> None:
    """Many reports per file, one folder per run. Reports end with a record separator.

    A separator inside a text is escaped, so every report comes back whole.
    """
    text = report_text(F.col(question_col), F.col(answer_col))
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit(RECORD_END), F.lit("\\s"))
    frame = df.select(escaped.alias("value"), F.col(run_col).alias("run"))
    frame.write.partitionBy("run").option("lineSep", RECORD_END).text(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(value, run): run names are text as they were written, so `001` stays `001`."""
    raw = spark.read.schema("value string, run string").option("lineSep", RECORD_END).text(path)
    text = F.replace(F.replace(F.col("value"), F.lit("\\s"), F.lit(RECORD_END)), F.lit("\\b"), F.lit("\\"))
    return raw.withColumn("value", text)


def read_report_files(spark: SparkSession, path: str) -> DataFrame:
    """Reports kept as one file each."""
    return spark.read.text(path, wholetext=True)


def report_question(report: Column) -> Column:
    """The text before the rule, without the question prefix."""
    return F.replace(F.split_part(report, F.lit(RULE), F.lit(1)), F.lit(QUESTION_PREFIX), F.lit(""))
