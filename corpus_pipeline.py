"""The corpus pipeline: documents through five operators, each stage written and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from inkwell.llm.exact import DigestIndex, drop_exact_copies
from inkwell.llm.frames import table
from inkwell.llm.nearcopies import drop_near_copies
from inkwell.llm.quality import drop_low_quality, train
from inkwell.llm.segment import sample_segmentations
from inkwell.llm.tiling import drop_contaminated
from inkwell.session import fresh_path, stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, fitted on the labels of their corpus, scores at 0.5 or more."""
    return drop_low_quality(docs, train(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside."""
    return drop_exact_copies(docs, DigestIndex(spark, fresh_path(spark, "digest-index")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document that is left, in small slices, as workers still hold what earlier stages needed."""
    return sample_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"), slice_bytes=1 << 18)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("segmentation", segmentation),
]

#: No SQL expresses a fitted model, fingerprints or sampled segmentations; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. Each sees all that the one before it kept."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
