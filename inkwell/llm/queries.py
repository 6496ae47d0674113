"""The registered queries: each operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from inkwell.llm import language
from inkwell.llm.exact import DigestIndex, exact_dedup
from inkwell.llm.frames import table
from inkwell.llm.registry import QUERIES, SQL, query  # noqa: F401  (read by the entry module)
from inkwell.llm.lmscore import lm_scores
from inkwell.llm.quality import score, train
from inkwell.llm.segment import sample_segmentations
from inkwell.llm.sharding import shard_documents
from inkwell.llm.simhash import simhash_groups
from inkwell.llm.spelling import spelling_forms
from inkwell.llm.substrings import without_repeats
from inkwell.llm.tiling import decontaminate
from inkwell.llm.tokenfile import encoded_documents
from inkwell.llm.urls import judge
from inkwell.llm.whitening import whiten
from inkwell.session import fresh_path

OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS whole, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents
), h AS (
  SELECT doc_id, length(whole) AS chars, sha256(bare) AS text_sha256 FROM t
), r AS (
  SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM h WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
"""


@query("op7_segmentations")
def op7_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of the sampled segmentations of all documents."""
    found = sample_segmentations(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumn("ids_crc32", F.crc32("ids").cast("long")).drop("ids")


@query("op8_exact_dedup", OP8_SQL)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as the first batch of a new index in the shared folder."""
    index = DigestIndex(spark, fresh_path(spark, "digest-index"))
    return exact_dedup(table(spark, sf_dir, "documents"), index)


#: Host, path and verdict of the rules that `pages` are judged by.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, by a text model of all documents."""
    languages, logs = language.train(table(spark, sf_dir, "documents"))
    return language.identify(table(spark, sf_dir, "pages"), languages, logs)


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


@query("op3_lm_scores")
def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op4_token_file")
def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


@query("op6_url_filters")
def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(str(rule) for rule in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS rules(rule_host, rule_path, rule_verdict)")
    return judge(table(spark, sf_dir, "pages"), rules)


@query("op9_sharding")
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


@query("op10_decontamination")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_spelling")
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(table(spark, sf_dir, "documents"))


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


@query("op13_substring_dedup")
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of what is left of all documents."""
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
