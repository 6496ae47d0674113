"""A stored inverted index for BM25: postings by term and document range, with the largest gain of each block."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkwell.functions.text import tokens
from inkwell.operators.bm25 import B, K1, _one_row_each, question_terms
from inkwell.operators.knn import rank_matches
from inkwell.operators.skew import HOT_ROWS, broadcast_if_small, join_unique
from inkwell.operators.topk import SCORE_DIGITS
from inkwell.session import stage

#: Documents of a range on average. Blocks of a smaller range have tighter bounds, but there are more of them.
RANGE_DOCS = 64
BUCKETS = 64
#: Ranges per question that are scored first, those of the highest bounds; their k-th score rules out others.
FIRST_RANGES = 8
SLACK = 10.0**-SCORE_DIGITS


class TextIndex:
    """Three tables in a folder: `postings` (partitioned by term bucket), `terms` and `facts`.

    A row of `postings` is a block: a term's documents in one range, with ids, counts, lengths and `most`, the largest
    gain of the block for an idf of one. Texts are read when the index is built and never again.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        row = spark.read.parquet(f"{path}/facts").first()
        self.docs, self.mean_length, self.ranges = row["docs"], row["mean_length"], row["ranges"]

    @classmethod
    def create(cls, spark: SparkSession, path: str, docs: DataFrame, doc_id: str, doc_text: str, range_docs: int = RANGE_DOCS) -> TextIndex:
        """A new index of all documents with a text, by unique ids.

        All words of a document are in one task, so counting shuffles one row per document and term, to its block.
        """
        words = docs.filter(F.col(doc_text).isNotNull()).select(F.col(doc_id).alias("match_id"), tokens(F.col(doc_text)).alias("words"))
        sized = words.select("match_id", F.size("words").alias("length"), "words")
        counts = _one_row_each(sized).groupBy("match_id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
        counts = stage(counts, "text-index-counts")
        n, total = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        mean = total / n if total else 1.0
        ranges = max(1, n // range_docs)
        tf, length = F.col("tf").cast("double"), F.col("length")
        gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean)))
        placed = counts.withColumn("range", F.pmod(F.xxhash64("match_id"), F.lit(ranges))).withColumn("gain", gain)
        # dealt by term once, so that the blocks of a term are made, sorted and written where its rows are
        bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket")
        dealt = placed.select("*", bucket).repartition("bucket", "term")
        # a block holds about range_docs documents, whatever the term
        blocks = dealt.groupBy("bucket", "term", "range").agg(
            F.max("gain").alias("most"), F.collect_list(F.struct("match_id", F.col("tf").cast("int").alias("tf"), F.col("length").cast("int").alias("length"))).alias("docs")
        )
        blocks = blocks.select("term", "range", "most", "docs", "bucket")
        blocks.sortWithinPartitions("bucket", "term", "range").write.partitionBy("bucket").parquet(f"{path}/postings")
        stored = spark.read.schema(blocks.schema).parquet(f"{path}/postings")
        counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", bucket, "df").write.parquet(f"{path}/terms")
        stored.select(F.expr("docs[0].match_id").alias("match_id")).limit(0).coalesce(1).write.parquet(f"{path}/names")  # the type of ids alone
        spark.createDataFrame([(n, float(mean), ranges)], "docs long, mean_length double, ranges long").coalesce(1).write.parquet(f"{path}/facts")
        return cls(spark, path)

    def _weighted(self, questions: DataFrame, question_id: str, question_text: str, hot_rows: int) -> DataFrame:
        """(query_id, term, bucket, idf) of the terms that the index holds, staged."""
        asked = stage(question_terms(questions, question_id, question_text), "text-index-asked")
        wanted = broadcast_if_small(asked.select("term").distinct())
        known = stage(self.spark.read.parquet(f"{self.path}/terms").join(wanted, "term", "left_semi"), "text-index-terms")
        df = F.col("df").cast("double")
        idf = F.log(F.lit(1.0) + (F.lit(float(self.docs)) - df + 0.5) / (df + 0.5))
        met = join_unique(asked, known.select("term", "bucket", idf.alias("idf")), "term", hot_rows=hot_rows, stable_left=True)
        return stage(met, "text-index-weighted")

    def _postings(self, weighted: DataFrame) -> DataFrame:
        """The blocks of the asked terms; partitions of other buckets are not opened."""
        buckets = [r["bucket"] for r in weighted.select("bucket").distinct().collect()]  # at most BUCKETS
        id_type = dict(self.spark.read.parquet(f"{self.path}/names").dtypes)["match_id"]
        schema = f"term string, `range` long, most double, docs array<struct<match_id:{id_type},tf:int,length:int>>, bucket int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/postings").filter(F.col("bucket").isin(buckets))

    def _bounds(self, weighted: DataFrame) -> DataFrame:
        """(query_id, range, bound, blocks), staged: no document of the range can score higher. Reads no posting."""
        blocks = self._postings(weighted).select("term", "range", "most")
        met = blocks.join(broadcast_if_small(weighted.select("query_id", "term", "idf")), "term")
        bound = F.sum(F.col("idf") * F.col("most")).alias("bound")
        return stage(met.groupBy("query_id", "range").agg(bound, F.count(F.lit(1)).alias("blocks")), "text-index-bounds")

    def _scored(self, weighted: DataFrame, chosen: DataFrame) -> DataFrame:
        """(query_id, match_id, score) of all documents in the chosen (query_id, range)."""
        pairs = stage(join_unique(chosen.select("query_id", "range"), weighted.groupBy("query_id").agg(F.collect_list(F.struct("term", "idf")).alias("terms")), "query_id"), "text-index-chosen")
        pairs = pairs.select("query_id", "range", F.inline("terms"))
        met = self._postings(weighted).select("term", "range", "docs").join(broadcast_if_small(pairs), ["term", "range"])
        each = met.select("query_id", "idf", F.inline("docs"))
        tf, length = F.col("tf").cast("double"), F.col("length")
        gain = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(self.mean_length)))
        return each.groupBy("query_id", "match_id").agg(F.round(F.sum(gain), SCORE_DIGITS).alias("score"))

    def _passes(self, questions: DataFrame, k: int, question_id: str, question_text: str, first_ranges: int, hot_rows: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """(weighted terms, bounds, results of the first ranges, ranges still to be scored)."""
        weighted = self._weighted(questions, question_id, question_text, hot_rows)
        bounds = self._bounds(weighted)
        top = rank_matches(bounds.select("query_id", F.col("range").alias("match_id"), F.col("bound").alias("score")), first_ranges)
        first = stage(top.select("query_id", F.col("match_id").alias("range"), F.lit(True).alias("first")), "text-index-first")
        found = stage(rank_matches(self._scored(weighted, first), k).drop("rank"), "text-index-found")
        floors = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
        open_ranges = bounds.join(broadcast_if_small(first), ["query_id", "range"], "left").filter(F.col("first").isNull()).drop("first")
        met = join_unique(open_ranges, floors, "query_id", "left", hot_rows=hot_rows)
        rest = met.filter(F.col("floor").isNull() | (F.col("bound") + 2 * SLACK >= F.col("floor"))).select("query_id", "range", "blocks")
        return weighted, bounds, found, stage(rest, "text-index-rest")

    def search(self, questions: DataFrame, k: int, *, question_id: str, question_text: str, first_ranges: int = FIRST_RANGES, hot_rows: int = HOT_ROWS) -> DataFrame:
        """(query_id, match_id, score, rank), exactly those of `bm25_topk`.

        Bounds of all ranges come from the blocks' maxima; the best ranges are scored first, and of the others only those
        whose bound reaches the k-th score so far.
        """
        weighted, _, found, rest = self._passes(questions, k, question_id, question_text, first_ranges, hot_rows)
        return rank_matches(found.unionByName(self._scored(weighted, rest)), k)

    def skipped(self, questions: DataFrame, k: int, *, question_id: str, question_text: str, first_ranges: int = FIRST_RANGES, hot_rows: int = HOT_ROWS) -> DataFrame:
        """(query_id, blocks, skipped): the blocks of each question's terms and how many of them no search reads."""
        _, bounds, _, rest = self._passes(questions, k, question_id, question_text, first_ranges, hot_rows)
        top = rank_matches(bounds.select("query_id", F.col("range").alias("match_id"), F.col("bound").alias("score"), "blocks"), first_ranges)
        read = rest.select("query_id", "blocks").union(top.select("query_id", "blocks")).groupBy("query_id").agg(F.sum("blocks").alias("read"))
        return bounds.groupBy("query_id").agg(F.sum("blocks").alias("blocks")).join(read, "query_id", "left").select("query_id", "blocks", (F.col("blocks") - F.coalesce("read", F.lit(0))).alias("skipped"))
