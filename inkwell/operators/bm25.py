"""BM25 scores of documents for questions, in one pass over the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from inkwell.functions.text import tokens
from inkwell.operators.knn import rank_matches
from inkwell.operators.skew import HOT_ROWS, is_small, join_unique
from inkwell.operators.topk import SCORE_DIGITS
from inkwell.session import stage

K1 = 1.2
B = 0.75
MAX_BROADCAST_TERMS = 500_000
#: Pairs of a question and a document that a task adds up and ranks at most, and the most tasks of a block of questions.
TASK_PAIRS = 1_000_000
MOST_TASKS = 100_000
#: The term that stands for the document itself; no token is empty.
WHOLE = ""


def question_terms(questions: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query_id, term), each term once per question."""
    return _one_row_each(questions.select(F.col(id_col).alias("query_id"), F.array_distinct(tokens(F.col(text_col))).alias("words")))


def _one_row_each(df: DataFrame) -> DataFrame:
    """A `term` row per element of `words`.

    The outer form keeps the optimizer from guessing a filter on the array's size, which would
    tokenise every text again in the scan.
    """
    others = [c for c in df.columns if c != "words"]
    return df.select(*others, F.explode_outer("words").alias("term")).filter(F.col("term").isNotNull())


def term_counts(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame, max_broadcast_terms: int = MAX_BROADCAST_TERMS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Staged (match_id, length, term, tf) of the asked terms, and a WHOLE row for every document with a text.

    The only pass over the documents: weights and scores come from these narrow rows. All words of a document
    are in one task, so counting leaves one row per document and term before the shuffle. When the terms
    are too many to broadcast, that counting comes first and the join with the terms salts hot ones.
    """
    words = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("match_id"), tokens(F.col(text_col)).alias("words"))
    marked = words.select("match_id", F.size("words").alias("length"), F.concat(F.array(F.lit(WHOLE)), "words").alias("words"))
    spread = _one_row_each(marked)
    wanted = stage(terms.select("term").distinct().unionByName(terms.sparkSession.range(1).select(F.lit(WHOLE).alias("term"))), "bm25-terms")
    counted = F.count(F.lit(1)).alias("tf")
    if is_small(wanted, max_broadcast_terms):
        return stage(spread.join(F.broadcast(wanted), "term").groupBy("match_id", "length", "term").agg(counted), "bm25-counts")
    whole = stage(spread.groupBy("match_id", "length", "term").agg(counted), "bm25-all-counts")
    return stage(join_unique(whole, wanted, "term", "left_semi", max_broadcast_rows=0, hot_rows=hot_rows, stable_left=True), "bm25-counts")


def term_weights(counts: DataFrame) -> tuple[DataFrame, float]:
    """(term, idf) of the counted terms, and the mean document length in tokens."""
    n_docs, total = counts.filter(F.col("term") == WHOLE).agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    seen = counts.filter(F.col("term") != WHOLE).groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    idf = F.log(F.lit(1.0) + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return seen.select("term", idf.alias("idf")), (total / n_docs if total else 1.0)


def _gain(mean_length: float) -> Column:
    tf, length = F.col("tf").cast("double"), F.col("length")
    return F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean_length)))


def bm25_topk(
    questions: DataFrame,
    docs: DataFrame,
    k: int,
    *,
    question_id: str,
    question_text: str,
    doc_id: str,
    doc_text: str,
    max_broadcast_terms: int = MAX_BROADCAST_TERMS,
    hot_rows: int = HOT_ROWS,
    task_pairs: int = TASK_PAIRS,
) -> DataFrame:
    """The k best documents per question: (query_id, match_id, score, rank); no shared term, no row.

    The counted terms are shuffled by document once. Questions come to them in blocks of at most
    about `max_broadcast_terms` terms, so scores are summed where the document's terms are, and the ranking sends
    k rows per question and task on: questions times documents is never shuffled. Documents are dealt over so many tasks
    that one holds about `task_pairs` pairs, however narrow the counts are that they come from.
    """
    terms = stage(question_terms(questions, question_id, question_text), "bm25-questions")
    counts = term_counts(docs, doc_id, doc_text, terms, max_broadcast_terms, hot_rows)
    idf, mean_length = term_weights(counts)
    weighted = stage(join_unique(terms, idf, "term", hot_rows=hot_rows, stable_left=True).select("query_id", "term", "idf"), "bm25-weighted")
    matched = counts.filter(F.col("term") != WHOLE)
    blocks = 1 if is_small(weighted, max_broadcast_terms) else 2 * -(-weighted.count() // max(1, max_broadcast_terms))
    asked, held = weighted.select("query_id").distinct().count(), counts.filter(F.col("term") == WHOLE).count()
    least = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, min(MOST_TASKS, asked * held // (blocks * task_pairs) + 1))
    found = None
    for block in range(blocks):
        part = weighted.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block) if blocks > 1 else weighted
        here = matched.repartition(tasks, "match_id").join(F.broadcast(part), "term")
        # grouped by more than the documents are dealt by, so this aggregate needs no shuffle
        summed = here.groupBy("query_id", "match_id").agg(F.round(F.sum(_gain(mean_length)), SCORE_DIGITS).alias("score"))
        ranked = rank_matches(summed, k)
        found = ranked if found is None else found.unionByName(ranked)
    return found


def bm25_rescore(pairs: DataFrame, questions: DataFrame, docs: DataFrame, *, question_id: str, question_text: str, doc_id: str, doc_text: str) -> DataFrame:
    """`pairs` (query_id, match_id, ...) with a `bm25` column; 0 when no term is shared."""
    terms = stage(question_terms(questions, question_id, question_text), "bm25-questions")
    counts = term_counts(docs, doc_id, doc_text, terms)
    idf, mean_length = term_weights(counts)
    weighted = join_unique(terms, idf, "term", stable_left=True)
    wanted = pairs.select("query_id", "match_id").join(weighted, "query_id")
    # a (document, term) is asked for by as many pairs as hold it, and its counts are one row
    scored = join_unique(wanted, counts, ["match_id", "term"])
    scores = scored.groupBy("query_id", "match_id").agg(F.round(F.sum(_gain(mean_length)), SCORE_DIGITS).alias("bm25"))
    return pairs.join(scores, ["query_id", "match_id"], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
