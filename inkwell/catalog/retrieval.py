"""Sampling, hold-outs, vector search and contexts over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.catalog import standins as st
from inkwell.catalog.registry import query
from inkwell.functions import fixed, prompts
from inkwell.functions.text import concat_lenient
from inkwell.operators import bm25, knn, lsa, ordering
from inkwell.operators.embed import embed, embedding_column
from inkwell.operators.skew import join_unique
from inkwell.operators.textindex import TextIndex
from inkwell.operators.vectorindex import VectorIndex
from inkwell.plans import corpora, retrieval
from inkwell.plans.runs import qa_sample as sample_pair
from inkwell.session import fresh_path, stage

DIM = 64
LSH_TABLES, LSH_BITS, LSH_PROBES = 8, 8, 3


def sampled_sql(source: str, id_col: str, n: int, seed: int | float, columns: str) -> str:
    return f"""SELECT {columns} FROM (
  SELECT *, row_number() OVER (ORDER BY md5('{seed}:' || {id_col}), {id_col}) AS pos FROM {source}) WHERE pos <= {n}"""


@query("holdout_corpus", f"SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT {fixed.HOLDOUT_ROWS})")
def holdout_corpus(spark, sf_dir):
    return ordering.holdout(st.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", fixed.HOLDOUT_ROWS)[0]


@query("holdout_tail", f"SELECT doc_id, lang FROM documents ORDER BY doc_id DESC LIMIT {fixed.HOLDOUT_ROWS}")
def holdout_tail(spark, sf_dir):
    return ordering.holdout(st.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", fixed.HOLDOUT_ROWS)[1]


@query("seeded_limit", sampled_sql("documents", "doc_id", 300, fixed.TUNING_SEED, "doc_id, text"))
def seeded_limit(spark, sf_dir):
    return ordering.seeded_limit(st.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", 300, fixed.TUNING_SEED)


@query("exact_sample", sampled_sql("orders", "o_orderkey", fixed.TEST_SAMPLE, fixed.TEST_SEED, "o_orderkey, o_totalprice"))
def exact_sample(spark, sf_dir):
    orders = st.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return ordering.exact_sample(orders, "o_orderkey", fixed.TEST_SAMPLE, fixed.TEST_SEED)


@query("train_val_test_split", f'SELECT doc_id, "DataSplit" FROM {st.split_sql("documents", "doc_id")}')
def train_val_test_split(spark, sf_dir):
    return ordering.train_val_test_split(st.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", st.SPLIT_SEED)


@query("split_counts", f'SELECT "DataSplit", count(*) AS n_rows FROM {st.split_sql("orders", "o_orderkey")} GROUP BY 1')
def split_counts(spark, sf_dir):
    split = ordering.train_val_test_split(st.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", st.SPLIT_SEED)
    return split.groupBy("DataSplit").agg(F.count(F.lit(1)).alias("n_rows"))


SAMPLE_SQL = sampled_sql("qa", '"Id"', fixed.TEST_SAMPLE, fixed.TEST_SEED, '"Id", "QuestionAsked"')


@query("qa_sample", f'WITH {st.QA_CTE}, {st.KEYS_CTE} SELECT s."Id", s."QuestionAsked", k."ExtractedAnswer" FROM ({SAMPLE_SQL}) s JOIN keys k ON s."Id" = k."Id"')
def qa_sample(spark, sf_dir):
    asked, keys = sample_pair(st.qa(spark, sf_dir), st.keys(spark, sf_dir))
    return asked.join(keys, "Id")


PAIRS_SQL = """SELECT q.vec_id AS query_id, c.vec_id AS match_id,
    round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id"""


def ranked_sql(pairs: str, k: int) -> str:
    return f"""SELECT query_id, match_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, match_id) AS rank FROM ({pairs})) WHERE rank <= {k}"""


def _self_hits(spark, sf_dir, k=fixed.TOP_K, **options):
    embeddings = st.table(spark, sf_dir, "embeddings")
    hits = knn.knn_join(
        embeddings, embeddings, k, query_id="vec_id", query_vec="embedding", corpus_id="vec_id", corpus_vec="embedding", skip_same=True, **options
    )
    return hits.withColumn("rank", F.col("rank").cast("long"))


@query("knn_topk", ranked_sql(PAIRS_SQL, fixed.TOP_K))
def knn_topk(spark, sf_dir):
    return _self_hits(spark, sf_dir)


@query("knn_partitioned", ranked_sql(PAIRS_SQL, fixed.TOP_K))
def knn_partitioned(spark, sf_dir):
    """The same search by the way for two large sides."""
    return _self_hits(spark, sf_dir, max_broadcast_queries=0, corpus_chunk=256, query_chunk=128, pivots=8)


SIGNS_SQL = f"""signs AS (
  SELECT t, b, list(CASE WHEN substr(md5(t || ':' || b || ':' || i), 1, 1) <= '7' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ORDER BY i) AS plane
  FROM range({LSH_TABLES}) r(t), range({LSH_BITS}) s(b), range({DIM}) u(i) GROUP BY t, b)"""


@query(
    "knn_lsh",
    f"""WITH {SIGNS_SQL},
margins AS (SELECT vec_id, t, b, list_dot_product(CAST(embedding AS DOUBLE[]), plane) AS margin FROM embeddings, signs),
places AS (SELECT *, row_number() OVER (PARTITION BY vec_id, t ORDER BY abs(margin), b) AS closeness FROM margins),
buckets AS (SELECT vec_id, t, sum(CASE WHEN margin >= 0 THEN 1 << b ELSE 0 END) AS bucket FROM places GROUP BY vec_id, t),
asked AS (SELECT vec_id, t, bucket FROM buckets UNION ALL
  SELECT vec_id, t, bucket + CASE WHEN margin >= 0 THEN -(1 << b) ELSE 1 << b END FROM buckets JOIN places USING (vec_id, t) WHERE closeness <= {LSH_PROBES}),
near AS (SELECT DISTINCT q.vec_id AS query_id, c.vec_id AS match_id FROM asked q JOIN buckets c ON q.t = c.t AND q.bucket = c.bucket AND q.vec_id <> c.vec_id),
found AS ({ranked_sql(f"SELECT p.* FROM ({PAIRS_SQL}) p JOIN near USING (query_id, match_id)", fixed.TOP_K)}),
exact AS ({ranked_sql(PAIRS_SQL, fixed.TOP_K)}),
shares AS (SELECT e.query_id, avg(CASE WHEN f.match_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS recall
  FROM exact e LEFT JOIN found f ON f.query_id = e.query_id AND f.match_id = e.match_id GROUP BY e.query_id)
SELECT query_id, match_id, score, rank, recall FROM found JOIN shares USING (query_id)""",
)
def knn_lsh(spark, sf_dir):
    """Bucketed neighbours, each query with the share of its exact neighbours that were found."""
    embeddings = st.table(spark, sf_dir, "embeddings")
    hits = knn.knn_bucketed(
        embeddings, embeddings, fixed.TOP_K, query_id="vec_id", query_vec="embedding", corpus_id="vec_id", corpus_vec="embedding",
        dim=DIM, tables=LSH_TABLES, bits=LSH_BITS, probes=LSH_PROBES, skip_same=True,
    )
    hits = stage(hits.withColumn("rank", F.col("rank").cast("long")), "bucket-hits")
    # staged, as the join measures its sides and the exact search should run once
    shares = stage(knn.recall(hits, _self_hits(spark, sf_dir)), "bucket-recall")
    return join_unique(hits, shares, "query_id", stable_left=True)


INDEX_RECALL = 0.9


def _index(spark, sf_dir, **options):
    """(index of all embeddings in a new folder, queries (query_id, vec))."""
    embeddings = st.table(spark, sf_dir, "embeddings")
    index = VectorIndex.create(spark, fresh_path(spark, "vector-index"), embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"), "label"), **options)
    return index, embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))


@query("vector_index", ranked_sql(PAIRS_SQL, fixed.TOP_K))
def vector_index(spark, sf_dir):
    """Stored cells, all of them probed: the exact neighbours of every vector."""
    index, queries = _index(spark, sf_dir)
    return index.search(queries, fixed.TOP_K, skip_same=True).withColumn("rank", F.col("rank").cast("long"))


@query("vector_index_recall", "SELECT way, count(*) AS n_queries, TRUE AS reached FROM embeddings CROSS JOIN (VALUES ('cells'), ('codes')) AS ways(way) GROUP BY way")
def vector_index_recall(spark, sf_dir):
    """Whether the probed cells hold 0.9 of the exact neighbours of all vectors, scored by vectors and by codes with rescoring.

    The probes and the candidates by codes are those that a part of the queries asks for. A code stands for two
    dimensions, so that candidates stay few however many vectors there are.
    """
    index, queries = _index(spark, sf_dir, parts=DIM // 2)
    drawn = stage(ordering.seeded_limit(queries, "query_id", 200, "probes"), "index-asked")
    probes = index.probes_for(drawn, fixed.TOP_K, INDEX_RECALL + 0.03, skip_same=True)
    candidates = index.candidates_for(drawn, fixed.TOP_K, INDEX_RECALL + 0.02, probes, skip_same=True)
    exact = stage(index.search(queries, fixed.TOP_K, skip_same=True), "index-exact")
    ways = {"cells": None, "codes": candidates}
    shares = [
        knn.recall(index.search(queries, fixed.TOP_K, probes, rescored, skip_same=True), exact).select(F.lit(way).alias("way"), "recall") for way, rescored in ways.items()
    ]
    return shares[0].union(shares[1]).groupBy("way").agg(F.count(F.lit(1)).alias("n_queries"), (F.avg("recall") >= INDEX_RECALL).alias("reached"))


@query(
    "vector_index_upsert",
    f"""WITH merged AS (
  SELECT CASE WHEN label < 2 THEN 1000000 + vec_id ELSE vec_id END AS id, CASE WHEN label >= 7 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS v FROM embeddings
  UNION ALL SELECT vec_id, embedding FROM embeddings WHERE label < 2),
pairs AS (SELECT q.vec_id AS query_id, c.id AS match_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.v AS DOUBLE[])), 6) AS score
  FROM embeddings q JOIN merged c ON q.vec_id <> c.id WHERE q.label = 3)
{ranked_sql('SELECT * FROM pairs', fixed.TOP_K)}""",
)
def vector_index_upsert(spark, sf_dir):
    """Records turned round and records added, written into the touched cells; then searched."""
    index, queries = _index(spark, sf_dir)
    embeddings = st.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"), "label")
    turned = embeddings.filter("label >= 7").withColumn("values", F.transform("values", lambda x: -x))
    index.upsert(turned)
    index.upsert(embeddings.filter("label < 2").withColumn("id", F.col("id") + 1000000))
    asked = st.table(spark, sf_dir, "embeddings").filter("label = 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return index.search(asked, fixed.TOP_K, skip_same=True).withColumn("rank", F.col("rank").cast("long"))


DAMAGED_SQL = f"""damaged AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label NOT IN (3, 4, 6, 7, 8) AND NOT (label = 5 AND len(list_filter(embedding, lambda x: x > 0.2)) > 0))"""


@query(
    "knn_dirty",
    f"""WITH {DAMAGED_SQL}, pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS match_id, round(list_cosine_similarity(q.v, c.v), 6) AS score
  FROM damaged q JOIN damaged c ON q.vec_id <> c.vec_id)
SELECT way, hits.* FROM ({ranked_sql('SELECT * FROM pairs', fixed.TOP_K)}) hits CROSS JOIN (VALUES ('broadcast'), ('cells'), ('buckets')) AS ways(way)""",
)
def knn_dirty(spark, sf_dir):
    """Vectors cut short, null, holding nulls, infinities or NaN, or zero: the same matches on all three ways."""
    v = F.col("embedding").cast("array<double>")
    one = lambda value: F.concat(F.array(F.lit(float(value))), F.slice(v, 2, DIM - 1))
    damaged = (
        F.when(F.col("label") == 3, F.slice(v, 1, 60)).when(F.col("label") == 4, F.lit(None))
        .when(F.col("label") == 5, F.transform(v, lambda x: F.when(x.cast("float") <= 0.2, x)))
        .when(F.col("label") == 6, one("inf")).when(F.col("label") == 7, one("nan")).when(F.col("label") == 8, F.transform(v, lambda x: x * 0))
        .otherwise(v)
    )
    rows = st.table(spark, sf_dir, "embeddings").select("vec_id", damaged.alias("v"))
    options = dict(query_id="vec_id", query_vec="v", corpus_id="vec_id", corpus_vec="v", skip_same=True)
    ways = {
        "broadcast": knn.knn_join(rows, rows, fixed.TOP_K, **options),
        "cells": knn.knn_join(rows, rows, fixed.TOP_K, **options, max_broadcast_queries=0, corpus_chunk=64, query_chunk=64, pivots=8),
        "buckets": knn.knn_bucketed(rows, rows, fixed.TOP_K, **options, dim=DIM, tables=1, bits=0, corpus_chunk=128, query_chunk=128),
    }
    named = [hits.select(F.lit(way).alias("way"), "query_id", "match_id", "score", F.col("rank").cast("long").alias("rank")) for way, hits in ways.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query(
    "neighbour_agreement",
    f"""WITH hits AS ({ranked_sql(PAIRS_SQL, 3)})
SELECT query_id, any_value(q.label) AS label, string_agg(CAST(c.label AS VARCHAR), ',' ORDER BY rank) AS match_labels,
  avg(CASE WHEN q.label = c.label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS agreement
FROM hits JOIN embeddings q ON q.vec_id = query_id JOIN embeddings c ON c.vec_id = match_id GROUP BY query_id""",
)
def neighbour_agreement(spark, sf_dir):
    return retrieval.neighbour_agreement(_self_hits(spark, sf_dir, 3), st.table(spark, sf_dir, "embeddings"), "vec_id", "label")


# ---- text search: benchmark texts as questions, documents as corpus -----------------------------

DOC_VECTORS_CTE = st.vectors_sql("dv", "documents", "doc_id", "text")
QUESTION_VECTORS_CTE = st.vectors_sql("qv", "benchmark", "item_id", "text")


def text_hits_cte(k: int) -> str:
    return f"{DOC_VECTORS_CTE},\n{QUESTION_VECTORS_CTE},\n{st.hits_sql('hits', 'qv', 'dv', k)}"


@query("hash_embed", f"WITH {DOC_VECTORS_CTE} SELECT id AS doc_id, pos AS place, round(v, 6) AS weight FROM dv")
def hash_embed(spark, sf_dir):
    embedded = embed(st.documents(spark, sf_dir).select("doc_id", "text"), "text")
    places = embedded.select("doc_id", F.posexplode_outer("values").alias("place", "weight")).filter("weight <> 0")
    return places.select("doc_id", F.col("place").cast("long").alias("place"), F.round(F.col("weight").cast("double"), 6).alias("weight"))


def _vector_sums():
    pairs = F.transform(F.col("values").cast("array<double>"), lambda x, i: x * (i + 1))
    checksum = F.round(F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x), 4)
    return F.size(F.filter("values", lambda x: x != 0)).cast("long").alias("n_places"), checksum.alias("checksum")


@query(
    "corpus_build",
    f"""WITH {st.NEWS_CTE},
kept AS (SELECT "Id", "NewsHeadline" || ' ' || "ShortDescription" AS details, "NewsDate", "NewsCategory" FROM news
  WHERE "Id" NOT IN (SELECT "Id" FROM news ORDER BY "Id" DESC LIMIT {fixed.HOLDOUT_ROWS})),
{st.vectors_sql('kv', 'kept', '"Id"', 'details')}
SELECT CAST(kept."Id" AS VARCHAR) AS id, strftime("NewsDate", '%Y-%m-%d') AS news_date, "NewsCategory" AS news_category,
  count(*) AS n_places, round(sum(v * (pos + 1)), 4) AS checksum FROM kept JOIN kv ON kv.id = kept."Id" GROUP BY ALL""",
)
def corpus_build(spark, sf_dir):
    records = corpora.news_corpus(st.news(spark, sf_dir))
    metadata = [F.col("metadata")[name].alias(name) for name in ("news_date", "news_category")]
    return records.select("id", *metadata, *_vector_sums())


@query(
    "qa_corpus",
    f"""WITH {st.CODE_QA_CTE},
kept AS (SELECT "Id", concat("QuestionAsked", ' ', "OutputAnswer") AS pair FROM code_qa
  WHERE "DataSplit" = 'Training' AND length(concat("QuestionAsked", "OutputAnswer")) < {fixed.SHORT_PAIR_CHARS}),
{st.vectors_sql('kv', 'kept', '"Id"', 'pair')}
SELECT CAST(kept."Id" AS VARCHAR) AS id, 'Python Q&A' AS info, count(*) AS n_places, round(sum(v * (pos + 1)), 4) AS checksum
FROM kept JOIN kv ON kv.id = kept."Id" GROUP BY ALL""",
)
def qa_corpus(spark, sf_dir):
    records = corpora.pair_corpus(st.code_qa(spark, sf_dir))
    return records.select("id", F.col("metadata")["info"].alias("info"), *_vector_sums())


def _text_hits(spark, sf_dir, k=fixed.TOP_K):
    return retrieval.search(st.questions(spark, sf_dir), st.doc_vectors(spark, sf_dir), k, "item_id", "doc_id")


@query(
    "knn_documents",
    f"WITH {text_hits_cte(fixed.TOP_K)} SELECT query_id, match_id, score, rank, text, lang FROM hits JOIN documents ON doc_id = match_id",
)
def knn_documents(spark, sf_dir):
    documents = st.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fetched = retrieval.fetch_documents(_text_hits(spark, sf_dir), documents, "doc_id")
    return fetched.withColumn("rank", F.col("rank").cast("long"))


CONTEXT_SQL = """SELECT item_id, coalesce(context, '') AS context FROM benchmark LEFT JOIN (
  SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY {rank}) AS context FROM {hits} JOIN documents ON doc_id = match_id GROUP BY query_id)
ON query_id = item_id"""


@query("build_context", f"WITH {text_hits_cte(3)} {CONTEXT_SQL.format(rank='rank', hits='hits')}")
def build_context(spark, sf_dir):
    documents = st.table(spark, sf_dir, "documents").select("doc_id", "text")
    fetched = retrieval.fetch_documents(_text_hits(spark, sf_dir, 3), documents, "doc_id")
    return retrieval.build_context(fetched, st.table(spark, sf_dir, "benchmark").select("item_id"), "item_id")


@query("rag_basic", f"WITH {text_hits_cte(fixed.TOP_K)} {CONTEXT_SQL.format(rank='rank', hits='hits')}")
def rag_basic(spark, sf_dir):
    contexts = retrieval.basic_contexts(
        st.questions(spark, sf_dir), st.doc_vectors(spark, sf_dir), st.table(spark, sf_dir, "documents"), question_id="item_id", doc_id="doc_id", text_col="text"
    )
    return contexts.select("item_id", "context")


# ---- searches asked by the exchanges of conversations --------------------------------------------

EXCHANGE_CONTEXT_SQL = """SELECT "Id", coalesce(context, '') AS context FROM asked LEFT JOIN (
  SELECT query_id, string_agg({text}, chr(10) || chr(10) ORDER BY {rank}) AS context FROM {hits} JOIN {source} ON {id} = match_id GROUP BY query_id)
ON query_id = "Id\""""


@query("hyde_prompts", f"""WITH {st.PIVOTED_CTE} SELECT "Id", {st.sql_text(fixed.HYPOTHETICAL_PREFIX)} || "QuestionAsked" AS prompt FROM pivoted WHERE "QuestionAsked" IS NOT NULL""")
def hyde_prompts(spark, sf_dir):
    asked = st.pivoted(spark, sf_dir).filter(F.col("QuestionAsked").isNotNull())
    return asked.select("Id", prompts.hypothetical_prompt(F.col("QuestionAsked")).alias("prompt"))


@query(
    "rag_hyde",
    f"""WITH {st.PIVOTED_CTE}, asked AS (SELECT "Id", coalesce("OutputAnswer", "QuestionAsked") AS text FROM pivoted),
{DOC_VECTORS_CTE}, {st.vectors_sql('hv', 'asked', '"Id"', 'text')},
{st.hits_sql('hits', 'hv', 'dv', fixed.TOP_K)} {EXCHANGE_CONTEXT_SQL.format(text='documents.text', rank='rank', hits='hits', source='documents', id='doc_id')}""",
)
def rag_hyde(spark, sf_dir):
    """Every exchange: its recorded answer is the hypothetical text; without one the question itself."""
    asked = st.pivoted(spark, sf_dir).select("Id", embedding_column(F.coalesce("OutputAnswer", "QuestionAsked")).alias("values"))
    contexts = retrieval.basic_contexts(
        asked, st.doc_vectors(spark, sf_dir), st.table(spark, sf_dir, "documents"), question_id="Id", doc_id="doc_id", text_col="text"
    )
    return contexts.select("Id", "context")


CODE_CTE = f"""{st.CODE_QA_CTE},
pairs_of_text AS (SELECT "Id", concat("QuestionAsked", ' ', "OutputAnswer") AS pair_text FROM code_qa WHERE "DataSplit" = 'Training'),
asked AS (SELECT "Id", "QuestionAsked" AS text FROM code_qa WHERE "DataSplit" <> 'Training' AND "QuestionAsked" IS NOT NULL)"""


@query(
    "rag_code",
    f"""WITH {CODE_CTE}, {st.vectors_sql('pv', 'pairs_of_text', '"Id"', 'pair_text')}, {st.vectors_sql('av', 'asked', '"Id"', 'text')},
{st.hits_sql('hits', 'av', 'pv', fixed.TOP_K)}, {st.bm25_sql('bm', 'SELECT "Id" AS id, text FROM asked', 'pairs_of_text', '"Id"', 'pair_text')},
reranked AS (
  SELECT h.query_id, h.match_id, row_number() OVER (PARTITION BY h.query_id ORDER BY coalesce(b.score, 0.0) DESC, h.rank) AS new_rank
  FROM hits h LEFT JOIN bm b ON b.query_id = h.query_id AND b.match_id = h.match_id)
{EXCHANGE_CONTEXT_SQL.format(text='pair_text', rank='new_rank', hits='reranked', source='pairs_of_text p', id='p."Id"').replace('SELECT "Id", coalesce', 'SELECT asked."Id", coalesce').replace('ON query_id = "Id"', 'ON query_id = asked."Id"')}""",
)
def rag_code(spark, sf_dir):
    """Questions outside the training split search the training pairs; all hits are kept and reranked."""
    split = stage(st.code_qa(spark, sf_dir), "code-qa")
    asked = split.filter((F.col("DataSplit") != "Training") & F.col("QuestionAsked").isNotNull()).select("Id", F.col("QuestionAsked").alias("text"))
    pairs = split.filter(F.col("DataSplit") == "Training").select(F.col("Id").alias("pair_id"), concat_lenient(F.col("QuestionAsked"), F.col("OutputAnswer")).alias("text"))
    contexts = retrieval.reranked_contexts(
        embed(asked, "text"), embed(pairs, "text").select("pair_id", "values"), pairs, question_id="Id", question_text="text", doc_id="pair_id", text_col="text", fetch=fixed.TOP_K, keep=None
    )
    return contexts.select("Id", "context")


BM25_CTE = st.bm25_sql("bm", "SELECT item_id AS id, text FROM benchmark", "documents", "doc_id", "text")


@query("bm25_topk", f"WITH {BM25_CTE} {ranked_sql('SELECT * FROM bm', fixed.TOP_K)}")
def bm25_topk(spark, sf_dir):
    hits = bm25.bm25_topk(
        st.table(spark, sf_dir, "benchmark"), st.documents(spark, sf_dir), fixed.TOP_K,
        question_id="item_id", question_text="text", doc_id="doc_id", doc_text="text",
    )
    return hits.withColumn("rank", F.col("rank").cast("long"))


@query("bm25_index", f"WITH {BM25_CTE} {ranked_sql('SELECT * FROM bm', fixed.TOP_K)}")
def bm25_index(spark, sf_dir):
    """The same hits from a stored inverted index."""
    index = TextIndex.create(spark, fresh_path(spark, "text-index"), st.documents(spark, sf_dir), "doc_id", "text")
    hits = index.search(st.table(spark, sf_dir, "benchmark"), fixed.TOP_K, question_id="item_id", question_text="text")
    return hits.withColumn("rank", F.col("rank").cast("long"))


@query("learned_neighbours")
def learned_neighbours(spark, sf_dir):
    """The documents closest to each benchmark text by vectors learned from all documents."""
    docs = st.documents(spark, sf_dir)
    make = lsa.encoder_of(docs, lsa.fit(docs, "text", DIM))
    asked, corpus = (embed(df, "text", make_encoder=make) for df in (st.table(spark, sf_dir, "benchmark"), docs))
    return knn.knn_join(asked, corpus, fixed.TOP_K, query_id="item_id", query_vec="values", corpus_id="doc_id", corpus_vec="values")


RERANKED_CTE = f"""{text_hits_cte(fixed.RERANK_FROM)}, {BM25_CTE},
reranked AS (
  SELECT * FROM (
    SELECT h.query_id, h.match_id, h.score, h.rank, coalesce(b.score, 0.0) AS bm25,
      row_number() OVER (PARTITION BY h.query_id ORDER BY coalesce(b.score, 0.0) DESC, h.rank) AS new_rank
    FROM hits h LEFT JOIN bm b ON b.query_id = h.query_id AND b.match_id = h.match_id)
  WHERE new_rank <= {fixed.TOP_K})"""


@query("rerank_topn", f"WITH {RERANKED_CTE} SELECT query_id, match_id, rank, bm25, new_rank FROM reranked")
def rerank_topn(spark, sf_dir):
    best = retrieval.reranked_hits(
        st.questions(spark, sf_dir), st.doc_vectors(spark, sf_dir), st.documents(spark, sf_dir),
        question_id="item_id", question_text="text", doc_id="doc_id", text_col="text",
    )
    return best.select("query_id", "match_id", F.col("rank").cast("long").alias("rank"), "bm25", F.col("new_rank").cast("long").alias("new_rank"))


@query("rag_rerank", f"WITH {RERANKED_CTE} {CONTEXT_SQL.format(rank='new_rank', hits='reranked')}")
def rag_rerank(spark, sf_dir):
    contexts = retrieval.reranked_contexts(
        st.questions(spark, sf_dir), st.doc_vectors(spark, sf_dir), st.documents(spark, sf_dir),
        question_id="item_id", question_text="text", doc_id="doc_id", text_col="text",
    )
    return contexts.select("item_id", "context")
