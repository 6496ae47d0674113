"""Scans, loads, sinks, projections and filters over the given tables."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkwell.catalog import standins as st
from inkwell.catalog.registry import query
from inkwell.functions import fixed
from inkwell.functions.text import concat_lenient, concat_strict
from inkwell.operators.ordering import dense_index
from inkwell.operators.skew import tasks_of_scan
from inkwell.plans.corpora import short_pairs, without_input
from inkwell.session import fresh_path, stage
from inkwell.sources import reports, tables, vectors
from inkwell.sources.cache import missing_from_cache, with_content_key
from inkwell.sources.keyfilter import KeyFilters
from inkwell.sources.scan import scan_indexed, scan_renamed, scan_typed
from inkwell.sources.schema import key_violations

DOCUMENT_CONFIG = [
    {"Column_Name": "doc_id", "Column_Type": "Integer", "Primary_Key": True, "New_Name": "DocId"},
    {"Column_Name": "text", "Column_Type": "String", "New_Name": "Body"},
    {"Column_Name": "lang", "Column_Type": "Text", "New_Name": "Language"},
    {"Column_Name": "n_chars", "Column_Type": "Integer", "Source_Exclude": True, "New_Name": "Size"},
]
ORDER_CONFIG = [
    {"Column_Name": "Id", "Column_Type": "Integer", "Primary_Key": True, "Source_Exclude": True, "New_Name": "Id"},
    {"Column_Name": "o_orderkey", "Column_Type": "Integer", "New_Name": "OrderKey"},
    {"Column_Name": "o_orderstatus", "Column_Type": "String", "New_Name": "Status"},
    {"Column_Name": "o_totalprice", "Column_Type": "Float", "New_Name": "Price"},
    {"Column_Name": "o_orderdate", "Column_Type": "Datetime", "New_Name": "OrderDate"},
]
ORDER_TABLE_CONFIG = [c for c in ORDER_CONFIG if c["Column_Name"] != "Id"]


def _order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_renamed(spark, f"{sf_dir}/orders.parquet", ORDER_CONFIG).withColumn("OrderDate", F.to_date("OrderDate"))


ORDER_ROWS_SQL = """SELECT o_orderkey AS "OrderKey", o_orderstatus AS "Status", o_totalprice AS "Price",
  CAST(o_orderdate AS DATE) AS "OrderDate" FROM orders"""


def _new_table(spark: SparkSession, config: list[dict]) -> tuple[str, str]:
    """An external table in the shared folder under a name of its own."""
    name, path = f"inkwell_{uuid.uuid4().hex}", fresh_path(spark, "table")
    tables.create_table(spark, name, config, rebuild=True, location=path)
    return name, path


def _taken_out(spark: SparkSession, name: str, path: str) -> DataFrame:
    """The table's files, with its name dropped from the catalog."""
    schema = spark.table(name).schema
    spark.sql(f"DROP TABLE {name}")
    return spark.read.schema(schema).parquet(path)


@query("scan_typed", "SELECT doc_id, text, lang FROM documents")
def scan_typed_query(spark, sf_dir):
    return scan_typed(spark, f"{sf_dir}/documents.parquet", DOCUMENT_CONFIG)


@query("rename_columns", 'SELECT doc_id AS "DocId", text AS "Body", lang AS "Language" FROM documents')
def rename_columns(spark, sf_dir):
    return scan_renamed(spark, f"{sf_dir}/documents.parquet", DOCUMENT_CONFIG)


@query(
    "row_index",
    """SELECT "Id", o_orderkey AS "OrderKey", o_totalprice AS "Price"
FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS "Id" FROM orders) WHERE o_orderstatus = 'F'""",
)
def row_index(spark, sf_dir):
    indexed = scan_indexed(spark, f"{sf_dir}/orders.parquet", ORDER_CONFIG)
    return indexed.filter(F.col("Status") == "F").select("Id", "OrderKey", "Price")


@query(
    "create_table",
    'SELECT o_orderstatus AS "Status", count(*) AS n_rows, CAST(max(o_orderdate) AS DATE) AS last_date FROM orders GROUP BY 1',
)
def create_table(spark, sf_dir):
    name, path = _new_table(spark, ORDER_TABLE_CONFIG)
    tables.load(spark, _order_rows(spark, sf_dir), name)
    tables.create_table(spark, name, ORDER_TABLE_CONFIG)  # keeps what is there
    rows = _taken_out(spark, name, path)
    return rows.groupBy("Status").agg(F.count(F.lit(1)).alias("n_rows"), F.max("OrderDate").alias("last_date"))


@query("read_columns", "SELECT doc_id, lang FROM documents")
def read_columns(spark, sf_dir):
    st.table(spark, sf_dir, "documents").createOrReplaceTempView("inkwell_documents")
    return tables.read_columns(spark, "inkwell_documents", ["doc_id", "lang"])


@query(
    "sql_query",
    """SELECT o_orderpriority AS priority, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
FROM orders WHERE o_totalprice > 100000 GROUP BY 1""",
)
def sql_query(spark, sf_dir):
    text = """SELECT o_orderpriority AS priority, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
    FROM {orders} WHERE o_totalprice > :floor GROUP BY o_orderpriority"""
    return tables.sql_query(spark, text, {"floor": 100000}, orders=st.table(spark, sf_dir, "orders"))


@query("load_overwrite", ORDER_ROWS_SQL + " WHERE o_orderstatus <> 'P'")
def load_overwrite(spark, sf_dir):
    rows = _order_rows(spark, sf_dir)
    name, path = _new_table(spark, ORDER_TABLE_CONFIG)
    tables.load(spark, rows, name, chunk_rows=5000)
    shuffled = rows.filter(F.col("Status") != "P").select("OrderDate", "Price", "Status", "OrderKey")
    tables.load(spark, shuffled, name, keys=["OrderKey"], chunk_rows=5000)
    return _taken_out(spark, name, path)


@query("load_append", ORDER_ROWS_SQL)
def load_append(spark, sf_dir):
    rows = _order_rows(spark, sf_dir)
    name, path = _new_table(spark, ORDER_TABLE_CONFIG)
    for part in (rows.filter(F.col("Status") == "F"), rows.filter(F.col("Status") != "F")):
        tables.load(spark, part, name, overwrite=False, keys=["OrderKey"])
    return _taken_out(spark, name, path)


@query(
    "key_filter_append",
    """SELECT "OrderKey", TRUE AS some_unread FROM (SELECT o_orderkey AS "OrderKey" FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey <= 500)
UNION ALL SELECT -count(*), TRUE FROM orders""",
)
def key_filter_append(spark, sf_dir):
    """An append through key filters: the keys of a batch that are stored already, and the rows once the others are in (negative).

    Most files hold no key of the batch and are not read.
    """
    rows = _order_rows(spark, sf_dir)
    name, path = _new_table(spark, ORDER_TABLE_CONFIG)
    filters = KeyFilters(spark, name, ["OrderKey"])
    stored = rows.filter(F.col("OrderKey") % 4 != 0)
    tables.load(spark, stored.repartitionByRange(16, "OrderKey"), name, keys=["OrderKey"], filters=filters)
    batch = rows.filter(F.col("OrderKey") <= 500)
    taken = stage(filters.taken(batch), "taken-keys")
    read, total = filters.files_for(batch)
    tables.load(spark, rows.filter(F.col("OrderKey") % 4 == 0), name, overwrite=False, keys=["OrderKey"], filters=filters)
    whole = _taken_out(spark, name, path).agg((-F.count(F.lit(1))).alias("OrderKey"))
    return taken.select(F.col("OrderKey").cast("long").alias("OrderKey")).union(whole).withColumn("some_unread", F.lit(len(read) < total))


@query("key_violations", "SELECT md5(text) AS text_key, count(*) AS n_rows FROM documents GROUP BY 1 HAVING count(*) > 1 OR md5(text) IS NULL")
def key_violations_query(spark, sf_dir):
    keyed = st.table(spark, sf_dir, "documents").select(F.md5("text").alias("text_key"))
    return key_violations(keyed, ["text_key"])


@query(
    "delete_where_reload",
    """SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT coalesce(quality = 0, FALSE)
UNION ALL SELECT doc_id + 1000000000, 2 FROM labels WHERE quality = 0""",
)
def delete_where_reload(spark, sf_dir):
    labels = st.table(spark, sf_dir, "labels").select("doc_id", "quality")
    marked = st.table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    name, path = f"inkwell_{uuid.uuid4().hex}", fresh_path(spark, "table")
    spark.sql(f"CREATE TABLE {name} (doc_id BIGINT, quality INT) USING parquet LOCATION '{path}'")
    tables.load(spark, marked, name)
    again = labels.filter("quality = 0").select((F.col("doc_id") + 1000000000).alias("doc_id"), F.lit(2).alias("quality"))
    return _taken_out(spark, name, tables.replace_after_delete(spark, name, F.col("quality") == 0, again))


@query("sql_script", f'WITH {st.QA_CTE}, {st.KEYS_CTE} SELECT "Id", "ExtractedAnswer" FROM keys')
def sql_script(spark, sf_dir):
    name, path = f"inkwell_{uuid.uuid4().hex}", fresh_path(spark, "table")
    source = f"{name}_source"
    st.qa(spark, sf_dir).createOrReplaceTempView(source)
    tables.run_script(
        spark,
        f"""-- the key table; made once
        CREATE TABLE IF NOT EXISTS {name} (Id BIGINT, ExtractedAnswer DOUBLE) USING parquet LOCATION '{path}';
        /* all keys; replaced on every run */
        INSERT OVERWRITE {name}
        SELECT Id, try_cast(replace(split_part(AnswersGiven, '####', 2), ',', '') AS DOUBLE) FROM {source}
        WHERE AnswersGiven <> ';';""",
    )
    return _taken_out(spark, name, path)


@query("parquet_roundtrip", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def parquet_roundtrip(spark, sf_dir):
    documents = st.table(spark, sf_dir, "documents")
    path = fresh_path(spark, "roundtrip")
    tables.write_parquet(documents, path, tasks=tasks_of_scan(documents, tables.WRITTEN_BYTES))
    return spark.read.schema(documents.schema).parquet(path)


@query(
    "report_readback",
    """SELECT lpad(CAST(turn AS VARCHAR), 3, '0') AS run, replace(split_part('Question: ' || text || chr(10) || '===============' || chr(10) || 'Answer: ' || turn, '===============', 1),
  'Question: ', '') AS question FROM conversations""",
)
def report_readback(spark, sf_dir):
    path = fresh_path(spark, "reports")
    turn = F.col("turn").cast("string")
    asked = st.table(spark, sf_dir, "conversations").withColumn("answer", turn).withColumn("run", F.lpad(turn, 3, "0"))
    reports.write_reports(asked, path, "run", "text", "answer")
    return reports.read_reports(spark, path).select("run", reports.report_question(F.col("value")).alias("question"))


@query(
    "cache_missing",
    """SELECT DISTINCT md5(text) AS content_key, length(text) AS n_chars FROM documents
WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'en')""",
)
def cache_missing(spark, sf_dir):
    documents = st.table(spark, sf_dir, "documents")
    cache = with_content_key(documents.filter("lang = 'en'"), "text").select("content_key").distinct()
    missing = missing_from_cache(documents, cache, "text")
    return missing.select("content_key", F.length("text").cast("long").alias("n_chars"))


def _checksum(values: str):
    weighted = F.transform(F.col(values).cast("array<double>"), lambda x, i: x * (i + 1))
    return F.round(F.aggregate(weighted, F.lit(0.0), lambda acc, x: acc + x), 4)


CHECKSUM_SQL = "round(list_sum(list_transform({v}, lambda x, i: CAST(x AS DOUBLE) * i)), 4)"


@query(
    "vector_upsert",
    f"""WITH stored AS (SELECT CAST(vec_id AS VARCHAR) AS id, embedding AS v, '0' AS version, label FROM embeddings),
batch AS (
  SELECT id, list_reverse(v) AS v, '1' AS version, label, 1 AS seq FROM stored WHERE label >= 5
  UNION ALL SELECT id, list_transform(v, lambda x: -x), '2', label, 2 FROM stored WHERE label >= 7
  UNION ALL SELECT id, v, '3', label, NULL FROM stored WHERE label IN (2, 7)
  UNION ALL SELECT 'new-' || id, v, '1', label, 1 FROM stored WHERE label < 2),
latest AS (SELECT id, v, version, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC NULLS LAST) AS pos FROM batch) WHERE pos = 1),
merged AS (SELECT id, v, version, label FROM stored WHERE id NOT IN (SELECT id FROM batch) UNION ALL SELECT id, v, version, label FROM latest)
SELECT id, version, CAST(label AS VARCHAR) AS label, {CHECKSUM_SQL.format(v='v')} AS checksum FROM merged""",
)
def vector_upsert(spark, sf_dir):
    embeddings = st.table(spark, sf_dir, "embeddings")

    def record(version: str, values, prefix: str = "") -> list:
        key = F.concat(F.lit(prefix), F.col("vec_id").cast("string"))
        return vectors.vector_record(key, values, {"label": F.col("label"), "version": F.lit(version)})

    stored = embeddings.select(*record("0", F.col("embedding")))
    turned = embeddings.filter("label >= 5").select(*record("1", F.reverse("embedding")), F.lit(1).alias("seq"))
    negated = embeddings.filter("label >= 7").select(*record("2", F.transform("embedding", lambda x: -x)), F.lit(2).alias("seq"))
    added = embeddings.filter("label < 2").select(*record("1", F.col("embedding"), "new-"), F.lit(1).alias("seq"))
    unordered = embeddings.filter("label IN (2, 7)").select(*record("3", F.col("embedding")), F.lit(None).cast("int").alias("seq"))
    batch = tables.union_runs([turned, negated, added, unordered])
    name, path = f"inkwell_{uuid.uuid4().hex}", fresh_path(spark, "vectors")
    spark.sql(f"CREATE TABLE {name} (id STRING, values ARRAY<FLOAT>, metadata MAP<STRING, STRING>) USING parquet LOCATION '{path}'")
    vectors.rebuild_vectors(stored, path, 64)
    spark.catalog.refreshTable(name)
    vectors.upsert_table(spark, name, batch, "seq")
    merged = _taken_out(spark, name, vectors.upsert_table(spark, name, batch, "seq"))  # the second time changes nothing
    return merged.select(
        "id", F.col("metadata")["version"].alias("version"), F.col("metadata")["label"].alias("label"), _checksum("values").alias("checksum")
    )


@query(
    "vector_dim_check",
    """SELECT vec_id FROM embeddings WHERE label IN (3, 4) OR (label = 5 AND len(list_filter(embedding, lambda x: x > 0.2)) > 0)""",
)
def vector_dim_check(spark, sf_dir):
    damaged = (
        F.when(F.col("label") == 3, F.slice("embedding", 1, 60))
        .when(F.col("label") == 4, F.lit(None))
        .when(F.col("label") == 5, F.transform("embedding", lambda x: F.when(x <= 0.2, x)))
        .otherwise(F.col("embedding"))
    )
    records = st.table(spark, sf_dir, "embeddings").select("vec_id", damaged.alias("values"))
    return vectors.wrong_dimension(records, 64).select("vec_id")


# ---- projections and filters --------------------------------------------------------------------


@query("date_truncate", "SELECT event_id, CAST(ts AS DATE) AS event_date FROM events")
def date_truncate(spark, sf_dir):
    return st.table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("event_date"))


@query("date_filter", "SELECT event_id, CAST(ts AS DATE) AS event_date FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-15'")
def date_filter(spark, sf_dir):
    dated = st.table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("event_date"))
    return dated.filter(F.col("event_date") > F.lit(datetime.date(2024, 1, 15)))


@query("concat_strict", f"""WITH {st.PIVOTED_CTE} SELECT "Id", "QuestionAsked" || ' ' || "QuestionInput" AS joined FROM pivoted""")
def concat_strict_query(spark, sf_dir):
    return st.pivoted(spark, sf_dir).select("Id", concat_strict(F.col("QuestionAsked"), F.col("QuestionInput")).alias("joined"))


@query("concat_lenient", f"""WITH {st.PIVOTED_CTE} SELECT "Id", concat("QuestionAsked", ' ', "QuestionInput") AS joined FROM pivoted""")
def concat_lenient_query(spark, sf_dir):
    return st.pivoted(spark, sf_dir).select("Id", concat_lenient(F.col("QuestionAsked"), F.col("QuestionInput")).alias("joined"))


@query("drop_columns", "SELECT doc_id, lang, n_chars FROM documents")
def drop_columns(spark, sf_dir):
    return st.table(spark, sf_dir, "documents").drop("text", "source")


@query(
    "length_filter",
    f"""WITH {st.CODE_QA_CTE} SELECT "Id", concat("QuestionAsked", ' ', "OutputAnswer") AS "PairText" FROM code_qa
WHERE "DataSplit" = 'Training' AND length(concat("QuestionAsked", "OutputAnswer")) < {fixed.SHORT_PAIR_CHARS}""",
)
def length_filter(spark, sf_dir):
    return short_pairs(st.code_qa(spark, sf_dir))


@query(
    "training_filter",
    f"""WITH {st.CODE_QA_CTE} SELECT "Id", "QuestionAsked", "QuestionInput", "OutputAnswer", "DataSplit" FROM code_qa
WHERE "DataSplit" = 'Training' AND "QuestionInput" = ''""",
)
def training_filter(spark, sf_dir):
    return without_input(st.code_qa(spark, sf_dir), "Training")


@query(
    "literal_columns",
    f"""SELECT conv_id, turn, {st.sql_text(fixed.MODEL_NAME)} AS "ModelName", CAST(0.2 AS DOUBLE) AS "ModelTemperature",
  'OPRO' AS "RunStyle", DATE '{st.RUN_DATE}' AS "RunDate" FROM conversations""",
)
def literal_columns(spark, sf_dir):
    from inkwell.plans.runs import run_literals

    turns = st.table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return run_literals(turns, fixed.MODEL_NAME, fixed.MODEL_TEMPERATURE, "OPRO", st.RUN_DATE)


@query("case_flag", "SELECT doc_id, CASE WHEN quality - 1 = 0 THEN 1 ELSE 0 END AS flag FROM documents LEFT JOIN labels USING (doc_id)")
def case_flag(spark, sf_dir):
    from inkwell.functions.text import is_correct

    marked = st.table(spark, sf_dir, "documents").select("doc_id").join(st.table(spark, sf_dir, "labels"), "doc_id", "left")
    return marked.select("doc_id", is_correct(F.col("quality"), F.lit(1)).alias("flag"))


@query("cast_double", "SELECT o_orderkey, TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS level, TRY_CAST(o_orderpriority AS DOUBLE) AS whole FROM orders")
def cast_double(spark, sf_dir):
    return st.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).try_cast("double").alias("level"),
        F.col("o_orderpriority").try_cast("double").alias("whole"),
    )


@query("id_shift", 'SELECT conv_id, turn, conv_id + 1 AS "Id" FROM conversations')
def id_shift(spark, sf_dir):
    return st.table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") + 1).alias("Id"))


@query("date_text", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_day FROM orders")
def date_text(spark, sf_dir):
    return st.table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_day"))


@query(
    "vector_records",
    f"""SELECT CAST(vec_id AS VARCHAR) AS id, CAST(len(embedding) AS BIGINT) AS dimension, CAST(label AS VARCHAR) AS label,
  {CHECKSUM_SQL.format(v='embedding')} AS checksum FROM embeddings""",
)
def vector_records(spark, sf_dir):
    embeddings = st.table(spark, sf_dir, "embeddings")
    records = embeddings.select(*vectors.vector_record(F.col("vec_id"), F.col("embedding"), {"label": F.col("label")}))
    return records.select(
        "id", F.size("values").cast("long").alias("dimension"), F.col("metadata")["label"].alias("label"), _checksum("values").alias("checksum")
    )


@query(
    "surrogate_keys",
    """SELECT (SELECT coalesce(max(event_id), 0) FROM events) + row_number() OVER (ORDER BY ts, event_id) AS "Id", event_id FROM events""",
)
def surrogate_keys(spark, sf_dir):
    events = st.table(spark, sf_dir, "events").select("event_id", "ts")
    stored = tables.max_id(events, "event_id").first()["Id"]
    return dense_index(events, ["ts", "event_id"], "Id", stored + 1).select("Id", "event_id")
