"""Question, news, answer and attempt tables derived from the given tables, in Spark and in SQL.

Every frame covers its whole source table. The SQL twins are common table expressions.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkwell.functions import fixed
from inkwell.functions.text import answer_key, extract_number
from inkwell.operators.embed import embedding_column
from inkwell.operators.ordering import train_val_test_split
from inkwell.operators.skew import spread_small_input
from inkwell.plans.corpora import TURNS, exchanges
from inkwell.plans.runs import score_run
from inkwell.session import stage

RUN_DATE = datetime.date(2024, 3, 1)
SPLIT_SEED = 42
VARIANTS = ["base", "base_rag", "loop_rag", "tuned_loop_rag"]
CANDIDATES = [
    (1, "Let us work it out step by step"),
    (1, "The answer is"),
    (1, "Calculating the answer, we get"),
    (2, "First list what is known"),
    (2, "Break the problem into parts"),
    (2, "Think about the units"),
    (3, "Write the equation and solve it"),
    (3, "Check the result twice"),
    (3, "Start from the question"),
    (4, "Draw a picture of the problem"),
    (4, "Estimate the result before computing"),
    (4, "Name every quantity"),
    (5, "Work backwards from what is asked"),
    (5, "Do one operation at a time"),
    (5, "Restate the question in short words"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, spread over the cores for work on their texts."""
    return spread_small_input(table(spark, sf_dir, "documents"), "doc_id")


def sql_text(value: str) -> str:
    """A SQL string literal of any text."""
    return "'" + value.replace("'", "''") + "'"


def digit(prefix: Column | str, key: Column) -> Column:
    """A hex digit that depends on a text and a key: the first of md5(`text:key`)."""
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.substring(F.md5(F.concat(head, F.lit(":"), key.cast("string"))), 1, 1)


# ---- numeric questions with an answer key, from orders ------------------------------------------


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.floor("o_totalprice").cast("long")
    question = F.concat(
        F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" was placed on "), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit(" with priority "), F.col("o_orderpriority"), F.lit(". What is its price in whole units?"),
    )
    answer = F.concat(F.lit("The listed price is "), whole.cast("string"), F.lit(" units. #### "), F.format_number(whole, 0))
    return spread_small_input(table(spark, sf_dir, "orders"), "o_orderkey").select(
        F.col("o_orderkey").alias("Id"), question.alias("QuestionAsked"), answer.alias("AnswersGiven")
    )


QA_CTE = """qa AS (
  SELECT o_orderkey AS "Id",
    'Order ' || o_orderkey || ' was placed on ' || strftime(o_orderdate, '%Y-%m-%d') || ' with priority ' || o_orderpriority
      || '. What is its price in whole units?' AS "QuestionAsked",
    'The listed price is ' || CAST(floor(o_totalprice) AS BIGINT) || ' units. #### '
      || format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS "AnswersGiven"
  FROM orders)"""


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa(spark, sf_dir).select("Id", answer_key(F.col("AnswersGiven")).alias("ExtractedAnswer"))


KEYS_CTE = """keys AS (
  SELECT "Id", TRY_CAST(replace(split_part("AnswersGiven", '####', 2), ',', '') AS DOUBLE) AS "ExtractedAnswer" FROM qa)"""


def reply_text(selector: Column, value: Column) -> Column:
    """A recorded reply: right, wrong, prose, several lines or decorated, by the selector digit."""
    shown = F.format_number(value.cast("long"), 0)
    return (
        F.when(selector <= "9", F.concat(F.lit("Working it out gives #### $"), shown))
        .when(selector <= "c", F.concat(F.lit("####"), (value.cast("long") + 1).cast("string"), F.lit(".")))
        .when(selector == "d", F.lit("I am not sure about this one"))
        .when(selector == "e", F.concat(F.lit("#### 7\n#### first 8\n"), value.cast("long").cast("string")))
        .otherwise(F.concat(F.lit("The answer is #### ("), value.cast("string"), F.lit(" units)")))
    )


REPLY_SQL = """CASE WHEN {d} <= '9' THEN 'Working it out gives #### $' || format('{{:,}}', CAST({v} AS BIGINT))
    WHEN {d} <= 'c' THEN '####' || (CAST({v} AS BIGINT) + 1) || '.'
    WHEN {d} = 'd' THEN 'I am not sure about this one'
    WHEN {d} = 'e' THEN '#### 7' || chr(10) || '#### first 8' || chr(10) || CAST({v} AS BIGINT)
    ELSE 'The answer is #### (' || CAST({v} AS BIGINT) || '.0 units)' END"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(RowId, RunStyle, Reply): every question answered under every run style."""
    style = F.explode(F.array(*[F.lit(s) for s in fixed.RUN_STYLES])).alias("RunStyle")
    base = keys(spark, sf_dir).select(F.col("Id").alias("RowId"), F.col("ExtractedAnswer").cast("long").alias("value"), style)
    return base.select("RowId", "RunStyle", reply_text(digit(F.col("RunStyle"), F.col("RowId")), F.col("value").cast("decimal(18,1)")).alias("Reply"))


STYLES_SQL = "(VALUES " + ", ".join(f"({sql_text(s)})" for s in fixed.RUN_STYLES) + ') AS styles("RunStyle")'

REPLIES_CTE = """replies AS (
  SELECT "Id" AS "RowId", "RunStyle", {reply} AS "Reply"
  FROM (SELECT "Id", "ExtractedAnswer", "RunStyle", substr(md5("RunStyle" || ':' || "Id"), 1, 1) AS d FROM keys CROSS JOIN {styles}))""".format(
    reply=REPLY_SQL.format(d="d", v='"ExtractedAnswer"'), styles=STYLES_SQL
)

BLANKS_SQL = r"[\t-\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^{BLANKS_SQL}+|{BLANKS_SQL}+\\z', '', 'g')"


def extract_number_sql(text: str) -> str:
    tail = strip_sql(f"string_split({text}, '####')[-1]")
    cleaned = strip_sql(f"regexp_replace({tail}, '[a-zA-Z$%/''=+(), ]', '', 'g')")
    trimmed = f"regexp_replace(regexp_replace({cleaned}, '\\.\\z', ''), '-\\z', '')"
    last = strip_sql(f"string_split({trimmed}, chr(10))[-1]")
    number = r"^-?([0-9]+(_[0-9]+)*|[0-9]+(_[0-9]+)*\.([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)\z"
    return f"coalesce(CASE WHEN regexp_matches({last}, '{number}') THEN TRY_CAST(replace({last}, '_', '') AS DOUBLE) END, 0.0)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored answers of all run styles over all questions."""
    answers = replies(spark, sf_dir).select("RowId", "RunStyle", extract_number(F.col("Reply")).alias("OpenAIAnswer"))
    return score_run(answers, keys(spark, sf_dir), RUN_DATE, F.col("RunStyle"))


SCORED_CTE = ",\n".join(
    [
        QA_CTE,
        KEYS_CTE,
        REPLIES_CTE,
        f"""answered AS (SELECT "RowId", "RunStyle", {extract_number_sql('"Reply"')} AS "OpenAIAnswer" FROM replies)""",
        f"""scored AS (
  SELECT a."RowId", a."OpenAIAnswer", k."ExtractedAnswer", {sql_text(fixed.MODEL_NAME)} AS "ModelName",
    CAST({fixed.MODEL_TEMPERATURE} AS DOUBLE) AS "ModelTemperature", a."RunStyle",
    CASE WHEN a."OpenAIAnswer" - k."ExtractedAnswer" = 0 THEN 1 ELSE 0 END AS "IndCorrect", DATE '{RUN_DATE}' AS "RunDate"
  FROM answered a JOIN keys k ON a."RowId" = k."Id")""",
    ]
)

DIM_CTE = """counts AS (
  SELECT "ModelName", "ModelTemperature", "RunStyle", "RunDate", CAST(sum("IndCorrect") AS BIGINT) AS "CorrectCounts", count(*) AS "TotalCounts"
  FROM scored GROUP BY ALL),
dim AS (
  SELECT row_number() OVER (ORDER BY "ModelName", "ModelTemperature", "RunStyle", "RunDate") AS "ModelId", "ModelName", "ModelTemperature",
    "RunStyle", CAST("CorrectCounts" AS DOUBLE) / CAST("TotalCounts" AS DOUBLE) * 100 AS "ModelAccuracy", "RunDate"
  FROM counts)"""

# ---- conversations as question / input / answer rows --------------------------------------------

ROLE_COLUMNS = {"user": "QuestionAsked", "system": "QuestionInput", "assistant": "OutputAnswer"}


def pivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per exchange: a user turn, the assistant turn after it, and the conversation's system text."""
    return exchanges(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text", ROLE_COLUMNS)


PIVOTED_CTE = f"""spoken AS (SELECT conv_id, turn - CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS spot, role, text FROM conversations WHERE role IN ('user', 'assistant')),
systems AS (SELECT conv_id, max(text) AS system_text FROM conversations WHERE role = 'system' GROUP BY conv_id),
pairs_of_turns AS (SELECT conv_id, spot, max(text) FILTER (role = 'user') AS question, max(text) FILTER (role = 'assistant') AS answer FROM spoken GROUP BY conv_id, spot),
pivoted AS (
  SELECT coalesce(p.conv_id, s.conv_id) * {TURNS} + coalesce(spot, 0) + 1 AS "Id", question AS "QuestionAsked", system_text AS "QuestionInput", answer AS "OutputAnswer"
  FROM pairs_of_turns p FULL JOIN systems s ON p.conv_id = s.conv_id)"""


def code_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivoted conversations with an empty text for a missing input, and their split."""
    filled = pivoted(spark, sf_dir).withColumn("QuestionInput", F.coalesce("QuestionInput", F.lit("")))
    filled = stage(filled, "exchanges")  # each count of the split reads it again
    return train_val_test_split(filled, "Id", SPLIT_SEED)


def split_sql(source: str, id_col: str) -> str:
    return f"""(SELECT *, CASE WHEN pos <= CAST(floor(0.8::DOUBLE * n) AS BIGINT) THEN 'Training'
    WHEN pos <= CAST(floor(0.8::DOUBLE * n) AS BIGINT) + CAST(floor(0.1::DOUBLE * n) AS BIGINT) THEN 'Validation' ELSE 'Testing' END AS "DataSplit"
  FROM (SELECT *, row_number() OVER (ORDER BY md5('{SPLIT_SEED}:' || {id_col}), {id_col}) AS pos, count(*) OVER () AS n FROM {source}))"""


CODE_QA_CTE = PIVOTED_CTE + f""",
filled AS (SELECT "Id", "QuestionAsked", coalesce("QuestionInput", '') AS "QuestionInput", "OutputAnswer" FROM pivoted),
code_qa AS (SELECT "Id", "QuestionAsked", "QuestionInput", "OutputAnswer", "DataSplit" FROM {split_sql('filled', '"Id"')})"""

# ---- news from documents ------------------------------------------------------------------------


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit(datetime.date(2021, 9, 1)), F.pmod(F.col("n_chars"), F.lit(365)).cast("int"))
    return documents(spark, sf_dir).select(
        (F.col("doc_id") + 1).alias("Id"), F.col("text").alias("NewsHeadline"), F.col("source").alias("ShortDescription"),
        F.col("lang").alias("NewsCategory"), day.alias("NewsDate"),
    )


NEWS_CTE = """news AS (
  SELECT doc_id + 1 AS "Id", text AS "NewsHeadline", source AS "ShortDescription", lang AS "NewsCategory",
    CAST(DATE '2021-09-01' + CAST(n_chars % 365 AS INTEGER) AS DATE) AS "NewsDate" FROM documents)"""


def vectors_sql(name: str, source: str, id_col: str, text_col: str, dim: int = fixed.VECTOR_DIMENSION) -> str:
    """Sparse hashed word vectors: (id, pos, v), unit length in single precision, with full norms."""
    return f"""{name}_places AS (
  SELECT id, ('0x' || substr(md5(tok), 1, 8))::BIGINT % {dim} AS pos, CAST(count(*) AS DOUBLE) AS c
  FROM (SELECT {id_col} AS id, unnest(list_filter(string_split_regex(lower({text_col}), '[^a-z0-9]+'), lambda t: t <> '')) AS tok FROM {source})
  GROUP BY ALL),
{name} AS (
  SELECT id, pos, CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS FLOAT) AS DOUBLE) AS v FROM {name}_places)"""


def hits_sql(name: str, queries: str, corpus: str, k: int) -> str:
    """Top-k cosine hits between two sparse vector tables."""
    return f"""{name}_norms AS (SELECT id, sqrt(sum(v * v)) AS norm FROM {corpus} GROUP BY id),
{name}_asked AS (SELECT id, sqrt(sum(v * v)) AS norm FROM {queries} GROUP BY id),
{name}_dots AS (SELECT q.id AS query_id, c.id AS match_id, sum(q.v * c.v) AS dot FROM {queries} q JOIN {corpus} c ON q.pos = c.pos GROUP BY ALL),
{name} AS (
  SELECT query_id, match_id, score, rank FROM (
    SELECT query_id, match_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, match_id) AS rank
    FROM (SELECT query_id, match_id, round(dot / (a.norm * n.norm), 6) AS score FROM {name}_dots
      JOIN {name}_asked a ON a.id = query_id JOIN {name}_norms n ON n.id = match_id))
  WHERE rank <= {k})"""


def doc_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", embedding_column(F.col("text")).alias("values"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", "text", embedding_column(F.col("text")).alias("values"))


def bm25_sql(name: str, questions_sql: str, docs: str, doc_id: str, text: str) -> str:
    """(query_id, match_id, score) for every question and document that share a term."""
    split = lambda col: f"list_filter(string_split_regex(lower({col}), '[^a-z0-9]+'), lambda t: t <> '')"
    return f"""{name}_terms AS (SELECT id AS query_id, unnest(list_distinct({split('text')})) AS term FROM ({questions_sql})),
{name}_lists AS MATERIALIZED (SELECT {doc_id} AS match_id, {split(text)} AS ws FROM {docs}),
{name}_sizes AS MATERIALIZED (SELECT match_id, len(ws) AS length FROM {name}_lists),
{name}_words AS (SELECT match_id, unnest(ws) AS term FROM {name}_lists),
{name}_tf AS MATERIALIZED (SELECT match_id, term, CAST(count(*) AS DOUBLE) AS tf FROM {name}_words GROUP BY ALL),
{name}_mean AS (SELECT count(*) AS n, avg(length) AS mean FROM {name}_sizes),
{name}_idf AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM {name}_tf, {name}_mean GROUP BY term),
{name} AS (SELECT query_id, match_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
  FROM {name}_terms JOIN {name}_tf USING (term) JOIN {name}_idf USING (term) JOIN {name}_sizes USING (match_id), {name}_mean GROUP BY ALL)"""


# ---- judged attempts from documents and labels --------------------------------------------------


#: What the judge said, by the digit of an attempt: verdicts, decorated ones, and words that only begin like one.
RELEVANCE = {
    **dict.fromkeys("01", "Yes"), "2": " yes.\n", "3": "**Yes**", "4": "Not sure", "5": "Yesterday it ran", "6": "'no'", "7": "None of it",
    "8": "(yes) it does", "9": "Yes-man", "a": "No.", **dict.fromkeys("bcd", "no"), "e": "maybe", "f": "NEEDS IMPROVEMENT, names",
}
OPENING_MARKS = "\"'*_`.([‘“ \t\n"
CLOSING_MARKS = "'’-"
WORD_BREAK = r"[^\p{L}\p{N}_'" + "’-]+"


def attempt_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, variant, quality_mark, toxic) of every document under every variant."""
    variant = F.explode(F.array(*[F.lit(v) for v in VARIANTS])).alias("variant")
    marks = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("quality_mark"), "toxic")
    pairs = documents(spark, sf_dir).select("doc_id").join(marks, "doc_id", "left")
    return pairs.select(F.col("doc_id").alias("question_id"), variant, "quality_mark", "toxic")


def _attempt_sign() -> Column:
    return digit(F.concat(F.col("variant"), F.lit("/"), F.col("attempt").cast("string")), F.col("question_id"))


def generated(rows: DataFrame) -> DataFrame:
    """What the recorded model answers to (question_id, variant, attempt)."""
    number = F.col("question_id").cast("string")
    fenced = F.concat(F.lit("Try this:\n```python\nprint("), number, F.lit(")\n```\nor\n```\nreturn "), F.col("attempt").cast("string"), F.lit("\n```\n"))
    return rows.withColumn("answer", F.when(_attempt_sign() <= "b", fenced).otherwise(F.concat(F.lit("print("), number, F.lit(")"))))


def judged_relevant(rows: DataFrame) -> DataFrame:
    return rows.withColumn("relevance", F.element_at(F.create_map(*[F.lit(x) for pair in RELEVANCE.items() for x in pair]), _attempt_sign()))


def graded(rows: DataFrame) -> DataFrame:
    quality = (
        F.when(F.col("toxic") == 1, F.lit("No, it fails."))
        .when(F.col("quality_mark") == 1, F.lit("Yes"))
        .when(F.col("quality_mark") == 0, F.lit("Needs improvement: names"))
        .otherwise(F.lit("Hard to say"))
    )
    return rows.withColumn("quality", quality)


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, variant, attempt, answer, relevance, quality): up to 30 attempts per pair.

    Half of the pairs have one attempt, most others a few, and some run past the step limit.
    """
    length = digit(F.col("variant"), F.col("question_id"))
    tries = F.when(length <= "7", 1).when(length <= "e", 4).otherwise(30)
    tried = attempt_pairs(spark, sf_dir).select("*", F.explode(F.sequence(F.lit(1), tries)).alias("attempt"))
    return graded(judged_relevant(generated(tried))).select("question_id", "variant", "attempt", "answer", "relevance", "quality")


VARIANTS_SQL = "(VALUES " + ", ".join(f"({sql_text(v)})" for v in VARIANTS) + ") AS variants(variant)"

FENCE_SQL = r"(?s)```[a-zA-Z0-9_+-]*\n(.*?)```"


def relevance_sql(digit_sql: str) -> str:
    whens = " ".join(f"WHEN '{d}' THEN {sql_text(text)}" for d, text in RELEVANCE.items())
    return f"CASE {digit_sql} {whens} END"


def verdict_sql(text: str) -> str:
    """Written apart from the Spark form: the first words of the bare text are compared as words."""
    bare = f"ltrim(lower({strip_sql(text)}), {sql_text(OPENING_MARKS)})"
    words = f"regexp_split_to_array({bare}, {sql_text(WORD_BREAK)})"
    first, second = (f"rtrim(coalesce({words}[{k}], ''), {sql_text(CLOSING_MARKS)})" for k in (1, 2))
    return (
        f"CASE WHEN {first} IN ('yes', 'no') THEN {first} "
        f"WHEN starts_with({bare}, 'needs improvement') AND {second} = 'improvement' THEN 'needs improvement' ELSE 'unknown' END"
    )


def code_sql(text: str) -> str:
    blocks = f"regexp_extract_all({text}, '{FENCE_SQL}', 1)"
    return f"CASE WHEN len({blocks}) > 0 THEN array_to_string({blocks}, chr(10)) ELSE {text} END"


ANSWER_SQL = """CASE WHEN {s} <= 'b' THEN 'Try this:' || chr(10) || '```python' || chr(10) || 'print(' || {id} || ')' || chr(10) || '```' || chr(10) || 'or'
      || chr(10) || '```' || chr(10) || 'return ' || {attempt} || chr(10) || '```' || chr(10) ELSE 'print(' || {id} || ')' END"""
QUALITY_SQL = """CASE WHEN {toxic} = 1 THEN 'No, it fails.' WHEN {quality} = 1 THEN 'Yes' WHEN {quality} = 0 THEN 'Needs improvement: names' ELSE 'Hard to say' END"""

ATTEMPTS_CTE = f"""pairs AS (
  SELECT doc_id, quality, toxic, variant, substr(md5(variant || ':' || doc_id), 1, 1) AS d
  FROM documents LEFT JOIN labels USING (doc_id) CROSS JOIN {VARIANTS_SQL}),
tried AS (
  SELECT *, CAST(unnest(generate_series(1, CASE WHEN d <= '7' THEN 1 WHEN d <= 'e' THEN 4 ELSE 30 END)) AS INTEGER) AS attempt FROM pairs),
signed AS (SELECT *, substr(md5(variant || '/' || attempt || ':' || doc_id), 1, 1) AS s FROM tried),
attempts AS (
  SELECT doc_id AS question_id, variant, attempt,
    {ANSWER_SQL.format(s='s', id='doc_id', attempt='attempt')} AS answer,
    {relevance_sql('s')} AS relevance,
    {QUALITY_SQL.format(toxic='toxic', quality='quality')} AS quality
  FROM signed)"""

FIRST_CTE = ATTEMPTS_CTE + f""",
accepted AS (
  SELECT question_id, variant, attempt, answer, quality, row_number() OVER (PARTITION BY question_id, variant ORDER BY attempt) AS pos
  FROM attempts WHERE {verdict_sql('relevance')} = 'yes' AND attempt <= 24),
firsts AS (
  SELECT p.question_id, p.variant, a.attempt, {code_sql('a.answer')} AS code,
    CASE WHEN a.attempt IS NULL THEN 'unresolved' ELSE {verdict_sql('a.quality')} END AS quality, p.n_attempts
  FROM (SELECT question_id, variant, count(*) AS n_attempts FROM attempts GROUP BY ALL) p
  LEFT JOIN (SELECT * FROM accepted WHERE pos = 1) a ON a.question_id = p.question_id AND a.variant = p.variant)"""
