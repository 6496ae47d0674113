"""Answer texts, prompts, chat records and verdicts over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.catalog import standins as st
from inkwell.catalog.registry import query
from inkwell.functions import fixed, prompts, text as tx
from inkwell.operators.skew import broadcast_if_small
from inkwell.plans import search
from inkwell.plans.corpora import without_input


def template_sql(name: str) -> str:
    method, lines = fixed.TEMPLATES[name]
    return st.sql_text((" " if method == "Same Line" else "\n").join(lines))


@query("answer_key", f'WITH {st.QA_CTE}, {st.KEYS_CTE} SELECT "Id", "ExtractedAnswer" FROM keys')
def answer_key(spark, sf_dir):
    return st.keys(spark, sf_dir)


@query(
    "extract_number",
    f"""WITH {st.QA_CTE}, {st.KEYS_CTE}, {st.REPLIES_CTE},
texts AS (SELECT "RunStyle" || ':' || "RowId" AS id, "Reply" AS text FROM replies UNION ALL SELECT 'doc:' || doc_id, text FROM documents
  UNION ALL SELECT 'day:' || event_id, strftime(ts, '%H:%M') || ' ####' || value || '-' FROM events)
SELECT id, {st.extract_number_sql('text')} AS number FROM texts""",
)
def extract_number(spark, sf_dir):
    replied = st.replies(spark, sf_dir).select(F.concat("RunStyle", F.lit(":"), F.col("RowId").cast("string")).alias("id"), F.col("Reply").alias("text"))
    documents = st.documents(spark, sf_dir).select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), "text")
    clocked = F.concat(F.date_format("ts", "HH:mm"), F.lit(" ####"), tx.number_text(F.col("value")), F.lit("-"))
    events = st.table(spark, sf_dir, "events").select(F.concat(F.lit("day:"), F.col("event_id").cast("string")).alias("id"), clocked.alias("text"))
    return replied.unionByName(documents).unionByName(events).select("id", tx.extract_number(F.col("text")).alias("number"))


def _styled(spark, sf_dir):
    return st.qa(spark, sf_dir).select("Id", "QuestionAsked", F.explode(F.array(*[F.lit(s) for s in fixed.RUN_STYLES])).alias("RunStyle"))


STYLED_CTE = f'{st.QA_CTE}, styled AS (SELECT "Id", "QuestionAsked", "RunStyle" FROM qa CROSS JOIN {st.STYLES_SQL})'
PROMPT_SQL = f"""CASE WHEN "RunStyle" = 'Basic Prompting' THEN "QuestionAsked" || {st.sql_text(fixed.NUMBER_SUFFIX)} ELSE "QuestionAsked" END"""


def _prompt():
    style = F.when(F.col("RunStyle") == "Basic Prompting", F.lit("basic")).otherwise(F.col("RunStyle"))
    return prompts.styled_question(F.col("QuestionAsked"), style)


@query("prompt_basic", f'WITH {STYLED_CTE} SELECT "Id", "RunStyle", {PROMPT_SQL} AS prompt FROM styled')
def prompt_basic(spark, sf_dir):
    return _styled(spark, sf_dir).select("Id", "RunStyle", _prompt().alias("prompt"))


@query(
    "render_templates",
    f"""SELECT conv_id, turn, {template_sql('coding_system')} AS system_prompt, {template_sql('coding_user')} || chr(10) || text AS user_prompt
FROM conversations WHERE role = 'user'""",
)
def render_templates(spark, sf_dir):
    asked = st.table(spark, sf_dir, "conversations").filter("role = 'user'")
    return asked.select("conv_id", "turn", prompts.template("coding_system").alias("system_prompt"), prompts.coding_prompt(F.col("text")).alias("user_prompt"))


@query("collapse_template", "SELECT doc_id, replace(text, chr(10), ' ') AS line FROM documents")
def collapse_template(spark, sf_dir):
    return st.table(spark, sf_dir, "documents").select("doc_id", tx.collapse_lines(F.col("text")).alias("line"))


ROLE_SQL = st.sql_text(fixed.ROLE_TEMPLATE.replace("\n", " "))
CHAIN_SQL = st.sql_text(fixed.CHAIN_TEMPLATE.replace("\n", " "))


@query(
    "chat_messages",
    f"""WITH {STYLED_CTE}, asked AS (SELECT "Id", "RunStyle", {PROMPT_SQL} AS prompt FROM styled),
messages AS (
  SELECT "Id", "RunStyle", CAST(0 AS BIGINT) AS place, 'user' AS role, prompt AS content FROM asked
  UNION ALL SELECT "Id", "RunStyle", 1, 'system', {ROLE_SQL} FROM asked WHERE "RunStyle" = 'Role-based Prompting'
  UNION ALL SELECT "Id", "RunStyle", 1, 'system', {CHAIN_SQL} || chr(10) || prompt FROM asked WHERE "RunStyle" = 'Chain of Thought Prompting')
SELECT "Id", "RunStyle", place, role, length(content) AS n_chars, md5(content) AS content_md5 FROM messages""",
)
def chat_messages(spark, sf_dir):
    messages = F.posexplode(prompts.chat_messages(_prompt(), F.col("RunStyle"))).alias("place", "message")
    return _styled(spark, sf_dir).select("Id", "RunStyle", messages).select(
        "Id", "RunStyle", F.col("place").cast("long").alias("place"), "message.role",
        F.length("message.content").cast("long").alias("n_chars"), F.md5("message.content").alias("content_md5"),
    )


@query(
    "rag_prompts",
    f"""WITH {st.PIVOTED_CTE} SELECT "Id", CASE WHEN "OutputAnswer" IS NOT NULL THEN 'Context: ' || "OutputAnswer" || chr(10) ELSE '' END
  || {template_sql('coding_user')} || chr(10) || 'Question: ' || "QuestionAsked" AS prompt FROM pivoted""",
)
def rag_prompts(spark, sf_dir):
    context = F.col("OutputAnswer")
    return st.pivoted(spark, sf_dir).select("Id", prompts.rag_prompt(F.col("QuestionAsked"), context.isNotNull(), context).alias("prompt"))


@query(
    "grader_prompts",
    f"""WITH {st.PIVOTED_CTE}
SELECT "Id", 'relevance' AS kind, {template_sql('relevance_user')} || chr(10) || 'Question: ' || "QuestionAsked" || chr(10) || 'Answer: ' || "OutputAnswer" AS prompt
FROM pivoted WHERE "OutputAnswer" IS NOT NULL
UNION ALL SELECT "Id", 'quality', {template_sql('quality_user')} || chr(10) || "OutputAnswer" FROM pivoted WHERE "OutputAnswer" IS NOT NULL""",
)
def grader_prompts(spark, sf_dir):
    answered = st.pivoted(spark, sf_dir).filter(F.col("OutputAnswer").isNotNull())
    kinds = answered.select("Id", "QuestionAsked", "OutputAnswer", F.explode(F.array(F.lit("relevance"), F.lit("quality"))).alias("kind"))
    question = F.when(F.col("kind") == "relevance", F.col("QuestionAsked"))
    return kinds.select("Id", "kind", prompts.grader_prompt(question, F.col("OutputAnswer")).alias("prompt"))


def _message_rows(df, ids: list[str]):
    """One row per message: place, role, length and digest of the content."""
    parts = df.select(*ids, F.posexplode("messages").alias("place", "message"))
    return parts.select(
        *ids, F.col("place").cast("long").alias("place"), "message.role", F.length("message.content").cast("long").alias("n_chars"), F.md5("message.content").alias("content_md5")
    )


def _messages_sql(source: str, ids: str, system: str, user: str) -> str:
    return f"""SELECT {ids}, place, role, length(content) AS n_chars, md5(content) AS content_md5 FROM (
  SELECT {ids}, CAST(0 AS BIGINT) AS place, 'system' AS role, {system} AS content FROM {source}
  UNION ALL SELECT {ids}, 1, 'user', {user} FROM {source})"""


GRADER_USER_SQL = f"""CASE WHEN kind = 'relevance' THEN {template_sql('relevance_user')} || chr(10) || 'Question: ' || "QuestionAsked" || chr(10) || 'Answer: ' || "OutputAnswer"
  ELSE {template_sql('quality_user')} || chr(10) || "OutputAnswer" END"""
GRADER_SYSTEM_SQL = f"CASE WHEN kind = 'relevance' THEN {template_sql('relevance_system')} ELSE {template_sql('quality_system')} END"


@query(
    "grader_messages",
    f"""WITH {st.PIVOTED_CTE}, graded AS (SELECT "Id", kind, "QuestionAsked", "OutputAnswer" FROM pivoted, (VALUES ('relevance'), ('quality')) AS kinds(kind)
  WHERE "QuestionAsked" IS NOT NULL AND "OutputAnswer" IS NOT NULL) {_messages_sql('graded', '"Id", kind', GRADER_SYSTEM_SQL, GRADER_USER_SQL)}""",
)
def grader_messages(spark, sf_dir):
    """Relevance and quality requests for every answered exchange, with their system halves."""
    answered = st.pivoted(spark, sf_dir).filter(F.col("QuestionAsked").isNotNull() & F.col("OutputAnswer").isNotNull())
    kinds = answered.select("Id", "QuestionAsked", "OutputAnswer", F.explode(F.array(F.lit("relevance"), F.lit("quality"))).alias("kind"))
    question = F.when(F.col("kind") == "relevance", F.col("QuestionAsked"))
    return _message_rows(kinds.withColumn("messages", prompts.grader_messages(question, F.col("OutputAnswer"))), ["Id", "kind"])


EXTRACTION_USER_SQL = f"{template_sql('extraction_user')} || chr(10) || 'Question: ' || answer || chr(10) || 'Answer: ' || answer"


@query("extraction_messages", f"WITH {st.ATTEMPTS_CTE} {_messages_sql('attempts', 'question_id, variant, attempt', template_sql('extraction_system'), EXTRACTION_USER_SQL)}")
def extraction_messages(spark, sf_dir):
    asked = st.attempts(spark, sf_dir).withColumn("messages", prompts.extraction_messages(F.col("answer")))
    return _message_rows(asked, ["question_id", "variant", "attempt"])


CANDIDATE_ROWS_SQL = "(VALUES " + ", ".join(f"({r}, {st.sql_text(c)})" for r, c in st.CANDIDATES) + ") AS proposed(round, candidate)"


@query(
    "evaluation_messages",
    f"""WITH {st.QA_CTE}, asked AS (SELECT "Id", round, candidate, "QuestionAsked" FROM qa CROSS JOIN {CANDIDATE_ROWS_SQL})
{_messages_sql('asked', '"Id", round, candidate', template_sql('search_evaluation') + " || chr(10) || candidate", '"QuestionAsked"')}""",
)
def evaluation_messages(spark, sf_dir):
    """The messages that evaluate every proposed sentence on every question."""
    asked = search.with_candidates(st.qa(spark, sf_dir).select("Id", "QuestionAsked"), st.CANDIDATES)
    return _message_rows(asked.withColumn("messages", prompts.evaluation_messages(F.col("candidate"), F.col("QuestionAsked"))), ["Id", "round", "candidate"])


@query(
    "parse_candidates",
    f"""WITH lines AS (
  SELECT doc_id, list_filter(list_transform(string_split('[' || replace(text, chr(10), '] ' || chr(10) || '[[') || ']]', chr(10)),
    lambda l: regexp_replace(regexp_replace(l, '^[\\[\\]]+|[\\[\\]]+\\z', '', 'g'), '{st.BLANKS_SQL}+\\z', '')), lambda l: l <> '') AS ls FROM documents)
SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS place, unnest(ls) AS candidate FROM lines""",
)
def parse_candidates(spark, sf_dir):
    reply = F.concat(F.lit("["), F.replace("text", F.lit("\n"), F.lit("] \n[[")), F.lit("]]"))
    replies = st.table(spark, sf_dir, "documents").select("doc_id", reply.alias("reply"))
    return search.parse_candidates(replies, "reply").withColumn("place", F.col("place").cast("long"))


@query(
    "sft_render",
    f"""WITH {st.CODE_QA_CTE} SELECT "Id", {st.sql_text(fixed.TUNING_RECORD).replace('{question}', "' || " + '"QuestionAsked"' + " || '").replace('{answer}', "' || " + '"OutputAnswer"' + " || '")} AS record
FROM code_qa WHERE "DataSplit" = 'Training' AND "QuestionInput" = ''""",
)
def sft_render(spark, sf_dir):
    chosen = without_input(st.code_qa(spark, sf_dir), "Training")
    return chosen.select("Id", prompts.tuning_record(F.col("QuestionAsked"), F.col("OutputAnswer")).alias("record"))


@query(
    "parse_verdict",
    f"""WITH {st.ATTEMPTS_CTE} SELECT question_id, variant, attempt, {st.verdict_sql('relevance')} AS relevance, {st.verdict_sql('quality')} AS quality FROM attempts""",
)
def parse_verdict(spark, sf_dir):
    return st.attempts(spark, sf_dir).select(
        "question_id", "variant", "attempt", tx.verdict(F.col("relevance")).alias("relevance"), tx.verdict(F.col("quality")).alias("quality")
    )


@query("extract_code", f"WITH {st.ATTEMPTS_CTE} SELECT question_id, variant, attempt, {st.code_sql('answer')} AS code FROM attempts")
def extract_code(spark, sf_dir):
    return st.attempts(spark, sf_dir).select("question_id", "variant", "attempt", tx.extract_code(F.col("answer")).alias("code"))


@query("pivot_messages", f"WITH {st.PIVOTED_CTE} SELECT * FROM pivoted")
def pivot_messages(spark, sf_dir):
    return st.pivoted(spark, sf_dir)


@query("semi_join_ids", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join_ids(spark, sf_dir):
    ids = st.table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return st.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(broadcast_if_small(ids), "doc_id", "left_semi")
