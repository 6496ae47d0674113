"""Prompts and chat records as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from inkwell.functions import fixed
from inkwell.functions.text import collapse_lines


def join_parts(concat_method: str, parts: list[Column]) -> Column:
    """`Same Line` joins with a space, anything else with a newline."""
    return F.array_join(F.array(*parts), " " if concat_method == "Same Line" else "\n")


def template(name: str) -> Column:
    method, lines = fixed.TEMPLATES[name]
    return join_parts(method, [F.lit(line) for line in lines])


def styled_question(question: Column, style: Column) -> Column:
    """The basic style asks for a marked number; other styles ask the question as it is."""
    return F.when(style == "basic", F.concat(question, F.lit(fixed.NUMBER_SUFFIX))).otherwise(question)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_messages(prompt: Column, style: Column, examples: Column | None = None) -> Column:
    """Messages per run style: the user message first, then the style's system message.

    `examples`, when given, follows the chain style's system text.
    """
    role_text = collapse_lines(F.lit(fixed.ROLE_TEMPLATE))
    chain_text = F.concat(collapse_lines(F.lit(fixed.CHAIN_TEMPLATE)), F.lit("\n"), prompt)
    if examples is not None:
        chain_text = F.concat(chain_text, F.lit("\n"), examples)
    user = message("user", prompt)
    return (
        F.when(style == "Role-based Prompting", F.array(user, message("system", role_text)))
        .when(style == "Chain of Thought Prompting", F.array(user, message("system", chain_text)))
        .otherwise(F.array(user))
    )


def evaluation_messages(candidate: Column, question: Column) -> Column:
    """System message: the evaluation instruction and the candidate sentence; then the question."""
    system = F.concat(template("search_evaluation"), F.lit("\n"), candidate)
    return F.array(message("system", system), message("user", question))


def coding_prompt(question: Column) -> Column:
    return F.concat(template("coding_user"), F.lit("\n"), question)


def hypothetical_prompt(question: Column) -> Column:
    """What a model is asked for before the search: a text that might answer the question."""
    return F.concat(F.lit(fixed.HYPOTHETICAL_PREFIX), question)


def rag_prompt(question: Column, rag: Column, context: Column) -> Column:
    asked = F.concat(template("coding_user"), F.lit("\nQuestion: "), question)
    return F.when(rag, F.concat(F.lit("Context: "), F.coalesce(context, F.lit("")), F.lit("\n"), asked)).otherwise(asked)


def grader_prompt(question: Column, answer: Column) -> Column:
    """With a question: does the answer fit it; without: is the code ready."""
    return F.when(
        question.isNotNull(),
        F.concat(template("relevance_user"), F.lit("\nQuestion: "), question, F.lit("\nAnswer: "), answer),
    ).otherwise(F.concat(template("quality_user"), F.lit("\n"), answer))


def extraction_messages(answer: Column) -> Column:
    """What is asked of a model that extracts code; the answer is both the question and the text."""
    user = F.concat(template("extraction_user"), F.lit("\nQuestion: "), answer, F.lit("\nAnswer: "), answer)
    return F.array(message("system", template("extraction_system")), message("user", user))


def grader_messages(question: Column, answer: Column) -> Column:
    system = F.when(question.isNotNull(), template("relevance_system")).otherwise(template("quality_system"))
    return F.array(message("system", system), message("user", grader_prompt(question, answer)))


def first_search_prompt() -> Column:
    parts = ["search_start", "search_problem", "search_examples", "search_request"]
    return F.array_join(F.array(*[template(p) for p in parts]), "\n")


def history_search_prompt(scored_history: Column) -> Column:
    return F.array_join(
        F.array(template("search_start"), scored_history, template("search_problem"), template("search_request")), "\n"
    )


def tuning_record(question: Column, answer: Column) -> Column:
    head, rest = fixed.TUNING_RECORD.split("{question}")
    middle, tail = rest.split("{answer}")
    return F.concat(F.lit(head), question, F.lit(middle), answer, F.lit(tail))
