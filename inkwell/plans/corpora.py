"""Building corpora: message reshaping, vector corpora and tuning data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from inkwell.functions import fixed
from inkwell.functions.prompts import tuning_record
from inkwell.functions.text import concat_lenient, concat_strict
from inkwell.operators.embed import Encoder, embedding_column, hashed_words_encoder
from inkwell.operators.ordering import holdout, seeded_limit
from inkwell.operators.skew import broadcast_if_small, join_unique
from inkwell.session import stage
from inkwell.sources.schema import require_unique
from inkwell.sources.vectors import vector_record

#: Turns that a conversation can have; exchange ids are conversation * TURNS + turn + 1.
TURNS = 1 << 20


def pivot_messages(
    df: DataFrame, index: str, type_col: str, value: str, columns: dict[str, str], order: str | None = None
) -> DataFrame:
    """Long messages to one row per conversation; `columns` maps message types to column names.

    The types are named, so no extra job looks for them and a missing type is a null column. A
    repeated (conversation, type) is an error, unless `order` says which message comes first. One
    aggregate with partial results per task does both the choice and the reshaping.
    """
    if order is None:
        require_unique(df.filter(F.col(type_col).isin(list(columns))), [index, type_col])

    def of_type(kind: str) -> Column:
        wanted = F.when(F.col(type_col) == kind, F.col(value))
        return F.max(wanted) if order is None else F.min_by(wanted, F.when(F.col(type_col) == kind, F.col(order)))

    wide = df.groupBy(index).agg(*[of_type(kind).alias(name) for kind, name in columns.items()])
    return wide.select((F.col(index) + 1).alias("Id"), *columns.values())


def exchanges(
    df: DataFrame, conversation: str, turn: str, type_col: str, value: str, columns: dict[str, str], user: str = "user", assistant: str = "assistant", system: str = "system"
) -> DataFrame:
    """Long messages to one row per exchange, so that every message is used.

    An exchange is named by its user's turn; an assistant's message belongs to the turn before it, with or
    without a user's message there. The system text stands in all exchanges of its conversation, or alone when there
    are none. Turns are below TURNS. A repeated turn or a second system text is an error. No window runs over a
    conversation, so a conversation of any length is spread like any other rows.
    """
    place = F.col(turn) - F.when(F.col(type_col) == assistant, 1).otherwise(0)
    spoken = df.filter(F.col(type_col).isin(user, assistant)).withColumn("_exchange", F.col(conversation) * F.lit(TURNS) + place)
    pairs = pivot_messages(spoken, "_exchange", type_col, value, {user: columns[user], assistant: columns[assistant]})
    pairs = pairs.withColumn("_conversation", F.floor((F.col("Id") - 1) / F.lit(TURNS)).cast("long"))
    systems = df.filter(F.col(type_col) == system).select(F.col(conversation).cast("long").alias("_conversation"), F.col(value).alias(columns[system]))
    require_unique(systems, ["_conversation"])
    systems = stage(systems, "system-texts")
    known = join_unique(pairs, systems, "_conversation", "left")
    alone = systems.join(broadcast_if_small(stage(pairs.select("_conversation").distinct(), "conversations")), "_conversation", "left_anti")
    empty = [F.lit(None).cast("string").alias(columns[kind]) for kind in (user, assistant)]
    rest = alone.select((F.col("_conversation") * F.lit(TURNS) + 1).alias("Id"), *empty, columns[system])
    order = ["Id", *columns.values()]
    return known.select(*order).unionByName(rest.select(*order))


def news_corpus(
    news: DataFrame,
    holdout_rows: int = fixed.HOLDOUT_ROWS,
    make_encoder: Callable[[], Encoder] = hashed_words_encoder,
) -> DataFrame:
    """Vector records of all but the last rows: headline and description embedded, date and category kept."""
    details = news.select(
        "Id", concat_strict(F.col("NewsHeadline"), F.col("ShortDescription")).alias("NewsDetails"), "NewsDate", "NewsCategory"
    )
    corpus, _ = holdout(details, "Id", holdout_rows)
    metadata = {"news_date": F.date_format("NewsDate", "yyyy-MM-dd"), "news_category": F.col("NewsCategory")}
    return corpus.select(*vector_record(F.col("Id"), embedding_column(F.col("NewsDetails"), make_encoder), metadata))


def short_pairs(pairs: DataFrame, max_chars: int = fixed.SHORT_PAIR_CHARS, split: str = "Training") -> DataFrame:
    """Question and answer as one text, where both together stay under the limit."""
    size = F.length(concat_lenient(F.col("QuestionAsked"), F.col("OutputAnswer"), sep=""))
    kept = pairs.filter((F.col("DataSplit") == split) & (size < max_chars))
    return kept.select("Id", concat_lenient(F.col("QuestionAsked"), F.col("OutputAnswer")).alias("PairText"))


def pair_corpus(
    pairs: DataFrame,
    info: str = "Python Q&A",
    make_encoder: Callable[[], Encoder] = hashed_words_encoder,
    batch_size: int = 200,
) -> DataFrame:
    """Vector records of the short training pairs."""
    vector = embedding_column(F.col("PairText"), make_encoder, batch_size)
    return short_pairs(pairs).select(*vector_record(F.col("Id"), vector, {"info": F.lit(info)}))


def without_input(pairs: DataFrame, split: str) -> DataFrame:
    """Rows of a split whose input is the empty text; a null input is not empty."""
    return pairs.filter((F.col("DataSplit") == split) & (F.col("QuestionInput") == ""))


def tuning_dataset(
    pairs: DataFrame, n: int = fixed.TUNING_ROWS, seed: float = fixed.TUNING_SEED, split: str = "Training", max_words: int = 2048
) -> DataFrame:
    """Seeded selection of training pairs rendered as chat records, with their length in words."""
    chosen = seeded_limit(without_input(pairs, split), "Id", n, seed)
    record: Column = tuning_record(F.col("QuestionAsked"), F.col("OutputAnswer"))
    words = F.size(F.regexp_extract_all(record, F.lit(r"[^ \n]+"), F.lit(0)))
    return chosen.select("Id", record.alias("record"), words.alias("n_words"), (words <= max_words).alias("within_limit"))
