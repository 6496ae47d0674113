"""Model responses for prompts: recorded ones reused, only missing ones asked for."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from inkwell.operators.skew import HOT_ROWS, join_unique
from inkwell.sources.cache import compute_or_reuse, with_content_key

Client = Callable[[list[str]], list[str]]


class RetryLater(Exception):
    """Raised by a client whose service asks to slow down."""


def _ask(client: Client, prompts: list[str], tries: int, first_wait: float) -> list[str]:
    for attempt in range(tries):
        try:
            return client(prompts)
        except RetryLater:
            if attempt == tries - 1:
                raise
            time.sleep(first_wait * 2**attempt)
    return []


def call_client(
    prompts: DataFrame,
    prompt_col: str,
    make_client: Callable[[], Client],
    tries: int = 6,
    first_wait: float = 0.5,
    batch_size: int = 500,
) -> DataFrame:
    """(content_key, response) for distinct prompts; one client per task, one call per batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                part = batch.iloc[start : start + batch_size]
                answers = _ask(client, part[prompt_col].tolist(), tries, first_wait)
                yield pd.DataFrame({"content_key": part["content_key"].to_numpy(), "response": answers})

    return prompts.mapInPandas(run, "content_key string, response string")


def recorded_responses(
    prompts: DataFrame, prompt_col: str, recorded: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Attach recorded responses (content_key, response) by the md5 of the prompt; null when none."""
    keyed = with_content_key(prompts, prompt_col)
    answers = recorded.select("content_key", "response")
    return join_unique(keyed, answers, "content_key", "left", hot_rows=hot_rows).drop("content_key")


def attach_responses(
    prompts: DataFrame,
    prompt_col: str,
    store_path: str,
    make_client: Callable[[], Client],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Attach a response to every prompt. Repeated prompts are asked once; answers are kept in the store."""
    return compute_or_reuse(
        prompts, prompt_col, store_path, lambda missing: call_client(missing, prompt_col, make_client), hot_rows
    )
