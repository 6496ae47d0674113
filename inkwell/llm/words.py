"""Words of the text contracts, for numpy work inside tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

SPACE = re.compile(rb"[\x20\x09-\x0D]")
BLOCK_BYTES = 1 << 20


def byte_blocks(text: str | None, lower: bool = True) -> Iterator[bytes]:
    """The UTF-8 bytes of a whole text in blocks that end between words, so that a very long text stays bounded.

    A-Z in lower case unless told otherwise; null counts as empty.
    """
    raw = (text or "").encode()
    at = 0
    while at < len(raw):
        end = at + BLOCK_BYTES
        if end < len(raw):
            cut = SPACE.search(raw, end)
            end = cut.start() if cut else len(raw)
        part = raw[at:end]
        yield part.lower() if lower else part
        at = end


def word_blocks(text: str | None, lower: bool = True) -> Iterator[list[bytes]]:
    """The UTF-8 words `[^\\x20\\x09-\\x0D]+` of a whole text, block by block."""
    for block in byte_blocks(text, lower):
        yield block.split()


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes of text, one row at least."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if held and held + n > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(lengths):
            yield batch.slice(start)
