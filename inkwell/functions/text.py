"""Numbers, verdicts, code and tokens out of free text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: the blanks stripped at both ends of an answer, the characters dropped from it, and
# what reads as a number
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
DROPPED = r"[a-zA-Z$%/'=+(), ]+"
NUMBER = r"^-?([0-9]+(_[0-9]+)*|[0-9]+(_[0-9]+)*\.([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)\z"

CODE_FENCE = r"(?s)```[a-zA-Z0-9_+-]*\n(.*?)```"
# a verdict is a whole word; quotes, stars, brackets and dots may stand around it
VERDICT = r"""^[\s"'*_`.(\[\u2018\u201c]*(yes|no|needs improvement)(?![\p{L}\p{N}_]|[-'\u2019][\p{L}\p{N}])"""
TOKEN_BREAK = "[^a-z0-9]+"


def concat_strict(*parts: Column, sep: str = " ") -> Column:
    """Null as soon as one part is null."""
    joined = [parts[0]]
    for part in parts[1:]:
        joined += [F.lit(sep), part]
    return F.concat(*joined)


def concat_lenient(*parts: Column, sep: str = " ") -> Column:
    """Null parts count as empty; separators stay."""
    return concat_strict(*[F.coalesce(p, F.lit("")) for p in parts], sep=sep)


def strip_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def number_text(value: Column) -> Column:
    """A double as text the way the SQL writes it: its shortest digits, plain from 1e-4 up to 1e16, else like `1.5e-07`.

    A cast alone gives the form with an exponent from 1e7 on and below 1e-3. Digits are those of the cast, which are the
    shortest but for some doubles of 16 digits and more.
    """
    short = value.cast("string")
    size = F.abs(value)
    plain = F.regexp_replace(short.cast("decimal(38,21)").cast("string"), r"(\.[0-9]+?)0+\z", "$1")
    mantissa = F.regexp_replace(F.substring_index(short, "E", 1), r"\.0\z", "")
    power = F.substring_index(short, "E", -1).try_cast("int")
    signed = F.concat(F.when(power < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), F.lit("0")))
    return (
        F.when(F.isnan(value), F.lit("nan")).when(size == float("inf"), F.when(value > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when((size == 0) | ((size >= 1e-3) & (size < 1e7)), short).when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(F.concat(mantissa, F.lit("e"), signed))
    )


def answer_key(text: Column) -> Column:
    """The number after the first `####`; null when there is none."""
    part = F.replace(F.split_part(text, F.lit("####"), F.lit(2)), F.lit(","), F.lit(""))
    return part.try_cast("double")


def extract_number(text: Column) -> Column:
    """The final number of an answer: after the last `####`, cleaned, last line; otherwise 0.

    Every step feeds the next once, so nothing is evaluated twice per row. Splitting and searching from the right differ
    in runs of more than four `#` alone; a cast of an empty text is spared, as its failure costs more than all the rest.
    """
    parted = F.element_at(F.split(text, "####"), -1)
    tail = F.when(F.contains(text, F.lit("#####")), parted).otherwise(F.substring_index(text, "####", -1))
    cleaned = strip_blanks(F.regexp_replace(tail, DROPPED, ""))
    trimmed = F.regexp_replace(cleaned, r"-?\.?\z", "")
    last_line = strip_blanks(F.substring_index(trimmed, "\n", -1))
    number = F.replace(F.regexp_extract(last_line, NUMBER, 0), F.lit("_"), F.lit(""))
    return F.coalesce(F.nullif(number, F.lit("")).try_cast("double"), F.lit(0.0))


def is_correct(answer: Column, key: Column) -> Column:
    return F.when((answer - key) == 0, 1).otherwise(0)


def candidate_lines(reply: Column) -> Column:
    """Proposed sentences of a reply: brackets stripped, right-trimmed, blank lines dropped."""
    lines = F.transform(
        F.split(reply, "\n"),
        lambda line: F.rtrim(F.btrim(line, F.lit("[]")), F.lit(BLANKS)),
    )
    return F.filter(lines, lambda line: line != "")


def verdict(text: Column) -> Column:
    """yes, no or needs improvement when the text begins with that whole word; else unknown.

    "Not sure", "None" and "Yesterday" are unknown; `**Yes**`, `'no'` and `(yes)` are verdicts.
    """
    found = F.regexp_extract(F.lower(strip_blanks(text)), VERDICT, 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("unknown"))


def extract_code(text: Column) -> Column:
    """All fenced code blocks joined by a newline; the whole text when there are none."""
    blocks = F.regexp_extract_all(text, F.lit(CODE_FENCE), F.lit(1))
    return F.when(F.size(blocks) > 0, F.array_join(blocks, "\n")).otherwise(text)


def collapse_lines(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), TOKEN_BREAK), "")


# every byte that is not a-z or 0-9 becomes a blank
_TOKEN_BYTES = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))


def token_bytes(text: str) -> list[bytes]:
    """The same tokens inside a Python task, as bytes."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_TOKEN_BYTES).split()
