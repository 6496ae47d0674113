"""The language of web pages by Bayesian fusion of their text, declared markup language, address suffix and host."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from inkwell.llm.urls import host_of, suffixes
from inkwell.llm.words import text_slices
from inkwell.operators.skew import HOT_ROWS, broadcast_if_small, join_unique
from inkwell.session import stage

BUCKETS = 1 << 14
#: A text counts for no more independent trigrams than this, as neighbouring ones tell the same.
EFFECTIVE = 60.0
#: Pages' worth of the parent's shares in the shares of a host, a site, a suffix and all pages.
KAPPA = 5.0
#: Shares of a declared language that agree with the page's, before any page is seen, and the weight of that belief.
AGREEMENT = 0.9
BELIEF = 10.0
SITE_LABELS = 3

HIDDEN = re.compile(r"(?is)<(script|style|head|template|noscript)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)")
#: A tag ends at the next opening mark too, so that a page of unclosed marks is read once.
TAG = re.compile(r"(?s)<[^<>]*>")
ENTITY = re.compile(r"&#?\w{1,32};")
DECLARED = r"""(?is)<html\b[^<>]*?\blang\s*+=\s*+(?:["']\s*+)?([a-z]{2,3})"""


def visible(html: str | None) -> str:
    """The text of a page without scripts, styles, head, comments, tags and entities."""
    return ENTITY.sub(" ", TAG.sub(" ", HIDDEN.sub(" ", html or "")))


def trigrams(text: str | None) -> np.ndarray:
    """How often each bucket of hashed byte trigrams occurs in a lower-case text with plain spaces."""
    raw = np.frombuffer(" ".join((text or "").lower().split()).encode(), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(BUCKETS)
    hashed = ((raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    return np.bincount(hashed, minlength=BUCKETS)


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities of the buckets in each) counted over all documents with a language.

    A task sends one row per language and bucket that it met, so the shuffle is bounded by the model.
    """
    rows = docs.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).filter("lang IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in text_slices(batches, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                counts.setdefault(lang, np.zeros(BUCKETS, np.int64))[:] += trigrams(text).astype(np.int64)
        for lang, found in counts.items():
            seen = np.flatnonzero(found)
            seen = seen if len(seen) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(found[seen])], names=["lang", "bucket", "n"])

    found = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = found["lang"].to_pylist()
    languages = sorted(set(names))
    place = {name: k for k, name in enumerate(languages)}
    counts = np.ones((len(languages), BUCKETS))
    counts[[place[x] for x in names], found["bucket"].to_numpy()] += found["n"].to_numpy()
    return languages, np.log(counts / counts.sum(1, keepdims=True))


def text_evidence(pages: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """`pages` with `html` replaced by `text_logs`: the tempered log likelihood of the text in each language.

    n trigrams weigh as n / (1 + n / EFFECTIVE), so a long text does not silence all other evidence. Pages
    without text have zero in every language.
    """
    others = [c for c in pages.columns if c != "html"]
    schema = ", ".join([f"`{c}` {t}" for c, t in pages.dtypes if c != "html"] + ["text_logs array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "html"):
            logs = []
            for html in batch.column("html").to_pylist():
                counts = trigrams(visible(html))
                n = counts.sum()
                logs.append((table @ counts) / n * (n / (1 + n / EFFECTIVE)) if n else np.zeros(len(languages)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + [pa.array(logs, pa.list_(pa.float64()))], names=others + ["text_logs"])

    return pages.mapInArrow(run, schema)


def _shares(logs: Column) -> Column:
    """Posterior shares from log weights."""
    weights = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.transform(weights, lambda x: x / total)


def _sums(languages: list[str]) -> list[Column]:
    return [F.sum(F.col("q")[k]).alias(f"s{k}") for k in range(len(languages))]


def _array(languages: list[str], expression) -> Column:
    return F.array(*[expression(k) for k in range(len(languages))])


def _given_language(rows: DataFrame, key: str, name: str, languages: list[str], own: Column | None) -> DataFrame:
    """(key, `name`): log probability of each key value in each language, from the pages' text shares.

    Each language starts with a belief worth BELIEF pages: `own` is the share of it that the key
    value gets in each language, or an even share over the values when None. Values are few for suffixes and
    declared languages; their number is only counted.
    """
    counts = stage(rows.filter(F.col(key) != "").groupBy(key).agg(*_sums(languages)), f"language-{name}")
    totals = counts.agg(F.count(F.lit(1)).alias("values"), *[F.coalesce(F.sum(f"s{k}"), F.lit(0.0)).alias(f"s{k}") for k in range(len(languages))]).first()
    values = max(1, totals["values"])

    def log(k: int) -> Column:
        prior = F.lit(1.0 / values) if own is None else F.when(own == F.lit(languages[k]), F.lit(AGREEMENT)).otherwise(F.lit((1 - AGREEMENT) / values))
        return F.log((F.col(f"s{k}") + F.lit(BELIEF) * prior) / F.lit(float(totals[f"s{k}"] + BELIEF)))

    return counts.select(key, _array(languages, log).alias(name))


def _smoothed(counts: DataFrame, parents: DataFrame, parent: str, name: str, languages: list[str], hot_rows: int) -> DataFrame:
    """Shares of each group, leaning on its parent's by KAPPA pages; `counts` has the parent's key."""
    met = join_unique(counts, parents, parent, "left", hot_rows=hot_rows, stable_left=True)
    total = sum((F.col(f"s{k}") for k in range(len(languages))), F.lit(0.0))
    above = F.coalesce(F.col("above"), F.array(*[F.lit(1.0 / max(1, len(languages)))] * max(1, len(languages))))
    shares = _array(languages, lambda k: (F.col(f"s{k}") + F.lit(KAPPA) * above[k]) / (total + F.lit(KAPPA)))
    return stage(met.select(name, shares.alias("above")), f"language-{name}-shares")


def identify(
    pages: DataFrame,
    languages: list[str],
    table: np.ndarray,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per page: id, host, declared, lang, confidence, text_lang.

    Four pieces of evidence are added as logs: the text; the language that the markup declares and
    the suffix of the address, each by how often it goes with a language over all pages; and a prior of the
    host, smoothed towards its site, its suffix and all pages, without the page's own share in its host. All are grouped sums over
    pages, one value per task and group before the shuffle. Missing evidence (null html or url, no declaration)
    adds nothing; a page without any gets the commonest language. Ties go to the first language in
    text order; without languages `lang` is null. Null and repeated ids are rows of their own; an empty table gives no rows;
    other columns are not read.
    """
    url, html = F.col(f"`{url_col}`"), F.col(f"`{html_col}`")
    host = host_of(url)
    named = pages.select(
        F.col(f"`{id_col}`").alias("id"),
        host.alias("host"),
        F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), DECLARED, 1)).alias("declared"),
        F.coalesce(html, F.lit("")).alias("html"),
    )
    if not languages:
        return named.select(
            F.col("id").alias(id_col), "host", F.expr("nullif(declared, '')").alias("declared"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang")
        )
    chain = suffixes(F.col("host"), SITE_LABELS)
    rows = text_evidence(named, languages, table).select(
        "id", "host", F.expr("nullif(declared, '')").alias("declared"), F.element_at(chain, -1).alias("site"),
        F.substring_index("host", ".", -1).alias("suffix"), "text_logs", _shares(F.col("text_logs")).alias("q"),
    )
    rows = stage(rows, "language-rows")
    declared = _given_language(rows, "declared", "declared_logs", languages, F.col("declared"))
    suffix = _given_language(rows, "suffix", "suffix_logs", languages, None)

    whole = rows.agg(*_sums(languages)).select(F.lit("").alias("all"), *[F.coalesce(f"s{k}", F.lit(0.0)).alias(f"s{k}") for k in range(len(languages))])
    total = sum((F.col(f"s{k}") for k in range(len(languages))), F.lit(0.0))
    top = stage(whole.select("all", _array(languages, lambda k: (F.col(f"s{k}") + 1) / (total + len(languages))).alias("above")), "language-all")
    by_host = stage(rows.groupBy("host", "site", "suffix").agg(*_sums(languages)), "language-hosts")
    by_suffix = by_host.groupBy("suffix").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(len(languages))]).withColumn("all", F.lit(""))
    by_site = by_host.groupBy("site", "suffix").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(len(languages))])
    suffix_shares = _smoothed(stage(by_suffix, "language-suffixes"), top, "all", "suffix", languages, hot_rows)
    site_shares = _smoothed(stage(by_site, "language-sites"), suffix_shares, "suffix", "site", languages, hot_rows)
    hosts = join_unique(by_host, site_shares, "site", "left", hot_rows=hot_rows, stable_left=True).drop("site", "suffix")

    met = join_unique(rows, stage(hosts, "language-host-shares"), "host", hot_rows=hot_rows, stable_left=True)
    met = met.join(broadcast_if_small(declared), "declared", "left").join(broadcast_if_small(suffix), "suffix", "left")
    pages_of_host = total - F.lit(1.0)

    def log(k: int) -> Column:
        others = F.greatest(F.col(f"s{k}") - F.col("q")[k], F.lit(0.0))
        prior = F.log((others + F.lit(KAPPA) * F.coalesce(F.col("above")[k], F.lit(1.0 / len(languages)))) / (F.greatest(pages_of_host, F.lit(0.0)) + F.lit(KAPPA)))
        return F.col("text_logs")[k] + prior + F.coalesce(F.col("declared_logs")[k], F.lit(0.0)) + F.coalesce(F.col("suffix_logs")[k], F.lit(0.0))

    shares = met.withColumn("shares", _shares(_array(languages, log)))
    best = lambda a: F.array(*map(F.lit, languages))[F.array_position(a, F.array_max(a)).cast("int") - 1]
    return shares.select(
        F.col("id").alias(id_col), "host", "declared", best(F.col("shares")).alias("lang"), F.array_max("shares").alias("confidence"), best(F.col("q")).alias("text_lang")
    )
