import time

import numpy as np
import pytest

from pyspark.sql import functions as F

from inkwell.llm.language import DECLARED, identify, train, trigrams, visible
from inkwell.llm.urls import LINK

WORDS = {"en": ["the", "house", "where", "with", "this", "nothing"], "de": ["der", "und", "schön", "nicht", "über", "ich"], "fr": ["le", "être", "où", "quelle", "français", "deux"]}


def text(lang, k, n=30):
    return " ".join(np.random.default_rng(k).choice(WORDS[lang], n))


@pytest.fixture(scope="module")
def model(spark):
    return train(spark.createDataFrame([(lang, text(lang, k)) for lang in WORDS for k in range(30)] + [(None, "x"), ("en", None), ("en", "")], "lang string, text string"))


def test_counts_equal_brute_force(model):
    languages, logs = model
    assert languages == ["de", "en", "fr"]
    for k, lang in enumerate(languages):
        counts = 1 + sum(trigrams(text(lang, i)) for i in range(30))
        assert logs[k] == pytest.approx(np.log(counts / counts.sum()))


def test_visible_text():
    assert visible("<html><head><title>T</title></head><script>a<b</script><p>One&amp;<!-- no -->two</p><style>x").split() == ["One", "two"]
    assert visible(None) == ""


def page(lang, k, declared, n=30):
    return f'<html lang="{declared}"><body><p>{text(lang, k, n)}</p></body></html>'


def test_evidence_is_fused(spark, model):
    rows = [(k, f"http://a.de.example/{k}", page("de", k, "de")) for k in range(30)] + [(100 + k, f"http://b.site.org/{k}", page("en", k, "en")) for k in range(60)]
    rows += [(200, "http://a.de.example/x", "<p></p>"), (201, "http://new.de.example/", None), (202, "http://b.site.org/y", page("fr", 1, "en", 40)), (203, "http://zzz.com/", '<html lang="fr-CA"><body></body>'), (204, None, None)]
    rows += [(k, f"http://c{k}.org/", page("fr", k, "fr")) for k in range(300, 320)]
    found = {r.page_id: r for r in identify(spark.createDataFrame(rows, "page_id long, url string, html string"), *model, hot_rows=10).collect()}
    assert len(found) == len(rows)
    assert {found[k].lang for k in range(30)} == {"de"} and {found[100 + k].lang for k in range(60)} == {"en"}
    assert found[200].lang == "de"  # its host
    assert found[201].lang == "de"  # its site
    assert found[202].lang == "fr" and found[202].declared == "en"  # its text against the rest
    assert found[203].lang == "fr"  # its markup
    assert found[204].lang == "en"  # what is common
    assert all(0 < r.confidence <= 1 for r in found.values())


def test_null_repeated_and_empty(spark, model):
    rows = [(None, None, None, "x"), (1, "", "", "y"), (1, "", "", "y"), (2, "http://h.de/", page("de", 1, "xx"), None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    found = identify(pages, *model).collect()
    assert len(found) == 4 and [r.lang for r in found if r.page_id == 2] == ["de"]
    assert identify(pages.filter("false"), *model).collect() == []
    languages, logs = train(spark.createDataFrame([], "lang string, text string"))
    assert languages == [] and [r.lang for r in identify(pages, languages, logs).collect()] == [None] * 4


def test_unclosed_marks_are_read_once():
    start = time.time()
    assert visible("<" * 1_000_000 + "a>b") .strip().endswith("b")
    assert visible("<a" * 500_000).count("<a") == 500_000
    assert time.time() - start < 10


def test_unclosed_marks_in_the_jvm(spark):
    html = ["<html " * 200_000, "<html lang" + " " * 300_000, "href=" + " " * 300_000, '<html x="1" lang = "de">']
    pages = spark.createDataFrame([(h,) for h in html], "html string")
    start = time.time()
    found = pages.select(F.regexp_extract("html", DECLARED, 1).alias("d"), F.size(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("n")).collect()
    assert [(r.d, r.n) for r in found] == [("", 0)] * 3 + [("de", 0)] and time.time() - start < 30
