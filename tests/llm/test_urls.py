import re

import pytest

from inkwell.llm.urls import host_edges, judge, propagate

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
URLS = [
    (1, "http://A.Example.NET/en/1?x"), (2, "http://a.example.net/de"), (3, "http://example.net"), (4, "https://b.example.com/de/2#y"),
    (5, "https://b.example.com/en"), (6, "http://x.org/fr/"), (7, "http://x.org/fr"), (8, None), (9, "no scheme/en/"), (10, "http://"),
    (11, "ftp://a://b/en/"), (12, "http://notexample.net/en/"), (None, "http://c.net/?q=1"), (5, "https://b.example.com/en"), (13, "http://x.net?/a"),
]


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame(RULES, "rule_host string, rule_path string, rule_verdict string")


def parts(url):
    met = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in met[1]), met[2]) if met else ("", "")


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_rules_hosts_and_paths(spark, rules):
    pages = spark.createDataFrame([(i, u, None, "extra") for i, u in URLS], "page_id long, url string, html string, rule string")
    found = judge(pages, rules, tolerance=0.5, hot_rows=2).collect()
    expected = sorted(((i, *parts(u), *rule_of(*parts(u))) for i, u in URLS), key=str)
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in found), key=str) == expected
    assert {r.verdict for r in found} == {"allow", "block"}


def test_distrust_walks_against_links(spark, rules):
    link = lambda h: f'<a href="http://{h}/">x</a>'
    rows = [(1, "http://bad.net/", ""), (2, "http://spam.com/", link("bad.net") * 3), (3, "http://fan.com/", link("spam.com")), (4, "http://good.org/fr/", link("friend.com")), (5, "http://friend.com/", ""), (6, "http://lone.com/", "")]
    found = {r.page_id: r for r in judge(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert [found[i].verdict for i in range(1, 7)] == ["block", "block", "block", "allow", "allow", "allow"]
    assert found[5].trust > 0 and found[6].trust == found[6].distrust == 0


def test_scores_equal_power_iteration(spark):
    pages = spark.createDataFrame([(f"h{i}.a.com", "".join(f'href="//h{j}.a.com/"' for j in range(i))) for i in range(5)], "host string, html string")
    edges = host_edges(pages)
    seeds = spark.createDataFrame([("h1.a.com", 2, 0), ("h4.a.com", 1, 3)], "host string, good long, bad long")
    found = {r.host: (r.trust, r.distrust) for r in propagate(edges, seeds, tolerance=0.02).collect()}
    table = {}
    for r in edges.collect():
        table[r.src, r.dst] = r.n
    hosts = sorted({h for pair in table for h in pair})
    flows = [table, {(b, a): n for (a, b), n in table.items()}]
    starts = [{"h1.a.com": 2 / 3, "h4.a.com": 1 / 3}, {"h4.a.com": 1.0}]
    scores, change, rounds = [dict(s) for s in starts], 1.0, 0
    while change > 0.02:
        new = [{h: 0.15 * s.get(h, 0) for h in hosts} for s in starts]
        for flow, score, to in zip(flows, scores, new):
            out = {h: sum(n for (a, _), n in flow.items() if a == h) for h in hosts}
            for (a, b), n in flow.items():
                to[b] += 0.85 * score.get(a, 0) * n / out[a]
        change = sum(abs(to[h] - score.get(h, 0)) for score, to in zip(scores, new) for h in hosts)
        scores, rounds = new, rounds + 1
    assert rounds > 3
    for h in hosts:
        assert found.get(h, (0, 0)) == pytest.approx((scores[0][h], scores[1][h]), abs=1e-12)


def test_distrust_reaches_far_hosts(spark, rules):
    """A chain of twelve hosts to a blocked one: every one of them leads to it alone."""
    rows = [(0, "http://end.net/", "")] + [(k, f"http://h{k}.com/", f'<a href="http://{"end.net" if k == 1 else f"h{k - 1}.com"}/">' * 20) for k in range(1, 13)]
    found = judge(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()
    assert all(r.verdict == "block" and r.distrust > 0 for r in found)


def test_empty_tables(spark, rules):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert judge(pages, rules).collect() == []
    one = spark.createDataFrame([(1, "http://a.net/", "")], "page_id long, url string, html string")
    assert judge(one, rules.filter("false")).first().verdict == "allow"
