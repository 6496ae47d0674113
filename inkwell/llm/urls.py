"""URL verdicts from host and path rules, and from trust and distrust spread over host links.

DataFrame operations alone; the link graph stays distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from inkwell.llm.frames import ascii_lower
from inkwell.operators.skew import HOT_ROWS, broadcast_if_small, join_unique
from inkwell.session import stage

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)href\s*+=\s*+(?:["']\s*+)?(?:https?:)?//([^/"'?#\s>]+)"""
#: The walks end when the scores of both together change by no more than this in a round; what is then open is at most
#: DAMPING / (1 - DAMPING) times as much. A round changes at most DAMPING of what the one before did, so rounds are bounded.
TOLERANCE = 1e-3
DAMPING = 0.85
THRESHOLD = 0.5
SITE_LABELS = 3


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def suffixes(host: Column, least: int = 1) -> Column:
    """The host and all its parent domains of at least so many labels."""
    labels = F.split(host, r"\.", -1)
    starts = F.sequence(F.lit(1), F.greatest(F.size(labels) - F.lit(least) + 1, F.lit(1)))
    return F.transform(starts, lambda s: F.concat_ws(".", F.slice(labels, s, F.size(labels))))


def host_rules(hosts: DataFrame, rules: DataFrame, max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """(host, rules): the rules of each host and of its parents, longest first; unique hosts in and out.

    Each host meets the rules through its few suffixes, so any number of rules is one equality join.
    """
    reach = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("rule_host"))
    whole = F.concat("rule_host", "rule_path")
    entry = F.struct(F.length(whole).alias("size"), "rule_path", whole.alias("rule"), "rule_verdict")
    met = reach.join(broadcast_if_small(rules, max_broadcast_rows), "rule_host").select("host", entry.alias("entry"))
    return met.groupBy("host").agg(F.sort_array(F.collect_list("entry"), asc=False).alias("rules"))


def host_edges(pages: DataFrame, site_labels: int = SITE_LABELS) -> DataFrame:
    """(src, dst, n): page links between hosts, a loop for each host's own pages, and its site.

    A page's absolute links lead to their hosts; its relative ones stay on its host, counted as one
    loop. A host and its parent domain (of at least `site_labels` labels) link to each other, once for
    each page. Counts are summed per task before the shuffle, so a host with a third of all pages
    sends one row per task and target.
    """
    found = F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), ascii_lower)
    out = F.concat(F.array("host"), found)
    links = pages.select(F.col("host").alias("src"), F.explode(out).alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    chain = suffixes(F.col("host"), site_labels)
    parents = (
        pages.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("parent", F.explode(F.slice(chain, 2, F.greatest(F.size(chain) - 1, F.lit(0)))))
    )
    site = parents.select(F.col("host").alias("src"), F.col("parent").alias("dst"), "n").union(parents.select("parent", "host", "n"))
    alone = links.select(F.col("dst").alias("src"), "dst", F.lit(1).cast("long").alias("n"))  # hosts without pages keep what they get
    return links.union(site).union(alone).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(host, trust, distrust) by personalised PageRank.

    `seeds` (host, good, bad) are page counts. Trust walks along the links from the good seeds;
    distrust walks against them from the bad ones, so a host that links to blocked hosts gets it.
    Both run as one table of edges of two kinds until their summed change in a round is at most `tolerance`. Every host
    has an edge, so no score is lost.
    """
    both = edges.select(F.lit(True).alias("good"), "src", "dst", "n").union(edges.select(F.lit(False), "dst", "src", "n"))
    out = both.groupBy("good", "src").agg(F.sum("n").alias("total"))
    steps = join_unique(stage(both, "host-links"), stage(out, "host-out"), ["good", "src"], hot_rows=hot_rows, stable_left=True)
    steps = stage(steps.select("good", "src", "dst", (F.col("n") / F.col("total")).alias("share")), "host-steps")
    totals = seeds.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    start = seeds.select(F.lit(True).alias("good"), F.col("host").alias("src"), (F.col("good") / F.lit(float(totals["good"] or 1))).alias("score")).union(
        seeds.select(F.lit(False), "host", F.col("bad") / F.lit(float(totals["bad"] or 1)))
    )
    start = stage(start.filter("score > 0"), "host-seeds")
    restart = start.select("good", "src", (F.col("score") * F.lit(1 - damping)).alias("score"))
    scores, change = start, None
    while change is None or change > tolerance:
        moved = join_unique(steps, scores, ["good", "src"], hot_rows=hot_rows, stable_left=True)
        walked = moved.select("good", F.col("dst").alias("src"), (F.col("share") * F.col("score") * F.lit(damping)).alias("score"))
        new, old = (df.select("*", F.lit(k).alias("old")) for df, k in ((walked.union(restart), 0.0), (scores.select("good", "src", -F.col("score")), 1.0)))
        either = new.union(old).groupBy("good", "src").agg(
            F.coalesce(F.sum(F.when(F.col("old") == 0, F.col("score"))), F.lit(0.0)).alias("score"), F.abs(F.sum("score")).alias("change")
        )
        scores = stage(either, "host-scores")
        change = scores.agg(F.coalesce(F.sum("change"), F.lit(0.0))).first()[0]
        scores = scores.select("good", "src", "score")
    side = lambda good: F.coalesce(F.sum(F.when(F.col("good") == F.lit(good), F.col("score"))), F.lit(0.0))
    return scores.groupBy(F.col("src").alias("host")).agg(side(True).alias("trust"), side(False).alias("distrust"))


def judge(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    tolerance: float = TOLERANCE,
    damping: float = DAMPING,
    threshold: float = THRESHOLD,
    site_labels: int = SITE_LABELS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, trust, distrust.

    `rules` (rule_host, rule_path, rule_verdict allow or block): a rule fits its host and all its
    subdomains when the path starts with the rule's; the longest host plus path wins, of equally long
    ones the last in text order. Pages with a rule take its verdict, and are the seeds by their hosts.
    Other pages are blocked when distrust / (trust + distrust) of their host is over `threshold`;
    a host that no score reaches is allowed. A url that is null or has no `://` has an empty host and
    path, which no rule fits. Null html has no links. Ids are carried along, null or repeated as they
    are; an empty table gives no rows; other columns are not read.
    """
    url = F.col(f"`{url_col}`")
    read = pages.select(F.col(f"`{id_col}`").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    whole = pages.select(host_of(url).alias("host"), F.col(f"`{html_col}`").alias("html"))
    edges = stage(host_edges(whole, site_labels), "host-edges")
    rows = stage(read, "page-rows")
    by_host = stage(host_rules(rows.select("host").distinct(), rules), "host-rules")
    fitting = F.filter("rules", lambda r: F.col("path").startswith(r.getField("rule_path")))
    ruled = join_unique(rows, by_host, "host", "left", hot_rows=hot_rows, stable_left=True).withColumn("fit", F.get(fitting, F.lit(0)))
    ruled = stage(
        ruled.select("id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.rule_verdict").alias("by_rule")), "page-rules"
    )
    count = lambda verdict: F.count(F.when(F.col("by_rule") == verdict, 1))
    seeds = stage(ruled.filter("by_rule IS NOT NULL").groupBy("host").agg(count("allow").alias("good"), count("block").alias("bad")), "host-rule-pages")
    scores = stage(propagate(edges, seeds, tolerance, damping, hot_rows), "host-trust")
    judged = join_unique(ruled, scores, "host", "left", hot_rows=hot_rows, stable_left=True)
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_method = F.when(distrust > F.lit(threshold) * (trust + distrust), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"), trust.alias("trust"), distrust.alias("distrust")
    )
