"""Near copies against brute force over all pairs of shingle sets."""

import numpy as np

from inkwell.llm import nearcopies
from inkwell.llm.frames import keyed
from inkwell.llm.nearcopies import across, described, drop_near_copies, may_be_alike, offered, places, prefixes, profile
from inkwell.session import stage


def test_near_copies_go_and_others_stay(spark, awkward, nothing):
    draw = np.random.default_rng(6)
    base = [[f"v{draw.integers(0, 4000)}" for _ in range(200)] for _ in range(40)]
    rows = [(100 + i, " ".join(w)) for i, w in enumerate(base)]
    rows += [(200 + i, " ".join([*w[:90], "changed", *w[91:]])) for i, w in enumerate(base[:20])]
    rows += [(300 + i, " ".join(w[:60] + [f"u{draw.integers(0, 4000)}" for _ in range(140)])) for i, w in enumerate(base)]
    found = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in found.collect()) == [*range(100, 140), *range(300, 340)]
    found = drop_near_copies(awkward)
    assert found.dtypes == awkward.dtypes
    kept = [r.doc_id for r in found.select("doc_id").collect()]
    assert kept.count(5) == 1 and 6 in kept and kept.count(1) == 1 and 2 not in kept and None in kept
    assert drop_near_copies(nothing).collect() == []


def set_of(text, n=5):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def slow_smallest(texts):
    """The smallest id of each connected group at a Jaccard similarity of 0.8."""
    sets, root = [set_of(t) for _, t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                root = [root[j] if r == root[i] else r for r in root]
    low = {}
    for (i, _), r in zip(texts, root):
        low[r] = min(low.get(r, i), i)
    return sorted(low.values())


def test_near_copies_are_the_components_at_the_similarity(spark):
    """Pairs on both sides of 0.8 and at it, short texts, a chain, and a line that very many texts share."""
    draw, texts = np.random.default_rng(8), []
    line = " ".join(f"line{k}" for k in range(30))
    fresh = lambda n: [f"v{draw.integers(0, 10**9)}" for _ in range(n)]

    def pair(total, common):  # two texts that share a start: `common` of `total` shingles in both
        start, more = fresh(common + 4), total - common
        texts.extend([(len(texts), " ".join(start + fresh(more // 2))), (len(texts) + 1, " ".join(start + fresh(more - more // 2)))])

    for _ in range(12):
        for percent in (65, 70, 75, 79, 80, 81, 82, 85):
            pair(200, 2 * percent)
        for total, common in ((8, 7), (9, 7), (10, 8), (7, 5), (6, 5), (5, 4), (5, 3), (4, 3), (2, 1)):
            pair(total, common)
    chain = fresh(120)
    for k in range(0, 60, 6):  # neighbours are alike, the ends are not
        texts.append((len(texts), " ".join(chain[k : k + 64])))
    texts += [(len(texts) + k, " ".join(fresh(40)) + " " + line) for k in range(60)]
    texts += [(len(texts) + k, t) for k, t in enumerate(["a b", "A  B", "a c", "", " "])]
    found = drop_near_copies(spark.createDataFrame(texts, "doc_id long, text string"), hot_rows=20)
    assert sorted(r.doc_id for r in found.collect()) == slow_smallest(texts)


def test_prefix_and_profile_lose_no_pair():
    draw = np.random.default_rng(4)
    for size in (1, 2, 3, 5, 8, 40, 300, 3000):
        for _ in range(20):
            a = np.unique(draw.integers(0, 2**64, size, np.uint64))
            kept = draw.choice(a, max(1, int(np.ceil(0.8 * len(a)))), replace=False)
            b = np.unique(np.concatenate([kept, draw.integers(0, 2**64, int(draw.integers(0, 1 + size // 10)), np.uint64)]))
            common = len(np.intersect1d(a, b))
            if common / (len(a) + len(b) - common) < 0.8:
                continue
            sizes, profiles = ([np.array([len(x)]), [profile(x)]] for x in (a, b))
            assert may_be_alike(*sizes, *profiles, 0.8)[0, 0]
            # in the order used with equal counts: the first part by value, then the rest by value
            prefix = lambda x: set(offered(x, 0.8)[0][: places(len(x), 0.8)].tolist())
            assert prefix(a) & prefix(b)


def test_a_crowded_profile_rules_nothing_out():
    crowded = np.arange(300, dtype=np.uint64)
    assert profile(crowded) == b"" and may_be_alike(np.array([300]), [b""], np.array([290]), [profile(crowded[:4])], 0.8)[0, 0]


def proposals(spark, count):
    """Pairs left for texts made of three of 40 stock passages each, next to what all pairs of a passage would be."""
    draw = np.random.default_rng(count)
    stock = [" ".join(f"s{draw.integers(0, 10**9)}" for _ in range(120)) for _ in range(40)]
    texts = [(k, " ".join(stock[j] for j in draw.choice(40, 3, replace=False))) for k in range(count)]
    docs = stage(spark.createDataFrame(texts, "doc_id long, text string"), "stock")
    nodes = described(keyed(docs, docs["doc_id"].alias("node"), docs["text"].alias("text")), 5, 0.8)
    nodes = stage(nodes, "stock-nodes")
    again = spark.createDataFrame([], "node long, again boolean")
    prefix = prefixes(nodes, again, 0.8).selectExpr("shingle", "node", "size", "node AS component")
    return across(prefix, nodes, 0.8).count(), texts


def test_stock_passages_propose_few_pairs(spark):
    """Only texts with two of three passages in common are proposed, a small part of those with one."""
    for count in (500, 1000):
        found, texts = proposals(spark, count)
        sets = [set_of(t) for _, t in texts]
        alike = sum(len(sets[i] & sets[j]) >= 0.4 * len(sets[i] | sets[j]) for i in range(count) for j in range(i))
        assert found <= alike
    kept = drop_near_copies(spark.createDataFrame(texts[:200], "doc_id long, text string"), hot_rows=30)
    assert sorted(r.doc_id for r in kept.collect()) == slow_smallest(texts[:200])


def test_large_groups_in_packs(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "PACK", 4)
    monkeypatch.setattr(nearcopies, "SMALL_GROUP", 2)
    monkeypatch.setattr(nearcopies, "HUB_PAIRS", 3)
    draw = np.random.default_rng(9)
    words = [f"w{draw.integers(0, 10**9)}" for _ in range(60)]
    texts = [(k, " ".join(words[: 20 + k % 41])) for k in range(120)] + [(500, "a b c"), (501, "a b d")]
    found = drop_near_copies(spark.createDataFrame(texts, "doc_id long, text string"), hot_rows=7)
    assert sorted(r.doc_id for r in found.collect()) == slow_smallest(texts)


def test_fingerprints_link_before_sets_meet(spark, monkeypatch):
    """The Gray-order index proposes every pair within its radius, each is verified, and it alone joins close copies."""
    draw = np.random.default_rng(12)
    base = [[f"w{draw.integers(0, 10**9)}" for _ in range(400)] for _ in range(20)]
    texts = [(k, " ".join(w)) for k, w in enumerate(base)] + [(100 + k, " ".join([*w[:-1], "end"])) for k, w in enumerate(base)]
    asked, real = [], nearcopies.alike
    monkeypatch.setattr(nearcopies, "alike", lambda pairs, *rest: asked.append(pairs.count()) or real(pairs, *rest))
    found = drop_near_copies(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(r.doc_id for r in found.collect()) == slow_smallest(texts) == list(range(20))
    assert asked[0] >= 18 and sum(asked[1:]) <= 2


def test_a_large_group_below_the_similarity_proposes_few_pairs(spark):
    """Texts of one origin that share most prefixes but lie near 0.6 are ruled out by profiles, not pair by pair on their texts."""
    draw = np.random.default_rng(21)
    base = [f"w{draw.integers(0, 10**9)}" for _ in range(160)]
    changed = lambda: {int(p): f"c{draw.integers(0, 10**9)}" for p in draw.choice(160, 4, replace=False)}
    texts = [(k, " ".join(swap.get(p, w) for p, w in enumerate(base))) for k, swap in enumerate(changed() for _ in range(300))]
    docs = stage(spark.createDataFrame(texts, "doc_id long, text string"), "origin")
    nodes = stage(described(keyed(docs, docs["doc_id"].alias("node"), docs["text"].alias("text")), 5, 0.8), "origin-nodes")
    prefix = prefixes(nodes, spark.createDataFrame([], "node long, again boolean"), 0.8).selectExpr("shingle", "node", "size", "node AS component")
    assert across(prefix, nodes, 0.8).count() <= 300
    assert [r.doc_id for r in drop_near_copies(docs).orderBy("doc_id").collect()] == slow_smallest(texts)
