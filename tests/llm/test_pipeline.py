import re

import corpus_pipeline
import public_tokenizers
import pytest

import __spark_entry__ as contract
from inkwell.llm.queries import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"


def shingles(text, n=5):
    words = text.lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


@pytest.fixture(scope="module")
def stages(spark):
    docs, kept = spark.read.parquet(f"{SF_DIR}/documents.parquet"), {}
    kept["documents"] = docs
    for name, function in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(function(spark, docs, SF_DIR), f"test-{name}")
        kept[name] = docs
    return kept


def test_stages_in_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_copies", "near_copies", "decontamination", "segmentation"]
    for name in [n for n, _ in corpus_pipeline.STAGES][:-1]:
        assert stages[name].dtypes == stages["documents"].dtypes
    counts = [stages[n].count() for n in ("documents", "quality", "exact_copies", "near_copies", "decontamination")]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]


def test_quality_stage_follows_the_labels(spark, stages):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    kept = {r.doc_id for r in stages["quality"].collect()}
    rows = [(r.doc_id in kept, r.quality == 1) for r in labels.collect()]
    assert sum(a == b for a, b in rows) / len(rows) > 0.9


def test_exact_stage_equals_brute_force(stages):
    best = {}
    for r in stages["quality"].collect():
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text)
        rank = (-len(r.text), r.doc_id)
        best[key] = min(best.get(key, rank), rank)
    assert sorted(r.doc_id for r in stages["exact_copies"].collect()) == sorted(i for _, i in best.values())


def test_near_stage_leaves_no_near_copy_and_drops_nothing_else(stages):
    before = {r.doc_id: shingles(r.text) for r in stages["exact_copies"].collect()}
    kept = {r.doc_id for r in stages["near_copies"].collect()}
    likeness = lambda a, b: len(before[a] & before[b]) / len(before[a] | before[b])
    assert not [(a, b) for a in kept for b in kept if a < b and likeness(a, b) >= 0.9]
    for gone in set(before) - kept:
        assert max(likeness(gone, other) for other in before if other != gone) >= 0.6


def smallest_of_components(texts):
    """The smallest id of each group connected by a Jaccard similarity of 0.8 or more, by brute force."""
    sets, root = {i: shingles(t or "") for i, t in texts}, {i: i for i, _ in texts}
    for a in sets:
        for b in sets:
            if a < b and root[a] != root[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    return sorted(set(root.values()))


def test_near_stage_equals_brute_force(stages):
    kept = sorted(r.doc_id for r in stages["near_copies"].collect())
    assert kept == smallest_of_components([(r.doc_id, r.text) for r in stages["exact_copies"].collect()])


def test_near_stage_equals_brute_force_on_planted_pairs(spark, stages):
    texts = [(r.doc_id, r.text) for r in stages["exact_copies"].limit(50).collect()]
    for total, common in [(100, 70), (100, 75), (100, 79), (100, 80), (100, 81), (100, 85), (8, 7), (6, 5), (5, 4), (4, 3), (9, 7)] * 5:
        start, left = [f"p{len(texts)}x{k}" for k in range(common + 4)], total - common
        ends = [f"q{len(texts)}x{k}" for k in range(left)]
        for own in (ends[: left // 2], ends[left // 2 :]):
            texts.append((10**6 + len(texts), " ".join(start + own)))
    found = corpus_pipeline.near_copies(spark, spark.createDataFrame(texts, "doc_id long, text string"), SF_DIR)
    assert sorted(r.doc_id for r in found.collect()) == smallest_of_components(texts)


def test_decontamination_stage(spark, stages):
    items = [re.findall(r"\w+", r.text.lower()) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in stages["decontamination"].collect()}
    for r in stages["near_copies"].collect():
        line = " " + " ".join(re.findall(r"\w+", r.text.lower())) + " "
        assert (r.doc_id in kept) == (not any(" " + " ".join(i) + " " in line for i in items))


def test_segmentation_stage(stages):
    found = stages["segmentation"].collect()
    assert all(r.exact for r in found) and {r.doc_id for r in found} == {r.doc_id for r in stages["decontamination"].collect()}


def test_all_operators_and_the_pipeline_are_registered():
    names = contract.queries()
    assert {int(n.split("_")[0][2:]) for n in names if re.match(r"op\d+_", n)} == set(range(1, 14)) and "pipeline" in names
    assert set(SQL) <= set(QUERIES) <= set(names) and corpus_pipeline.ORACLE_SQL is None
    assert public_tokenizers.path("piece_bpe_32k.model")
