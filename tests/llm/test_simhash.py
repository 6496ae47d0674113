import numpy as np
import pytest
import xxhash

from inkwell.llm.components import components
from inkwell.llm.hamming import Forest, close_pairs, gray_order, gray_rank, levels, run_pairs
from inkwell.llm import simhash
from inkwell.llm.simhash import fingerprint, pigeonhole_masks, shingle_hashes, simhash_groups


def slow_fingerprint(text, words=4):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    runs = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, radius):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_gray_rank_inverts_the_code():
    ranks = np.arange(1000, dtype=np.uint64)
    assert (gray_rank(ranks ^ (ranks >> np.uint64(1))) == ranks).all()


@pytest.mark.parametrize("width,n,radius", [(1, 1, 4), (1, 17, 30), (1, 600, 4), (2, 300, 20)])
def test_close_pairs_equal_brute_force(width, n, radius):
    draw = np.random.default_rng(n)
    a = draw.integers(0, 1 << 63, (n, width), dtype=np.uint64)
    a[n // 2 :] = a[: n - n // 2] ^ (np.uint64(1) << draw.integers(0, 64, (n - n // 2, width)).astype(np.uint64))
    a = a[gray_order(a)]
    far = np.bitwise_count(a[:, None] ^ a[None]).sum(2)
    within = [p for i, j in close_pairs(a, None, radius) for p in zip(i.tolist(), j.tolist())]
    assert sorted(within) == [(i, j) for i in range(n) for j in range(i + 1, n) if far[i, j] <= radius]
    b = a[::3]
    across = [p for i, j in close_pairs(a, b, radius) for p in zip(i.tolist(), j.tolist())]
    assert sorted(across) == [(i, j) for i in range(n) for j in range(len(b)) if far[i, 3 * j] <= radius]


def test_upper_nodes_hold_what_their_members_share():
    codes = np.sort(np.random.default_rng(1).integers(0, 1 << 20, (40, 1), dtype=np.uint64), axis=0)
    pattern, shared = levels(codes)[1]
    for k in range(len(pattern)):
        assert ((codes[16 * k : 16 * k + 16] ^ pattern[k]) & shared[k] == 0).all()


def test_runs_and_forest():
    runs, codes = np.array([1, 1, 1, 2, 2, 3]), np.array([[0], [1], [255], [7], [6], [7]], np.uint64)
    forest = Forest(6)
    for i, j in run_pairs(runs, codes, 2):
        forest.link(i, j)
    assert forest.root.tolist() == [0, 0, 2, 3, 3, 5]


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000)] + [(2000 + i, 2100 - i) for i in range(50)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), hot_rows=10).collect()}
    assert all(found[i] == 0 for i in range(61)) and all(found[1000 + i] == 1000 for i in range(50))
    assert all(found[2100 - i] == 2000 + i for i in range(50)) and 5000 not in found
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_pigeonhole_masks_meet():
    draw = np.random.default_rng(3)
    for blocks in (5, 6):
        masks = pigeonhole_masks(4, blocks)
        for _ in range(200):
            change = sum(1 << int(b) for b in draw.choice(64, 4, replace=False))
            assert any(change & m[0] == 0 for m in masks)


def test_long_text_in_blocks_equals_whole(monkeypatch):
    text = " ".join(f"w{i}" for i in range(500))
    whole = shingle_hashes(text, 4)
    monkeypatch.setattr("inkwell.llm.words.BLOCK_BYTES", 16)
    assert (shingle_hashes(text, 4) == whole).all() and len(whole) == 497
    assert [fingerprint(shingle_hashes(t, 4)) for t in (None, "", " \n")] == [[0]] * 3


@pytest.mark.parametrize("blocks", [None, 6])
def test_groups_of_awkward_and_near_documents(spark, awkward, monkeypatch, blocks):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    draw = np.random.default_rng(5)
    base = [" ".join(f"v{draw.integers(0, 400)}" for _ in range(60)) for _ in range(30)]
    rows = [(100 + i, " ".join([*base[i % 30].split()[:-1], f"end{i // 30 % 4}"])) for i in range(240)]
    docs = awkward.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    found = simhash_groups(docs, blocks=blocks, hot_rows=10).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [slow_fingerprint(t) for _, t in texts]
    roots = slow_components(prints, 4)
    low = {}
    for (i, _), root in zip(texts, roots):
        low[root] = min((x for x in (low.get(root), i) if x is not None), default=None)
    expected = sorted(((i, f"{p:016x}", low[root]) for (i, _), p, root in zip(texts, prints, roots)), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in found), key=str) == expected


def test_buckets_over_many_chunks_lose_no_link(spark, monkeypatch):
    """One bucket with hundreds of fingerprints, in chunks of eight on many partitions."""
    monkeypatch.setattr(simhash, "CHUNK", 8)
    monkeypatch.setattr(simhash, "SMALL_RUN", 4)
    draw = np.random.default_rng(9)
    codes = [int(x) << 32 | 5 for x in draw.integers(0, 1 << 31, 300)]
    codes += [c ^ (1 << int(draw.integers(32, 63))) ^ (1 << int(draw.integers(32, 63))) for c in codes[:150]]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "id long, f0 long")
    found = {r.id: r.component_id for r in simhash.grouped(rows, pigeonhole_masks(4), 1, 4).collect()}
    roots = slow_components(codes, 4)
    assert [found[i] for i in range(len(codes))] == roots
