import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from inkwell.llm import attention
from inkwell.llm.attention import BEGIN, BLOCK, CLASSES, DEPTH, GROUPS, LOG10E, MEMBERS, SIZE, Scorer, Vocabulary, fresh, gradient, train, unpack
from inkwell.llm.lmscore import END_ID, WINDOW, fit, frequency_cut, gather, lm_scores
from inkwell.llm.tokenfile import encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def vocabulary():
    draw = np.random.default_rng(0)
    counts = draw.integers(0, 50, 3000)
    found = Vocabulary.from_counts(counts, counts // 2, draw.random(3000) < 0.4)
    return found.with_successions(draw.integers(0, 5, (CLASSES + 1, CLASSES)).astype(float), np.full(CLASSES, 1 / CLASSES))


def test_probabilities_of_all_ids_add_up_to_one(vocabulary):
    assert np.exp(vocabulary.group_log).sum(1) == pytest.approx(1, abs=1e-4)
    assert np.exp(vocabulary.member_log).sum(1) == pytest.approx(1, abs=1e-4)
    for row in vocabulary.log_share:
        assert np.bincount(vocabulary.class_of, 10**row) == pytest.approx(1)


def test_gradient(vocabulary):
    draw = np.random.default_rng(1)
    flat = fresh().astype(np.float64)
    x = draw.integers(0, CLASSES, (2, 2 * BLOCK + 1))
    x[1, 20:] = -1
    inputs, contexts = np.where(x[:, :-1] < 0, BEGIN, x[:, :-1]), draw.integers(0, CLASSES + 1, (2, 2 * BLOCK))
    _, grad = gradient(flat, vocabulary, inputs, contexts, x[:, 1:])
    for k in draw.choice(np.flatnonzero(grad), 40):
        step = np.zeros(SIZE)
        step[k] = 1e-5
        up, down = (gradient(flat + s, vocabulary, inputs, contexts, x[:, 1:])[0] for s in (step, -step))
        assert (up - down) / 2e-5 == pytest.approx(grad[k], rel=1e-3, abs=1e-6)


def slow_score(vocabulary, flat, ids):
    p, total = unpack(flat.astype(np.float64)), 0.0
    classes = vocabulary.class_of[ids]
    inputs, contexts = np.concatenate([[BEGIN], classes[:-1]]), np.concatenate([[BEGIN], vocabulary.contexts(ids[:-1])])
    for i in range(len(ids)):
        seen = np.arange(max(0, (i // BLOCK - 1) * BLOCK), i + 1)
        logits = (p["embed"][inputs[seen]] @ p["key"]) @ (p["embed"][inputs[i]] @ p["query"]) / np.sqrt(DEPTH) + p["near"][i - seen]
        weight = np.exp(logits - logits.max())
        h = p["embed"][inputs[i]] + (weight / weight.sum()) @ (p["embed"][inputs[seen]] @ p["value"])
        group = classes[i] // MEMBERS
        z = h @ p["group"] + p["group_bias"] + vocabulary.group_log[contexts[i]]
        y = h @ p["member"][group] + p["member_bias"][group] + vocabulary.member_log[contexts[i] * GROUPS + group]
        log = z[group] - np.log(np.exp(z).sum()) + y[classes[i] % MEMBERS] - np.log(np.exp(y).sum())
        total += log * LOG10E + vocabulary.log_share[int(contexts[i] == BEGIN), ids[i]]
    return total


def test_windows_score_each_token_once(vocabulary, monkeypatch):
    draw = np.random.default_rng(2)
    texts = [draw.integers(0, 3000, n) for n in (1, 15, 16, 17, 100, 0, 33)]
    scorer = Scorer(vocabulary, fresh())
    expected = [slow_score(vocabulary, fresh(), t) for t in texts]
    assert scorer.log10(texts) == pytest.approx(expected, rel=1e-4)
    monkeypatch.setattr(Scorer, "BLOCKS_AT_ONCE", 3)
    assert scorer.log10(texts) == pytest.approx(expected, rel=1e-4)
    assert scorer.log10([]).tolist() == [] and scorer.log10([np.zeros(0, np.int64)]).tolist() == [0.0]


def test_training_learns_what_is_further_back(vocabulary):
    draw = np.random.default_rng(3)
    tops = np.argsort(vocabulary.class_of)[:64]
    line = draw.choice(tops, (600, 2 * BLOCK + 1))
    line[:, 2:] = line[:, :1]  # the first id comes again and again
    flat = train(fresh(), vocabulary, line, 3, 1)
    before, after = (Scorer(vocabulary, f).log10(list(line[:50])).sum() for f in (fresh(), flat))
    assert after > 0.6 * before and np.isfinite(flat).all()


def documents(n):
    draw = np.random.default_rng(4)
    return [(i, " ".join(draw.choice(["The", "cat", "of", "rare" + str(draw.integers(0, 200)), "mat,"], 30))) for i in range(n)]


@pytest.mark.parametrize("frequent_words", [10**6, 5, 0])
def test_base_model_equals_counting(spark, awkward, frequent_words):
    docs = awkward.select("doc_id", "text").union(spark.createDataFrame(documents(150), "doc_id long, text string"))
    found = lm_scores(docs, PATH, frequent_words=frequent_words, hot_rows=20).collect()
    rows = [(r.doc_id, (r.text or "").encode().lower().split() + ["end"]) for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, words in rows if not held(i) for w in words)
    n, v = sum(counts.values()), len(counts)
    expected = sorted(((i, held(i), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 4)) for i, w in rows), key=str)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found), key=str) == expected
    assert all(-math.inf < r.score < 0 for r in found)


def test_model_beats_the_even_guess_on_held_out_texts(spark):
    docs = spark.createDataFrame(documents(400), "doc_id long, text string")
    held = [r for r in lm_scores(docs, PATH).collect() if r.held_out]
    assert len(held) > 20 and sum(r.score for r in held) > -0.5 * sum(r.n_tokens for r in held) * math.log10(49_408)


def test_windows_cover_every_id_of_every_text_once(spark, awkward):
    docs = awkward.select("text").union(spark.createDataFrame([(t,) for _, t in documents(50)], "text string"))
    found = gather(docs, PATH).filter("window IS NOT NULL").collect()
    rows = np.array([np.frombuffer(r.window, np.int32) for r in found])
    goals, expected = rows[:, 1:], Counter()
    for r in docs.collect():
        words = (r.text or "").encode().lower().split()
        ids_of = encoder(PATH).ids_of(words)
        expected.update([i for w in words for i in np.frombuffer(ids_of[w], encoder(PATH).dtype).tolist()] + [END_ID])
    assert rows.shape[1] == WINDOW and Counter(goals[goals >= 0].tolist()) == expected
    assert (rows[:, 0] == -2).sum() == docs.count() and (goals[:, 0] >= 0).all()


def test_fit_trains_on_every_window(spark, vocabulary, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(flat, vocabulary, windows, epochs, seed, rate=0.01):
        if seed >= 100:
            seen.add(len(windows))
        return flat

    monkeypatch.setattr("inkwell.llm.lmscore.train", counted)
    monkeypatch.setattr("inkwell.llm.lmscore.WINDOWS_PER_SHARD", 8)
    windows = np.random.default_rng(5).integers(0, 3000, (203, WINDOW)).astype(np.int32)
    fit(spark.createDataFrame([(bytearray(w.tobytes()),) for w in windows], "window binary"), vocabulary, first_windows=10)
    assert seen.value == 203


def test_frequency_cut_keeps_its_bound(spark):
    counts = spark.createDataFrame([(str(k), 1 + k // 3) for k in range(300)], "word string, n long")
    for most in (0, 1, 10, 100, 300):
        cut = frequency_cut(counts, most)
        assert counts.filter(f"n >= {cut}").count() <= most
    assert frequency_cut(counts, 300) == 1


def test_empty_tables(spark, nothing):
    assert lm_scores(nothing, PATH).collect() == []
    only = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2)
    found = lm_scores(spark.createDataFrame([(only, "held out")], "doc_id long, text string"), PATH).first()
    assert (found.held_out, found.n_tokens, found.n_known, found.train_tokens, found.base_score) == (True, 3, 0, 0, 0.0)
