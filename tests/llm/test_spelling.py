"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings, strategies as st

from inkwell.llm import queries, spelling
from inkwell.llm.spelling import decomposed, most_affected, near_pairs, runs, spelling_forms

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    form, close = {}, {}
    for w, n in words.items():
        close[w] = [x for x in words if near(w, x)]
        best = min(close[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    result = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        result.append((w, form[w], root, n, len(close[w]), words.get(form[w])))
    return sorted(result)


def listed(frame):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in frame.collect())


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    mine, expected = listed(queries.QUERIES["op11_spelling"](spark, sf_dir)), brute(docs)
    assert mine == expected and any(form for _, form, *_ in mine)


def test_variants_chains_and_ties(spark):
    random.seed(5)
    words = ["information", "banana", "élégant", "àéîõü", "aaaaa", "abcde", "straße", "pppppppp", "ÿÿÿÿÿ"]
    text = []
    for w in words:
        chain = w
        for times in (40, 18, 7, 3):
            text += [chain] * times
            k = random.randrange(len(chain))
            chain = random.choice([chain[:k] + random.choice("abé") + chain[k:], chain[:k] + "q" + chain[k + 1 :], chain[:k] + chain[k + 1 :]])
        text += [w[:-1] + "x"] * 4 + [w[:-1] + "y"] * 4 + [w + w[-1]] * 12
    docs = [(k, " ".join(text[k::7]) + (" Banana, BANANA_" if k % 2 else " ×÷ÀÉ")) for k in range(7)] + [(None, "banana " * 5), (9, None), (10, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    expected = brute(docs)
    assert listed(spelling_forms(frame, hot_rows=4)) == expected
    assert any(root != form for _, form, root, *_ in expected if form)


def test_all_pairs_of_many_short_words(spark, monkeypatch):
    """Few letters, so that grams are frequent, lengthened and pruned; every pair must meet."""
    random.seed(1)
    words = sorted({"".join(random.choice("abé") for _ in range(random.randint(5, 8))) for _ in range(700)})
    monkeypatch.setattr(spelling, "PLACES_PER_GRAM", 100)
    frame = spark.createDataFrame([(w, k + 3) for k, w in enumerate(words)], "word string, n long")
    pairs = near_pairs(frame, hot_rows=50).collect()
    assert {tuple(sorted((r["a"], r["b"]))) for r in pairs} == {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b)}
    assert len(pairs) == len({tuple(sorted((r["a"], r["b"]))) for r in pairs})


word = st.text("abc", min_size=5, max_size=9)


@settings(max_examples=300, deadline=None)
@given(word, st.integers(0, 9), st.sampled_from(["a", "b", "c", ""]), st.sampled_from("rid"), st.sets(st.text("abc^$", min_size=2, max_size=4), max_size=40))
def test_an_edit_leaves_the_bound_of_grams(w, k, letter, kind, frequent):
    k = min(k, len(w) - 1)
    other = {"r": w[:k] + (letter or "a") + w[k + 1 :], "i": w[:k] + (letter or "a") + w[k:], "d": w[:k] + w[k + 1 :]}[kind]
    frequent = frozenset(frequent)

    def grams(x):
        return Counter(f"^{x}$"[p : p + n] for p, n in enumerate(decomposed(x, frequent)))

    common = sum((grams(w) & grams(other)).values())
    for x in (w, other):
        kept = len(x) + 1 - most_affected(decomposed(x, frequent))
        assert 1 <= kept <= common


def test_runs_are_those_of_the_pattern(monkeypatch):
    text = "Abc déF_ghi ÀÉx 漢字é×÷ don't 123a🙂b ſKK"
    expected = [r.translate(UPPER) for r in RUN.findall(text)]
    assert [r.decode("latin-1") for part in runs(text) for r in part] == expected
    monkeypatch.setattr(spelling, "PART_BYTES", 3)
    assert [r.decode("latin-1") for part in runs(text) for r in part] == expected


def test_awkward_documents(spark, awkward, nothing):
    docs = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    long = "z" * 30_000
    docs += [(20 + k, long) for k in range(4)] + [(30 + k, long[:-1] + "y") for k in range(9)]
    frame = awkward.select("doc_id", "text").union(spark.createDataFrame(docs[-13:], "doc_id long, text string"))
    assert listed(spelling_forms(frame)) == brute(docs)
    assert listed(spelling_forms(awkward, hot_rows=2)) == brute(docs[:-13])
    assert spelling_forms(nothing).count() == 0
