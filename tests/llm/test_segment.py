import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from inkwell.llm import lattice as lattices
from inkwell.llm.lattice import Pieces, build, decode_ids
from inkwell.llm.segment import decoded, sample_segmentations, segmentations

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return Pieces(PATH)


def all_segmentations(pieces, text):
    """Every segmentation with its exact probability."""
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    names = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    line = "".join("\0" if c < 0 else chr(c) for c in pieces.codes(text))

    def rest(at):
        if at == len(line):
            return [((), 0.0)]
        steps = [(end, [names[line[at:end]]]) for end in range(at + 1, len(line) + 1) if line[at:end] in names]
        if line[at] not in names:
            steps.append((at + 1, list(model.encode(line[at])[1:]) if line[at] != "\0" else [names_of_bytes(model, b) for b in "▁".encode()]))
        return [(tuple(ids) + more, sum(pieces.log_p[i] for i in ids) + log) for end, ids in steps for more, log in rest(end)]

    found = rest(0)
    total = math.log(sum(math.exp(log) for _, log in found))
    return {ids: log - total for ids, log in found}


def names_of_bytes(model, value):
    return model.piece_to_id(f"<0x{value:02X}>")


@pytest.mark.parametrize("text", ["the cat", "a b\n", "▁x ▁", "naïve", "  two", "漢字𝄞z"])
def test_probabilities_are_exact_and_all_are_met(pieces, text):
    every = all_segmentations(pieces, text)
    found = list(segmentations(pieces, [text], [1], len(every) + 5, 3))
    assert {tuple(ids.tolist()) for _, _, ids, *_ in found} == set(every) and len(found) == len(every)
    assert all(log == pytest.approx(every[tuple(ids.tolist())], abs=1e-9) for _, _, ids, log, _, _ in found)
    values = [v for *_, v, _ in found]
    assert values == sorted(values, reverse=True) and {i for *_, i in found} == {0.0}
    assert all(decode_ids(pieces, ids) == text for _, _, ids, *_ in found)


def test_samples_follow_the_law_of_drawing_without_replacement(pieces):
    model, text, n = Pieces(PATH, sharpness=0.2), "cats", 4000
    every = {k: math.exp(v) for k, v in all_segmentations(model, text).items()}
    drawn = {}
    for k, _, ids, log, value, inclusion in segmentations(model, [text] * n, list(range(n)), 3, 11):
        drawn.setdefault(k, []).append((tuple(ids.tolist()), log, value, inclusion))
    firsts, pairs = Counter(d[0][0] for d in drawn.values()), Counter((d[0][0], d[1][0]) for d in drawn.values())
    for a, p in every.items():
        assert firsts[a] / n == pytest.approx(p, abs=4 * math.sqrt(p / n) + 0.002)
        for b, q in every.items():
            if a != b:
                both = p * q / (1 - p)
                assert pairs[a, b] / n == pytest.approx(both, abs=4 * math.sqrt(both / n) + 0.002)
    assert all(len({x[0] for x in d}) == 3 for d in drawn.values())
    weights = [sum(math.exp(log - inclusion) for _, log, _, inclusion in d) for d in drawn.values()]
    assert np.mean(weights) == pytest.approx(1, abs=0.05)  # inclusion scores make unbiased estimates


def test_samples_do_not_depend_on_the_batch(pieces):
    texts = ["The same text here, " * k for k in range(1, 9)]
    together = [(k, s, i.tolist()) for k, s, i, *_ in segmentations(pieces, texts, list(range(8)), 3, 5)]
    apart = [(k, s, i.tolist()) for k in range(8) for _, s, i, *_ in segmentations(pieces, [texts[k]], [k], 3, 5)]
    assert together == apart


def test_branches_wait_without_changing_the_result(pieces, monkeypatch):
    text = "A rather long text with many words in it. " * 60
    whole = [(s, i.tolist(), v) for _, s, i, _, v, _ in segmentations(pieces, [text], [1], 4, 5)]
    monkeypatch.setattr(lattices, "STEPS_AT_ONCE", 7)
    assert [(s, i.tolist(), v) for _, s, i, _, v, _ in segmentations(pieces, [text], [1], 4, 5)] == whole
    monkeypatch.setattr(lattices, "MOST_NOISE", 1e9)
    assert [(s, i.tolist(), v) for _, s, i, _, v, _ in segmentations(pieces, [text], [1], 4, 5)] == whole


def test_equal_units_share_a_lattice(pieces):
    codes = pieces.codes("one two one two one")
    found = build(pieces, codes, np.flatnonzero(pieces.starts(codes)))
    assert len(found.start) == len(set(found.unit_of)) == 2
    assert np.add.reduceat(np.exp(found.log_share)[np.argsort(found.node, kind="stable")], np.cumsum(found.edge_count) - found.edge_count) == pytest.approx(1)


def test_awkward_documents_round_trip(spark, awkward, nothing):
    found = sample_segmentations(awkward, PATH, samples=3).withColumn("text", decoded(F.col("ids"), PATH)).collect()
    texts = {r.doc_id: r.text or "" for r in awkward.collect()}
    assert all(r.exact and r.text == texts[r.doc_id] for r in found)
    counts = Counter(r.doc_id for r in found)
    assert (counts[1], counts[2], counts[4], counts[5], counts[None], counts[8]) == (1, 1, 3, 6, 3, 2)
    assert [(r.n_pieces, r.log_prob, r.log_inclusion) for r in found if r.doc_id == 1] == [(0, 0.0, 0.0)]
    again = sample_segmentations(awkward.repartition(4), PATH, samples=3).collect()
    assert sorted((str(r.doc_id), r.sample, r.ids) for r in again) == sorted((str(r.doc_id), r.sample, r.ids) for r in found)
    assert sample_segmentations(nothing, PATH).collect() == []
