"""Whole-text scores of the lattice model against sums over every segmentation."""

import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from colloquy.llm import lattice_lm
from colloquy.llm.common import remainder
from tests.llm.fixtures import rows

PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["the cat sat on the mat", "a cat and a dog", "THE dogs  sat", "é 中", "", None, "cat"]


def enumerated(text, table, byte_ids, logs):
    """All ways to write a text's characters as pieces, one after the other."""
    if not text:
        return [()]
    out, single = [], False
    for end in range(1, len(text) + 1):
        piece = table.get(text[:end])
        if piece is not None:
            single = single or end == 1
            out += [(piece, *rest) for rest in enumerated(text[end:], table, byte_ids, logs)]
    if not single:
        out += [(*(byte_ids[b] for b in text[0].encode()), *rest) for rest in enumerated(text[1:], table, byte_ids, logs)]
    return out


def brute_model(texts, model):
    """Piece and end probabilities by expected counts over enumerated segmentations."""
    table, byte_ids = lattice_lm.vocabulary(model)
    size = lattice_lm.processor(model).get_piece_size()
    words = Counter(w for t in texts for w in (t or "").encode().lower().split())
    counts = np.zeros(size)
    for word, n in words.items():
        for piece in lattice_lm.processor(model).encode(word.decode()):
            counts[piece] += n
    for step in range(lattice_lm.ROUNDS + 1):
        counts = np.round(counts, 3)  # as sums that arrive in any order are
        total = (counts + lattice_lm.FLOOR).sum() + len(texts) + lattice_lm.FLOOR
        p = (counts + lattice_lm.FLOOR) / total
        end = (len(texts) + lattice_lm.FLOOR) / total
        if step == lattice_lm.ROUNDS:
            return p, end
        counts = np.zeros(size)
        for word, n in words.items():
            ways = enumerated(lattice_lm.START + word.decode(), table, byte_ids, None)
            weights = np.array([math.prod(p[i] for i in way) for way in ways])
            for way, weight in zip(ways, weights / weights.sum(), strict=True):
                for piece in way:
                    counts[piece] += n * weight


@pytest.fixture(scope="module")
def model():
    with open(PIECES, "rb") as file:
        return file.read()


def test_scores_equal_sums_over_all_segmentations(spark, model):
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(TEXTS * 3)], "doc_id long, text string").repartition(3)
    learned = [r["text"] for r in docs.filter(remainder("doc_id", 5) != 1).collect()]
    p, end = brute_model(learned, model)
    table, byte_ids = lattice_lm.vocabulary(model)
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in docs.collect()}
    for r in rows(lattice_lm.lattice_scores(docs, PIECES)):
        # The whole text at once: every way to segment each word, in every combination.
        want = math.log10(end)
        for word in texts[r["doc_id"]]:
            ways = enumerated(lattice_lm.START + word.decode(), table, byte_ids, None)
            want += math.log10(sum(math.prod(p[i] for i in way) for way in ways))
        assert r["score"] == pytest.approx(want, abs=1e-6), r["doc_id"]


def test_probabilities_of_pieces_and_end_sum_to_one(spark, model):
    docs = spark.createDataFrame([(n, False, (t or "").encode()) for n, t in enumerate(TEXTS)], "doc_id long, held_out boolean, bytes binary")
    words = lattice_lm.count_words(docs)
    logs, end = lattice_lm.learn_pieces(words, model, lattice_lm._totals(words))
    assert np.exp(logs).sum() + math.exp(end) == pytest.approx(1, abs=1e-6)


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("a", "x y"), (None, "y z"), ("c", None)], "doc_id string, text string")
    got = {r["doc_id"]: r for r in rows(lattice_lm.lattice_scores(docs, PIECES))}
    assert set(got) == {"a", None, "c"} and got["c"]["n_tokens"] == 1


def test_words_summed_at_once_equal_words_summed_alone(model):
    """One by one, words took most of the query's time."""
    table, byte_ids = lattice_lm.vocabulary(model)
    size = lattice_lm.processor(model).get_piece_size()
    logs = np.log(np.random.default_rng(0).dirichlet(np.ones(size)))
    texts = ["cat", "the", "", "internationalization", "x" * 23, "x" * 24, "ab" * 300, "中文", "é", "\U0001fa9a", "a\0b", "▁▁a", "1,234.56", "zq\u0378z"]
    words = [t.encode() for t in texts] + [b"\xff\xfe", b"ok\xc3"]
    times = np.arange(1, len(words) + 1)
    want = [0.0] * size
    for word, n in zip(words, times.tolist(), strict=True):
        lattice_lm.expected_pieces(word, table, byte_ids, logs.tolist(), np.exp(logs).tolist(), want, n)
    assert lattice_lm.expected_counts(words, times, logs, model) == pytest.approx(np.array(want), rel=1e-9, abs=1e-12)
    alone = [lattice_lm.marginal(word, table, byte_ids, logs.tolist()) for word in words]
    assert lattice_lm.marginals(words, logs, model) == pytest.approx(np.array(alone), rel=1e-12)
    assert not lattice_lm.expected_counts([], times[:0], logs, model).any() and not len(lattice_lm.marginals([], logs, model))


def test_common_words_are_not_summed_one_by_one(model, monkeypatch):
    def alone(*args):
        raise AssertionError(args[0])

    monkeypatch.setattr(lattice_lm, "expected_pieces", alone)
    monkeypatch.setattr(lattice_lm, "marginal", alone)
    logs = np.full(lattice_lm.processor(model).get_piece_size(), -12.0)
    words = [b"the", b"cat", "é".encode(), b"internationalization", b"1,234.56"]
    assert lattice_lm.expected_counts(words, np.ones(5), logs, model).sum() > 5
    assert (lattice_lm.marginals(words, logs, model) < 0).all()
