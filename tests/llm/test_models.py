"""op4, op5 and op10: their parts against brute force, and held-out results."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from colloquy.llm import lattice_lm, quality, toxicity
from tests.llm.fixtures import TEXTS, all_null, documents, empty, rows

SF_DIR = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int, id long, label string"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def labels_of(spark, rows):
    return spark.createDataFrame([(i, q, t, 1, "x") for i, q, t in rows], LABELS)


SPECIAL_LABELS = [(i, i % 2, i % 3 == 0) for i, _ in TEXTS if i is not None] + [(1, 0, None), (None, 1, 1), (99, 1, 1), (4, None, 7)]


def remainder(i, modulus):
    return zlib.crc32(b"" if i is None else str(i).encode()) % modulus


def area(truth, scores):
    """Area under the ROC curve."""
    order = np.argsort(np.argsort(scores)) + 1
    ones = truth == 1
    n1, n0 = ones.sum(), (~ones).sum()
    return (order[ones].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet")


@pytest.mark.parametrize("score,modulus,out", [(toxicity.toxicity, 4, 2), (quality.quality, 3, 1)])
@pytest.mark.parametrize("make", [documents, all_null, empty])
@pytest.mark.parametrize("labelled", [SPECIAL_LABELS, []])
def test_special_rows_are_scored(spark, score, modulus, out, make, labelled):
    labels = labels_of(spark, [(i, q, None if t is None else int(t)) for i, q, t in labelled])
    docs = make(spark)
    got = rows(score(docs, labels))
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted((r["doc_id"] for r in docs.collect()), key=repr)
    for r in got:
        assert r["held_out"] == (remainder(r["doc_id"], modulus) == out)
        assert 0 <= r["score"] <= 1
        assert r["predicted"] == (r["score"] >= (0.3 if modulus == 4 else 0.5))


def held_out_results(df, labels, label):
    pairs = df.filter("held_out").join(labels, "doc_id").select(label, "score", "predicted").collect()
    truth, scores = np.array([r[0] for r in pairs]), np.array([r[1] for r in pairs])
    return truth, scores, np.array([r[2] for r in pairs])


def test_toxic_documents_are_found(given):
    truth, scores, predicted = held_out_results(toxicity.toxicity(*given), given[1], "toxic")
    assert area(truth, scores) > 0.95
    assert predicted[truth == 1].mean() > 0.9 and predicted[truth == 0].mean() < 0.03


def test_low_quality_is_found_and_clean_documents_stay(given):
    truth, scores, predicted = held_out_results(quality.quality(*given), given[1], "quality")
    assert area(truth, scores) > 0.98
    assert predicted[truth == 1].mean() > 0.99 and predicted[truth == 0].mean() < 0.1


def test_held_out_labels_do_not_matter(spark, given):
    docs = given[0].limit(1500)
    learned = given[1].filter("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2").select("doc_id", "toxic")
    same = {r["doc_id"]: r["score"] for r in rows(toxicity.toxicity(docs, learned))}
    assert {r["doc_id"]: r["score"] for r in rows(toxicity.toxicity(docs, given[1]))} == same


def brute_segments(scores):
    """The best segment (the shortest of equals), and the same to its left and right."""

    def inside(low, high):
        best = None
        for i in range(low, high):
            total = 0
            for j in range(i, high):
                total += scores[j]
                if total > 1e-12 and (best is None or total > best[0] + 1e-12 or (abs(total - best[0]) <= 1e-12 and j - i < best[2] - best[1])):
                    best = (total, i, j)
        if best is None:
            return []
        return inside(low, best[1]) + [(best[1], best[2], round(best[0], 6))] + inside(best[2] + 1, high)

    return inside(0, len(scores))


def test_maximal_segments():
    draw = random.Random(1)
    for _ in range(500):
        scores = [draw.choice([-0.25] * 4 + [1.03, 0.31, 2.17]) for _ in range(draw.randint(1, 25))]
        places = [i for i, s in enumerate(scores) if s > 0]
        got = toxicity.segments(places, [scores[i] for i in places], 0.25)
        assert [(a, b, round(s, 6)) for a, b, s in got] == brute_segments(scores)


def test_passages_are_where_the_words_are(spark):
    model = toxicity.Model({b"scum": 4.0, b"idiot": 3.5}, 2.0, 0.01, -3.0, 2.0)
    text = "Nothing here. You SCUM, idiot! " + "calm words follow " * 40 + "scum"
    docs = spark.createDataFrame([(1, text), (2, "fine"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows(toxicity.score_toxicity(docs, model))}
    assert [text[p["begin"] : p["end"]] for p in got[1]["passages"]] == ["SCUM, idiot", "scum"]
    assert got[1]["score"] > got[2]["score"] == got[3]["score"] and not got[2]["passages"]


def test_decay_solves_its_equation():
    rates = {2.0: 0.01, 4.0: 0.002}
    decay = toxicity.solve_decay(rates)
    rest = 1 - sum(rates.values())
    assert rest * math.exp(-decay * toxicity.LOSS) + sum(p * math.exp(decay * s) for s, p in rates.items()) == pytest.approx(1)


# The language model.


@pytest.fixture(scope="module")
def pieces():
    with open(PIECES, "rb") as file:
        return lattice_lm.vocabulary(file.read())


def brute_marginal(text, table, byte_ids, logs):
    if not text:
        return 1.0
    total, single = 0.0, table.get(text[0]) is not None
    for end in range(1, len(text) + 1):
        piece = table.get(text[:end])
        if piece is not None:
            total += math.exp(logs[piece]) * brute_marginal(text[end:], table, byte_ids, logs)
    if not single:
        unknown = math.exp(sum(logs[byte_ids[b]] for b in text[0].encode()))
        total += unknown * brute_marginal(text[1:], table, byte_ids, logs)
    return total


def test_lattice_sums_over_all_segmentations(pieces):
    table, byte_ids = pieces
    logs = np.log(np.random.default_rng(0).dirichlet(np.ones(40_000))).tolist()
    for word in ("the", "nation", "internationale", "éçà", "x中🙂y", "...", "▁a"):
        got = lattice_lm.marginal(word.encode(), table, byte_ids, logs)
        assert got == pytest.approx(math.log(brute_marginal("▁" + word, table, byte_ids, logs)))


@pytest.mark.parametrize("word", ["international", "x中🙂y", "long" * 30])
def test_expected_pieces_cover_the_word(pieces, monkeypatch, word):
    table, byte_ids = pieces
    logs = np.random.default_rng(1).normal(-8, 1, 40_000)
    found = []
    for short in (1000, 0):  # without and with logarithms
        monkeypatch.setattr(lattice_lm, "SHORT", short)
        into = [0.0] * 40_000
        lattice_lm.expected_pieces(word.encode(), table, byte_ids, logs.tolist(), np.exp(logs).tolist(), into)
        found.append(into)
    assert found[0] == pytest.approx(found[1])
    lengths = {number: len(piece) for piece, number in table.items() if number is not None}
    lengths |= {b: 0 for b in byte_ids}
    unknown = sum(table.get(c) is None for c in word)
    assert sum(found[0][n] * lengths[n] for n in np.flatnonzero(found[0])) == pytest.approx(len("▁" + word) - unknown)


def test_very_long_words_have_a_score(pieces):
    table, byte_ids = pieces
    assert -1e7 < lattice_lm.marginal(b"ab" * 50_000, table, byte_ids, [-9.0] * 40_000) < -1e4


def brute_base(texts, modulus=5, out=1):
    learned, docs = Counter(), 0
    for i, text in texts:
        if remainder(i, modulus) != out:
            learned.update((text or "").encode().lower().split())
            learned[b""] += 1
    tokens, types = sum(learned.values()), len([w for w in learned if learned[w]])
    result = []
    for i, text in texts:
        words = [*(text or "").encode().lower().split(), b""]
        base = sum(math.log10((learned[w] + 0.5) / (tokens + 0.5 * (types + 1))) for w in words)
        result.append((i, remainder(i, modulus) == out, len(words), sum(learned[w] > 0 for w in words), tokens, base))
    return sorted(result, key=repr)


@pytest.mark.parametrize("head", [3, 100_000])
def test_base_scores(spark, monkeypatch, head):
    monkeypatch.setattr(lattice_lm, "HEAD", head)
    got = sorted(
        (tuple(r[k] for k in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")) for r in rows(lattice_lm.lattice_scores(documents(spark), PIECES))),
        key=repr,
    )
    for have, want in zip(got, brute_base(TEXTS), strict=True):
        assert have[:5] == want[:5] and have[5] == pytest.approx(want[5])


@pytest.mark.parametrize("head", [5, 100_000])
def test_split_of_frequent_words_does_not_change_scores(spark, monkeypatch, head):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r["doc_id"]: r["score"] for r in rows(lattice_lm.lattice_scores(docs, PIECES))}
    monkeypatch.setattr(lattice_lm, "HEAD", head)
    got = {r["doc_id"]: r["score"] for r in rows(lattice_lm.lattice_scores(docs.repartition(3), PIECES))}
    assert got == pytest.approx(want, rel=1e-6)


def test_null_and_empty_tables(spark):
    assert lattice_lm.lattice_scores(empty(spark), PIECES).count() == 0
    got = rows(lattice_lm.lattice_scores(all_null(spark), PIECES))
    assert [(r["n_tokens"], r["n_known"]) for r in got] == [(1, 1)] * 4
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in got)


def test_expected_counts_raise_the_probability_of_held_out_text(given, monkeypatch):
    """Each round over the lattices beats the vocabulary's own segmentation; the base score is no distribution to compare with."""
    from pyspark.sql import functions as F

    found = []
    for rounds in (0, 1, 2):
        monkeypatch.setattr(lattice_lm, "ROUNDS", rounds)
        got = lattice_lm.lattice_scores(given[0], PIECES).filter("held_out")
        score, tokens, bad = got.agg(F.sum("score"), F.sum("n_tokens"), F.sum((F.col("score") > 0).cast("int"))).first()
        found.append(score / tokens)
        assert not bad
    assert found[0] < found[1] < found[2]
