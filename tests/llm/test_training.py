"""Labelled samples, and scores against brute force on whole texts."""

import math
from collections import Counter

import numpy as np
import pytest

from colloquy.llm import common, quality, toxicity

SF_DIR = "/root/testdata/sf0.01"


def sample(spark, docs, labels, bound=1000):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    ids = common.training_ids(docs, labels, "quality", 3, 1, bound)
    return ids, common.training_rows(docs, ids)


def test_one_id_on_many_texts_counts_each_text_once(spark):
    learned = [n for n in range(200) if __import__("zlib").crc32(str(n).encode()) % 3 != 1]
    hot, others = learned[0], learned[1:41]
    docs = [(hot, f"text {n}") for n in range(300)] + [(n, f"other {n}") for n in others]
    ids, rows = sample(spark, docs, [(n, 1) for n in learned])
    assert ids.count() == rows.count() == 340


@pytest.mark.parametrize("times", [1, 500])
def test_repeated_rows_count_once(spark, times):
    learned = [n for n in range(100) if __import__("zlib").crc32(str(n).encode()) % 3 != 1]
    docs = [(learned[0], "same text")] * times + [(learned[1], "same text"), (learned[2], "another"), (learned[3], None), (learned[4], "")]
    ids, rows = sample(spark, docs, [(n, n % 2) for n in learned] * 2)
    want = Counter()
    for i, text in {(i, text or "") for i, text in docs}:
        want[(i % 2, text)] = 1
    assert Counter((r["label"], bytes(r["bytes"]).decode()) for r in rows.collect()) == want


def test_sample_keeps_its_bound_and_its_weights(spark):
    learned = [n for n in range(30_000) if __import__("zlib").crc32(str(n).encode()) % 3 != 1]
    ids, _ = sample(spark, [(n, f"text {n}") for n in learned], [(n, 1) for n in learned], bound=2000)
    n, weight = ids.count(), ids.first()["weight"]
    assert abs(n - 2000) < 200 and weight == pytest.approx(len(learned) / 2000)


def given(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    return docs, spark.read.parquet(f"{SF_DIR}/labels.parquet")


def test_quality_votes_equal_a_search_over_all_labelled_vectors(spark):
    docs, labels = given(spark)
    model = quality.learn(docs, labels, "quality", 3, 1)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    scores = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, model).collect()}
    for doc_id in sorted(texts)[::20]:
        row = quality.features((texts[doc_id] or "").encode(), {})
        latent = [sum(float(x) * float(w) * float(a) for x, w, a in zip(row, model.idf, axis, strict=True) if x) for axis in model.axes.T]
        length = math.sqrt(sum(x * x for x in latent)) or 1.0
        near = sorted(
            ((sum(x / length * float(v) for x, v in zip(latent, vector, strict=True)), n) for n, vector in enumerate(model.vectors)), reverse=True
        )[: quality.NEIGHBOURS]
        weights = [max(0.0, min(1.0, s)) ** 4 * model.votes[n] for s, n in near]
        want = (sum(w * model.labels[n] for w, (_, n) in zip(weights, near, strict=True)) + 1e-3 * model.rate) / (sum(weights) + 1e-3)
        assert scores[doc_id] == pytest.approx(want, abs=0.02), doc_id
    assert 0.0 < np.mean([s >= 0.5 for s in scores.values()]) < 1.0


def brute_segments(values):
    """Maximal scoring segments by their definition: the best span, then the same left and right of it."""
    best = None
    for i in range(len(values)):
        total = 0.0
        for j in range(i, len(values)):
            total += values[j]
            if total > 0 and (best is None or total > best[0] + 1e-12):
                best = (total, i, j)
    if best is None:
        return []
    total, i, j = best
    shifted = [(a + j + 1, b + j + 1, s) for a, b, s in brute_segments(values[j + 1 :])]
    return [*brute_segments(values[:i]), (i, j, total), *shifted]


def test_toxicity_scores_equal_brute_force_over_every_span(spark):
    docs, labels = given(spark)
    model = toxicity.learn(docs, labels, "toxic", 4, 2)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    short = [i for i in sorted(texts) if len(toxicity.tokens(texts[i])) < 150][:150]
    assert any(scores[i] >= 0.3 for i in short) and any(scores[i] < 0.3 for i in short)
    for doc_id in short:
        words = toxicity.tokens(texts[doc_id])
        values = [toxicity.token_weight(model.weights, w) or -toxicity.LOSS for w in words]
        chance = [model.scale * max(len(words), 1) * math.exp(-model.decay * s) for _, _, s in brute_segments(values)]
        total = sum(max(0.0, -math.log(max(e, 1e-300))) for e in chance)
        want = 1 / (1 + math.exp(-(model.base + model.slope * math.log1p(total))))
        assert scores[doc_id] == pytest.approx(want, abs=1e-6), doc_id
