"""Toxic passages as maximum-scoring segments of token log-odds.

Each token has the log-odds of toxic against other documents under an informative
Dirichlet prior (Monroe, Colaresi, Quinn: "Fightin' Words"): the prior is the background
rate of all learned documents, so rare tokens stay near zero. Tokens whose log-odds are
many standard errors above zero keep them, all others count a small loss. Words that
share a beginning share evidence: the first bytes of words that have no weight of their own are
tokens too.

The maximal scoring segments of a text (Ruzzo and Tompa, linear time) are its passages.
Their significance follows from extreme-value theory (Karlin and Altschul): in ``n`` clean
tokens ``K n exp(-lambda S)`` segments of score ``S`` or more are expected by chance. The
document's evidence is the sum over its significant passages of the negative logarithms
of these expectations, and a logistic curve over the evidence of the learned documents makes it a
probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.common import doc_column, remainder, stored, text_bytes, training_ids, training_rows

#: Documents learned from, distinct tokens kept with a weight, and counts a task holds at once.
MAX_LEARNED, MAX_WEIGHTS, HELD = 200_000, 50_000, 200_000
#: Lengths in bytes of the beginnings that count as tokens.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Prior strength as a share of the learned tokens, standard errors, documents with the
#: token, and the loss of every other token.
PRIOR, ERRORS, LEAST, LOSS = 0.1, 3.5, 5, 0.25

#: Letters to lower case, other ASCII to blanks; UTF-8 bytes of other characters stay.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))

SCORE = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("passages", T.ArrayType(T.StructType([
    T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())])))])


@dataclass(frozen=True)
class Model:
    """Token weights, the extreme-value parameters and the logistic curve."""

    weights: dict[bytes, float]
    decay: float  # lambda
    scale: float  # K
    base: float
    slope: float


def tokens(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def token_weight(weights: dict[bytes, float], token: bytes) -> float:
    """The largest weight of a word or its beginnings, 0 without any."""
    best = weights.get(token, 0.0)
    for length in BEGINNINGS:
        if len(token) > length:
            best = max(best, weights.get(token[:length], 0.0))
    return best


def segments(places: list[int], scores: list[float], loss: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last place, score), linear in the places.

    ``places`` are those of positive scores; every place between counts ``-loss``. For each
    new segment the list is searched leftward for one that starts from a lower sum; links
    over those already passed keep the search linear.
    """
    left: list[float] = []  # sum before each candidate
    right: list[float] = []
    spans: list[tuple[int, int]] = []
    link: list[int] = []  # nearest earlier candidate with a lower sum before it
    total, before = 0.0, -1
    for place, score in zip(places, scores, strict=True):
        total -= loss * (place - before - 1)
        low, high, first = total, total + score, place
        total, before = high, place
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= low:
                j = link[j]
            if j < 0 or right[j] >= high:
                left.append(low)
                right.append(high)
                spans.append((first, place))
                link.append(j)
                break
            low, first = left[j], spans[j][0]
            del left[j:], right[j:], spans[j:], link[j:]
    return [(*span, r - l) for span, l, r in zip(spans, left, right, strict=True)]


def passages_of(text: bytes, weight_of: dict[bytes, float], weights: dict[bytes, float]) -> tuple[int, list[tuple[int, int, float]], list[float]]:
    """Number of tokens, segments by token number, and the positive scores."""
    words = tokens(text)
    places, scores = [], []
    for place, word in enumerate(words):
        score = weight_of.get(word)
        if score is None:
            score = weight_of[word] = token_weight(weights, word)
        if score:
            places.append(place)
            scores.append(score)
    if len(weight_of) > HELD:
        weight_of.clear()
    return len(words), segments(places, scores, LOSS), scores


def expected(model: Model, size: int, score: float) -> float:
    """Segments of at least this score that ``size`` clean tokens hold by chance."""
    return model.scale * max(size, 1) * math.exp(-model.decay * score)


def evidence(model: Model, size: int, found: list[tuple[int, int, float]]) -> float:
    return sum(max(0.0, -math.log(max(expected(model, size, score), 1e-300))) for _, _, score in found)


def probability(model: Model, value: float) -> float:
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, model.base + model.slope * math.log1p(value)))))


def _token_counts(rows: DataFrame, known: dict[bytes, float] | None) -> DataFrame:
    """``token, toxic, other``: learned documents that hold each word, or beginning of a word not ``known``."""
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            names = list(held[0].keys() | held[1].keys())
            for start in range(0, len(names), 50_000):
                part = names[start : start + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.binary())]
                    + [pa.array([held[side][n] for n in part], pa.int64()) for side in (1, 0)],
                    names=["token", "toxic", "other"],
                )
            held[0].clear()
            held[1].clear()

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = set(tokens(text.as_py()))
                if shared.value is not None:
                    words = [word for word in words if word not in shared.value]
                    words = {word[:length] for length in BEGINNINGS for word in words if len(word) > length}
                held[label].update(words)
                if len(held[0]) + len(held[1]) > HELD:
                    yield from flush()
        yield from flush()

    parts = rows.select("label", "bytes").mapInArrow(counted, "token binary, toxic long, other long")
    return parts.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def learned_weights(rows: DataFrame) -> dict[bytes, float]:
    """Weights of words, and of beginnings that other words share."""
    words = _significant(_token_counts(rows, None))
    return _significant(_token_counts(rows, words)) | words


def _significant(counts: DataFrame) -> dict[bytes, float]:
    """Log-odds of the tokens that lie ``ERRORS`` standard errors above zero, at most MAX_WEIGHTS."""
    counts = stored(counts, "toxic-counts")
    toxic, other = F.col("toxic"), F.col("other")
    sums = counts.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("other"), F.lit(0))).first()
    n1, n0 = float(sums[0]), float(sums[1])
    if not n1 or not n0:
        return {}
    prior = (toxic + other) * PRIOR
    strength = (n1 + n0) * PRIOR
    # Half a count keeps the odds finite where one token is all there is.
    odds = F.log((toxic + prior) / (n1 + strength - toxic - prior + 0.5)) - F.log(
        (other + prior) / (n0 + strength - other - prior + 0.5)
    )
    error = F.sqrt(1 / (toxic + prior) + 1 / (other + prior))
    found = (
        counts.filter(toxic >= LEAST)
        .select("token", odds.alias("odds"), (odds / error).alias("z"))
        .filter(F.col("z") >= ERRORS)
        .orderBy(F.desc("z"), "token")
        .limit(MAX_WEIGHTS)
        .collect()
    )
    return {bytes(row["token"]): row["odds"] for row in found}


def learn(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int) -> Model:
    """A model from the labelled documents that the split does not hold out."""
    ids = training_ids(docs, labels, label, modulus, held_out, MAX_LEARNED)
    rows = training_rows(docs, ids)
    weights = learned_weights(rows)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kinds = dict(ids.groupBy("label").count().collect())
    rate = (kinds.get(1, 0) + 0.5) / (sum(kinds.values()) + 1)
    flat = Model(weights, 1.0, 1.0, math.log(rate / (1 - rate)), 0.0)
    if not weights:
        return flat

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[bytes, float] = {}
        for batch in batches:
            out = [passages_of(text.as_py(), memory, shared.value) for text in batch.column(1)]
            floats = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([size for size, _, _ in out], pa.int64()),
                    pa.array([[s[2] for s in found] for _, found, _ in out], floats),
                    pa.array([positive for _, _, positive in out], floats),
                ],
                names=["label", "size", "found", "positive"],
            )

    seen = stored(
        rows.select("label", "bytes").mapInArrow(scored, "label int, size long, found array<double>, positive array<double>"),
        "toxic-learned",
    )
    # Scores of single tokens in clean text, in tenths; those of toxic text fill in what never occurs there.
    clean = seen.filter("label = 0")
    size = clean.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    positive = seen.select("label", F.explode("positive").alias("s")).select("label", F.round("s", 1).alias("score"))
    by_score = [dict(positive.filter(f"label = {k}").groupBy("score").count().collect()) for k in (0, 1)]
    toxic_total = max(1, sum(by_score[1].values()))
    rates = {
        s: (by_score[0].get(s, 0) + 0.5 * by_score[1].get(s, 0) / toxic_total) / (size + 1)
        for s in by_score[0].keys() | by_score[1].keys()
    }
    decay = solve_decay(rates)
    lowest = min(weights.values())
    above = clean.select(F.explode("found").alias("s")).filter(F.col("s") >= lowest).count()
    scale = (above + 0.5) / ((size + 1) * math.exp(-decay * lowest))
    model = Model(weights, decay, scale, 0.0, 0.0)

    # Evidence in bins of a half, and the logistic curve over its logarithm.
    gain = F.aggregate(
        "found",
        F.lit(0.0),
        lambda total, s: total + F.greatest(F.lit(0.0), s * decay - F.log(F.greatest(F.col("size"), F.lit(1)) * scale)),
    )
    bins = seen.select("label", F.least(F.floor(gain * 2), F.lit(400)).alias("bin")).groupBy("label", "bin").count().collect()
    base, slope = fit_curve([((row["bin"] + 0.25) / 2 if row["bin"] else 0.0, row["label"], row["count"]) for row in bins])
    return Model(model.weights, model.decay, model.scale, base, slope)


def solve_decay(rates: dict[float, float]) -> float:
    """The positive solution of ``sum p exp(lambda s) = 1``."""
    rest = 1 - sum(rates.values())

    def excess(decay: float) -> float:
        return rest * math.exp(-decay * LOSS) + sum(p * math.exp(decay * s) for s, p in rates.items()) - 1

    low, high = 1e-6, 1e-3
    while excess(high) < 0 and high < 50:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return high


def fit_curve(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Base and slope of a logistic curve over ``log(1 + evidence)``; points are few bins."""
    x = np.array([math.log1p(value) for value, _, _ in points])
    y = np.array([label for _, label, _ in points], float)
    w = np.array([count for _, _, count in points], float)
    design = np.stack([np.ones_like(x), x], 1)
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        slope = design.T @ (w * (y - p)) - 1e-2 * theta
        curve = (design * (w * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        theta = theta + np.clip(np.linalg.solve(curve, slope), -3, 3)
    return float(theta[0]), float(max(theta[1], 0.0))


def _byte_spans(text: bytes, spans: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """Byte ranges of token ranges."""
    places = [match.span() for match in re.finditer(rb"[^ ]+", text.translate(LETTERS))] if spans else []
    return [(places[first][0], places[last][1]) for first, last, _ in spans]


def score_toxicity(
    docs: DataFrame, model: Model, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text", carry: bool = False
) -> DataFrame:
    """One row per input row: ``doc_id, score, predicted, passages`` (and ``doc``).

    ``passages`` are the significant ones of the whole text (fewer than one expected by
    chance), as byte ranges with score and expectation. Null, empty and blank texts have none
    and get the score of that. Equal texts score equally; empty tables give empty results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(SCORE)
    def scored(texts: pa.Array) -> pa.Array:
        model, memory = shared.value, {}
        scores, passages = [], []
        for text in texts:
            text = text.as_py()
            size, found, _ = passages_of(text, memory, model.weights)
            scores.append(probability(model, evidence(model, size, found)))
            found = [s for s in found if expected(model, size, s[2]) < 1]
            passages.append(
                [
                    {"begin": b, "end": e, "score": s[2], "expected": expected(model, size, s[2])}
                    for (b, e), s in zip(_byte_spans(text, found), found, strict=True)
                ]
            )
        kind = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())])
        return pa.StructArray.from_arrays(
            [pa.array(scores, pa.float64()), pa.array(passages, pa.list_(kind))], names=["score", "passages"]
        )

    return docs.select(
        F.col(id_col).alias("doc_id"), scored(text_bytes(text_col)).alias("s"), *doc_column(carry)
    ).select(
        "doc_id", "s.score", (F.col("s.score") >= cut).cast("int").alias("predicted"), "s.passages", *(["doc"] if carry else [])
    )


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, cut: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted, passages`` of all documents, learned from ``labels.toxic``.

    Rows with ``crc32(doc_id) mod modulus`` equal to ``held_out`` teach nothing. Without
    both labels among the others, every score is their smoothed rate.
    """
    model = learn(docs, labels, "toxic", modulus, held_out)
    scores = score_toxicity(docs, model, cut)
    return scores.select(
        "doc_id", (remainder("doc_id", modulus) == held_out).alias("held_out"), "score", "predicted", "passages"
    )
