"""Quality by voting of the nearest labelled documents in a latent-semantic space.

A document is a bag of hashed features: its words, their endings and their shapes, words
that repeat the one before, and how varied its words and lines are. A bounded,
documented sample of labelled documents gives feature weights (inverse document
frequency) and, by a truncated singular value decomposition, the latent space. Its
vectors, of known number and length, are broadcast. Every document is projected, compared with
all of them in blocks by exact cosine products, and its nearest neighbours vote with
weights that grow with their similarity.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.common import doc_column, remainder, text_bytes, training_ids, training_rows

#: Labelled documents of each class in the sample, latent dimensions, and voting neighbours.
PER_CLASS, DIMENSIONS, NEIGHBOURS = 1500, 48, 15
#: Hashed features: words, endings, shapes and places for the rates of a whole document.
WORDS, ENDINGS, SHAPES, RATES = 1024, 512, 256, 64
FEATURES = WORDS + ENDINGS + SHAPES + RATES
#: Documents in one block of products, and words whose features a batch remembers.
BLOCK, REMEMBERED = 256, 100_000

#: Bytes to classes of shape: lower case and other letters, upper case, digits, the rest as they are.
SHAPE = bytes(
    97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256)
)


@dataclass(frozen=True)
class Model:
    """Feature weights, the projection, and the labelled vectors with the weights of their votes."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    votes: np.ndarray
    rate: float


def word_features(word: bytes) -> int:
    """Places of the word, its last two bytes, and the classes of its first two and last two, in one number."""
    classes = word.translate(SHAPE)
    ending = zlib.crc32(word[-2:]) % ENDINGS
    shape = zlib.crc32(classes[:2] + classes[-2:]) % SHAPES
    return (shape * ENDINGS + ending) * WORDS + zlib.crc32(word) % WORDS


def features(text: bytes, memory: dict[bytes, int]) -> np.ndarray:
    """Damped counts of a text's features."""
    words = text.split()
    out = np.zeros(FEATURES, np.float32)
    if not words:
        return out
    if len(memory) > REMEMBERED:
        memory.clear()
    counts = Counter(words)
    for word in counts:
        if word not in memory:
            memory[word] = word_features(word)
    packed = np.fromiter(map(memory.__getitem__, counts), np.int64, len(counts))
    rest, word_places = np.divmod(packed, WORDS)
    shapes, endings = np.divmod(rest, ENDINGS)
    places = np.concatenate([word_places, WORDS + endings, WORDS + ENDINGS + shapes])
    times = np.tile(np.fromiter(counts.values(), np.float32, len(counts)), 3)
    out = np.log1p(np.bincount(places, times, FEATURES)).astype(np.float32)
    # Rates of the whole text fill one place out of eight each, as heavy as a common word.
    total = len(words)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False)) / total
    lines = [line for line in text.split(b"\n") if line]
    sentences = [part for part in text.split(b".") if part]
    rates = (
        repeats,
        1 - len(set(lines)) / max(1, len(lines)),
        1 - len(set(sentences)) / max(1, len(sentences)),
        max(counts.values()) / total,
        1 - len(counts) / total if total >= 20 else 0.0,
    )
    base = FEATURES - RATES
    for number, rate in enumerate(rates):
        if rate > 0.02:
            out[base + number * 8 + min(7, int(rate * 8))] = math.log1p(total)
    out[base + 48 + min(15, int(math.log2(total)))] = 1.0
    return out


def project(rows: np.ndarray, idf: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit vectors in the latent space; a text without features is the zero vector."""
    latent = (rows * idf) @ axes
    length = np.linalg.norm(latent, axis=1, keepdims=True)
    return (latent / np.where(length > 0, length, 1)).astype(np.float32)


def vote(model: Model, latent: np.ndarray) -> np.ndarray:
    """Share of the votes for label 1 among the nearest labelled vectors of each row."""
    if not len(model.labels):
        return np.full(len(latent), model.rate)
    products = latent @ model.vectors.T
    k = min(NEIGHBOURS, products.shape[1])
    nearest = np.argpartition(-products, k - 1, axis=1)[:, :k]
    similarity = np.take_along_axis(products, nearest, 1).astype(float)
    # The similarity to the furth power sets near copies apart; one vote of the rate settles ties.
    weight = np.clip(similarity, 0, 1) ** 4 * model.votes[nearest]
    prior = 1e-3
    return (np.sum(weight * model.labels[nearest], 1) + prior * model.rate) / (weight.sum(1) + prior)


def learn(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int) -> Model:
    """A model from a sample of at most about ``PER_CLASS`` labelled documents a class."""
    ids = training_ids(docs, labels, label, modulus, held_out, PER_CLASS, per_class=True)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        for batch in batches:
            rows = [features(text.as_py(), memory) for text in batch.column(2)]
            places = [np.flatnonzero(row) for row in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([p.astype("<u2").tobytes() for p in places], pa.binary()),
                    pa.array([r[p].astype("<f4").tobytes() for r, p in zip(rows, places, strict=True)], pa.binary()),
                ],
                names=["label", "weight", "places", "values"],
            )

    sample = training_rows(docs, ids).mapInArrow(featured, "label int, weight double, places binary, values binary")
    # The order decides the signs and the last bits of the axes: a fixed one makes reruns agree.
    sample = sorted(tuple(row) for row in sample.collect())
    weights = np.array([row[1] for row in sample])
    marks = np.array([row[0] for row in sample], float)
    rate = float((marks @ weights + 0.5) / (weights.sum() + 1)) if sample else 0.5
    empty = np.zeros((0, DIMENSIONS), np.float32)
    if len(set(marks)) < 2:
        return Model(np.zeros(FEATURES, np.float32), np.zeros((FEATURES, DIMENSIONS), np.float32), empty, marks[:0], weights[:0], rate)
    rows = np.zeros((len(sample), FEATURES), np.float32)
    for number, (_, _, places, values) in enumerate(sample):
        rows[number, np.frombuffer(places, "<u2")] = np.frombuffer(values, "<f4")
    idf = np.log((1 + len(rows)) / (1 + (rows > 0).sum(0))).astype(np.float32) + 1
    axes = latent_axes(rows * idf, DIMENSIONS)
    vectors = project(rows, idf, axes)
    return Model(idf, axes, vectors, marks, np.sqrt(weights), rate)


def latent_axes(rows: np.ndarray, dimensions: int, rounds: int = 5) -> np.ndarray:
    """Right singular vectors of unit rows by subspace iteration from a fixed start."""
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    rows = rows / np.where(length > 0, length, 1)
    basis = np.random.default_rng(0).normal(size=(rows.shape[1], dimensions)).astype(np.float32)
    for _ in range(rounds):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    return basis.astype(np.float32)


def score_quality(
    docs: DataFrame, model: Model, cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text", carry: bool = False
) -> DataFrame:
    """One row per input row: ``doc_id, score, predicted`` (and ``doc``).

    Null, empty and blank texts have no features and get the rate of label 1 among what was
    learned. Whole texts are read; equal texts score equally; empty tables give empty results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        model, memory, out = shared.value, {}, []
        for start in range(0, len(texts), BLOCK):
            rows = np.stack([features(text.as_py(), memory) for text in texts[start : start + BLOCK]])
            out.append(vote(model, project(rows, model.idf, model.axes)))
        return pa.array(np.concatenate(out) if out else [], pa.float64())

    return docs.select(
        F.col(id_col).alias("doc_id"), scored(text_bytes(text_col)).alias("score"), *doc_column(carry)
    ).select("doc_id", "score", (F.col("score") >= cut).cast("int").alias("predicted"), *(["doc"] if carry else []))


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, cut: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of all documents, learned from ``labels.quality``.

    Rows with ``crc32(doc_id) mod modulus`` equal to ``held_out`` teach nothing. Without
    both labels among the others, every score is their smoothed rate.
    """
    model = learn(docs, labels, "quality", modulus, held_out)
    return score_quality(docs, model, cut).select(
        "doc_id", (remainder("doc_id", modulus) == held_out).alias("held_out"), "score", "predicted"
    )
