"""op6 against exact products."""

import numpy as np
import pytest

from colloquy.llm import topk
from tests.llm.fixtures import rows

SCHEMA = "vec_id long, embedding array<float>, id string, q int, chunk int, rank string"


def table(spark, vectors):
    data = [(i, None if v is None else [None if x is None else float(x) for x in v], "x", 1, 2, "r") for i, v in vectors]
    return spark.createDataFrame(data, SCHEMA).repartition(2)


def quantised(v):
    if v is None or any(x is None or not np.isfinite(x) for x in v):
        return None
    return [int(np.floor(256 * float(np.float32(x)))) for x in v]


def brute(vectors, every=50, k=5):
    usable = [(i, q) for i, v in vectors if i is not None and (q := quantised(v)) is not None]
    out, asked = [], set()
    for i, q in usable:
        if i % every or (i, tuple(q)) in asked:
            continue
        asked.add((i, tuple(q)))
        scores = sorted((-sum(a * b for a, b in zip(q, p, strict=False)), j) for j, p in usable if j != i)
        out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def result(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(df))


def random_vectors(n, dims=16, scale=1.0, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, (rng.normal(size=dims) * scale).tolist()) for i in range(n)]


@pytest.mark.parametrize("block_rows,chunk_queries", [(64, 3), (1000, 100)])
def test_top_k(spark, block_rows, chunk_queries):
    vectors = random_vectors(400, scale=0.3)
    got = topk.top_k(table(spark, vectors), block_rows=block_rows, chunk_queries=chunk_queries)
    assert result(got) == brute(vectors)


def test_special_vectors(spark):
    vectors = random_vectors(60, 4, 2.0)
    vectors += [(100, None), (101, [1.0, None, 1.0, 1.0]), (102, [float("nan")] * 4), (103, [float("inf"), 0, 0, 0])]
    vectors += [(None, [1.0] * 4), (150, [0.0] * 4), (200, [-3.5, 2.25, -100.0, 7.0]), (-50, [0.5] * 4), (201, [1.0, 2.0]), (250, [])]
    vectors += [(300, [0.25] * 4), (300, [0.25] * 4), (350, [0.25] * 4), (350, [0.75] * 4)]  # repeated rows and ids
    assert result(topk.top_k(table(spark, vectors), block_rows=16)) == brute(vectors)


def test_ties_go_to_the_smaller_id(spark):
    vectors = [(i, [0.5, -0.25, 0.0]) for i in range(130)]
    got = result(topk.top_k(table(spark, vectors), block_rows=32))
    assert got == brute(vectors)
    assert [j for i, _, j, _ in got if i == 0] == [1, 2, 3, 4, 5]


def test_fewer_candidates_than_places(spark):
    assert result(topk.top_k(table(spark, [(0, [1.0]), (1, [2.0]), (50, [3.0])]))) == [
        (0, 1, 50, 256 * 768), (0, 2, 1, 256 * 512), (50, 1, 1, 768 * 512), (50, 2, 0, 768 * 256),
    ]
    assert result(topk.top_k(table(spark, [(0, [1.0])]))) == []
    assert result(topk.top_k(table(spark, []))) == []
    assert result(topk.top_k(table(spark, [(None, None), (7, None)]))) == []


def test_sums_of_slices_are_sums():
    rng = np.random.default_rng(2)
    for _ in range(20):
        values = rng.integers(-300, 300, (130, 7))
        query = rng.integers(-300, 300, 7)
        low, slices = topk.build_slices(values)
        sums, base = topk.score_slices(slices, low, query)
        total = np.full(130, base)
        for bit, bitmap in enumerate(sums):
            if bitmap is not None:
                total += np.unpackbits(bitmap.view(np.uint8), bitorder="little")[:130].astype(np.int64) << bit
        assert (total == values @ query).all()
