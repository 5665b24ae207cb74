"""op6: finite vectors stay however large; what can't be scored is an error."""

import pytest

from colloquy.llm import topk
from tests.llm.test_topk import brute, random_vectors, result, table


def test_large_components_take_part(spark):
    vectors = random_vectors(60, 4, 2.0) + [(100, [1e6, -7e4, 3.0, 0.5]), (101, [65_537.0, 0.0, 0.0, 1.0]), (150, [-1e6] * 4)]
    vectors += [(201, [1e7, 0.0, 0.0, -1e7])]
    vectors += [(102, [float("inf"), 0, 0, 0]), (103, [float("nan")] * 4), (104, [None, 1e6, 0, 0])]
    got = result(topk.top_k(table(spark, vectors), block_rows=16))
    assert got == brute(vectors)
    assert {100, 101, 201} <= {j for _, _, j, _ in got} and {100, 150} <= {i for i, _, _, _ in got}


@pytest.mark.parametrize("large", [1e20, 1e16])
def test_what_does_not_fit_fails(spark, large):
    with pytest.raises(Exception, match="can't be indexed|too large"):
        topk.top_k(table(spark, [(0, [large]), (50, [large]), (1, [1.0])])).collect()
