"""Alignment of calls against every order-keeping choice of pairs."""

import itertools
import random

from colloquy.operators.alignment import with_alignment

CALLS = "array<struct<name:string,arguments:string>>"


def brute(expected, predicted):
    """Most pairs of one name that keep both orders, then most equal arguments."""
    best = (0, 0)
    for size in range(1, min(len(expected), len(predicted)) + 1):
        for left in itertools.combinations(expected, size):
            for right in itertools.combinations(predicted, size):
                if all(a[0] is not None and a[0] == b[0] for a, b in zip(left, right, strict=True)):
                    best = max(best, (size, sum(a[1] == b[1] for a, b in zip(left, right, strict=True))))
    return best


def test_random_lists_equal_enumeration(spark):
    rng = random.Random(3)

    def calls():
        return [(rng.choice(["a", "b", "c", None]), rng.choice(['{"x":1}', '{"x":2}', "no json"])) for _ in range(rng.randrange(0, 6))]

    rows = [(n, calls(), calls()) for n in range(80)]
    df = with_alignment(spark.createDataFrame(rows, f"id int, expected {CALLS}, predicted {CALLS}").repartition(5))
    given = {n: (e, p) for n, e, p in rows}
    for r in df.collect():
        expected, predicted = given[r["id"]]
        assert (r["matched"], r["exact"]) == brute(expected, predicted)
        assert r["missing"] == len(expected) - r["matched"] and r["surplus"] == len(predicted) - r["matched"]
        # The pairs themselves keep both orders and join equal names.
        places = [(p["expected"], p["predicted"]) for p in r["pairs"]]
        assert all(a < c and b < d for (a, b), (c, d) in itertools.pairwise(places))
        assert all(expected[a][0] == predicted[b][0] for a, b in places)


def test_one_more_call_does_not_shift_the_others(spark):
    want = [("a", '{"x": 1}'), ("b", '{"y": [1, 2]}'), ("c", "{}")]
    cases = [
        (0, want, [("log", "{}"), *want], (3, 3, 0, 1)),
        (1, want, want[1:], (2, 2, 1, 0)),
        (2, want, [("a", '{"x":1}'), ("b", '{ "y":[1,2] }'), ("c", "{}")], (3, 3, 0, 0)),
        (3, want, None, (0, 0, 3, 0)),
        (4, None, want, (0, 0, 0, 3)),
        (5, None, None, (0, 0, 0, 0)),
        (6, want, list(reversed(want)), (1, 1, 2, 2)),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], f"id int, expected {CALLS}, predicted {CALLS}")
    got = {r["id"]: (r["matched"], r["exact"], r["missing"], r["surplus"]) for r in with_alignment(df).collect()}
    assert got == {c[0]: c[3] for c in cases}
