"""Phrase collocations against counting in one place."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from colloquy.llm import collocations as c
from tests.llm.fixtures import all_null, documents, empty, rows

FOLD = {c: c + 32 for c in range(65, 91)}


def brute(docs, support, longest, first=2000, covered=50):
    counts = defaultdict(Counter)
    for row in docs:
        lang = "und" if row["lang"] is None else row["lang"]
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (row["text"] or "").translate(FOLD)):
            words = [w for w in re.split(r"[ \t]", piece) if w]
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    counts[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(v for k, v in f.items() if len(k) == 1)
        frequent = {k: v for k, v in f.items() if len(k) > 1 and v >= support}
        scored = []
        for phrase, a in frequent.items():
            inside = [
                v for k, v in frequent.items()
                if len(k) > len(phrase) and any(k[i : i + len(phrase)] == phrase for i in range(len(k)))
            ]
            if any(100 * v >= covered * a for v in inside):
                continue
            cuts = [(1_000_000 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def found(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in rows(df))


TEXTS = [
    "New York is far. new york, New York! to be or not to be\tto be",
    "to be or not to be\nto be or not; to be or",
    "a a a a a a. a a a a",
    "x.y.z x.y.z  x y z x y z",
    "of the. Of the of the\x0bof the\x0cof the\rof the",
    "ÀÉ ñ ÀÉ ñ àé ñ \xa0 nb\xa0sp nb\xa0sp ÀÉ ñ",
    "",
    None,
    "one.",
]


@pytest.mark.parametrize("support,longest", [(1, 2), (2, 3), (3, 4), (10, 3)])
def test_small_texts(spark, support, longest):
    langs = ["en", "fr", None, "und"]
    data = [(n % 5, text, langs[n % 4]) for n, text in enumerate(TEXTS * 5)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(4)
    got = c.collocations(docs, support=support, longest=longest)
    assert found(got) == brute(rows(docs), support, longest)
    few = c.collocations(docs, support=support, longest=longest, first=2, covered=80)
    assert found(few) == brute(rows(docs), support, longest, 2, 80)


def test_fixtures(spark):
    docs = documents(spark)
    assert found(c.collocations(docs)) == brute(rows(docs), 10, 3)
    for make in (all_null, empty):
        assert c.collocations(make(spark)).count() == 0


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(c, "SEGMENT", 40)
    text = b"one two three. four five, six seven eight nine ten eleven twelve thirteen; fourteen  fifteen" * 5
    parts = list(c.segments(text))
    assert len(parts) > 5
    assert [w for part in parts for w in part] == [w for w in re.sub(rb"[.,;]", b" . ", text).split() if w]
    # Only a segment without any end of a piece may be longer.
    assert all(part[-1] == b"." for part in parts[:-1])


def test_scores_beyond_64_bits(spark):
    """a * a * 1,000,000 and l * r pass 2 ** 63 long before a count does."""
    word = "w " * 3_000_000
    docs = spark.createDataFrame([(1, word, "en"), (2, word, "en")], "doc_id long, text string, lang string")
    (row,) = c.collocations(docs, longest=2).collect()
    a, f = 5_999_998, 6_000_000
    assert (row["a"], row["l"], row["score"]) == (a, f, 1_000_000 * a * a // (f * f))


def test_exact_counts_do_not_depend_on_digests():
    ids = np.array([0, 1, 2, 3, 1, 2, 3, 0, 1, 2, 0, 3, 3, 3, 3, 0, 0], np.int32)
    for size in (1, 2, 3, 4):
        starts = c.windows(ids, size)
        phrases, n = c.exact_counts(ids, starts, size)
        want = Counter(tuple(ids[i : i + size].tolist()) for i in range(len(ids) - size + 1) if all(ids[i : i + size]))
        assert dict(zip(map(tuple, phrases.tolist()), n.tolist(), strict=True)) == want
    # Everything passes a full bitmap, nothing an empty one.
    digests = np.arange(5, dtype=np.uint64) << np.uint64(60)
    assert c.Candidates(np.full(1 << (c.BITS - 6), 2**64 - 1, np.uint64)).has(digests).all()
    assert not c.Candidates(np.zeros(1 << (c.BITS - 6), np.uint64)).has(digests).any()


def test_a_worker_hands_phrases_on_as_it_counts_them():
    """Word numbers of all phrases of a chunk at once took most of a worker's memory."""
    draw = np.random.default_rng(1)
    ids = draw.integers(0, 50, 5000).astype(np.int32)
    for size in (1, 2, 3, 4):
        starts = c.windows(ids, size)
        parts = list(c.exact_parts(ids, starts, size, rows=100))
        assert all(0 < len(found) <= 100 and found.shape[1] == size for found, _ in parts)
        want = Counter(tuple(ids[i : i + size].tolist()) for i in range(len(ids) - size + 1) if all(ids[i : i + size]))
        got = {tuple(row): n for found, counts in parts for row, n in zip(found.tolist(), counts.tolist(), strict=True)}
        assert got == want and sum(len(found) for found, _ in parts) == len(want)
        assert not list(c.exact_parts(ids, starts[:0], size))


def test_runs_of_values():
    for values in ([], [3], [5, 1, 5, 5, 2**64 - 1, 1]):
        distinct, counts = c.runs(np.array(values, np.uint64))
        assert dict(zip(distinct.tolist(), counts.tolist(), strict=True)) == Counter(values)
