"""op3 and op8 against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from colloquy.llm import exact_dedup, simhash
from colloquy.llm.components import components
from tests.llm.fixtures import TEXTS, all_null, documents, empty, rows


def folded(text):
    return (text or "").encode().lower()


def brute_exact(texts):
    groups = defaultdict(list)
    for i, text in texts:
        groups[folded(text)].append(i)
    out = []
    for body, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(body).hexdigest()
        out += [(i, keep, len(ids), sha) for i in ids]
    return groups, sorted(out, key=repr)


def exact_rows(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows(df)), key=repr)


def check_exact(df, texts):
    groups, want = brute_exact(texts)
    assert exact_rows(df) == want
    kept = [r for r in rows(df) if r["kept"]]
    assert len(kept) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_duplicates(spark):
    check_exact(exact_dedup.exact_duplicates(documents(spark)), TEXTS)


def test_exact_duplicates_of_null_and_empty_tables(spark):
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0
    check_exact(exact_dedup.exact_duplicates(all_null(spark)), [(None, None)] * 4)


@pytest.mark.parametrize("widths", [(1, 1, 2), (2, 3, 4)])
def test_exact_duplicates_over_many_passes(spark, monkeypatch, widths):
    """Narrow digits split groups in many rounds; a third of all rows is one text."""
    first, second, growth = widths
    monkeypatch.setattr(exact_dedup, "SECOND", second)
    monkeypatch.setattr(exact_dedup, "GROWTH", growth)
    texts = [(i, "same text for a third of the rows") for i in range(60)]
    texts += [(100 + i, "prefix " * 12 + f"{i % 17:03d}" + " suffix" * (i % 3)) for i in range(120)]
    check_exact(exact_dedup.exact_duplicates(documents(spark, texts)), texts)


def test_rows_without_duplicates_are_whole(spark):
    docs = documents(spark)
    got = rows(exact_dedup.without_duplicates(docs))
    groups, _ = brute_exact(TEXTS)
    want = [max((i for i in ids if i is not None), default=None) for ids in groups.values()]
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted(want, key=repr)
    assert all(r["rest"] == "r" and r["kept"] == 4 for r in got)
    assert exact_dedup.without_duplicates(empty(spark)).count() == 0
    assert exact_dedup.without_duplicates(all_null(spark)).count() == 1


def brute_fingerprint(text, width=4):
    words = folded(text).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance):
    """Smallest id reachable, by plain search over all pairs."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    codes = np.array([fp for _, fp in prints], np.uint64)
    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i + 1 :] ^ codes[i]) <= distance):
            a, b = find(i), find(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for n, (i, _) in enumerate(prints):
        least.setdefault(find(n), []).append(i)
    least = {root: min((i for i in ids if i is not None), default=None) for root, ids in least.items()}
    return sorted(((i, f"{fp:016x}", least[find(n)]) for n, (i, fp) in enumerate(prints)), key=repr)


def simhash_rows(df):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows(df)), key=repr)


def test_simhash_components(spark):
    prints = [(i, brute_fingerprint(text)) for i, text in TEXTS]
    assert simhash_rows(simhash.simhash_components(documents(spark))) == brute_components(prints, 4)


def test_simhash_of_null_and_empty_tables(spark):
    assert simhash.simhash_components(empty(spark)).count() == 0
    assert simhash_rows(simhash.simhash_components(all_null(spark))) == [(None, "0" * 16, None)] * 4


def test_simhash_keeps_one_row_of_each_component(spark):
    got = rows(simhash.one_per_component(documents(spark)))
    prints = [(i, brute_fingerprint(text)) for i, text in TEXTS]
    ids = [row[2] for row in brute_components(prints, 4)]
    assert sorted(map(repr, {*ids})) == sorted(repr(r["doc_id"]) for r in got)
    assert all(r["fp"] == 3 for r in got)
    assert simhash.one_per_component(empty(spark)).count() == 0
    assert simhash.one_per_component(all_null(spark)).count() == 1


def test_simhash_on_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    prints = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()]
    assert simhash_rows(simhash.simhash_components(docs)) == brute_components(prints, 4)


@pytest.mark.parametrize("limit", [32, 1 << 14])
def test_links_of_random_and_crowded_codes(spark, limit):
    """Crowded codes agree in most segments; a low limit factors their nodes again and again."""
    rng = np.random.default_rng(5)
    far = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = far[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    crowd = np.uint64(12345678901234567) ^ (rng.integers(0, 1 << 18, 150).astype(np.uint64) << np.uint64(20))
    codes = np.unique(np.concatenate([far, near, crowd]))
    prints = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    roots = dict(components(simhash.near_links(prints, 4, limit)).collect())
    signed = [int(c) for c in codes.view(np.int64)]
    got = defaultdict(set)
    for code in signed:
        got[roots.get(code, code)].add(code)
    want = defaultdict(set)
    for i, _, least in brute_components([(n, int(c)) for n, c in enumerate(codes)], 4):
        want[least].add(signed[i])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_gray_rank_sorts_codes_one_bit_apart():
    codes = np.arange(256, dtype=np.uint64)
    ordered = codes[np.argsort(simhash.gray_rank(codes))]
    assert (np.bitwise_count(ordered[1:] ^ ordered[:-1]) == 1).all()


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(50)}
