"""Groups of similar texts against all pairs."""

import random

import pytest

from colloquy.operators.similar import components, similar_groups


def brute(texts, width=5, similarity=0.8):
    sets = {}
    for key, text in texts:
        words = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
        sets[key] = {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}
    root = {key: key for key in sets}

    def find(key):
        while root[key] != key:
            key = root[key]
        return key

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = {key: find(key) for key in keys}
    sizes = list(groups.values())
    return sorted((k, g, sizes.count(g)) for k, g in groups.items())


def found(df):
    return sorted((r["key"], r["group"], r["group_size"]) for r in df.collect())


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in texts], "key string, text string, kind string, size int").repartition(4)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_edits_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    texts = []
    for n in range(25):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 60))]
        for m in range(rng.randrange(1, 7)):
            texts.append((f"{n:02}-{m}", " ".join(words)))
            if words and rng.random() < 0.7:
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                words.append("more")
    texts += [("null", None), ("empty", ""), ("blank", " \t\n"), ("one", "word"), ("ONE", "Word")]
    assert found(similar_groups(frame(spark, texts), "key", "text")) == brute(texts)


def test_a_passage_that_dissimilar_texts_share(spark):
    """Every text meets all others by one passage; only some are similar."""
    rng = random.Random(5)
    passage = [f"p{n}" for n in range(30)]
    texts = [(f"{n:03}", " ".join(passage + [f"u{n % 20}-{k}" for k in range(rng.choice((2, 40)))])) for n in range(120)]
    assert found(similar_groups(frame(spark, texts), "key", "text")) == brute(texts)


def test_links_of_a_large_group_are_linear(spark):
    """10,000 near copies, all different, and as many equal ones."""
    words = [f"w{n}" for n in range(120)]
    texts = [(f"a{n:05}", " ".join([*words[: n % 119], f"x{n}", *words[n % 119 + 1 :]])) for n in range(10_000)]
    texts += [(f"b{n:05}", " ".join(words)) for n in range(10_000)]
    rows = similar_groups(frame(spark, texts), "key", "text").collect()
    assert {(r["group"], r["group_size"]) for r in rows} == {("a00000", 20_000)}


def test_chains_and_empty_tables(spark):
    links = spark.createDataFrame([(n, n + 1) for n in range(200)] + [(500, 499)], "a long, b long")
    assert {r["root"] for r in components(links).filter("node <= 200").collect()} == {0}
    assert components(links).filter("node > 400 AND root = 499").count() == 2
    assert similar_groups(frame(spark, [("a", "b")]).limit(0), "key", "text").count() == 0
