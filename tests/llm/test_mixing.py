"""op1 against its SQL and against brute force."""

import re
from collections import defaultdict

import duckdb
import pytest

from colloquy.llm.mixing import mix
from colloquy.llm.queries import MIX_SQL
from tests.llm.fixtures import TEXTS, all_null, documents, empty, rows


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Share all words by weight, stop the full ones, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[n % 3] for n, s in enumerate(order)}
    target, open_sources, left = dict.fromkeys(sizes, 0.0), set(sizes), float(sum(sizes.values()))
    while open_sources and left > 1e-9:
        total = sum(weight[s] for s in open_sources)
        for s in open_sources:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_sources):
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                open_sources.remove(s)
    return target


def check(df, docs):
    got = rows(df)
    sizes, largest = defaultdict(int), defaultdict(int)
    for r in docs:
        sizes[r["source"]] += size_of(r["text"])
        largest[r["source"]] = max(largest[r["source"]], size_of(r["text"]))
    targets, taken = brute_targets(sizes), defaultdict(int)
    assert len(got) == len(docs)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]], rel=1e-9, abs=1e-6)
        assert r["taken"] == r["size"] * r["times"] and 0 <= r["times"] <= 3
        taken[r["source"]] += r["taken"]
    return targets, taken, largest


def as_docs(texts_and_sources):
    return [{"text": t, "source": s} for t, s in texts_and_sources]


def sql_rows(docs):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs)
    return sorted(con.execute(MIX_SQL).fetchall(), key=repr)


def test_mix_of_special_rows(spark):
    df = documents(spark)
    docs = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    out = mix(df)
    check(out, [{"text": t, "source": s} for _, t, s in docs])
    got = [tuple(r[k] for k in ("doc_id", "source", "size", "source_size", "target", "taken")) for r in rows(out)]
    assert sorted(got, key=repr) == sql_rows(docs)


def test_mix_of_given_documents_is_near_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    targets, taken, largest = check(mix(docs), as_docs((r["text"], r["source"]) for r in docs.collect()))
    for source, target in targets.items():
        assert abs(taken[source] - target) <= largest[source]
    again = mix(docs.repartition(5))
    assert {r["doc_id"]: r["taken"] for r in rows(again)} == {r["doc_id"]: r["taken"] for r in rows(mix(docs))}


def test_mix_with_a_hot_source_and_equal_rows(spark):
    texts = [(i % 3, "one two three") for i in range(300)] + [(i, f"{i} four five") for i in range(300)]
    df = documents(spark, texts).withColumn("source", __import__("pyspark").sql.functions.lit("hot"))
    check(mix(df), as_docs((r["text"], r["source"]) for r in df.collect()))


def test_mix_of_null_and_empty_tables(spark):
    assert mix(empty(spark)).count() == 0
    got = rows(mix(all_null(spark)))
    assert [(r["size"], r["source_size"], r["target"], r["taken"]) for r in got] == [(0, 0, 0.0, 0)] * 4


def test_mix_carries_rows(spark):
    got = rows(mix(documents(spark), carry=True))
    assert len(got) == len(TEXTS) and all(r["doc"]["hash"] == 2 for r in got)


def test_full_sources_pass_their_excess_on():
    assert brute_targets({"a": 1, "b": 100, "c": 100}) == pytest.approx({"a": 3, "b": 132, "c": 66})
