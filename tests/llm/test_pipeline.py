"""The corpus pipeline: every stage on all that the one before it kept."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from colloquy.llm import byte_bpe, quality
from colloquy.llm.queries import QUERIES, SQL
from tests.llm.fixtures import all_null, documents, empty
from tests.llm.test_dedup import brute_components, brute_fingerprint, folded
from tests.oracle import _rows, connect

SF_DIR = "/root/testdata/sf0.01"
STAGES = dict(corpus_pipeline.STAGES)


def test_queries_are_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(names) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, name):
    con = connect(SF_DIR)
    df = QUERIES[name](spark, SF_DIR)
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert _rows(df.columns, df.collect()) == _rows(names, cursor.fetchall())


def test_pipeline_step_by_step(spark):
    """Each stage against brute force on what the one before it gave."""
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    docs = {r["doc_id"]: r for r in given.collect()}
    rejected = {r["doc_id"] for r in quality.quality(given, labels).filter("predicted = 0").collect()}
    kept = [(i, r["text"]) for i, r in docs.items() if i not in rejected]
    best = {}
    for i, text in kept:
        best[folded(text)] = max(best.get(folded(text), i), i)
    kept = [(i, text) for i, text in kept if best[folded(text)] == i]
    first = {c for _, _, c in brute_components([(i, brute_fingerprint(t)) for i, t in kept], 4)}
    kept = spark.createDataFrame([docs[i] for i, _ in kept if i in first], given.schema)
    times = {r["doc_id"]: r["times"] for r in corpus_pipeline.mix(kept).collect() if r["times"]}

    out = corpus_pipeline.run(spark, SF_DIR).collect()
    assert Counter(r["doc_id"] for r in out) == times
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        encoding = byte_bpe.encoder(file.read(), public_tokenizers.PATTERN)
    for r in out[:100]:
        ids = encoding.encode_ordinary(docs[r["doc_id"]]["text"])
        assert r["ids"] == ids
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_stages_return_the_columns_of_documents(spark):
    for make in (documents, all_null, empty):
        docs = make(spark)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF_DIR).schema.names == docs.schema.names, name
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF_DIR)
        assert STAGES["byte-level BPE encoding and decoding"](spark, docs, SF_DIR).count() == docs.count()


def test_dedup_stages_keep_one_row_of_each_group(spark):
    docs = documents(spark)
    groups = defaultdict(set)
    for r in docs.collect():
        groups[folded(r["text"])].add(r["doc_id"])
    assert STAGES["exact dedup"](spark, docs, SF_DIR).count() == len(groups)
