"""The Merkle manifest against a tree built in one place."""

from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from colloquy.llm.merkle import merkle_manifest
from tests.llm.fixtures import all_null, documents, empty, rows

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(text):
    return sha256(text.encode()).hexdigest()


def brute_leaf(row):
    parts = ["-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS]
    return h("".join(parts))


def brute_proof(nodes, at):
    """Siblings of a node, level by level, and the top."""
    out = []
    while len(nodes) > 1:
        start = at - at % 3
        out.append(("".join(nodes[start:at]), "".join(nodes[at + 1 : start + 3])))
        nodes = [h("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
        at //= 3
    return out, nodes[0]


def brute(docs):
    """doc_id, leaf, subroot, root, proof, sorted."""
    by_source = defaultdict(list)
    for row in docs:
        by_source[row["source"]].append(((row["doc_id"] is not None, row["doc_id"] or 0), brute_leaf(row), row["doc_id"]))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {s: [x[1] for x in sorted(by_source[s], key=lambda x: x[:2])] for s in order}
    subroots = [brute_proof(leaves[s], 0)[1] for s in order]
    out = []
    for n, source in enumerate(order):
        outer, root = brute_proof(subroots, n)
        for at, (_, leaf, doc_id) in enumerate(sorted(by_source[source], key=lambda x: x[:2])):
            out.append((doc_id, leaf, subroots[n], root, brute_proof(leaves[source], at)[0] + outer))
    return sorted(out, key=str)


def found(df):
    return sorted(
        (
            (r["doc_id"], r["leaf"], r["subroot"], r["root"], list(zip(r["lefts"], r["rights"], strict=True)))
            for r in rows(df)
        ),
        key=str,
    )


@pytest.mark.parametrize("height", [1, 2, 6])
def test_proofs_on_fixtures(spark, height):
    for make in (documents, all_null):
        docs = make(spark)
        got = merkle_manifest(docs, height=height)
        assert found(got) == brute(rows(docs))
        for r in got.collect():
            assert r["folded_root"] == r["root"]
            assert r["proof_sha256"] == h("".join(a + b for a, b in zip(r["lefts"], r["rights"], strict=True)))
    assert merkle_manifest(empty(spark), height=height).count() == 0


def test_many_levels_one_large_source_and_many_small_ones(spark):
    docs = spark.range(400).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("é"), (F.col("id") % 40).cast("string"))).alias("source"),
        F.lit("en").alias("lang"),
        F.col("id").alias("n_chars"),
        F.concat(F.lit("line\n"), F.col("id").cast("string")).alias("text"),
    )
    # Superblocks of three: six inner trees above each other, and four outer ones.
    assert found(merkle_manifest(docs.repartition(7), height=1)) == brute(rows(docs))
    assert found(merkle_manifest(docs, height=2)) == brute(rows(docs))


def test_only_altered_rows_fold_to_another_root(spark):
    docs = documents(spark)
    odd = F.when(F.col("doc_id") % 2 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    for r in merkle_manifest(docs, altered=odd, proofs=False, height=1).collect():
        changed = r["doc_id"] is not None and r["doc_id"] > 0 and r["doc_id"] % 2 == 1 and r["doc_id"] != 3  # 3 has no text
        assert (r["folded_root"] != r["root"]) == changed, r["doc_id"]
    assert "lefts" not in merkle_manifest(docs, proofs=False).columns


def test_other_id_types_and_order_of_partitions(spark):
    docs = spark.createDataFrame([("b", "s", None, 1, "x"), ("a", "s", None, 1, "x"), (None, None, "", 0, "")], "doc_id string, source string, lang string, n_chars int, text string")
    assert found(merkle_manifest(docs)) == found(merkle_manifest(docs.repartition(5)))
    assert {r["doc_id"] for r in merkle_manifest(docs).collect()} == {"a", "b", None}
