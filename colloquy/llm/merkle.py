"""A dataset manifest as a Merkle tree, with a proof for every row.

Every row is a leaf: the digest of its fields. The leaves of a source, by id, are reduced in
runs of three to its subroot, and the subroots, by source, to the root of the dataset.

A tree is cut into superblocks of ``RUN ** height`` consecutive nodes. Going up, each superblock
is reduced to its top, and the tops are the nodes of the next, far smaller tree. Coming down,
the nodes of a superblock are cogrouped with the outer nodes that their proofs need, those
beside the superblock's own path: one function finishes the local reduction, joins the inner
and the outer part of each proof, and folds the row's leaf up to the root. A group is one
superblock, however many rows a source has; digests are shuffled, texts never are.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import stored
from colloquy.llm.ranks import positions

#: Nodes that become one, and levels inside a superblock.
RUN, LEVELS = 3, 6

PROOF = "lefts array<string>, rights array<string>, subroot string, root string"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def reductions(nodes: list[str], total: int, height: int) -> list[list[str]]:
    """The nodes of each level of a superblock, from the given ones to their top.

    A superblock that is all ``total`` nodes of its tree ends at one node; another goes up ``height`` levels.
    """
    whole = total <= RUN**height
    levels = [nodes]
    while len(levels[-1]) > 1 if whole else len(levels) <= height:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + RUN])) for i in range(0, len(below), RUN)])
    return levels


def siblings(levels: list[list[str]], at: int) -> tuple[list[str], list[str]]:
    """What stands left and right of a node's path in its run, level by level."""
    lefts, rights = [], []
    for nodes in levels[:-1]:
        start = at - at % RUN
        lefts.append("".join(nodes[start:at]))
        rights.append("".join(nodes[at + 1 : start + RUN]))
        at //= RUN
    return lefts, rights


def fold(node: str, lefts: list[str], rights: list[str]) -> str:
    """The root that follows from a node and what stands beside its path."""
    for left, right in zip(lefts, rights, strict=True):
        node = digest(left + node + right)
    return node


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Digest of fields: ``-`` for null, else the length in bytes, a colon and the value."""
    return F.sha2(F.concat(*map(_field, values)), 256)


def _block(height: int) -> Column:
    return F.expr(f"position div {RUN**height}").alias("block")


def _upper(nodes: DataFrame, height: int) -> DataFrame:
    """Stored tops of the superblocks of ``tree, position, total, node``, as the nodes of the next tree."""

    def top(rows: pd.DataFrame) -> pd.DataFrame:
        tree, position, total = rows.loc[0, ["tree", "position", "total"]]
        nodes = rows.sort_values("position")["node"].tolist()
        last = reductions(nodes, total, height)[-1][0]
        place, blocks = position // RUN**height, -(-total // RUN**height)
        return pd.DataFrame([(tree, place, blocks, last)], columns=["tree", "position", "total", "node"])

    blocks = nodes.select("tree", "position", "total", "node", _block(height))
    tops = blocks.groupBy("tree", "block").applyInPandas(top, "tree string, position long, total long, node string")
    return stored(tops, "merkle-tops")


def _levels(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The given nodes, those of each next tree, and at last one node for every tree."""
    levels = [nodes]
    while (levels[-1].agg(F.max("total")).first()[0] or 0) > 1:
        levels.append(_upper(levels[-1], height))
    return levels


def _inner_proofs(nodes: DataFrame, outer: DataFrame, height: int) -> DataFrame:
    """Stored proofs of ``nodes``, from those of their superblocks (``tree, block``)."""

    def joined(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position")
        levels = reductions(rows["node"].tolist(), rows["total"].iloc[0], height)
        lefts, rights, subroot, root = above.loc[0, ["lefts", "rights", "subroot", "root"]]
        out = []
        for at, (tree, position) in enumerate(zip(rows["tree"], rows["position"], strict=True)):
            left, right = siblings(levels, at)
            out.append((tree, position, left + list(lefts), right + list(rights), subroot, root))
        return pd.DataFrame(out, columns=["tree", "block", "lefts", "rights", "subroot", "root"])

    blocks = nodes.select("tree", "position", "total", "node", _block(height))
    both = blocks.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
    return stored(both.applyInPandas(joined, f"tree string, block long, {PROOF}"), "merkle-proofs")


def _descend(levels: list[DataFrame], outer: DataFrame, height: int) -> DataFrame:
    """``outer`` of the last of ``levels``, carried down to the superblocks of the first."""
    for nodes in reversed(levels[1:]):
        outer = _inner_proofs(nodes, outer, height)
    return outer


def merkle_manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    altered: Column | None = None,
    altered_col: str = "text",
    proofs: bool = True,
    height: int = LEVELS,
) -> DataFrame:
    """One row per input row: ``doc_id, leaf, subroot, root, folded_root, proof_sha256`` and the proof itself.

    A proof is ``lefts`` and ``rights``: for every level from the leaf to the root what is joined before and
    after the node (both left out unless ``proofs``). ``folded_root`` is what the proof makes of the leaf in which
    ``altered_col`` is replaced by ``altered`` (by default of the leaf itself): the root for rows that are as they were.

    Leaves of a source ascend by id, null ids first; rows alike in id ascend by leaf, and repeated rows are
    leaves of their own. ``height`` is that of a superblock. Null fields and empty ones differ. A null source is one of its own and
    the first. A source with a single row has its leaf as subroot; an empty table gives an empty result.
    """
    marks = leaf(*(F.col(c) for c in fields))
    other = marks if altered is None else leaf(*(altered if c == altered_col else F.col(c) for c in fields))
    leaves = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.coalesce(F.concat(F.lit(":"), F.col(source_col).cast("string")), F.lit("")).alias("tree"),
            F.unhex(marks).alias("node"),
            F.unhex(other).alias("other"),
            F.monotonically_increasing_id().alias("row"),
        ).withColumn("other", F.when(F.col("other") != F.col("node"), F.col("other"))),
        "merkle-leaves",
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("node").asc(), F.col("row").asc()]
    placed = positions(leaves, "tree", order)
    text = F.lower(F.hex("node")).alias("node")
    levels = _levels(placed.select("tree", "position", "total", text), height)
    # The subroots are the leaves of one more tree; its root is proved by nothing beyond it.
    subroots = levels[-1].select(F.lit("").alias("all"), "tree", "node")
    ranked = positions(subroots, "all", [F.col("tree").asc()])
    upper = _levels(ranked.select(F.lit("").alias("tree"), "position", "total", "node"), height)
    nothing = F.array().cast("array<string>")
    outer = upper[-1].select(
        "tree", F.lit(0).cast("long").alias("block"), nothing.alias("lefts"), nothing.alias("rights"),
        F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"),
    )
    if len(upper) > 1:
        beside = _inner_proofs(upper[0], _descend(upper[:-1], outer, height), height)
    else:
        beside = outer
    sources = ranked.select(F.col("tree").alias("source"), "position", "node").join(
        beside.withColumnRenamed("block", "position").drop("subroot", "tree"), "position"
    )
    outer = stored(
        sources.select(
            F.col("source").alias("tree"), F.lit(0).cast("long").alias("block"), "lefts", "rights", F.col("node").alias("subroot"), "root"
        ),
        "merkle-sources",
    )
    outer = _descend(levels[:-1], outer, height)

    def finished(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position")
        nodes = [node.hex() for node in rows["node"]]
        levels = reductions(nodes, rows["total"].iloc[0], height)
        lefts, rights, subroot, root = above.loc[0, ["lefts", "rights", "subroot", "root"]]
        lefts, rights = list(lefts), list(rights)
        out = []
        for at, (doc_id, other) in enumerate(zip(rows["doc_id"], rows["other"], strict=True)):
            left, right = siblings(levels, at)
            left, right = left + lefts, right + rights
            proof = digest("".join(x for pair in zip(left, right, strict=True) for x in pair))
            start = nodes[at] if other is None else other.hex()
            row = (doc_id, nodes[at], subroot, root, fold(start, left, right), proof)
            out.append((*row, left, right) if proofs else row)
        return pd.DataFrame(out, columns=names).astype({"doc_id": "object"})

    names = ["doc_id", "leaf", "subroot", "root", "folded_root", "proof_sha256"] + ["lefts", "rights"] * proofs
    kinds = f"doc_id string, leaf string, subroot string, root string, folded_root string, proof_sha256 string{', lefts array<string>, rights array<string>' * proofs}"
    blocks = placed.select(
        F.col("doc_id").cast("string").alias("doc_id"), "tree", "position", "total", "node", "other", _block(height)
    )
    both = blocks.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(finished, kinds)
    return both.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
