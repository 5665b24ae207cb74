"""Exact duplicates by distributed radix partitioning on successive bytes.

A document is the string of its byte length and its bytes, with A-Z lower-cased. The
first pass splits all rows by the length and the first ``FIRST`` bytes; only the counts of
those keys are shuffled. Rows alone in their group are done. The others are split again
by their next bytes, a digit that grows from pass to pass, until a group holds one row or its
texts have ended. As all texts of a group have one length, they end together, and what is
then in a group is equal; no digest decides anything.

Rows are stored once, with their numbers, and never moved or written again: each pass reads the digit
at its own offset and counts groups and digits, combined before the shuffle. Copies stay
together, so what a pass adds is a small table of the groups that fell apart, and a row's
group follows from these tables by joins. A group with a third of all rows is one row in each.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.common import discard, doc_column, lookup, stored, text_bytes

#: Bytes compared in the first pass and in the second, and the growth of each pass after that.
FIRST, SECOND, GROWTH = 64, 64, 4

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NORMAL = T.StructType(
    [T.StructField("body", T.BinaryType()), T.StructField("head", T.BinaryType()), T.StructField("sha", T.StringType())]
)


@F.arrow_udf(NORMAL)
def _normalized(texts: pa.Array) -> pa.Array:
    bodies = [text.lower() for text in texts.to_pylist()]  # bytes.lower() changes A-Z only
    return pa.StructArray.from_arrays(
        [
            pa.array(bodies, pa.binary()),
            pa.array([body[:FIRST] for body in bodies], pa.binary()),
            pa.array([hashlib.sha256(body).hexdigest() for body in bodies], pa.string()),
        ],
        names=["body", "head", "sha"],
    )


def _first_pass(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """Stored rows, numbered; ``group``, ``size`` and ``body`` of those that share their first bytes."""
    normal = docs.select(
        F.col(id_col).alias("doc_id"), _normalized(text_bytes(text_col)).alias("n"), *doc_column(carry)
    )
    size = F.octet_length("n.body").alias("size")
    keys = stored(
        normal.select(size, F.col("n.head").alias("head"))
        .groupBy("size", "head")
        .count()
        .filter("count > 1")
        .select("size", "head", F.monotonically_increasing_id().alias("group")),
        "radix-heads",
    )
    split = normal.select("*", size, F.col("n.head").alias("head")).join(lookup(keys), ["size", "head"], "left")
    # A carried document has its text already.
    return stored(
        split.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.col("n.sha").alias("sha"),
            "group",
            F.when(F.col("group").isNotNull(), F.col("size")).alias("size"),
            *(["doc"] if carry else [F.when(F.col("group").isNotNull(), F.col("n.body")).alias("body")]),
        ),
        "radix-rows",
    )


def _grouped(rows: DataFrame, body: Column) -> DataFrame:
    """``row, doc_id, sha, keep_id, group_size, kept`` of the rows that share their first bytes."""
    members = _classes(rows.filter("group IS NOT NULL").withColumn("body", body)).select(
        "row", "doc_id", "sha", F.col("group").alias("class")
    )
    members = stored(members, "radix-members")
    groups = stored(
        members.groupBy("class").agg(
            F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("best")
        ),
        "radix-groups",
    )
    return members.join(lookup(groups), "class").select(
        "row", "doc_id", "sha", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    A null text is an empty one. Of equal texts the row with the largest id stays, a null id
    being the smallest; of rows with equal text and equal largest id exactly one stays.
    ``text_sha256`` is an output only. An empty table gives an empty result.
    """
    rows = _first_pass(docs, id_col, text_col, carry=False)
    grouped = _grouped(rows, F.col("body"))
    out = ["doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")]
    singles = rows.filter("group IS NULL").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"
    ).select(*out)
    return singles.unionByName(grouped.select(*out))


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that ``exact_duplicates`` keeps, whole.

    Only numbers of rows that go meet the rows again; no document is shuffled for that
    unless those numbers are too many to broadcast.
    """
    rows = _first_pass(docs, id_col, text_col, carry=True)
    folded = F.translate(F.coalesce(f"doc.`{text_col}`", F.lit("")), UPPER, LOWER).cast("binary")
    grouped = _grouped(rows, folded)
    gone = stored(grouped.filter("NOT kept").select("row"), "radix-gone")
    return rows.join(lookup(gone), "row", "left_anti").select("doc.*")


def _classes(rows: DataFrame) -> DataFrame:
    """The rows with their last ``group``: those of equal texts, from groups of equal length and first bytes.

    ``size`` and ``body`` are read at the offset of each pass; a pass looks at groups with more than one row
    and bytes left, and its result is a row for each digit of the groups that fell apart.
    """
    longest = rows.agg(F.max("size")).first()[0] or 0
    offset, width = FIRST, SECOND
    while offset < longest:
        digit = F.substring("body", offset + 1, width)
        found = stored(
            rows.filter(F.col("size") > offset)
            .groupBy("group", digit.alias("digit"))
            .agg(F.count("*").alias("n"), F.min("row").alias("least")),
            "radix-digits",
        )
        apart = found.groupBy("group").agg(F.count("*").alias("digits")).filter("digits > 1").select("group")
        # The numbers of rows are never those of groups: negative ones are new.
        split = stored(
            found.join(apart, "group").select("group", "digit", (-1 - F.col("least")).alias("next"), (F.col("n") > 1).alias("more")),
            "radix-split",
        )
        discard(found)
        if not split.isEmpty():
            next_ = F.when(F.col("next").isNotNull(), F.col("next")).otherwise(F.col("group"))
            # A row alone has its own group, and nothing more to compare.
            size = F.when(F.coalesce("more", F.lit(True)), F.col("size")).otherwise(F.lit(0))
            rows = (
                rows.withColumn("digit", F.when(F.col("size") > offset, digit))
                .join(lookup(split), ["group", "digit"], "left")
                .withColumns({"group": next_, "size": size})
                .drop("digit", "next", "more")
            )
        offset, width = offset + width, width * GROWTH
    return rows
