"""Mixing sources to target weights, by hash thresholds.

A source whose target is ``t`` times its size is taken ``floor(t)`` times whole; of the
rest, the documents whose hash lies below a threshold are taken once more. Thresholds
come from nested histograms: words by source and hash bucket, the bucket in which the
budget ends, and then the same for the rows of that bucket alone with the next bits of
the hash, until the bucket in question holds one hash. Nothing is sorted but the buckets of a
source, and the last step is a filter on each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import WORD_PATTERN, doc_column, lookup, stored

#: Bits of the hash, and of each histogram: at most 4096 buckets a source, five levels.
HASH_BITS, LEVEL_BITS = 60, 12
#: Hexadecimal digits that HASH_BITS are.
DIGITS = HASH_BITS // 4


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def row_hash(id_col: str, text_col: str) -> Column:
    """60 bits of a digest of id and text; rows alike in both have one hash."""
    key = F.concat(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))
    )
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, DIGITS), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row per source.

    Weights repeat over the sources by code point, null last. A target stops at ``most``
    times its source's size and what is left is shared by weight among the others, until
    none is above: all targets below that bound are one factor times their weights.
    """
    ranked = _positions(sizes)
    cycle = F.array(*[F.lit(w) for w in weights])
    weighted = stored(
        ranked.select("source", "source_size", F.get(cycle, F.pmod("position", F.lit(len(weights))).cast("int")).alias("weight")),
        "mix-weights",
    )
    total = (weighted.agg(F.sum("source_size")).first()[0] or 0) * share
    full = F.col("source_size") * most
    factor = None
    while True:
        # With each round more sources are full, and the factor of the others grows.
        above = F.lit(False) if factor is None else full <= F.col("weight") * F.lit(factor)
        filled, open_weight = weighted.agg(
            F.coalesce(F.sum(F.when(above, full)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))
        ).first()
        if not open_weight:
            break
        previous, factor = factor, float(total - filled) / float(open_weight)
        if factor == previous:
            break
    target = full.cast("double")
    if factor is not None:
        target = F.when(full <= F.col("weight") * F.lit(factor), target).otherwise(F.lit(factor) * F.col("weight"))
    return stored(weighted.select("source", "source_size", target.alias("target")), "mix-targets")


def _positions(sizes: DataFrame) -> DataFrame:
    """``position`` of each source by code point, null last, without a global sort in one task."""
    spark = sizes.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").isNull(), F.col("source")]
    ranged = stored(
        sizes.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "mix-ranges"
    )
    # One row per range; strings compare by their UTF-8 bytes, which is by code point.
    before = ranged.groupBy("range").count().select(
        "range", (F.sum("count").over(Window.orderBy("range")) - F.col("count")).alias("before")
    )
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    return ranged.withColumn("inside", inside).join(before, "range").withColumn("position", F.col("inside") + F.col("before"))


def _thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, copies, threshold``: how often a source is taken whole, and below which hash once more."""
    times = F.floor(F.col("target") / F.col("source_size")).cast("long")
    plan = targets.select(
        "source",
        F.when(F.col("source_size") > 0, times).otherwise(0).alias("copies"),
        F.when(F.col("source_size") > 0, F.col("target") - times * F.col("source_size")).otherwise(0.0).alias("budget"),
    )
    edges = stored(
        plan.filter("budget > 0").select("source", "budget", F.lit(0).cast("long").alias("floor")), "mix-edges"
    )
    inside, found = rows, []
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        width = 1 << (HASH_BITS - level * LEVEL_BITS)
        bucket = F.expr(f"hash div {width}L") * F.lit(width)
        same = F.col("r.source").eqNullSafe(F.col("e.source"))
        inside = inside.alias("r").join(lookup(edges).alias("e"), same).select("r.source", "size", "hash", "budget")
        sums = inside.groupBy("source", bucket.alias("floor")).agg(
            F.sum("size").alias("words"), F.min("hash").alias("low"), F.max("hash").alias("high"), F.first("budget").alias("budget")
        )
        by_bucket = Window.partitionBy("source").orderBy("floor")
        # At most 4096 rows a source: the first bucket whose sum reaches the budget.
        edges = stored(
            sums.withColumn("reached", F.sum("words").over(by_bucket))
            .filter("reached >= budget AND reached - words < budget")
            .withColumn("rest", F.col("budget") - (F.col("reached") - F.col("words"))),
            "mix-edges",
        )
        if level * LEVEL_BITS < HASH_BITS:
            one = F.col("low") == F.col("high")
        else:
            one = F.lit(True)
        # A single hash goes in if that brings the sum nearer to the budget than leaving it out.
        found.append(
            edges.filter(one).select(
                "source", (F.col("low") + F.when(F.col("rest") * 2 >= F.col("words"), 1).otherwise(0)).alias("threshold")
            )
        )
        edges = stored(edges.filter(~one).select("source", F.col("rest").alias("budget"), "floor"), "mix-edges")
        if edges.isEmpty():
            break
        same = F.col("r.source").eqNullSafe(F.col("e.source"))
        inside = stored(
            rows.alias("r")
            .join(lookup(edges.drop("budget")).alias("e"), same)
            .filter((F.col("hash") >= F.col("floor")) & (F.col("hash") < F.col("floor") + F.lit(width)))
            .select("r.source", "size", "hash"),
            "mix-inside",
        )
        rows = inside
    cuts = found[0]
    for part in found[1:]:
        cuts = cuts.unionByName(part)
    same = F.col("p.source").eqNullSafe(F.col("c.source"))
    return (
        plan.alias("p")
        .join(cuts.alias("c"), same, "left")
        .select("p.source", "copies", F.coalesce("threshold", F.lit(0).cast("long")).alias("threshold"))
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1,
    most: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: bool = False,
) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target, taken, times`` (and ``doc``).

    ``size`` is the number of words (a null text has none), ``target`` that of the row's source:
    its share by weight of ``share`` times all words, at most ``most`` times what it has.
    ``times`` is how often the mix takes the document, ``taken`` the words so taken. Each
    source comes as near to its target as whole documents in the order of their hashes
    allow. Rows alike in id and text are taken alike. Sources without words have target
    0; an empty table gives an empty result. Reruns agree on any partitioning.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(text_col).alias("size"),
        row_hash(id_col, text_col).alias("hash"),
        *doc_column(carry),
    )
    # Sizes and hashes follow from a row alone: carried documents are read again, not stored.
    narrow = stored(rows.drop("doc"), "mix-rows")
    rows = rows if carry else narrow
    sizes = stored(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sizes")
    targets = source_targets(sizes, weights, share, most)
    cuts = _thresholds(narrow.select("source", "size", "hash"), targets)
    same = F.col("t.source").eqNullSafe(F.col("c.source"))
    plan = stored(
        targets.alias("t").join(cuts.alias("c"), same).select("t.*", "copies", "threshold"), "mix-plan"
    )
    same = F.col("r.source").eqNullSafe(F.col("p.source"))
    return (
        rows.alias("r")
        .join(lookup(plan).alias("p"), same)
        .withColumn("times", F.col("copies") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0))
        .select(
            "doc_id",
            F.col("r.source").alias("source"),
            "size",
            "source_size",
            "target",
            (F.col("size") * F.col("times")).alias("taken"),
            "times",
            *(["doc"] if carry else []),
        )
    )
