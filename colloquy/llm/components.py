"""Connected components of an edge table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import lookup, stored


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges`` (``a, b``); the root is the smallest node reachable.

    Each round links the larger neighbours of a node to the smallest (large star), then all
    smaller ones to it (small star), and ends when the edges are stars. The number of
    rounds follows the logarithm of the largest component. Every round is aggregates that
    combine before their shuffle and joins of written tables.
    """
    links = stored(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "components",
    )
    mark = None
    while mark != (mark := _fingerprint(links)):
        # Large star: every node links its larger neighbours to its smallest neighbour or itself.
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("least")), "components")
        large = stored(
            both.filter("b > a")
            .join(lookup(least), "a")
            .select(F.col("b").alias("a"), F.col("least").alias("b"))
            .filter("a > b")
            .distinct(),
            "components",
        )
        # Small star: every node links its smaller neighbours and itself to the smallest.
        least = stored(large.groupBy("a").agg(F.min("b").alias("least")), "components")
        links = stored(
            large.join(lookup(least), "a")
            .select(F.col("b").alias("a"), F.col("least").alias("b"))
            .unionByName(least.select("a", F.col("least").alias("b")))
            .filter("a > b")
            .distinct(),
            "components",
        )
    roots = links.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _fingerprint(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod("b", F.lit(1 << 20)))).first())
