"""Positions of rows inside groups, by a range sort instead of one window a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import lookup, stored


def positions(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """The stored ``rows`` with ``position`` (from 0) by ``order`` in their ``group``, and its size as ``total``.

    ``group`` must not be null, and ``order`` should leave no ties. Ranges are cut through groups, so one
    group with most of the rows is as many tasks as any other share of them. Only the numbers of rows
    by group and range meet in a window, at most as many for a group as there are ranges.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group).asc(), *order]
    ranged = stored(
        rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()),
        "ranks-rows",
    )
    # The upper bits of a place are the range, the lower ones count on inside it.
    part = F.shiftright("place", 33)
    spans = ranged.groupBy(F.col(group).alias("of"), part.alias("part")).agg(F.count("*").alias("n"), F.min("place").alias("first"))
    by_part = Window.partitionBy("of").orderBy("part")
    spans = stored(
        spans.select(
            "of",
            "part",
            (F.sum("n").over(by_part) - F.col("n") - F.col("first")).alias("shift"),
            F.sum("n").over(Window.partitionBy("of")).alias("total"),
        ),
        "ranks-spans",
    )
    found = ranged.join(lookup(spans), (F.col(group) == F.col("of")) & (part == F.col("part")))
    return found.withColumn("position", F.col("place") + F.col("shift")).drop("of", "part", "shift", "place")
