"""Groups of similar texts: exact Jaccard similarity of word shingles, links as few as connect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.session import scratch_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _written(df: DataFrame, purpose: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shingle_set(text: Column, width: int) -> Column:
    """Digests of the distinct shingles of ``width`` words, sorted; all words as one if they are fewer."""
    folded = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    # A filter over one item binds the words, which are then split once only.
    words = F.filter(F.split(folded, r"[\x20\x09-\x0D]+"), lambda word: word != "")

    def shingles(found: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(found) - width + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(found, i, width), " ")))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.array(words), shingles))))


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of the nodes of ``a, b``: the smallest node that each reaches.

    Labels spread along links and jump to the label of their label, until none changes; the number of
    rounds follows the logarithm of the longest chain. Every round aggregates before it shuffles.
    """
    both = _written(links.select("a", "b").union(links.select("b", "a")).distinct(), "similar-links")
    labels = _written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "similar-labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        spread = labels.join(near, labels.node == near.a, "left").select(
            "node", F.col("root").alias("before"), F.least("root", "near").alias("root")
        )
        spread = _written(spread, "similar-labels")
        above = spread.select(F.col("node").alias("up"), F.col("root").alias("top"))
        jumped = spread.join(above, F.col("root") == F.col("up"), "left").select(
            "node", "before", F.least("root", F.coalesce("top", "root")).alias("root")
        )
        jumped = _written(jumped, "similar-labels")
        labels = jumped.select("node", "root")
        if jumped.filter("before <> root").isEmpty():
            return labels


def similar_groups(texts: DataFrame, key: str, text: str, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``key, group, group_size`` of every text; texts of ``similarity`` or more are linked, directly or by others.

    ``group`` is the smallest key in reach. Texts with equal sets of shingles are one from the start, however
    many they are. Two sets of that similarity share one of their rarest shingles (as many as
    may be missing, and one more), so sets meet only there, which loses no pair. Where sets meet, each
    is compared with the smallest, and what these links leave apart is then compared across: the
    members of all but the largest part with everything outside their own part. Links are linear where
    texts are copies of each other. Null and empty texts are alike. ``key`` must be unique and not null.
    """
    rows = _written(
        texts.select(F.col(key).alias("key"), shingle_set(F.col(text), width).alias("shingles")).withColumn(
            "kind", F.sha2(F.array_join("shingles", ","), 256)
        ),
        "similar-rows",
    )
    members = rows.select("kind", "key")
    kinds = _written(
        rows.groupBy("kind").agg(F.min("key").alias("least"), F.first("shingles").alias("shingles")), "similar-kinds"
    )
    size = F.size("shingles")
    # How many shingles two sets may not share, and one: of these the rarest are looked at.
    part = size - F.ceil(size * F.lit(similarity) - F.lit(1e-9)).cast("int") + 1
    single = kinds.select("kind", size.alias("size"), part.alias("part"), F.explode("shingles").alias("shingle"))
    counts = single.groupBy("shingle").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("n", "shingle"))
    meeting = single.join(counts.filter("n > 1"), "shingle", "left").withColumn("n", F.coalesce("n", F.lit(1).cast("long")))
    meeting = meeting.withColumn("rank", rank).filter("rank <= part AND n > 1").select("shingle", "kind", "size")
    meeting = _written(meeting, "similar-meeting")

    sets = kinds.select("kind", "shingles")

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs of kinds that are similar enough, as ``a, b``."""
        left, right = (sets.select(F.col("kind").alias(end), F.col("shingles").alias(f"{end}_set")) for end in "ab")
        both = pairs.distinct().join(left, "a").join(right, "b")
        shared = F.size(F.array_intersect("a_set", "b_set"))
        union = F.size("a_set") + F.size("b_set") - shared
        return both.filter(shared >= F.lit(similarity) * union - F.lit(1e-9)).select("a", "b")

    fits = (F.col("a_size") >= F.lit(similarity) * F.col("b_size") - 1e-9) & (F.col("b_size") >= F.lit(similarity) * F.col("a_size") - 1e-9)
    middle = meeting.groupBy("shingle").agg(F.min(F.struct("kind", "size")).alias("first"))
    stars = meeting.join(middle, "shingle").select(
        F.col("kind").alias("a"), F.col("size").alias("a_size"), F.col("first.kind").alias("b"), F.col("first.size").alias("b_size")
    )
    links = _written(verified(stars.filter("a <> b").filter(fits).select("a", "b")), "similar-stars")
    parts = components(links)
    placed = meeting.join(parts, F.col("kind") == F.col("node"), "left").select(
        "shingle", "kind", "size", F.coalesce("root", "kind").alias("component")
    )
    placed = _written(placed, "similar-placed")
    by_part = placed.groupBy("shingle", "component").agg(F.count("*").alias("many"))
    largest = by_part.groupBy("shingle").agg(F.max(F.struct("many", "component")).alias("most"), F.count("*").alias("apart")).filter("apart > 1")
    left = placed.join(largest, "shingle").filter(F.col("component") != F.col("most.component"))
    left = left.select("shingle", F.col("kind").alias("a"), F.col("size").alias("a_size"), F.col("component").alias("a_part"))
    right = placed.select("shingle", F.col("kind").alias("b"), F.col("size").alias("b_size"), F.col("component").alias("b_part"))
    across = left.join(right, "shingle").filter("a_part <> b_part").filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = _written(links.unionByName(verified(across)), "similar-all")
    roots = components(links)
    joined = members.join(roots, F.col("kind") == F.col("node"), "left").select("key", F.coalesce("root", "kind").alias("root"))
    joined = _written(joined, "similar-joined")
    groups = joined.groupBy("root").agg(F.min("key").alias("group"), F.count("*").alias("group_size"))
    return joined.join(groups, "root").select("key", "group", "group_size")

