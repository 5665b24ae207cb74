"""Exact row positions without a global sort.

Pages, caps, multiples and samples need no position of every row, only the order value
at which they begin and end. ``before`` finds it by nested histograms: counts by range,
and again inside the one range that holds the position, until that is small. What remains is a
filter on each row; no payload is shuffled, and gaps or crowds among the values cost further
rounds but never a large range in one task.

Batches number every row: ``rows in earlier buckets + rank inside the bucket``. Their buckets
are digest prefixes, which are uniform; the prefix sum runs over a table of fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_BUCKETS = 1 << 16
PAGE_EVAL_ROWS = 100
_HASH_DIGITS = 4  # 16 ** 4 == MAX_BUCKETS


def seeded_key(seed: int, *keys: str) -> Column:
    """Hex digest that orders rows pseudo-randomly but reproducibly."""
    parts = [F.col(key).cast("string") for key in keys]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def seeded_bucket(seed: int, buckets: int, *keys: str) -> Column:
    """Uniform bucket number in ``[0, buckets)`` from the first 32 digest bits."""
    head = F.substring(seeded_key(seed, *keys), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") % buckets


def _offsets(df: DataFrame, bucket: str) -> DataFrame:
    """Rows before each bucket, and the total. At most ``MAX_BUCKETS`` rows."""
    counts = df.groupBy(bucket).agg(F.count("*").alias("n"))
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        bucket,
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("n").over(Window.partitionBy()).alias("_rows_total"),
    )


def _ranked(df: DataFrame, order: list[str], ordinal: str, total: str, bucket: str | None = None) -> DataFrame:
    offsets = F.broadcast(_offsets(df.select("_bucket"), "_bucket"))
    inside = Window.partitionBy("_bucket").orderBy(*order)
    return (
        df.join(offsets, "_bucket")
        .withColumn(ordinal, F.col("_rows_before") + F.row_number().over(inside) - 1)
        .withColumnRenamed("_rows_total", total)
        .withColumnRenamed("_bucket", bucket or "_bucket")
        .drop("_rows_before", *([] if bucket else ["_bucket"]))
    )


def with_shuffled_ordinal(
    df: DataFrame,
    keys: list[str],
    seed: int = 42,
    *,
    ordinal: str = "ordinal",
    total: str = "n_rows",
    bucket: str | None = None,
    ties: list[str] | None = None,
) -> DataFrame:
    """Zero-based position in the seeded order of the unique key, and the row count.

    Buckets are digest prefixes: uniform whatever the key distribution is. With a name in
    ``bucket`` their numbers stay as a column, by which the rows are partitioned. ``ties`` order rows of the same key.
    """
    hashed = df.withColumn("_digest", seeded_key(seed, *keys)).withColumn(
        "_bucket", F.conv(F.substring("_digest", 1, _HASH_DIGITS), 16, 10).cast("int")
    )
    return _ranked(hashed, ["_digest", *keys, *(ties or [])], ordinal, total, bucket).drop("_digest")


def before(df: DataFrame, position: int, order: Column, coarse: Column | None = None) -> Column:
    """A condition that the rows before a position in the order of unique values fulfil.

    ``coarse`` is an integer that follows the order, by default the order value itself.
    Rows without one have no position. Reads that column alone, in a few aggregates.
    """
    rows = df.select((order if coarse is None else coarse).alias("_c"), order.alias("_o"))
    low, high, total = rows.agg(F.min("_c"), F.max("_c"), F.count("_c")).first()
    if position <= 0 or not total:
        return F.lit(False)
    if position >= total:
        return order.isNotNull()
    earlier = 0
    while True:
        width = -(-(high - low + 1) // MAX_BUCKETS)
        inside = rows.where(F.col("_c").between(low, high))
        counts = inside.groupBy(F.expr(f"(_c - {low}L) div {width}L").alias("_bucket")).agg(
            F.count("*").alias("n")
        )
        reached = F.sum("n").over(Window.orderBy("_bucket")) + earlier
        bucket, n, reached = (
            counts.withColumn("reached", reached)
            .where(F.col("reached") > position)
            .orderBy("_bucket")
            .first()
        )
        earlier = reached - n
        low = low + bucket * width
        high = min(high, low + width - 1)
        if n <= MAX_BUCKETS or width == 1:
            break
    edge = rows.where(F.col("_c").between(low, high)).orderBy("_o")
    return order < F.lit(edge.offset(position - earlier).first()["_o"])


def before_in_seeded_order(df: DataFrame, position: int, keys: list[str], seed: int = 42) -> Column:
    """As ``before``, in the seeded order of unique keys."""
    digest = seeded_key(seed, *keys)
    return before(df, position, digest, F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"))


def first_rows(df: DataFrame, key: str, limit: int | None) -> DataFrame:
    """The first ``limit`` rows in the order of a unique integer key; all without a limit."""
    return df if limit is None else df.where(before(df, limit, F.col(key)))


def multiple_of(df: DataFrame, key: str, k: int) -> DataFrame:
    """Drop the rest rows beyond the largest multiple of ``k``, in the order of the key."""
    return df.where(before(df, df.count() // k * k, F.col(key)))


def page(df: DataFrame, key: str, index: int, max_rows: int) -> DataFrame:
    """Page ``index`` of ``max_rows`` rows with their positions, the next index and the page count.

    A table of fewer than ``max_rows`` rows is one page; next index and page count
    are 0 then.
    """
    n = df.count()
    fits = n < max_rows
    start = 0 if fits else index * max_rows
    rows = df.where(~before(df, start, F.col(key)) & before(df, start + max_rows, F.col(key)))
    place = F.row_number().over(Window.orderBy(key)) - 1 + start  # a page of rows
    return rows.select(
        "*",
        place.cast("bigint").alias("ordinal"),
        F.lit(0 if fits else index + 1).cast("bigint").alias("next_index"),
        F.lit(0.0 if fits else n / max_rows + 1).alias("page_count"),
    )


def eval_sample_size(max_rows: int) -> int:
    return max(500, int(0.2 * max_rows))


def page_eval(df: DataFrame, keys: list[str], max_rows: int, seed: int = 42) -> DataFrame:
    """Evaluation rows that go with a page: all of a small table, else a fixed number in seeded order."""
    small = df.limit(eval_sample_size(max_rows)).count() < eval_sample_size(max_rows)
    return df if small else sample_train(df, keys, PAGE_EVAL_ROWS, seed)


def sample_train(df: DataFrame, keys: list[str], max_rows: int, seed: int = 42) -> DataFrame:
    """All rows if there are fewer than ``max_rows``, else that many in seeded order."""
    return df.where(before_in_seeded_order(df, max_rows, keys, seed))


def sample_eval(df: DataFrame, keys: list[str], max_rows: int, seed: int = 42) -> DataFrame:
    """Seeded evaluation sample sized from the training limit."""
    return sample_train(df, keys, eval_sample_size(max_rows), seed)
