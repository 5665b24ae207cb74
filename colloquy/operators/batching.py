"""Padded batches and the weighted token-loss reduction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.tokens import IGNORED_LABEL
from colloquy.operators.ordering import with_shuffled_ordinal


def assign_batches(
    tokenized: DataFrame, keys: list[str], batch_size: int, seed: int = 42
) -> DataFrame:
    """Number rows in seeded order and cut that order into batches."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    ranked = with_shuffled_ordinal(tokenized, keys, seed)
    return ranked.withColumn("batch_id", F.floor(F.col("ordinal") / batch_size)).drop("n_rows")


def pad_batches(
    batched: DataFrame, pad_id: int = 0, *, label_pad: int = IGNORED_LABEL
) -> DataFrame:
    """Pad every row on the right to the longest row of its batch."""
    batch = Window.partitionBy("batch_id")
    return _padded(batched.withColumn("batch_len", F.max(F.size("input_ids")).over(batch)), pad_id, label_pad)


def padded_batches(
    tokenized: DataFrame,
    keys: list[str],
    batch_size: int,
    seed: int = 42,
    pad_id: int = 0,
    *,
    label_pad: int = IGNORED_LABEL,
) -> DataFrame:
    """``assign_batches`` and ``pad_batches`` with one exchange of the token arrays.

    Rows are partitioned by digest prefix, and all but the batches at the edges of a prefix lie within one.
    The longest rows of those few come from keys and lengths alone, at most one row per prefix.
    Rows of one key are told apart by their length.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    length = F.col("n_tokens") if "n_tokens" in tokenized.columns else F.size("input_ids")
    batch = F.floor(F.col("ordinal") / batch_size)

    def numbered(rows: DataFrame) -> DataFrame:
        sized = rows.withColumn("_length", length)
        placed = with_shuffled_ordinal(sized, keys, seed, bucket="_prefix", ties=["_length"])
        return placed.withColumn("batch_id", batch).drop("n_rows")

    lengths = tokenized.select(*keys, length.alias("_length"))
    lengths = with_shuffled_ordinal(lengths, keys, seed, bucket="_prefix", ties=["_length"]).withColumn("batch_id", batch)
    inside = lengths.groupBy("_prefix", "batch_id").agg(F.max("_length").alias("_longest"))
    across = inside.groupBy("batch_id").agg(F.max("_longest").alias("_across"), F.count("*").alias("_parts"))
    # A batch in several prefixes holds the last row of one: there are no more of them than prefixes.
    edges = F.broadcast(across.where("_parts > 1").drop("_parts"))
    here = F.max("_length").over(Window.partitionBy("_prefix", "batch_id"))
    sized = numbered(tokenized).withColumn("_here", here).join(edges, "batch_id", "left")
    longest = F.coalesce("_across", "_here")
    return _padded(sized.withColumn("batch_len", longest), pad_id, label_pad).drop("_prefix", "_length", "_here", "_across")


def _padded(sized: DataFrame, pad_id: int, label_pad: int) -> DataFrame:
    missing = F.col("batch_len") - F.size("input_ids")

    def fill(name: str, value) -> dict:
        return {name: F.concat(F.col(name), F.array_repeat(F.lit(value), missing))}

    columns = {**fill("attention_mask", 0), **fill("labels", label_pad)}
    if "loss_weights" in sized.columns:
        columns.update(fill("loss_weights", 0.0))
    columns.update(fill("input_ids", pad_id))
    return sized.withColumns(columns)


def require_features(batched: DataFrame) -> DataFrame:
    """Fail on an empty input instead of returning no batch."""
    if batched.limit(1).isEmpty():
        raise ValueError("no rows to batch")
    return batched


def batch_loss(losses: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Weighted mean loss per batch; the plain sum where all weights are zero.

    Input arrays ``labels``, ``loss_weights`` and ``token_loss``; ``token_loss[i]`` is
    the loss of predicting ``labels[i + 1]`` from position ``i``. Tokens are unnested
    into the aggregate, which combines them per batch before the shuffle.
    """
    n = F.greatest(F.least(F.size("labels"), F.size("loss_weights")) - 1, F.lit(0))
    shifted = F.arrays_zip(
        F.slice("labels", F.lit(2), n).alias("label"),
        F.slice("loss_weights", F.lit(2), n).alias("weight"),
        F.slice("token_loss", F.lit(1), n).alias("loss"),
    )
    live = F.col("label") != IGNORED_LABEL
    # The outer form keeps batches without any token to predict.
    tokens = losses.select(batch, F.inline_outer(shifted))
    summed = tokens.groupBy(batch).agg(
        F.coalesce(F.sum(F.when(live, F.col("loss") * F.col("weight"))), F.lit(0.0)).alias(
            "weighted_loss"
        ),
        F.coalesce(F.sum(F.when(live, F.col("weight"))), F.lit(0.0)).alias("weight_sum"),
    )
    mean = F.when(F.col("weight_sum") > 0, F.col("weighted_loss") / F.col("weight_sum"))
    return summed.withColumn("loss", F.coalesce(mean, F.col("weighted_loss")))
