"""Train/eval splits, concatenation and split selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators.ordering import seeded_bucket


def percent_split(
    df: DataFrame, unit: str, eval_percent: float, seed: int, *, split: str = "split"
) -> DataFrame:
    """Label rows ``train`` or ``eval``; rows of one unit stay together.

    The label depends on the unit's digest only, so it is the same for any file
    layout, partitioning or retry.
    """
    bucket = seeded_bucket(seed, 10_000, unit)
    return df.withColumn(
        split, F.when(bucket < round(eval_percent * 100), "eval").otherwise("train")
    )


def holdout_split(
    df: DataFrame, keys: Sequence[str], seed: int = 42, *, test_fraction: float = 0.1
) -> DataFrame:
    """Seeded ``train`` / ``test`` label for data that comes with a single split."""
    bucket = seeded_bucket(seed, 10_000, *keys)
    return df.withColumn(
        "split", F.when(bucket < round(test_fraction * 10_000), "test").otherwise("train")
    )


def concat_splits(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def concat_subsets(subsets: Mapping[str, DataFrame]) -> DataFrame:
    return concat_splits(
        [df.withColumn("subset", F.lit(name)) for name, df in subsets.items()]
    )


def select_aliased(df: DataFrame, aliases: Mapping[str, str], split: str = "split") -> DataFrame:
    """Keep the aliased splits under their plain names."""
    label = F.lit(None).cast("string")
    for name, alias in aliases.items():
        label = F.when(F.col(split) == alias, F.lit(name)).otherwise(label)
    return df.withColumn(split, label).where(F.col(split).isNotNull())


def resolve_splits(
    df: DataFrame,
    splits: Sequence[str] | None,
    keys: Sequence[str],
    *,
    aliases: Mapping[str, str] | None = None,
    split: str = "split",
    seed: int = 42,
) -> DataFrame:
    """Label rows ``train`` or ``test`` by the rules for named, single and odd splits.

    Aliases win. One split or none is held out 90/10. With ``train`` and ``test``
    both are kept; with ``train`` only, the second listed split is the test part;
    without ``train``, every split is held out 90/10 and the parts are joined.
    """
    if aliases:
        return select_aliased(df, aliases, split)
    if splits is None:
        return holdout_split(df, keys, seed)
    if len(splits) == 1:
        return holdout_split(df.where(F.col(split) == splits[0]), keys, seed)
    if "train" in splits:
        test = "test" if "test" in splits else splits[1]
        return select_aliased(df, {"train": "train", "test": test}, split)
    return holdout_split(df.where(F.col(split).isin(list(splits))), keys, seed)
