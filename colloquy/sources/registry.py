"""Named datasets: where a dataset lies, its splits, and how its rows are formatted."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import formatters
from colloquy.operators.splits import concat_subsets, resolve_splits

Formatter = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class NamedDataset:
    """``subsets`` maps to folders below the dataset's; files carry a ``split`` column."""

    keys: tuple[str, ...]
    splits: tuple[str, ...] | None = None
    subsets: tuple[str, ...] = ()
    split_aliases: Mapping[str, str] | None = None
    formatter: Formatter | None = None


# Datasets with their splits, subsets and formatters.
REGISTRY: dict[str, NamedDataset] = {
    "timdettmers/openassistant-guanaco": NamedDataset(
        keys=("text",), splits=("train", "test"), subsets=("default",)
    ),
    "rajpurkar/squad_v2": NamedDataset(
        keys=("id",),
        splits=("train", "validation"),
        subsets=("squad_v2",),
        formatter=formatters.context_question,
    ),
    "Open-Orca/SlimOrca": NamedDataset(
        keys=("conversations",),
        splits=("train",),
        subsets=("default",),
        formatter=formatters.shared_conversation,
    ),
    "facebook/belebele": NamedDataset(
        keys=("link", "question_number", "dialect"),
        splits=tuple(formatters.LANGUAGE_NAMES),
        subsets=("default",),
        formatter=formatters.passage_choice,
    ),
    "allenai/ai2_arc": NamedDataset(
        keys=("id",),
        splits=("train", "validation", "test"),
        subsets=("ARC-Challenge", "ARC-Easy"),
        formatter=formatters.multiple_choice,
    ),
    "Intel/orca_dpo_pairs": NamedDataset(
        keys=("question", "chosen", "rejected"),
        splits=("train",),
        subsets=("default",),
        formatter=formatters.preference_pair,
    ),
    "allenai/ultrafeedback_binarized_cleaned": NamedDataset(
        keys=("prompt_id",),
        split_aliases={"train": "train_prefs", "test": "test_prefs"},
        subsets=("default",),
        formatter=formatters.preference_messages,
    ),
    "openai/gsm8k": NamedDataset(
        keys=("question",),
        splits=("train", "test"),
        subsets=("default",),
        formatter=formatters.reward_prompt,
    ),
}


def format_splits(df: DataFrame, formatter: Formatter | None) -> DataFrame:
    """Apply a formatter to each split; its output replaces the columns."""
    if formatter is None:
        return df
    parts = [
        formatter(df.where(F.col("split") == name)).withColumn("split", F.lit(name))
        for name in ("train", "test")
    ]
    return parts[0].unionByName(parts[1])


def prepare(df: DataFrame, dataset: NamedDataset) -> DataFrame:
    """Resolve train and test rows of loaded subsets, then format them."""
    labeled = resolve_splits(
        df, dataset.splits, dataset.keys, aliases=dataset.split_aliases
    )
    return format_splits(labeled, dataset.formatter)


def load_named(
    spark: SparkSession,
    name: str,
    root: str,
    registry: Mapping[str, NamedDataset] = REGISTRY,
    formats: Sequence[str] = ("parquet",),
) -> DataFrame:
    """Load a local export of a registered dataset: ``root/name/subset``."""
    dataset = registry[name]
    base = f"{root.rstrip('/')}/{name.replace('/', '_')}"
    read = spark.read.format(formats[0])
    if dataset.subsets:
        df = concat_subsets({s: read.load(f"{base}/{s}") for s in dataset.subsets})
    else:
        df = read.load(base)
    return prepare(df, dataset)
