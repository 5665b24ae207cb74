"""Release sink: partitioned Parquet plus the manifest that describes it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.sources.releases_format import MANIFEST, register


def split_row_counts(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows per split and, with a null split, in total."""
    return df.rollup(split).agg(F.count("*").alias("rows"))


def release_folder(root: str, dataset_id: str, dataset_version: str) -> str:
    return f"{root.rstrip('/')}/dataset_id={dataset_id}/dataset_version={dataset_version}"


def write_release(
    df: DataFrame,
    root: str,
    dataset_id: str,
    dataset_version: str,
    *,
    construction: dict | None = None,
    policy_class: str | None = None,
    split: str = "split",
) -> str:
    """Write the rows by split and, once all tasks have finished, the manifest; return its URI.

    A version is written once: an existing manifest is an error. The manifest is made of what the
    tasks say they wrote, so nothing is read back, and a folder without one is no release.
    """
    spark: SparkSession = df.sparkSession
    register(spark)
    folder = release_folder(root, dataset_id, dataset_version)
    # Keys of object stores are bucket keys; elsewhere they are relative to the manifest.
    stored = root.startswith(("s3://", "s3a://"))
    options = {
        "dataset_id": dataset_id,
        "dataset_version": dataset_version,
        "construction": json.dumps(construction or {}),
        "split_column": split,
        "key_root": folder.split("://", 1)[1].split("/", 1)[1] + "/" if stored else "",
    }
    if policy_class:
        options["policy_class"] = policy_class
    df.write.format("release").mode("append").options(**options).save(folder)
    return f"{folder}/{MANIFEST}"
