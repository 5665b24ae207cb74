"""Comparison tables at rest: one folder per base model, one Parquet table per version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from colloquy.schemas import COMPARISON_BASE
from colloquy.sources.storage import exists, hadoop_uri, write_text

EMPTY = T.StructType([T.StructField("row_id", T.LongType()), *COMPARISON_BASE.fields])


def _folder(root: str, model: str) -> str:
    return f"{root.rstrip('/')}/{model.rstrip('/').rsplit('/', 1)[-1]}"


def load_comparison(spark: SparkSession, root: str, model: str) -> DataFrame:
    """The current version, or an empty table with the base columns."""
    pointer = f"{_folder(root, model)}/CURRENT"
    if not exists(spark, pointer):
        return spark.createDataFrame([], EMPTY)
    version = spark.read.text(hadoop_uri(pointer)).first()["value"].strip()
    return spark.read.parquet(hadoop_uri(f"{_folder(root, model)}/{version}"))


def save_comparison(table: DataFrame, root: str, model: str, version: str) -> None:
    """Write a new version, then point to it; a failed write leaves the old one."""
    folder = _folder(root, model)
    table.write.mode("errorifexists").parquet(hadoop_uri(f"{folder}/{version}"))
    write_text(table.sparkSession, f"{folder}/CURRENT", version)
