"""Prompt lists: a JSON array of strings in one file."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import jsontext
from colloquy.sources.storage import exists, hadoop_uri, write_text


def parse_prompts(text: Column) -> Column:
    """The strings of a JSON array; text of any other form gives an empty list."""
    items = F.try_variant_get(jsontext.strict_json(text), "$", "array<string>")
    return F.coalesce(items, F.array().cast("array<string>"))


def load_prompts(spark: SparkSession, uri: str) -> DataFrame:
    """``position, prompt`` rows; a missing or unparseable file gives none."""
    if not exists(spark, uri):
        return spark.createDataFrame([], "position int, prompt string")
    raw = spark.read.text(hadoop_uri(uri), wholetext=True)
    return raw.select(F.posexplode(parse_prompts(F.col("value"))).alias("position", "prompt"))


def save_prompts(spark: SparkSession, uri: str, prompts: Sequence[str]) -> None:
    write_text(spark, uri, json.dumps(list(prompts), indent=4))
