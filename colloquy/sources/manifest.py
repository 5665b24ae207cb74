"""Manifest-described releases: parse, guard, resolve, scan."""

from __future__ import annotations

import posixpath
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions import jsontext, policy
from colloquy.schemas import DPO_REQUIRED, DPO_ROW, SFT_ROW
from colloquy.sources.conform import conform
from colloquy.sources.storage import hadoop_uri

CONSTRUCTION_KEYS = (
    "target_mode",
    "token_budget",
    "context_overhead_tokens",
    "split_seed",
    "eval_percent",
)
STATS_KEYS = ("train_rows", "eval_rows", "total_rows")
CACHE_MODES = ("reuse", "refresh")


def read_manifest(spark: SparkSession, uri: str) -> DataFrame:
    """One row: ``manifest_uri``, ``manifest_sha256`` and the parsed ``manifest``.

    Text that is not a JSON object makes the row fail when it is read.
    """
    raw = spark.read.text(hadoop_uri(uri), wholetext=True)
    return parse_manifest(raw.withColumn("manifest_uri", F.lit(uri)), "value")


def parse_manifest(texts: DataFrame, text: str) -> DataFrame:
    """Replace the text column by its digest and the parsed object."""
    others = [name for name in texts.columns if name != text]
    parsed = texts.select(
        *others,
        F.sha2(text, 256).alias("manifest_sha256"),
        jsontext.strict_json(F.col(text)).alias("manifest"),
    )
    checked = F.when(jsontext.is_object(F.col("manifest")), F.col("manifest")).otherwise(
        F.raise_error(F.lit("manifest must be a JSON object")).cast("variant")
    )
    return parsed.withColumn("manifest", checked)


def expected_digest_matches(expected: Column, actual: Column) -> Column:
    """Digests equal after trimming and lower-casing; no expectation always matches."""
    wanted = F.lower(F.trim(F.coalesce(expected, F.lit(""))))
    return F.coalesce(expected == "", F.lit(True)) | (wanted == F.lower(F.trim(actual)))


def check_digest(manifest: DataFrame, expected: str | None) -> None:
    """Fail on a digest mismatch, before any split file is opened."""
    if not expected:
        return
    row = manifest.select(
        "manifest_sha256",
        expected_digest_matches(F.lit(expected), F.col("manifest_sha256")).alias("ok"),
    ).first()
    if not row["ok"]:
        raise ValueError(
            f"manifest digest mismatch: expected={expected.strip().lower()} "
            f"actual={row['manifest_sha256']}"
        )


def resolve_uri(base: Column, key: Column) -> Column:
    """Absolute keys stay; keys of object-store manifests are bucket keys; else relative."""
    bucket = F.regexp_extract(base, r"\As3a?://([^/]*)", 1)
    folder = F.regexp_replace(base, r"[^/]*\z", "")
    return (
        F.when(F.contains(key, F.lit("://")), key)
        .when(
            base.rlike(r"\As3a?://"),
            F.concat(F.lit("s3://"), bucket, F.lit("/"), F.ltrim(key, F.lit("/"))),
        )
        .when(key.startswith("/"), key)
        .otherwise(F.concat(folder, key))
    )


def split_files(manifest: DataFrame) -> DataFrame:
    """Usable split entries in manifest order: ``file_pos, split, key, uri``.

    An entry is usable if it is an object with text ``split`` and text ``key``.
    """
    entries = F.try_variant_get("manifest", "$.splits", "array<variant>")
    listed = manifest.select(
        "manifest_uri", F.posexplode(entries).alias("file_pos", "_entry")
    )

    def text_at(path: str) -> Column:
        value = F.try_variant_get("_entry", path, "variant")
        return F.when(jsontext.is_string(value), F.try_variant_get("_entry", path, "string"))

    named = listed.select(
        "manifest_uri", "file_pos", text_at("$.split").alias("split"), text_at("$.key").alias("key")
    ).where(F.col("split").isNotNull() & F.col("key").isNotNull())
    return named.withColumn("uri", resolve_uri(F.col("manifest_uri"), F.col("key")))


def _normal(uri: str) -> str:
    """Address without scheme variants and ``.`` or ``..`` parts."""
    for scheme in ("s3a://", "s3n://", "s3://"):
        if uri.startswith(scheme):
            return "s3://" + uri[len(scheme) :]
    if uri.startswith("file:"):
        uri = "/" + uri[len("file:") :].lstrip("/")
    return uri if "://" in uri else posixpath.abspath(uri)


def _tables(spark: SparkSession, uris: Sequence[str]) -> list[DataFrame]:
    """The files as tables that lose no column: one if their types agree, else one per schema.

    Spark compares the footers in a job. Only where types contradict each other are
    the files told apart by their schemas.
    """

    def read(group: Sequence[str]) -> DataFrame:
        return spark.read.option("mergeSchema", "true").parquet(*[hadoop_uri(u) for u in group])

    try:
        return [read(uris)]
    except Py4JJavaError as conflict:
        if "CANNOT_MERGE_SCHEMAS" not in str(conflict.java_exception):
            raise
    groups: dict[str, list[str]] = {}
    for uri in uris:
        groups.setdefault(spark.read.parquet(hadoop_uri(uri)).schema.json(), []).append(uri)
    return [read(group) for group in groups.values()]


def _union(tables: Sequence[DataFrame], schema: T.StructType | None) -> DataFrame:
    """The tables as one, each brought to the schema first; other columns follow by name."""
    if schema is not None:
        tables = [conform(part, schema) for part in tables]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def rows_per_file(spark: SparkSession, uris: Sequence[str]) -> dict[str, int]:
    """Row counts by normalized address, from file footers only."""
    counts = (
        spark.read.parquet(*[hadoop_uri(u) for u in uris])
        .groupBy(F.col("_metadata.file_path").alias("path"))
        .agg(F.count("*").alias("rows"))
        .collect()  # one row per listed file, and the list is a manifest's
    )
    return {_normal(unquote(row["path"])): row["rows"] for row in counts}


def split_tables(
    spark: SparkSession, uris: Sequence[str], limit: int | None = None
) -> list[DataFrame]:
    """Tables of the files; with a limit, of the first rows in manifest and file order.

    A limit is a choice of files: those that fit whole, and the head of the next one.
    No other file is read, and nothing is sorted.
    """
    if not uris:
        raise ValueError("no split files")
    if limit is None:
        return _tables(spark, uris)
    counts = rows_per_file(spark, uris)
    whole, left = [], limit
    for uri in uris:
        rows = counts.get(_normal(uri), 0)
        if rows > left:
            heads = [t.where(F.col("_metadata.row_index") < left) for t in _tables(spark, [uri])]
            return (_tables(spark, whole) if whole else []) + heads
        whole.append(uri)
        left -= rows
    return _tables(spark, uris)


def scan_split(
    spark: SparkSession,
    uris: Sequence[str],
    limit: int | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Rows of the files, all or the first ones, with every column that any file has.

    Files of contradicting types need a schema to agree on.
    """
    return _union(split_tables(spark, uris, limit), schema)


def with_file_order(
    spark: SparkSession, uris: Sequence[str], schema: T.StructType | None = None
) -> DataFrame:
    """Rows of the files with their order: ``file_pos`` in the list and ``row_index``."""
    listed = spark.createDataFrame(
        [(_normal(uri), position) for position, uri in enumerate(uris)],
        "_path string, file_pos long",
    )
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    path = F.regexp_replace(path, r"\Afile:/+", "/")
    path = F.regexp_replace(path, r"\As3[an]?://", "s3://")
    placed = ("*", path.alias("_path"), F.col("_metadata.row_index").alias("row_index"))
    rows = _union([part.select(*placed) for part in _tables(spark, uris)], schema)
    unlisted = F.raise_error(F.concat(F.lit("file is not in the list: "), F.col("_path")))
    return (
        rows.join(listed, "_path", "left")
        .withColumn("file_pos", F.coalesce(F.col("file_pos"), unlisted.cast("long")))
        .drop("_path")
    )


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def check_columns(df: DataFrame, split: str, required: Sequence[str] = DPO_REQUIRED) -> None:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing required preference columns in split {split}: {missing}")


@dataclass(frozen=True)
class Release:
    """Both splits as one table with a ``split`` column, and the one-row manifest."""

    rows: DataFrame
    manifest: DataFrame

    def split(self, name: str) -> DataFrame:
        return self.rows.where(F.col("split") == name)

    def lineage(self) -> DataFrame:
        return self.manifest.select("manifest_uri", "manifest_sha256")


def _load(
    spark: SparkSession,
    uri: str,
    schema: T.StructType,
    required: Sequence[str],
    train_split: str,
    eval_split: str,
    max_train_samples: int | None,
    max_eval_samples: int | None,
    cache_mode: str,
    expected_sha256: str | None,
) -> Release:
    if cache_mode not in CACHE_MODES:
        raise ValueError(f"cache_mode must be one of {CACHE_MODES}")
    if cache_mode == "refresh":
        spark.catalog.refreshByPath(hadoop_uri(uri))
    manifest = read_manifest(spark, uri)
    check_digest(manifest, expected_sha256)
    names = [train_split, eval_split]
    files = split_files(manifest).where(F.col("split").isin(names)).orderBy("file_pos")
    # File names only, as the manifest lists them; needed to plan the scan.
    listed = [(row["split"], row["uri"]) for row in files.select("split", "uri").collect()]
    parts = []
    for name, limit in zip(names, (max_train_samples, max_eval_samples), strict=True):
        uris = [u for split, u in listed if split == name]
        if not uris:
            raise ValueError(f"no files in manifest split {name!r}")
        if cache_mode == "refresh":
            for folder in sorted({posixpath.dirname(u) for u in uris}):
                spark.catalog.refreshByPath(hadoop_uri(folder))
        tables = split_tables(spark, uris, limit)
        for part in tables if required else ():
            check_columns(part, name, required)
        parts.append(_union(tables, schema).withColumn("split", F.lit(name)))
    rows = parts[0].unionByName(parts[1], allowMissingColumns=True)
    return Release(rows=rows, manifest=manifest)


def load_sft_release(
    spark: SparkSession,
    uri: str,
    *,
    train_split: str = "train",
    eval_split: str = "eval",
    max_train_samples: int | None = None,
    max_eval_samples: int | None = None,
    cache_mode: str = "reuse",
    expected_sha256: str | None = None,
) -> Release:
    return _load(
        spark, uri, SFT_ROW, (), train_split, eval_split,
        max_train_samples, max_eval_samples, cache_mode, expected_sha256,
    )


def load_dpo_release(
    spark: SparkSession,
    uri: str,
    *,
    train_split: str = "train",
    eval_split: str = "eval",
    max_train_samples: int | None = None,
    max_eval_samples: int | None = None,
    cache_mode: str = "reuse",
    expected_sha256: str | None = None,
) -> Release:
    return _load(
        spark, uri, DPO_ROW, DPO_REQUIRED, train_split, eval_split,
        max_train_samples, max_eval_samples, cache_mode, expected_sha256,
    )


def policy_summary(manifest: DataFrame) -> DataFrame:
    """Governance summary row of the manifest."""
    governance = F.try_variant_get("manifest", "$.governance", "variant")
    columns = policy.summary(governance)
    return manifest.select(
        "manifest_uri", *[column.alias(name) for name, column in columns.items()]
    )
