"""Lineage and fit-metric records as long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.sources.manifest import CONSTRUCTION_KEYS, STATS_KEYS
from colloquy.sources.storage import hadoop_uri


def _entry(kind: str, key: str, value: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), F.lit(key).alias("key"), value.cast("string").alias("value")
    )


def lineage_record(manifest: DataFrame) -> DataFrame:
    """``kind, key, value`` rows of a one-row manifest; absent fields are left out."""

    def at(path: str, kind: str = "string") -> Column:
        return F.try_variant_get("manifest", f"$.{path}", kind)

    entries = [
        _entry("param", "dataset_manifest_uri", F.col("manifest_uri")),
        _entry("param", "dataset_manifest_sha256", F.col("manifest_sha256")),
        _entry("param", "dataset_id", at("dataset_id")),
        _entry("param", "dataset_version", at("dataset_version")),
    ]
    entries += [
        _entry("param", f"dataset_{key}", at(f"construction.{key}")) for key in CONSTRUCTION_KEYS
    ]
    entries += [_entry("metric", key, at(f"stats.{key}", "double")) for key in STATS_KEYS]
    return manifest.select(F.inline(F.array(*entries))).where(F.col("value").isNotNull())


# Metric names of the fit record, by statistics column.
FIT_METRICS = {
    "rows_total": "rows_total_raw",
    "rows_kept": "rows_valid_before_filter",
    "rows_fit_fully": "rows_fit_fully",
    "rows_truncated": "rows_truncated",
    "rows_dropped": "rows_dropped_tokenization",
    "fit_pct": "context_fit_pct",
    "truncated_pct": "context_truncated_pct",
}


def fit_record(statistics: DataFrame, histogram: DataFrame, split: str = "split") -> DataFrame:
    """``split, metric, value`` rows: seven per split and one per drop reason."""
    pairs = F.array(
        *[
            F.struct(
                F.concat_ws("_", F.col(split), F.lit(name)).alias("metric"),
                F.col(column).cast("double").alias("value"),
            )
            for column, name in FIT_METRICS.items()
        ]
    )
    fitted = statistics.select(F.col(split).alias("split"), F.inline(pairs))
    reason = F.translate(F.col("drop_reason"), "- ", "__")
    dropped = histogram.select(
        F.col(split).alias("split"),
        F.concat_ws("_", F.col(split), F.lit("drop"), reason).alias("metric"),
        F.col("rows").cast("double").alias("value"),
    )
    return fitted.unionByName(dropped)


def append_records(records: DataFrame, uri: str) -> None:
    records.write.mode("append").parquet(hadoop_uri(uri))
