"""Rollups of metric samples ``(run_id, ts, key, value)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metric_rollup(samples: DataFrame) -> DataFrame:
    """Average, peak and sample count per run and key."""
    return samples.groupBy("run_id", "key").agg(
        F.coalesce(F.avg("value"), F.lit(0.0)).alias("avg"),
        F.coalesce(F.max("value"), F.lit(0.0)).alias("peak"),
        F.count("value").alias("samples"),
    )


def run_rollup(samples: DataFrame) -> DataFrame:
    """Sample count and wall time per run."""
    first, last = (f("ts").cast("timestamp") for f in (F.min, F.max))
    micros = F.unix_micros(last) - F.unix_micros(first)
    return samples.groupBy("run_id").agg(
        F.count("value").alias("telemetry_samples"),
        F.greatest(micros / 1e6, F.lit(0.0)).alias("run_wall_time_sec"),
    )


def long_metrics(rollup: DataFrame) -> DataFrame:
    """``<key>_avg`` and ``<key>_peak`` as one row per metric."""
    pairs = F.array(
        F.struct(F.concat("key", F.lit("_avg")).alias("metric"), F.col("avg").alias("value")),
        F.struct(F.concat("key", F.lit("_peak")).alias("metric"), F.col("peak").alias("value")),
    )
    return rollup.select("run_id", F.inline(pairs))


def windowed_rollup(samples: DataFrame, window: str, delay: str) -> DataFrame:
    """Tumbling-window rollup per key; on a stream, samples later than ``delay`` go."""
    return (
        samples.withWatermark("ts", delay)
        .groupBy(F.window("ts", window), "key")
        .agg(
            F.avg("value").alias("avg"),
            F.max("value").alias("peak"),
            F.count("value").alias("samples"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "key",
            "avg",
            "peak",
            "samples",
        )
    )
