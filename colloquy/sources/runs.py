"""Whole runs: manifest, digest, gates, rows, accounting and records, with one scan of the splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import governance
from colloquy.operators import tokenization as tz
from colloquy.sources import manifest as mf
from colloquy.sources.records import append_records, fit_record, lineage_record
from colloquy.sources.storage import hadoop_uri


@dataclass(frozen=True)
class Run:
    """What a run wrote: its rows, and the records of the run."""

    kept: DataFrame
    quarantine: DataFrame
    statistics: DataFrame
    histogram: DataFrame
    records: DataFrame


def admitted(spark: SparkSession, uri: str, *, expected_sha256: str | None, push: bool, assume_yes: bool) -> DataFrame:
    """The one-row manifest, once its digest and its classes have passed; no split is opened before."""
    manifest = mf.read_manifest(spark, uri)
    mf.check_digest(manifest, expected_sha256)
    governance.enforce_gates(mf.policy_summary(manifest), push=push, assume_yes=assume_yes)
    return manifest


def _written(rows: DataFrame, counts: dict[str, Column], folder: str) -> dict[str, int]:
    """Writes rows by ``dropped`` and ``split``; the counts are taken while they pass."""
    seen = Observation()
    observed = rows.observe(seen, *[F.count_if(condition).alias(name) for name, condition in counts.items()])
    named = observed.withColumn("dropped", F.when(F.col("dropped"), "yes").otherwise("no"))
    named.write.partitionBy("dropped", "split").parquet(hadoop_uri(folder))
    return seen.get


def _finished(spark: SparkSession, out: str, statistics: DataFrame, histogram: DataFrame, records: DataFrame) -> Run:
    append_records(records, f"{out}/records")
    rows = spark.read.parquet(hadoop_uri(f"{out}/rows"))
    return Run(
        kept=rows.where("dropped = 'no'").drop("dropped"),
        quarantine=rows.where("dropped = 'yes'").drop("dropped"),
        statistics=statistics,
        histogram=histogram,
        records=spark.read.parquet(hadoop_uri(f"{out}/records")),
    )


def _fit_entries(statistics: DataFrame, histogram: DataFrame) -> DataFrame:
    record = fit_record(statistics, histogram)
    return record.select(F.lit("metric").alias("kind"), F.col("metric").alias("key"), F.round("value", 6).cast("string").alias("value"))


def sft_run(
    spark: SparkSession,
    uri: str,
    spec: tz.TokenizeSpec,
    out: str,
    *,
    train_split: str = "train",
    eval_split: str = "eval",
    max_train_samples: int | None = None,
    max_eval_samples: int | None = None,
    expected_sha256: str | None = None,
    push: bool = False,
    assume_yes: bool = False,
) -> Run:
    """Prepares a supervised release for training below ``out`` (a new folder).

    The manifest's digest and its policy classes are judged before any split file is opened.
    Rows are read and tokenized once: kept and dropped ones are written side by side, and their
    accounting is counted while they are written. A run without a single kept training row is an error.
    """
    manifest = admitted(spark, uri, expected_sha256=expected_sha256, push=push, assume_yes=assume_yes)
    release = mf.load_sft_release(
        spark, uri, train_split=train_split, eval_split=eval_split, max_train_samples=max_train_samples, max_eval_samples=max_eval_samples
    )
    rows = tz.tokenize(release.rows, spec).withColumn("dropped", F.col("drop_reason").isNotNull())
    splits = (train_split, eval_split)
    counts: dict[str, Column] = {}
    for place, name in enumerate(splits):
        here = F.col("split") == name
        counts[f"{place}_total"] = here
        counts[f"{place}_kept"] = here & ~F.col("dropped")
        counts[f"{place}_truncated"] = here & ~F.col("dropped") & (F.col("is_truncated") == 1)
        for n, reason in enumerate(tz.DROP_REASONS):
            counts[f"{place}_reason_{n}"] = here & (F.col("drop_reason") == reason)
    found = _written(rows, counts, f"{out}/rows")
    totals = [(name, *(found[f"{place}_{k}"] for k in ("total", "kept", "truncated"))) for place, name in enumerate(splits)]
    dropped = [
        (name, reason, n)
        for place, name in enumerate(splits)
        for number, reason in enumerate(tz.DROP_REASONS)
        if (n := found[f"{place}_reason_{number}"])
    ]
    counted = spark.createDataFrame(totals, "split string, rows_total long, rows_kept long, rows_truncated long")
    statistics = tz.accounted(counted, spec)
    histogram = spark.createDataFrame(dropped, "split string, drop_reason string, rows long")
    tz.require_rows(statistics, histogram, train_split)
    records = lineage_record(manifest).unionByName(_fit_entries(statistics, histogram))
    return _finished(spark, out, statistics, histogram, records)


def dpo_run(
    spark: SparkSession,
    uri: str,
    out: str,
    *,
    train_split: str = "train",
    eval_split: str = "eval",
    expected_sha256: str | None = None,
    push: bool = False,
    assume_yes: bool = False,
) -> Run:
    """Prepares a preference release below ``out``: gates first, then required columns, rows and records.

    Preference rows pass unchanged; none is dropped.
    """
    manifest = admitted(spark, uri, expected_sha256=expected_sha256, push=push, assume_yes=assume_yes)
    release = mf.load_dpo_release(spark, uri, train_split=train_split, eval_split=eval_split)
    splits = (train_split, eval_split)
    counts = {f"{place}_total": F.col("split") == name for place, name in enumerate(splits)}
    found = _written(release.rows.withColumn("dropped", F.lit(False)), counts, f"{out}/rows")
    totals = [(name, found[f"{place}_total"]) for place, name in enumerate(splits)]
    statistics = spark.createDataFrame(totals, "split string, rows_total long")
    histogram = spark.createDataFrame([], "split string, drop_reason string, rows long")
    entries = statistics.select(
        F.lit("metric").alias("kind"), F.concat("split", F.lit("_rows_read")).alias("key"), F.col("rows_total").cast("double").cast("string").alias("value")
    )
    return _finished(spark, out, statistics, histogram, lineage_record(manifest).unionByName(entries))
