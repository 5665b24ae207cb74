"""Streaming queries: run over what has arrived, then read their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import examples, splits
from colloquy.plans.inputs import (
    EVAL_PERCENT,
    IRREGULAR_TURNS_SQL,
    has_long,
    MAX_SEQ_LEN,
    SEED,
    id_sum,
    irregular_turns,
    masked_sql,
)
from colloquy.plans.registry import plan, table
from colloquy.plans.rewards import AUDITED_SQL, outputs
from colloquy.plans.supervised import SPEC
from colloquy.session import scratch_dir
from colloquy.sources.release import write_release
from colloquy.streaming import jobs

WINDOW, DELAY = "1 hour", "10 minutes"


@plan(
    """WITH closed AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events),
rolled AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS key,
  round(avg(value), 6) AS avg, max(value) AS peak, count(value) AS samples
  FROM events GROUP BY ALL)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, key, avg, peak, samples
FROM rolled, closed WHERE window_start + INTERVAL 1 HOUR <= mark"""
)
def stream_metric_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed hourly windows per key; the windows still open are not written yet."""
    root = scratch_dir(spark, "stream-rollup")
    schema = table(spark, sf_dir, "events").schema
    events = jobs.read_arrivals(spark, sf_dir, schema, names="events.parquet")
    # A watermark needs an instant; the wall-clock times of the file come back below.
    samples = events.select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("key"), "value"
    )
    query = jobs.stream_rollup(
        samples, f"{root}/out", f"{root}/checkpoint", window=WINDOW, delay=DELAY, available_now=True
    )
    query.awaitTermination()
    wall = {name: F.col(name).cast("timestamp_ntz") for name in ("window_start", "window_end")}
    return spark.read.parquet(f"{root}/out").withColumns({**wall, "avg": F.round("avg", 6)})


@plan(
    masked_sql(IRREGULAR_TURNS_SQL, MAX_SEQ_LEN)
    + """ SELECT example_id, drop_reason, is_truncated,
  CASE WHEN drop_reason IS NULL THEN len(ids) ELSE 0 END::INTEGER AS n_tokens,
  CASE WHEN drop_reason IS NULL THEN list_sum(ids) ELSE 0 END::BIGINT AS id_sum FROM masked"""
)
def stream_tokenized_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that arrive as files, tokenized into a kept and a quarantine table."""
    root = scratch_dir(spark, "stream-tokenize")
    long = has_long(spark, sf_dir, MAX_SEQ_LEN)
    rows = examples.single_turn(irregular_turns(spark, sf_dir), MAX_SEQ_LEN, long=long)
    rows.write.parquet(f"{root}/in")
    arrivals = jobs.read_arrivals(spark, f"{root}/in", spark.read.parquet(f"{root}/in").schema)
    query = jobs.stream_tokenize(
        arrivals, SPEC, f"{root}/kept", f"{root}/dropped", f"{root}/checkpoint", available_now=True
    )
    query.awaitTermination()
    parts = [spark.read.parquet(f"{root}/{name}") for name in ("kept", "dropped")]
    return parts[0].unionByName(parts[1]).select(
        "example_id", "drop_reason", "is_truncated", "n_tokens", id_sum("input_ids").alias("id_sum")
    )


@plan(
    masked_sql(IRREGULAR_TURNS_SQL, MAX_SEQ_LEN)
    + """ SELECT example_id, drop_reason, is_truncated,
  CASE WHEN drop_reason IS NULL THEN len(ids) ELSE 0 END::INTEGER AS n_tokens,
  CASE WHEN drop_reason IS NULL THEN list_sum(ids) ELSE 0 END::BIGINT AS id_sum FROM masked"""
)
def stream_release_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a release, the second one seen after a restart, each tokenized once."""
    root = scratch_dir(spark, "stream-releases")
    long = has_long(spark, sf_dir, MAX_SEQ_LEN)
    rows = examples.single_turn(irregular_turns(spark, sf_dir), MAX_SEQ_LEN, long=long)
    labelled = splits.percent_split(rows, "session_id", EVAL_PERCENT, SEED)
    labelled.write.parquet(f"{root}/in")
    labelled = spark.read.parquet(f"{root}/in")
    second = F.pmod(F.xxhash64("session_id"), F.lit(3)) == 0
    for version, part in (("v1", labelled.where(~second)), ("v2", labelled.where(second))):
        write_release(part, f"{root}/releases", "chat", version)
        arrivals = jobs.read_releases(spark, f"{root}/releases", labelled.schema)
        query = jobs.stream_tokenize(
            arrivals, SPEC, f"{root}/kept", f"{root}/dropped", f"{root}/checkpoint", available_now=True
        )
        query.awaitTermination()
    parts = [spark.read.parquet(f"{root}/{name}") for name in ("kept", "dropped")]
    return parts[0].unionByName(parts[1]).select(
        "example_id", "drop_reason", "is_truncated", "n_tokens", id_sum("input_ids").alias("id_sum")
    )


@plan(
    AUDITED_SQL
    + """ SELECT doc_id, loop_pattern, stopped_at_eos, detected_loop,
  array_to_string(issues, ' | ') AS issues FROM audited"""
)
def stream_output_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loop and stop flags of completions that arrive as files."""
    root = scratch_dir(spark, "stream-audit")
    outputs(spark, sf_dir).write.parquet(f"{root}/in")
    arrivals = jobs.read_arrivals(spark, f"{root}/in", spark.read.parquet(f"{root}/in").schema)
    query = jobs.stream_audit(arrivals, f"{root}/out", f"{root}/checkpoint", available_now=True)
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out").select(
        "doc_id",
        "loop_pattern",
        "stopped_at_eos",
        "detected_loop",
        F.array_join("issues", " | ").alias("issues"),
    )
