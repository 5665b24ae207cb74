"""Whole runs over releases written from the given conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import examples, splits
from colloquy.plans.formatting import PAIRS_SQL
from colloquy.plans.inputs import EVAL_PERCENT, IRREGULAR_TURNS_SQL, MAX_SEQ_LEN, SEED, has_long, irregular_turns, masked_sql, split_sql
from colloquy.plans.registry import plan
from colloquy.plans.releases import write_preferences
from colloquy.plans.supervised import SPEC
from colloquy.session import scratch_dir
from colloquy.sources import runs
from colloquy.sources.release import write_release

#: Where a release lies, and the digest that follows from it, differ from run to run.
LOCATED = ("dataset_manifest_uri", "dataset_manifest_sha256")


def _shown(run: runs.Run) -> DataFrame:
    """Records of a run, and what it kept and dropped as counted from the written rows."""

    def rows(df: DataFrame, kind: str, key) -> DataFrame:
        return df.groupBy(key.alias("key")).agg(F.count("*").cast("string").alias("value")).select(F.lit(kind).alias("kind"), "key", "value")

    out = run.records.where(~F.col("key").isin(*LOCATED)).unionByName(rows(run.kept, "kept", F.col("split")))
    if "drop_reason" in run.quarantine.columns:
        out = out.unionByName(rows(run.quarantine, "quarantine", F.concat_ws("/", "split", "drop_reason")))
    return out


@plan(
    masked_sql(IRREGULAR_TURNS_SQL, MAX_SEQ_LEN)
    + """,
stats AS (
  SELECT split, count(*)::DOUBLE AS total, count(*) FILTER (drop_reason IS NULL)::DOUBLE AS kept,
    sum(is_truncated)::DOUBLE AS truncated FROM masked GROUP BY split),
named AS (
  SELECT split, unnest([
    {'m': 'rows_total_raw', 'v': total}, {'m': 'rows_valid_before_filter', 'v': kept},
    {'m': 'rows_fit_fully', 'v': kept - truncated}, {'m': 'rows_truncated', 'v': truncated},
    {'m': 'rows_dropped_tokenization', 'v': total - kept},
    {'m': 'context_fit_pct', 'v': (kept - truncated) / kept * 100.0},
    {'m': 'context_truncated_pct', 'v': truncated / kept * 100.0}]) AS x FROM stats
  UNION ALL
  SELECT split, {'m': 'drop_' || drop_reason, 'v': count(*)::DOUBLE} FROM masked
  WHERE drop_reason IS NOT NULL GROUP BY split, drop_reason)
SELECT 'metric' AS kind, split || '_' || x.m AS key, round(x.v, 6)::VARCHAR AS value FROM named
UNION ALL SELECT 'metric', split || '_rows', total::VARCHAR FROM stats
UNION ALL SELECT 'metric', 'total_rows', sum(total)::VARCHAR FROM stats
UNION ALL SELECT 'param', k, v FROM (VALUES ('dataset_id', 'chat'), ('dataset_version', 'v1')) t(k, v)
UNION ALL SELECT 'kept', split, kept::BIGINT::VARCHAR FROM stats
UNION ALL SELECT 'quarantine', split || '/' || drop_reason, count(*)::VARCHAR FROM masked
  WHERE drop_reason IS NOT NULL GROUP BY split, drop_reason"""
)
def sft_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supervised run over conversations with dropped rows: records, kept and dropped rows."""
    rows = examples.single_turn(irregular_turns(spark, sf_dir), MAX_SEQ_LEN, long=has_long(spark, sf_dir, MAX_SEQ_LEN))
    labelled = splits.percent_split(rows, "session_id", EVAL_PERCENT, SEED).withColumn("policy_class", F.lit("P1"))
    uri = write_release(labelled, scratch_dir(spark, "run-release"), "chat", "v1", policy_class="policy_class")
    return _shown(runs.sft_run(spark, uri, SPEC, scratch_dir(spark, "run")))


@plan(
    PAIRS_SQL
    + f""", named AS (SELECT {split_sql("conv_id")} AS split FROM pairs),
stats AS (SELECT split, count(*) AS n FROM named GROUP BY split)
SELECT 'metric' AS kind, split || '_rows' AS key, n::DOUBLE::VARCHAR AS value FROM stats
UNION ALL SELECT 'metric', 'total_rows', sum(n)::DOUBLE::VARCHAR FROM stats
UNION ALL SELECT 'metric', split || '_rows_read', n::DOUBLE::VARCHAR FROM stats
UNION ALL SELECT 'kept', split, n::VARCHAR FROM stats"""
)
def dpo_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preference run with classes that need approval."""
    run = runs.dpo_run(spark, write_preferences(spark, sf_dir), scratch_dir(spark, "run"), assume_yes=True)
    return _shown(run).where("kind <> 'param'")
