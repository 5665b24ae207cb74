"""Queries on the comparison table, tool-call evaluation and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import comparison, telemetry, tool_eval
from colloquy.plans.registry import plan, table
from colloquy.session import scratch_dir
from colloquy.sources.comparison_store import load_comparison, save_comparison

# The table derives from whole documents, whose texts repeat; responses come for
# every document of an even source and for as many prompts that are new.
TABLE_SQL = """WITH stored AS (
  SELECT doc_id AS row_id, text AS prompt, CASE WHEN doc_id % 3 <> 0 THEN lang END AS vanilla,
    CASE WHEN doc_id % 4 = 0 THEN 'old ' || doc_id END AS tuned FROM documents),
responses AS (
  SELECT doc_id AS position, CASE WHEN doc_id % 2 = 0 THEN text ELSE source || '?' END AS prompt,
    'new ' || doc_id AS response, n_chars / 100.0 AS seconds FROM documents),
known AS (SELECT prompt, min(row_id) AS row_id FROM stored GROUP BY prompt),
latest AS (SELECT prompt, max_by(response, position) AS response,
  max_by(seconds, position) AS seconds FROM responses GROUP BY prompt),
updates AS (SELECT row_id, response, seconds FROM known JOIN latest USING (prompt)),
merged AS (
  SELECT s.row_id, s.prompt, s.vanilla, coalesce(u.response, s.tuned) AS tuned,
    u.seconds::DOUBLE AS tuned_time, CASE WHEN u.row_id IS NOT NULL THEN 'now' END AS tuned_timestamp
  FROM stored s LEFT JOIN updates u USING (row_id)
  UNION ALL
  SELECT (SELECT max(row_id) + 1 FROM stored) + position, prompt, NULL, response, seconds::DOUBLE, 'now'
  FROM responses WHERE prompt NOT IN (SELECT prompt FROM known))"""


def stored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        doc.alias("row_id"),
        F.col("text").alias("prompt"),
        F.when(doc % 3 != 0, F.col("lang")).alias("vanilla"),
        F.when(doc % 4 == 0, F.concat(F.lit("old "), doc)).alias("tuned"),
    )


def response_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        doc.alias("position"),
        F.when(doc % 2 == 0, F.col("text"))
        .otherwise(F.concat("source", F.lit("?")))
        .alias("prompt"),
        F.concat(F.lit("new "), doc).alias("response"),
        (F.col("n_chars") / 100.0).alias("seconds"),
    )


def merged_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.upsert_responses(
        stored_table(spark, sf_dir), response_rows(spark, sf_dir), "tuned", F.lit("now")
    )


MERGED_COLUMNS = "row_id, md5(prompt) AS prompt, vanilla, tuned, tuned_time, tuned_timestamp"


@plan(TABLE_SQL + f" SELECT {MERGED_COLUMNS} FROM merged")
def comparison_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New responses written into the table; unknown prompts appended."""
    return merged_table(spark, sf_dir).withColumn("prompt", F.md5("prompt"))


@plan(TABLE_SQL + f" SELECT {MERGED_COLUMNS} FROM merged")
def comparison_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The updated table written as a new version and read back."""
    root = scratch_dir(spark, "comparison")
    before = load_comparison(spark, root, "owner/base-model")
    columns = comparison.upsert_responses(
        stored_table(spark, sf_dir).unionByName(before, allowMissingColumns=True),
        response_rows(spark, sf_dir),
        "tuned",
        F.lit("now"),
    )
    save_comparison(columns, root, "owner/base-model", "v1")
    return load_comparison(spark, root, "owner/base-model").withColumn("prompt", F.md5("prompt"))


@plan(
    TABLE_SQL
    + """, wanted AS (SELECT text AS prompt FROM documents UNION ALL SELECT text FROM benchmark),
first_row AS (SELECT prompt, arg_min_null(vanilla, row_id) AS answer FROM stored GROUP BY prompt)
SELECT md5(prompt) AS prompt FROM wanted
WHERE prompt NOT IN (SELECT prompt FROM first_row WHERE answer IS NOT NULL)"""
)
def missing_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed prompts without a response of the base model."""
    wanted = (
        table(spark, sf_dir, "documents")
        .select(F.col("text").alias("prompt"))
        .unionByName(table(spark, sf_dir, "benchmark").select(F.col("text").alias("prompt")))
    )
    missing = comparison.missing_responses(wanted, stored_table(spark, sf_dir), "vanilla")
    return missing.select(F.md5("prompt").alias("prompt"))


LISTED_SQL = """, listed AS (SELECT text AS prompt FROM documents WHERE lang <> 'en'
  UNION ALL SELECT source || '?' FROM documents)"""


def listed_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return (
        documents.where(F.col("lang") != "en")
        .select(F.col("text").alias("prompt"))
        .unionByName(documents.select(F.concat("source", F.lit("?")).alias("prompt")))
    )


@plan(
    TABLE_SQL
    + LISTED_SQL
    + """ SELECT row_id, md5(prompt) AS prompt, vanilla, tuned FROM merged
WHERE prompt IN (SELECT prompt FROM listed)"""
)
def shown_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of listed prompts with the response columns only."""
    shown = comparison.shown_rows(merged_table(spark, sf_dir), listed_prompts(spark, sf_dir))
    return shown.withColumn("prompt", F.md5("prompt"))


@plan(
    TABLE_SQL
    + LISTED_SQL
    + """ SELECT md5(prompt) AS prompt, arg_min_null(vanilla, row_id) AS base,
  arg_min_null(tuned, row_id) AS tuned FROM merged
WHERE prompt IN (SELECT prompt FROM listed) GROUP BY prompt"""
)
def side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = comparison.side_by_side(
        merged_table(spark, sf_dir), listed_prompts(spark, sf_dir), "vanilla", "tuned"
    )
    return pairs.withColumn("prompt", F.md5("prompt"))


# Predictions derive from whole events: some are absent, name another tool, add a
# key, quote the number or break the JSON.
CALLS_SQL = """WITH base AS (
  SELECT event_id, event_type, 'P' || user_id % 5 AS policy_class, value < 4.0 AS absent,
    event_id % 4 <> 1 AS right_name, event_id % 5 AS kind FROM events),
compared AS (
  SELECT *, NOT absent AND right_name AS decision,
    NOT absent AND right_name AND kind = 0 AS strict,
    NOT absent AND right_name AND kind IN (0, 2) AS relaxed,
    CASE WHEN absent OR kind IN (3, 4) THEN 0 ELSE 1 END AS matching,
    CASE WHEN absent OR kind = 3 THEN 0 WHEN kind = 1 THEN 2 ELSE 1 END AS predicted FROM base)"""


def compared_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    event, kind = F.col("event_id"), F.col("event_id") % 5
    number = F.regexp_extract("props", r"\d+", 0)
    events = ("event_id", "event_type", "user_id", "props")
    expected = table(spark, sf_dir, "events", *events).select(
        event.alias("example_id"),
        F.lit(0).alias("call_index"),
        F.col("event_type").alias("name"),
        F.col("props").alias("arguments"),
        F.col("event_type").alias("scenario_type"),
        F.concat(F.lit("P"), F.col("user_id") % 5).alias("policy_class"),
    )
    arguments = (
        F.when(kind == 0, F.concat(F.lit('{"k":'), number, F.lit(".0}")))
        .when(kind == 1, F.concat(F.lit('{"extra": 1, "k": '), number, F.lit("}")))
        .when(kind == 2, F.concat(F.lit('{"k": " '), number, F.lit('"}')))
        .when(kind == 3, F.concat("props", F.lit("!")))
        .otherwise(F.lit('{"k": -1}'))
    )
    predicted = (
        table(spark, sf_dir, "events")
        .where(F.col("value") >= 4.0)  # no prediction was made for the others
        .select(
            event.alias("example_id"),
            F.lit(0).alias("call_index"),
            F.when(event % 4 != 1, F.col("event_type")).otherwise("other").alias("name"),
            arguments.alias("arguments"),
        )
    )
    return tool_eval.compare_calls(tool_eval.pair_calls(expected, predicted))


@plan(
    CALLS_SQL
    + """ SELECT event_id AS example_id, decision AS decision_match, strict AS strict_match,
  relaxed AS relaxed_match, matching::INTEGER AS matching_keys, predicted::INTEGER AS predicted_keys
FROM compared"""
)
def tool_call_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision, strict and relaxed match of every expected call."""
    return compared_calls(spark, sf_dir).select(
        "example_id",
        "decision_match",
        "strict_match",
        "relaxed_match",
        "matching_keys",
        "predicted_keys",
    )


@plan(
    CALLS_SQL
    + """ SELECT event_type AS scenario_type, policy_class,
  grouping(event_type, policy_class)::BIGINT AS grouping, count(*) AS calls,
  round(avg(decision::INTEGER), 6) AS decision_accuracy,
  round(avg(strict::INTEGER), 6) AS strict_match, round(avg(relaxed::INTEGER), 6) AS relaxed_match,
  round(coalesce(sum(matching) / nullif(sum(predicted), 0), 0.0), 6) AS argument_precision
FROM compared
GROUP BY GROUPING SETS ((event_type, policy_class), (event_type), (policy_class), ())"""
)
def tool_call_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by scenario and policy class, each alone, and overall."""
    report = tool_eval.evaluation_report(compared_calls(spark, sf_dir))
    metrics = ("decision_accuracy", "strict_match", "relaxed_match", "argument_precision")
    return report.withColumns({name: F.round(name, 6) for name in metrics})


SAMPLES_SQL = """WITH samples AS (SELECT 'run-' || user_id % 20 AS run_id, ts, event_type AS key,
  CASE WHEN event_id % 50 <> 0 THEN value END AS value FROM events)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("run-"), F.col("user_id") % 20).alias("run_id"),
        "ts",
        F.col("event_type").alias("key"),
        F.when(F.col("event_id") % 50 != 0, F.col("value")).alias("value"),
    )


@plan(
    SAMPLES_SQL
    + """ SELECT run_id, key, round(coalesce(avg(value), 0), 6) AS avg, coalesce(max(value), 0) AS peak,
  count(value) AS samples FROM samples GROUP BY run_id, key"""
)
def metric_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.metric_rollup(samples(spark, sf_dir)).withColumn("avg", F.round("avg", 6))


@plan(
    SAMPLES_SQL
    + """, rolled AS (SELECT run_id, key, avg(value) AS a, max(value) AS p FROM samples
  GROUP BY run_id, key)
SELECT run_id, key || '_avg' AS metric, round(a, 6) AS value FROM rolled
UNION ALL SELECT run_id, key || '_peak', round(p, 6) FROM rolled"""
)
def metric_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per average and peak."""
    rolled = telemetry.metric_rollup(samples(spark, sf_dir))
    return telemetry.long_metrics(rolled).withColumn("value", F.round("value", 6))


@plan(
    SAMPLES_SQL
    + """ SELECT run_id, count(value) AS telemetry_samples,
  round(greatest(date_diff('microsecond', min(ts), max(ts)) / 1e6, 0), 6) AS run_wall_time_sec
FROM samples GROUP BY run_id"""
)
def run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = telemetry.run_rollup(samples(spark, sf_dir))
    return rolled.withColumn("run_wall_time_sec", F.round("run_wall_time_sec", 6))
