"""Inputs derived from the given tables, for queries and, as SQL, for their checks.

The given conversations are all well formed. ``irregular_turns`` derives the cases
that occur in practice from whole tables: blank questions, missing texts and
consecutive assistant turns. No row is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.examples import has_long_conversations
from colloquy.plans.registry import table

SEED = 42
EVAL_PERCENT = 10.0
MAX_SEQ_LEN = 2048


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def irregular_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("role") == "user"
    conv = F.col("conv_id")
    return turns(spark, sf_dir).select(
        "conv_id",
        "turn",
        F.when(user & (conv % 5 == 0), "assistant").otherwise(F.col("role")).alias("role"),
        F.when(user & (conv % 7 == 0), " \n\t")
        .when((F.col("role") == "system") & (conv % 3 == 0), F.lit(None))
        .otherwise(F.col("text"))
        .alias("text"),
    )


def has_long(spark: SparkSession, sf_dir: str, reach: int) -> bool:
    """Whether the given conversations, as they lie in files, need blocks."""
    return has_long_conversations(turns(spark, sf_dir), reach)


IRREGULAR_TURNS_SQL = """
irregular AS (
  SELECT conv_id, turn,
    CASE WHEN role = 'user' AND conv_id % 5 = 0 THEN 'assistant' ELSE role END AS role,
    CASE WHEN role = 'user' AND conv_id % 7 = 0 THEN ' ' || chr(10) || chr(9)
         WHEN role = 'system' AND conv_id % 3 = 0 THEN NULL ELSE text END AS text
  FROM conversations)"""

REGULAR_TURNS_SQL = """
irregular AS (SELECT conv_id, turn, role, text FROM conversations)"""


def split_sql(unit: str) -> str:
    return (
        f"CASE WHEN ('0x' || substr(md5({unit} || '|{SEED}'), 1, 8))::BIGINT % 10000 < 1000 "
        "THEN 'eval' ELSE 'train' END"
    )


# One row per assistant turn with its whole context, as lines.
EXAMPLES_SQL = """
ctx AS (
  SELECT conv_id, turn, role, text,
    count(*) OVER w AS n_context,
    coalesce(bool_or(role = 'user' AND regexp_matches(text, '\\S')) OVER w, false) AS asked,
    coalesce(bool_or(role = 'system') OVER w, false) AS has_system,
    coalesce(list(role || ':' || text) OVER w, []) AS lines
  FROM irregular WHERE text IS NOT NULL
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
examples AS (
  SELECT conv_id || '-' || turn AS example_id, conv_id::VARCHAR AS session_id,
    turn::INTEGER AS target_turn_index, n_context, asked, has_system,
    text AS target_text, lines,
    array_to_string(list_append(lines, 'assistant:'), chr(10)) AS prompt_text,
    array_to_string(list_append(lines, 'assistant:' || text), chr(10)) AS full_text
  FROM ctx WHERE role = 'assistant')"""


def examples_sql(turns_sql: str = REGULAR_TURNS_SQL) -> str:
    return f"WITH {turns_sql}, {EXAMPLES_SQL}"


# The same, with contexts as lists of messages.
WHOLE_SQL = """
gathered AS (
  SELECT *, coalesce(list({'role': role, 'text': text}) OVER w, []) AS items
  FROM irregular WHERE text IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
examples AS (
  SELECT conv_id || '-' || turn AS example_id, conv_id::VARCHAR AS session_id,
    turn::INTEGER AS target_turn_index, len(items) AS n_context, items, text AS target_text,
    len(list_filter(items, lambda m: m.role = 'user' AND regexp_matches(m.text, '\\S'))) > 0
      AS asked,
    list_contains(list_transform(items, lambda m: m.role), 'system') AS has_system,
    list_transform(items, lambda m: m.role || ':' || m.text) AS lines
  FROM gathered WHERE role = 'assistant')"""


def whole_sql(turns_sql: str) -> str:
    return f"WITH {turns_sql}, {WHOLE_SQL}"


def masked_sql(turns_sql: str, limit: int, drops: str = "NULL") -> str:
    """Examples with drop reason, truncation and ids, for the character tokenizer."""
    return f"""{examples_sql(turns_sql)},
sized AS (
  SELECT *, {split_sql("session_id")} AS split,
    CASE WHEN n_context = 0 THEN 'empty_prompt_messages'
         WHEN NOT asked THEN 'missing_user_query' ELSE {drops} END AS drop_reason,
    greatest(length(full_text) - {limit}, 0) AS overflow,
    least(length(prompt_text), length(full_text)) AS raw_prompt
  FROM examples),
masked AS (
  SELECT *, CASE WHEN drop_reason IS NULL AND overflow > 0 THEN 1 ELSE 0 END AS is_truncated,
    greatest(raw_prompt - overflow, 0) AS prompt_len,
    list_transform(string_split(right(full_text, {limit}), ''),
                   lambda c: unicode(c) % 97 + 1) AS ids
  FROM sized)"""


def id_sum(ids: Column | str) -> Column:
    return F.aggregate(ids, F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def position_sum(ids: Column | str) -> Column:
    """Sum of value times one-based position: changes if any order does."""
    weighted = F.transform(ids, lambda x, i: x.cast("bigint") * (i + 1))
    return F.aggregate(weighted, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
