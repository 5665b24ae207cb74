"""Queries that audit corpora, tokenizers, artifacts and repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import messages as msg
from colloquy.functions import tokens as tok
from colloquy.functions.rendering import PlainTemplate
from colloquy.operators import audits, ordering
from colloquy.plans.formatting import PAIRS_SQL, preference_rows
from colloquy.plans.inputs import id_sum, turns
from colloquy.plans.registry import plan, table

# The full stop plays the end token of the character tokenizer.
EOS = ord(".") % 97 + 1

# Every third message is continued so that it does not end in a full stop.
AUDIT_SQL = f"""WITH said AS (SELECT conv_id, turn, role,
    text || CASE WHEN turn % 3 = 1 THEN ' and so on' ELSE '' END AS text FROM conversations),
coded AS (
  SELECT conv_id, turn, role, list_transform(string_split(text, ''), lambda c: unicode(c) % 97 + 1)
    AS ids FROM said),
placed AS (
  SELECT *, list_filter(list_transform(ids, lambda x, i: CASE WHEN x = {EOS} THEN i - 1 END),
    lambda p: p IS NOT NULL) AS pos FROM coded),
checked AS (
  SELECT *, len(ids) AS n, len(pos) AS eos_count,
    coalesce(len(ids) - list_max(pos) <= 3, false) AS has_final_eos FROM placed)"""


def audited_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.when(F.col("turn") % 3 == 1, " and so on").otherwise("")
    rows = turns(spark, sf_dir).withColumn("text", F.concat("text", ending))
    rows = rows.withColumn("input_ids", tok.CharTokenizer().encode(F.col("text")))
    return audits.audit_sequences(rows, EOS)


@plan(
    AUDIT_SQL
    + """ SELECT conv_id, turn, n::INTEGER AS sequence_length, eos_count::INTEGER AS eos_count,
  list_sum(pos)::BIGINT AS position_sum, has_final_eos,
  list_sum(ids[:50])::BIGINT AS first_sum, list_sum(ids[-50:])::BIGINT AS last_sum,
  CASE WHEN has_final_eos THEN '' ELSE 'No EOS token at end of sequence' END AS issues
FROM checked"""
)
def eos_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End-token positions and first and last tokens of every message."""
    return audited_turns(spark, sf_dir).select(
        "conv_id",
        "turn",
        "sequence_length",
        "eos_count",
        F.when(F.col("eos_count") > 0, id_sum("eos_positions")).alias("position_sum"),
        "has_final_eos",
        id_sum("first_tokens").alias("first_sum"),
        id_sum("last_tokens").alias("last_sum"),
        F.array_join("issues", " | ").alias("issues"),
    )


SUMMARY_SQL = """ SELECT count(*) AS samples_analyzed,
  count(*) FILTER (has_final_eos) AS samples_with_final_eos,
  count(*) FILTER (NOT has_final_eos) AS samples_with_issues,
  min(n)::INTEGER AS sequence_length_min, max(n)::INTEGER AS sequence_length_max,
  round(avg(n), 6) AS sequence_length_avg, min(eos_count)::INTEGER AS eos_count_min,
  max(eos_count)::INTEGER AS eos_count_max, round(avg(eos_count), 6) AS eos_count_avg FROM """


def _rounded(summary: DataFrame) -> DataFrame:
    return summary.withColumns(
        {name: F.round(name, 6) for name in ("sequence_length_avg", "eos_count_avg")}
    )


@plan(AUDIT_SQL + SUMMARY_SQL + "checked")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(audits.corpus_summary(audited_turns(spark, sf_dir)))


@plan(
    AUDIT_SQL
    + """ SELECT 'Only ' || count(*) FILTER (has_final_eos) || '/' || count(*) ||
  ' samples have proper EOS termination. Check chat template application.' AS recommendation
FROM checked HAVING count(*) FILTER (has_final_eos) < count(*)"""
)
def corpus_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = audits.corpus_summary(audited_turns(spark, sf_dir))
    return audits.corpus_recommendation(summary)


@plan(
    AUDIT_SQL
    + """ SELECT role, 'No EOS token at end of sequence' AS issue, count(*) AS occurrences,
  'No EOS token at end of sequence (' || count(*) || 'x)' AS label
FROM checked WHERE NOT has_final_eos GROUP BY role"""
)
def issue_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by frequency, per role."""
    return audits.issue_histogram(audited_turns(spark, sf_dir), ["role"])


@plan(
    AUDIT_SQL
    + """, looped AS (
  SELECT c.*, CASE WHEN length(s.text) >= 50 THEN list_filter(list_transform([10, 20, 30, 50],
    lambda n: CASE WHEN length(s.text) >= n * 3 AND (length(s.text) -
      length(replace(s.text, right(s.text, n), ''))) // n >= 3 THEN right(s.text, n) END),
    lambda t: t IS NOT NULL)[1] END AS pattern
  FROM checked c JOIN said s USING (conv_id, turn))
SELECT conv_id, turn, coalesce(n - list_max(pos) <= 2, false) AS stopped_at_eos,
  pattern IS NOT NULL AS detected_loop,
  CASE WHEN pattern IS NULL AND NOT coalesce(n - list_max(pos) <= 2, false)
    THEN 'Generation reached max_new_tokens without EOS'
    WHEN pattern IS NOT NULL THEN 'loop' ELSE '' END AS issue
FROM looped"""
)
def token_stop_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop and loop flags of messages judged by their token ids."""
    audited = audits.audit_by_tokens(audited_turns(spark, sf_dir), EOS, ids="input_ids")
    issue = F.array_join("issues", " | ")
    return audited.select(
        "conv_id",
        "turn",
        "stopped_at_eos",
        "detected_loop",
        F.when(F.col("detected_loop"), "loop").otherwise(issue).alias("issue"),
    )


# Fixed value: the end token of the byte-level vocabulary.
END_TEXT, END_ID = "<|endoftext|>", 50256

RENDERED_SQL = PAIRS_SQL + f""",
ended AS (
  SELECT conv_id, turn, asked_by, 'chosen' AS side, question, chosen AS answer FROM pairs
  UNION ALL SELECT conv_id, turn, asked_by, 'rejected', question, rejected || '{END_TEXT}' FROM pairs),
shown AS (
  SELECT conv_id, turn, side, CASE WHEN asked_by = 'system' THEN '' ELSE
    asked_by || ':' || question || chr(10) || 'assistant:' || answer END AS rendered FROM ended),
checked AS (
  SELECT *, len(string_split(rendered, '{END_TEXT}')) - 1 AS eos_count,
    CASE WHEN rendered = '' THEN ['Chat template error: System role not supported']
      WHEN side = 'chosen' THEN ['No EOS token at end of sequence'] ELSE [] END AS issues FROM shown)"""


def rendered_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both answers of each preference pair; only the rejected one has its end token."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    sides = F.explode(
        F.array(
            F.struct(F.lit("chosen").alias("side"), F.col("chosen").alias("answer")),
            F.struct(F.lit("rejected").alias("side"), F.concat("rejected", F.lit(END_TEXT)).alias("answer")),
        )
    )
    rows = preference_rows(spark, sf_dir).withColumn("_side", sides)
    items = F.array(msg.message(F.col("asked_by"), F.col("question")), msg.message(F.lit("assistant"), F.col("_side.answer")))
    rows = rows.select("conv_id", "turn", "_side.side", items.alias("messages"))
    return audits.audit_rendered(
        rows, PlainTemplate(rejects_system=True), tok.tokenizer_file(path), END_ID, tok.tokenizer_file_decoder(path)
    )


@plan(
    RENDERED_SQL
    + """ SELECT conv_id, turn, side, md5(rendered) AS rendered, eos_count::INTEGER AS eos_count,
  eos_count > 0 AND side = 'rejected' AS has_final_eos, array_to_string(issues, ' | ') AS issues,
  true AS first_shown, true AS last_shown FROM checked"""
)
def rendered_example_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered, encoded and decoded pairs; the decoded ends are ends of the text, but for characters cut in two."""
    first, last = F.rtrim(F.col("first_text"), F.lit("\ufffd")), F.ltrim(F.col("last_text"), F.lit("\ufffd"))
    return rendered_audit(spark, sf_dir).select(
        "conv_id",
        "turn",
        "side",
        F.md5("rendered").alias("rendered"),
        "eos_count",
        "has_final_eos",
        F.array_join("issues", " | ").alias("issues"),
        F.startswith("rendered", first).alias("first_shown"),
        F.endswith("rendered", last).alias("last_shown"),
    )


@plan(RENDERED_SQL + " SELECT side, x.issue, count(*) AS occurrences, x.issue || ' (' || count(*) || 'x)' AS label\n"
      "FROM (SELECT side, unnest(issues) AS issue FROM checked) x GROUP BY side, x.issue")
def rendered_issue_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of the rendered pairs by frequency, per side."""
    return audits.issue_histogram(rendered_audit(spark, sf_dir), ["side"])


DIAGNOSED = 100


@plan(
    f"""WITH firsts AS (SELECT * FROM documents ORDER BY doc_id LIMIT {DIAGNOSED}),
coded AS (SELECT list_transform(string_split(text, ''), lambda c: unicode(c) % 97 + 1) AS ids
  FROM firsts),
checked AS (SELECT len(ids) AS n, len(list_filter(ids, lambda x: x = {EOS})) AS eos_count,
  list_contains(ids[-3:], {EOS}) AS has_final_eos FROM coded)"""
    + SUMMARY_SQL
    + "checked"
)
def first_rows_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus summary of the first documents, the diagnostic sample of the audit."""
    sample = ordering.first_rows(table(spark, sf_dir, "documents"), "doc_id", DIAGNOSED)
    coded = sample.withColumn("input_ids", tok.CharTokenizer().encode(F.col("text")))
    return _rounded(audits.corpus_summary(audits.audit_sequences(coded, EOS)))


# Model configurations derive from parts.
MODELS_SQL = """WITH models AS (
  SELECT p_partkey AS model, (['full_conversation', 'assistant_only', 'weighted'])[p_partkey % 3 + 1]
      AS loss_mode,
    CASE WHEN p_partkey % 11 <> 0 THEN p_size END AS eos_id,
    CASE WHEN p_partkey % 4 <> 0 THEN CASE WHEN p_partkey % 4 = 1 THEN p_size ELSE p_size + 1 END END
      AS pad_id,
    CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN '' ELSE p_name END
      AS chat_template FROM part),
after AS (
  SELECT *, CASE WHEN pad_id IS NULL OR model % 7 = 0 THEN eos_id ELSE pad_id END AS pad_after
  FROM models)"""


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    modes = F.array(*[F.lit(m) for m in ("full_conversation", "assistant_only", "weighted")])
    pad = F.when(key % 4 == 1, F.col("p_size")).when(key % 4 != 0, F.col("p_size") + 1)
    rows = table(spark, sf_dir, "part").select(
        key.alias("model"),
        F.get(modes, (key % 3).cast("int")).alias("loss_mode"),
        F.when(key % 11 != 0, F.col("p_size")).alias("eos_id"),
        pad.alias("pad_id"),
        F.when(key % 5 == 1, "").when(key % 5 > 1, F.col("p_name")).alias("chat_template"),
    )
    overwritten = F.col("pad_id").isNull() | (F.col("model") % 7 == 0)
    return rows.withColumn(
        "pad_id_after", F.when(overwritten, F.col("eos_id")).otherwise(F.col("pad_id"))
    ).withColumns({"eos_token": F.lit("</s>"), "pad_token": F.lit("<pad>")})


@plan(
    MODELS_SQL
    + """, flagged AS (SELECT *, coalesce(pad_after = eos_id, false) AS same_after,
    coalesce(pad_id = eos_id, false) AS same_before, coalesce(chat_template, '') = '' AS bare FROM after)
SELECT model, same_after AS pad_equals_eos,
  array_to_string(list_filter([
    CASE WHEN NOT same_before AND same_after THEN 'pad_overwritten' END,
    CASE WHEN same_after AND loss_mode = 'full_conversation' THEN 'pad_in_loss' END,
    CASE WHEN bare THEN 'no_chat_template' END], lambda x: x IS NOT NULL), ' | ')
    AS issues,
  (same_after AND loss_mode = 'full_conversation')::INTEGER + bare::INTEGER AS n_recommendations
FROM flagged"""
)
def tokenizer_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.audit_tokenizers(_models(spark, sf_dir)).select(
        "model",
        "pad_equals_eos",
        F.array_join("issues", " | ").alias("issues"),
        F.size("recommendations").alias("n_recommendations"),
    )


@plan(
    MODELS_SQL
    + """ SELECT model, coalesce(trim(chat_template) <> '', false) AS has_chat_template,
  array_to_string(list_filter([
    CASE WHEN coalesce(trim(chat_template), '') = '' THEN 'no_packed_template' END,
    CASE WHEN eos_id IS NULL THEN 'no_packed_end' END,
    CASE WHEN pad_id = eos_id THEN 'packed_pad_is_end' END], lambda x: x IS NOT NULL), ' | ') AS issues
FROM models"""
)
def artifact_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.audit_artifacts(_models(spark, sf_dir)).select(
        "model", "has_chat_template", F.array_join("issues", " | ").alias("issues")
    )


# Repository listings derive from orders: the customer is the repository.
FILES = (
    "adapter_config.json",
    "adapter_model.safetensors",
    "config.json",
    "model.safetensors",
    "pytorch_model-1.bin",
    "README.md",
    "tokenizer.json",
)


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int"))


@plan(
    """WITH listing AS (SELECT o_custkey AS repo, (['adapter_config.json', 'adapter_model.safetensors',
  'config.json', 'model.safetensors', 'pytorch_model-1.bin', 'README.md', 'tokenizer.json'])
  [o_orderkey % 7 + 1] AS file FROM orders),
flags AS (SELECT repo, bool_or(file LIKE 'adapter%') AS adapter,
  bool_or(file = 'config.json') AND bool_or(file LIKE 'model.safetensors%' OR
    file LIKE 'pytorch_model%') AS whole FROM listing GROUP BY repo)
SELECT repo, CASE WHEN adapter AND whole THEN 'mixed' WHEN adapter THEN 'adapter'
  WHEN whole THEN 'full' ELSE 'unknown' END AS content FROM flags"""
)
def repository_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("repo"), _pick(FILES, F.col("o_orderkey")).alias("file")
    )
    return audits.repository_content(listing)


QUANTS = ("Q8_0", "q4_k_m", "F16", "Q5_K_S", "q5_k_m", "Q4_K_S")


@plan(
    """WITH listing AS (SELECT o_custkey AS repo, o_orderkey AS position, 'm-' ||
  (['Q8_0', 'q4_k_m', 'F16', 'Q5_K_S', 'q5_k_m', 'Q4_K_S'])[o_orderkey % 6 + 1] || '-' || o_orderkey
  || CASE WHEN o_orderkey % 5 = 0 THEN '.bin' ELSE '.gguf' END AS file FROM orders),
ranked AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY
  CASE WHEN lower(file) LIKE '%q4_k_m%' THEN 0 WHEN lower(file) LIKE '%q4_k_s%' THEN 1
    WHEN lower(file) LIKE '%q5_k_m%' THEN 2 WHEN lower(file) LIKE '%q5_k_s%' THEN 3
    WHEN lower(file) LIKE '%q8_0%' THEN 4 ELSE 5 END, position) AS rn
  FROM listing WHERE file LIKE '%.gguf')
SELECT repo, file AS selected_file FROM ranked WHERE rn = 1"""
)
def preferred_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    suffix = F.when(key % 5 == 0, ".bin").otherwise(".gguf")
    listing = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("repo"),
        key.alias("position"),
        F.concat(F.lit("m-"), _pick(QUANTS, key), F.lit("-"), key, suffix).alias("file"),
    )
    return audits.preferred_artifact(listing)
