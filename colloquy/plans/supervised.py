"""Queries on supervised examples: contexts, tokenization, accounting, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import tokens as tok
from colloquy.functions.rendering import PlainTemplate
from colloquy.operators import batching, examples, splits
from colloquy.operators import tokenization as tz
from colloquy.plans.inputs import (
    EVAL_PERCENT,
    IRREGULAR_TURNS_SQL,
    MAX_SEQ_LEN,
    REGULAR_TURNS_SQL,
    SEED,
    whole_sql,
    examples_sql,
    has_long,
    id_sum,
    irregular_turns,
    masked_sql,
    position_sum,
    split_sql,
    turns,
)
from colloquy.plans.registry import plan
from colloquy.sources.records import fit_record

SPEC = tz.assistant_only(MAX_SEQ_LEN)
STRICT = tz.assistant_only(MAX_SEQ_LEN, template=PlainTemplate(rejects_system=True))
WEIGHT = 0.25
#: A reach for queries that need facts of the context and next to none of its text.
FACTS = 16


def split_examples(df: DataFrame) -> DataFrame:
    return splits.percent_split(df, "session_id", EVAL_PERCENT, SEED)


def regular(spark: SparkSession, sf_dir: str, reach: int = MAX_SEQ_LEN) -> DataFrame:
    long = has_long(spark, sf_dir, reach)
    return split_examples(examples.single_turn(turns(spark, sf_dir), reach, long=long))


def irregular(spark: SparkSession, sf_dir: str, reach: int = MAX_SEQ_LEN, tokenizer=None) -> DataFrame:
    long = has_long(spark, sf_dir, reach)
    tokens = examples.line_tokens(F.col("role"), F.col("text"), tokenizer)
    return split_examples(examples.single_turn(irregular_turns(spark, sf_dir), reach, tokens=tokens, long=long))


@plan(
    masked_sql(REGULAR_TURNS_SQL, MAX_SEQ_LEN)
    + """
SELECT split, count(*) AS rows_total,
  count(*) FILTER (drop_reason IS NULL) AS rows_kept,
  sum(is_truncated)::BIGINT AS rows_truncated,
  count(*) FILTER (drop_reason IS NOT NULL) AS rows_dropped,
  round((count(*) FILTER (drop_reason IS NULL) - sum(is_truncated)) * 100.0
        / count(*) FILTER (drop_reason IS NULL), 6)::DOUBLE AS fit_pct,
  sum(len(ids)) FILTER (drop_reason IS NULL)::BIGINT AS tokens,
  sum(len(ids) - least(prompt_len, len(ids))) FILTER (drop_reason IS NULL)::BIGINT
    AS supervised_tokens,
  sum(list_sum(ids)) FILTER (drop_reason IS NULL)::BIGINT AS id_sum
FROM masked GROUP BY split"""
)
def sequence_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: what share of each split fits the limit, with token totals."""
    return sequence_fit_at(spark, sf_dir, MAX_SEQ_LEN)


def sequence_fit_at(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    rows = tz.tokenize(regular(spark, sf_dir, limit), tz.assistant_only(limit))
    kept = F.col("drop_reason").isNull()
    size = F.size("input_ids").cast("bigint")
    return (
        rows.groupBy("split")
        .agg(
            F.count("*").alias("rows_total"),
            F.count_if(kept).alias("rows_kept"),
            F.sum("is_truncated").alias("rows_truncated"),
            F.count_if(~kept).alias("rows_dropped"),
            F.sum(F.when(kept, size)).alias("tokens"),
            F.sum(F.when(kept, size - F.least("prompt_len", F.size("input_ids")))).alias(
                "supervised_tokens"
            ),
            F.sum(F.when(kept, id_sum("input_ids"))).alias("id_sum"),
        )
        .withColumn(
            "fit_pct",
            F.round(
                (F.col("rows_kept") - F.col("rows_truncated")) * 100.0 / F.col("rows_kept"), 6
            ),
        )
    )


@plan(
    examples_sql()
    + f"""
SELECT example_id, session_id, target_turn_index, n_context AS context_messages, asked,
  length(prompt_text)::BIGINT AS prompt_chars, length(full_text)::BIGINT AS full_chars,
  md5(full_text) AS full_text, md5(target_text) AS target
FROM examples"""
)
def single_turn_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One example per assistant turn with its whole context."""
    rows = examples.single_turn(turns(spark, sf_dir))
    prompt = PlainTemplate().render(F.col("messages"), generation_prompt=True)
    full = F.concat(F.col("prompt_text"), F.col("target_text"))
    return rows.withColumn("prompt_text", prompt).select(
        "example_id",
        "session_id",
        "target_turn_index",
        F.size("messages").cast("bigint").alias("context_messages"),
        "asked",
        F.length("prompt_text").cast("bigint").alias("prompt_chars"),
        F.length(full).cast("bigint").alias("full_chars"),
        F.md5(full).alias("full_text"),
        F.md5("target_text").alias("target"),
    )


MERGED_SQL = f"""WITH {IRREGULAR_TURNS_SQL},
marked AS (
  SELECT *, CASE WHEN role = 'assistant' AND lag(role) OVER w = 'assistant' THEN 0 ELSE 1 END
    AS opens
  FROM irregular WHERE text IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
runs AS (
  SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM marked),
merged AS (
  SELECT conv_id, max(turn) AS turn, first(role) AS role,
    string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, count(*)::INTEGER AS merged_turns
  FROM runs GROUP BY conv_id, run)"""


@plan(MERGED_SQL + " SELECT conv_id, turn, role, md5(text) AS text, merged_turns FROM merged")
def merged_assistant_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = examples.merge_consecutive_assistant(
        irregular_turns(spark, sf_dir), long=has_long(spark, sf_dir, MAX_SEQ_LEN)
    )
    return merged.withColumn("text", F.md5("text"))


@plan(
    MERGED_SQL
    + """
SELECT conv_id || '-' || turn AS example_id, count(*) OVER w AS context_messages,
  md5(coalesce(string_agg(role || ':' || text, chr(10)) OVER w, '')) AS context,
  md5(text) AS target
FROM merged WINDOW w AS (PARTITION BY conv_id ORDER BY turn
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
QUALIFY role = 'assistant'"""
)
def merged_turn_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-context examples after consecutive assistant turns were merged."""
    merged = examples.merge_consecutive_assistant(
        irregular_turns(spark, sf_dir), long=has_long(spark, sf_dir, MAX_SEQ_LEN)
    )
    rows = examples.single_turn(merged, target_mode="merge_consecutive_assistant")
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return rows.select(
        "example_id",
        F.size("messages").cast("bigint").alias("context_messages"),
        F.md5(F.array_join(lines, "\n")).alias("context"),
        F.md5("target_text").alias("target"),
    )


TOKEN_BUDGET, OVERHEAD = 1500, 100


@plan(
    f"""WITH sized AS (
  SELECT conv_id, turn, role, text, length(role) + length(text) + 2 AS tokens FROM conversations),
starts AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sized)
SELECT t.conv_id || '-' || t.turn AS example_id, count(c.turn)::INTEGER AS context_messages,
  coalesce(sum(c.tokens), 0)::BIGINT AS context_tokens,
  (t.start - coalesce(sum(c.tokens), 0))::BIGINT AS omitted_tokens,
  coalesce(string_agg(c.role || ':' || md5(c.text), ',' ORDER BY c.turn), '') AS context
FROM starts t LEFT JOIN starts c
  ON c.conv_id = t.conv_id AND c.turn < t.turn AND c.start >= t.start - {TOKEN_BUDGET - OVERHEAD}
WHERE t.role = 'assistant' GROUP BY t.conv_id, t.turn, t.start"""
)
def budgeted_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest context messages that fit a token budget."""
    long = has_long(spark, sf_dir, TOKEN_BUDGET)
    rows = examples.budgeted(turns(spark, sf_dir), TOKEN_BUDGET, OVERHEAD, long=long)
    sizes = F.aggregate(
        "messages",
        F.lit(0).cast("bigint"),
        lambda acc, m: acc + F.length(m["role"]) + F.length(m["content"]) + 2,
    )
    shown = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.md5(m["content"])))
    return rows.select(
        "example_id",
        F.size("messages").alias("context_messages"),
        sizes.alias("context_tokens"),
        "omitted_tokens",
        F.array_join(shown, ",").alias("context"),
    )


def with_missing_targets(df: DataFrame) -> DataFrame:
    """Rows without a target, for the shape check."""
    lost = F.col("session_id").cast("bigint") % 13 == 0
    return df.withColumn("target_text", F.when(~lost, F.col("target_text")))


CLASSIFIED_SQL = (
    whole_sql(IRREGULAR_TURNS_SQL)
    + f""",
classified AS (
  SELECT *, {split_sql("session_id")} AS split,
    CASE WHEN session_id::BIGINT % 13 = 0 THEN 'invalid_row_shape'
         WHEN n_context = 0 THEN 'empty_prompt_messages'
         WHEN NOT asked THEN 'missing_user_query'
         WHEN has_system THEN 'chat_template_error' END AS drop_reason
  FROM examples)"""
)


def irregular_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with their whole contexts, as templates and reports need them."""
    return split_examples(examples.single_turn(irregular_turns(spark, sf_dir)))


def classified(rows: DataFrame) -> DataFrame:
    return tz.classify(with_missing_targets(rows), STRICT)


@plan(CLASSIFIED_SQL + " SELECT example_id, split, drop_reason FROM classified")
def row_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First matching drop reason per row; null for kept rows."""
    return classified(irregular(spark, sf_dir, FACTS)).select("example_id", "split", "drop_reason")


@plan(
    CLASSIFIED_SQL
    + """ SELECT split, drop_reason, count(*) AS rows FROM classified
WHERE drop_reason IS NOT NULL GROUP BY ALL"""
)
def drop_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tz.drop_histogram(classified(irregular(spark, sf_dir, FACTS)))


@plan(
    CLASSIFIED_SQL
    + """,
roles AS (
  SELECT *, CASE WHEN drop_reason = 'invalid_row_shape' THEN [] ELSE
    list_transform(lines, lambda x: string_split(x, ':')[1]) END AS role_list,
    CASE WHEN drop_reason = 'invalid_row_shape' THEN [] ELSE lines END AS shown,
    trim(regexp_replace(CASE WHEN drop_reason = 'invalid_row_shape' THEN '' ELSE target_text END,
                        '\\s+', ' ', 'g')) AS flat
  FROM classified WHERE drop_reason IS NOT NULL)
SELECT example_id, split, drop_reason AS reason, session_id, target_turn_index,
  len(role_list)::INTEGER AS message_count, array_to_string(role_list, ',') AS roles,
  list_filter(role_list, lambda r: r <> 'system')[-1] AS last_non_system_role,
  CASE WHEN length(flat) <= 240 THEN flat ELSE flat[:240] || '...' END AS target_preview,
  array_to_string(list_transform(list_transform(shown[-3:], lambda x:
      x[:position(':' IN x)] || trim(regexp_replace(x[position(':' IN x) + 1:], '\\s+', ' ', 'g'))),
    lambda y: CASE WHEN length(y[position(':' IN y) + 1:]) <= 240 THEN y
                   ELSE y[:position(':' IN y) + 240] || '...' END), ' | ') AS messages_tail,
  CASE WHEN drop_reason = 'chat_template_error' THEN 'System role not supported' END AS error
FROM roles"""
)
def drop_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, roles and previews of every dropped row."""
    report = tz.drop_report(classified(irregular_rows(spark, sf_dir)))
    tail = F.transform(
        "messages_tail", lambda m: F.concat(m["role"], F.lit(":"), m["content"])
    )
    return report.select(
        "example_id",
        "split",
        "reason",
        "session_id",
        "target_turn_index",
        "message_count",
        F.array_join("role_sequence", ",").alias("roles"),
        "last_non_system_role",
        F.coalesce("target_preview", F.lit("")).alias("target_preview"),
        F.array_join(tail, " | ").alias("messages_tail"),
        "error",
    )


IRREGULAR_MASKED = masked_sql(IRREGULAR_TURNS_SQL, MAX_SEQ_LEN)


@plan(
    IRREGULAR_MASKED
    + """
SELECT split, count(*) AS rows_total, count(*) FILTER (drop_reason IS NULL) AS rows_kept,
  count(*) FILTER (drop_reason IS NULL) AS rows_valid_before_filter,
  (count(*) FILTER (drop_reason IS NULL) - sum(is_truncated))::BIGINT AS rows_fit_fully,
  sum(is_truncated)::BIGINT AS rows_truncated,
  count(*) FILTER (drop_reason IS NOT NULL) AS rows_dropped,
  round((count(*) FILTER (drop_reason IS NULL) - sum(is_truncated))
    / count(*) FILTER (drop_reason IS NULL) * 100.0, 6) AS fit_pct,
  round(sum(is_truncated) / count(*) FILTER (drop_reason IS NULL) * 100.0, 6) AS truncated_pct,
  'weighted' AS loss_mode, 0.25::DOUBLE AS prompt_loss_weight
FROM masked GROUP BY split"""
)
def fit_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row accounting per split of conversations with dropped rows."""
    spec = tz.for_mode(SPEC, "weighted", WEIGHT)
    stats = tz.fit_statistics(tz.tokenize(irregular(spark, sf_dir), spec), spec)
    return stats.withColumns(
        {name: F.round(name, 6) for name in ("fit_pct", "truncated_pct")}
    )


@plan(
    IRREGULAR_MASKED
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
SELECT split, split || '_' || x.m AS metric, round(x.v, 6) AS value FROM named"""
)
def fit_metric_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven metrics per split and one per drop reason, as long rows."""
    rows = tz.tokenize(irregular(spark, sf_dir), SPEC)
    record = fit_record(tz.fit_statistics(rows, SPEC), tz.drop_histogram(rows))
    return record.withColumn("value", F.round("value", 6))


BYTES_LIMIT = 3000
BYTES = tz.assistant_only(
    BYTES_LIMIT,
    tokenizer=tok.ArrowTokenizer(lambda: tok.each_text(lambda t: t.encode("utf-8")), splits_at_lines=True),
)
BPE_LIMIT = 512


@plan(
    whole_sql(IRREGULAR_TURNS_SQL)
    + f""",
kept AS (
  SELECT example_id, array_to_string(list_append(lines, 'assistant:'), chr(10)) AS prompt,
    array_to_string(list_append(lines, 'assistant:' || target_text), chr(10)) AS whole
  FROM examples WHERE n_context > 0 AND asked),
coded AS (
  SELECT example_id, strlen(prompt) AS prompt_n, strlen(whole) AS n, hex(encode(whole)) AS code
  FROM kept),
placed AS (
  SELECT *, greatest(n - {BYTES_LIMIT}, 0) AS over, list_transform(
    range(greatest(n - {BYTES_LIMIT}, 0), n), lambda i: ('0x' || substr(code, 2 * i + 1, 2))::BIGINT)
    AS ids FROM coded)
SELECT example_id, len(ids)::INTEGER AS n_tokens, greatest(prompt_n - over, 0)::INTEGER AS prompt_len,
  (over > 0)::INTEGER AS is_truncated, list_sum(ids)::BIGINT AS id_sum,
  list_sum(list_transform(ids, lambda x, i: x * i))::BIGINT AS id_positions
FROM placed"""
)
def byte_token_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokenization through Arrow, with a byte per token and contexts within reach."""
    return _arrow_masks(spark, sf_dir, BYTES)


@plan(
    whole_sql(IRREGULAR_TURNS_SQL)
    + """
SELECT example_id, md5(array_to_string(list_append(lines, 'assistant:' || target_text), chr(10))) AS decoded,
  true AS has_tokens, 0 AS is_truncated
FROM examples WHERE n_context > 0 AND asked"""
)
def bpe_token_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-pair ids of whole rows, decoded again: the vocabulary is lossless."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    spec = tz.assistant_only(1 << 30, tokenizer=tok.tokenizer_file(path))
    kept, _ = tz.valid_and_dropped(tz.tokenize(irregular_rows(spark, sf_dir), spec))
    return kept.select(
        "example_id",
        F.md5(tok.tokenizer_file_decoder(path)(F.col("input_ids"))).alias("decoded"),
        ((F.col("n_tokens") > 0) & (F.col("prompt_len") < F.col("n_tokens"))).alias("has_tokens"),
        "is_truncated",
    )


def bpe_spec(limit: int) -> tz.TokenizeSpec:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return tz.assistant_only(limit, tokenizer=tok.tokenizer_file(path, splits_at_lines=True))


@plan(None)
def bpe_truncated_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last byte-pair ids of every row; each message is counted once, and only contexts within reach are encoded."""
    return _arrow_masks(spark, sf_dir, bpe_spec(BPE_LIMIT))


def _arrow_masks(spark: SparkSession, sf_dir: str, spec: tz.TokenizeSpec) -> DataFrame:
    rows = irregular(spark, sf_dir, spec.max_seq_len, spec.tokenizer)
    return _checked_ids(tz.tokenize(rows, spec))


def _checked_ids(tokenized: DataFrame) -> DataFrame:
    kept, _ = tz.valid_and_dropped(tokenized)
    return kept.select(
        "example_id",
        "n_tokens",
        "prompt_len",
        "is_truncated",
        id_sum("input_ids").alias("id_sum"),
        position_sum("input_ids").alias("id_positions"),
    )


MASK_SQL = """
SELECT example_id, split, len(ids)::INTEGER AS n_tokens,
  least(prompt_len, len(ids))::INTEGER AS prompt_len, is_truncated,
  list_sum(ids)::BIGINT AS id_sum,
  list_sum(list_transform(ids, lambda x, i: x::BIGINT * i))::BIGINT AS id_positions,
  {labels} AS label_sum, {extra}
  len(ids)::BIGINT AS mask_sum
FROM masked WHERE drop_reason IS NULL"""
MASKED_LABELS = (
    "list_sum(list_transform(ids, lambda x, i: "
    "(CASE WHEN i <= prompt_len THEN -100 ELSE x END)::BIGINT * i))::BIGINT"
)
PLAIN_LABELS = "list_sum(list_transform(ids, lambda x, i: x::BIGINT * i))::BIGINT"


def _mask_checks(spark: SparkSession, sf_dir: str, spec: tz.TokenizeSpec, *extra) -> DataFrame:
    kept, _ = tz.valid_and_dropped(tz.tokenize(irregular(spark, sf_dir), spec))
    return kept.select(
        "example_id",
        "split",
        "n_tokens",
        "prompt_len",
        "is_truncated",
        id_sum("input_ids").alias("id_sum"),
        position_sum("input_ids").alias("id_positions"),
        position_sum("labels").alias("label_sum"),
        *extra,
        id_sum("attention_mask").alias("mask_sum"),
    )


@plan(IRREGULAR_MASKED + MASK_SQL.format(labels=MASKED_LABELS, extra=""))
def assistant_only_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mask_checks(spark, sf_dir, SPEC)


@plan(IRREGULAR_MASKED + MASK_SQL.format(labels=PLAIN_LABELS, extra=""))
def full_conversation_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mask_checks(spark, sf_dir, tz.for_mode(SPEC, "full_conversation"))


@plan(
    IRREGULAR_MASKED
    + MASK_SQL.format(
        labels=PLAIN_LABELS,
        extra="(least(prompt_len, len(ids)) * 0.25 + len(ids) - least(prompt_len, len(ids)))"
        "::DOUBLE AS weight_sum, ",
    )
)
def weighted_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = F.aggregate("loss_weights", F.lit(0.0), lambda acc, w: acc + w)
    return _mask_checks(
        spark, sf_dir, tz.for_mode(SPEC, "weighted", WEIGHT), weights.alias("weight_sum")
    )


@plan(
    IRREGULAR_MASKED
    + """
SELECT split, sum(len(ids))::BIGINT AS tokens,
  sum(len(ids))::BIGINT AS supervised_tokens,
  sum(least(prompt_len, len(ids)) * 0.25 + len(ids) - least(prompt_len, len(ids)))::DOUBLE
    AS weight_sum
FROM masked WHERE drop_reason IS NULL GROUP BY split"""
)
def supervised_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = tz.for_mode(SPEC, "weighted", WEIGHT)
    return tz.supervised_tokens(tz.tokenize(irregular(spark, sf_dir), spec), spec)


BATCH_SIZE = 8
BATCHED_SQL = (
    IRREGULAR_MASKED
    + f""",
batched AS (
  SELECT *, (row_number() OVER (ORDER BY md5(example_id || '|{SEED}'), example_id) - 1)
    // {BATCH_SIZE} AS batch_id
  FROM masked WHERE drop_reason IS NULL)"""
)


def _batches(spark: SparkSession, sf_dir: str, spec: tz.TokenizeSpec) -> DataFrame:
    kept, _ = tz.valid_and_dropped(tz.tokenize(irregular(spark, sf_dir), spec))
    return batching.assign_batches(kept, ["example_id"], BATCH_SIZE, SEED)


@plan(
    BATCHED_SQL
    + """,
lens AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS batch_len FROM batched)
SELECT batch_id, example_id, batch_len::INTEGER AS batch_len,
  list_sum(ids)::BIGINT AS id_sum, len(ids)::BIGINT AS mask_sum,
  (list_sum(ids[prompt_len + 1:]) - 100 * (least(prompt_len, len(ids)) + batch_len - len(ids)))
    ::BIGINT AS label_sum
FROM lens"""
)
def padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded batches, each padded to its longest row."""
    kept, _ = tz.valid_and_dropped(tz.tokenize(irregular(spark, sf_dir), SPEC))
    padded = batching.padded_batches(kept, ["example_id"], BATCH_SIZE, SEED)
    return padded.select(
        "batch_id",
        "example_id",
        F.size("input_ids").alias("batch_len"),
        id_sum("input_ids").alias("id_sum"),
        id_sum("attention_mask").alias("mask_sum"),
        id_sum("labels").alias("label_sum"),
    )


@plan(
    BATCHED_SQL
    + """,
terms AS (
  SELECT batch_id, unnest(list_transform(ids, lambda x, i: {'id': x, 'at': i,
    'w': CASE WHEN i <= prompt_len THEN 0.25 ELSE 1.0 END,
    'loss': ids[i - 1] % 7 * 0.125})) AS t FROM batched)
SELECT batch_id, round(sum(t.loss * t.w) / sum(t.w), 6)::DOUBLE AS loss,
  round(sum(t.w), 6)::DOUBLE AS weight_sum
FROM terms WHERE t.at > 1 GROUP BY batch_id"""
)
def weighted_batch_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean of per-token losses per batch; losses derive from the ids."""
    rows = _batches(spark, sf_dir, tz.for_mode(SPEC, "weighted", WEIGHT))
    losses = rows.withColumn(
        "token_loss", F.transform("input_ids", lambda x: (x % 7) * F.lit(0.125))
    )
    return batching.batch_loss(losses).select(
        "batch_id",
        F.round("loss", 6).alias("loss"),
        F.round("weight_sum", 6).alias("weight_sum"),
    )
