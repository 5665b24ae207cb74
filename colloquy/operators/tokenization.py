"""From supervised rows to token ids, masks, drop accounting and fit statistics.

The whole path from row to arrays is one row-local projection, so it runs the same
on a batch and on a stream, and a query that needs counts only never builds arrays.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import messages as msg
from colloquy.functions import tokens as tok
from colloquy.functions.rendering import PlainTemplate
from colloquy.functions.text import preview

INVALID_SHAPE = "invalid_row_shape"
NO_MESSAGES = "empty_prompt_messages"
NO_USER_QUERY = "missing_user_query"
TEMPLATE_ERROR = "chat_template_error"


@dataclass(frozen=True)
class TokenizeSpec:
    """How to tokenize. ``loss_mode`` has no default on purpose."""

    max_seq_len: int
    loss_mode: str
    prompt_loss_weight: float = 0.0
    family: str = "generic"
    template: object = field(default_factory=PlainTemplate)
    tokenizer: object = field(default_factory=tok.CharTokenizer)
    enable_thinking: bool = True
    keep_null_content: bool = False

    def __post_init__(self):
        tok.check_loss(self.loss_mode, self.prompt_loss_weight)
        if self.loss_mode == "weighted" and self.prompt_loss_weight == 0.0:
            warnings.warn("weighted loss with prompt weight 0.0 ignores the prompt", stacklevel=3)

    @property
    def thinks(self) -> bool:
        """Thinking can be switched off for one family only."""
        return self.enable_thinking or self.family != "qwen"


def assistant_only(max_seq_len: int, **options) -> TokenizeSpec:
    """Preset: loss on the target only."""
    return TokenizeSpec(max_seq_len=max_seq_len, loss_mode="assistant_only", **options)


def _or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def classify(df: DataFrame, spec: TokenizeSpec) -> DataFrame:
    """Normalize rows and add ``drop_reason`` (null: kept), prompt, target and texts.

    Rows from the example builder may carry ``omitted_messages``, ``omitted_tokens``,
    ``asked`` and ``has_system``: exact totals of context that truncation would cut anyway.
    """
    if "omitted_tokens" in df.columns and not spec.template.renders_tails:
        raise ValueError(
            "contexts that were shortened for truncation need a template that renders line by "
            "line; use budgeted contexts and drop their omitted_* columns"
        )
    if "omitted_tokens" in df.columns and "has_system" not in df.columns and spec.template.rejects_system:
        raise ValueError("a template that refuses system messages needs has_system beside shortened contexts")
    kind = msg.MESSAGE.simpleString()
    target_text = _or_null(df, "target_text", "string")
    normalize = lambda item: msg.normalize_message(
        item, spec.family, keep_null_content=spec.keep_null_content
    )
    if "target_message" in df.columns:
        target = normalize(F.col("target_message"))
    else:
        target = F.lit(None).cast(kind)
    prompt = msg.normalize_messages(
        F.col("messages"), spec.family, keep_null_content=spec.keep_null_content
    )
    omitted = F.coalesce(_or_null(df, "omitted_messages", "bigint"), F.lit(0))
    asked = F.coalesce(_or_null(df, "asked", "boolean"), F.lit(False))
    has_system = F.coalesce(_or_null(df, "has_system", "boolean"), F.lit(False))

    normalized = df.withColumns({"prompt_messages": prompt, "_target": target})
    prompt, target = F.col("prompt_messages"), F.col("_target")
    usable = F.col("messages").isNotNull() & (target_text.isNotNull() | target.isNotNull())
    shape_reason = (
        F.when(~usable, F.lit(INVALID_SHAPE))
        .when((F.size(prompt) == 0) & (omitted == 0), F.lit(NO_MESSAGES))
        .when(~asked & ~msg.has_user_query(prompt), F.lit(NO_USER_QUERY))
    )
    staged = normalized.withColumns(
        {
            "_shape_reason": shape_reason,
            "target_message_used": msg.resolve_target(target, target_text),
            "effective_target_text": F.coalesce(
                msg.target_content(target, target_text), F.lit("")
            ),
        }
    )
    full = F.concat(prompt, F.array(F.col("target_message_used")))
    template = spec.template
    error = F.when(
        F.col("_shape_reason").isNull(), F.coalesce(template.error(prompt, has_system), template.error(full, has_system))
    )
    staged = staged.withColumn("template_error", error).withColumn(
        "drop_reason",
        F.coalesce(
            F.col("_shape_reason"),
            F.when(F.col("template_error").isNotNull(), F.lit(TEMPLATE_ERROR)),
        ),
    )
    kept = F.col("drop_reason").isNull()
    rendered = staged.withColumns(
        {
            "prompt_text": F.when(
                kept,
                template.render(prompt, generation_prompt=True, enable_thinking=spec.thinks),
            ),
            "full_text": F.when(kept, template.render(full, enable_thinking=spec.thinks)),
        }
    )
    return rendered.drop("_target", "_shape_reason")


def _lengths(classified: DataFrame, spec: TokenizeSpec) -> DataFrame:
    """Token counts of prompt and full text, with omitted context added."""
    omitted = F.coalesce(_or_null(classified, "omitted_tokens", "bigint"), F.lit(0))
    count = spec.tokenizer.count
    full = omitted + count(F.col("full_text"))
    prompt = omitted + count(F.col("prompt_text"))
    overflow = F.greatest(F.col("_full_len") - spec.max_seq_len, F.lit(0))
    kept = F.col("drop_reason").isNull()
    sized = classified.withColumns({"_full_len": full, "_prompt_all": prompt})
    return sized.withColumns(
        {
            "n_tokens": F.when(kept, F.least(F.col("_full_len"), F.lit(spec.max_seq_len)))
            .otherwise(0)
            .cast("int"),
            "prompt_len": F.when(
                kept,
                F.greatest(
                    F.least(F.col("_prompt_all"), F.col("_full_len")) - overflow, F.lit(0)
                ),
            )
            .otherwise(0)
            .cast("int"),
            "is_truncated": F.when(kept, (overflow > 0).cast("int")).otherwise(0),
        }
    ).drop("_full_len", "_prompt_all")


def tokenize(df: DataFrame, spec: TokenizeSpec) -> DataFrame:
    """Add ids, masks and accounting to every row; dropped rows get empty arrays."""
    classified = classify(df, spec)
    kept = F.col("drop_reason").isNull()
    no_ids = F.array().cast("array<int>")
    if spec.tokenizer.splits_by_character:
        sized = _lengths(classified, spec)
        tail = F.right(F.col("full_text"), F.col("n_tokens"))
        sized = sized.withColumn("input_ids", F.when(kept, spec.tokenizer.encode(tail)).otherwise(no_ids))
    else:
        if "omitted_tokens" in df.columns and not spec.tokenizer.splits_at_lines:
            raise ValueError("shortened contexts need a tokenizer that splits by character or at lines")
        omitted = F.coalesce(_or_null(df, "omitted_tokens", "bigint"), F.lit(0))
        nothing = F.lit(None).cast("string")
        if "omitted_tokens" in df.columns:
            # The context is encoded once: prompt and full text differ in their last line only.
            used = F.col("target_message_used")
            some = F.when(kept, spec.template.line(used["role"], used["content"]))
            more = F.when(kept, F.lit(spec.template.opening))
            prompt_n = F.size("_coded.ids") - F.col("_coded.n") + F.col("_coded.m")
        else:
            some, more, prompt_n = F.col("prompt_text"), nothing, F.col("_coded.n")
        coded = spec.tokenizer.encode_and_count(F.col("full_text"), some, more)
        encoded = classified.withColumn("_coded", coded).withColumns({"_ids": F.col("_coded.ids"), "_prompt_n": prompt_n})
        cut = tok.truncate_left(
            F.col("_ids"), F.least(F.col("_prompt_n"), F.size("_ids")), spec.max_seq_len, omitted
        )
        sized = encoded.withColumns(
            {
                "input_ids": F.when(kept, cut.ids).otherwise(no_ids),
                "prompt_len": F.when(kept, cut.prompt_len).otherwise(0),
                "is_truncated": F.when(kept, cut.is_truncated).otherwise(0),
            }
        ).withColumn("n_tokens", F.size("input_ids"))
        sized = sized.drop("_coded", "_ids", "_prompt_n")
    ids, prompt_len = F.col("input_ids"), F.col("prompt_len")
    arrays = {
        "attention_mask": tok.attention_mask(ids),
        "labels": tok.labels(ids, prompt_len, spec.loss_mode),
    }
    if spec.loss_mode == "weighted":
        arrays["loss_weights"] = tok.loss_weights(ids, prompt_len, spec.prompt_loss_weight)
    return sized.withColumns(arrays)


def valid_and_dropped(tokenized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept rows, and the quarantine of dropped ones."""
    kept = F.col("drop_reason").isNull()
    return tokenized.where(kept), tokenized.where(~kept)


def model_columns(kept: DataFrame) -> DataFrame:
    wanted = ("input_ids", "attention_mask", "labels", "loss_weights")
    return kept.select(*[name for name in wanted if name in kept.columns])


def fit_statistics(tokenized: DataFrame, spec: TokenizeSpec, split: str = "split") -> DataFrame:
    """Row accounting per split: total, kept, truncated, fitting, dropped, percentages."""
    kept = F.col("drop_reason").isNull()
    counted = tokenized.groupBy(split).agg(
        F.count("*").alias("rows_total"),
        F.count_if(kept).alias("rows_kept"),
        F.coalesce(F.sum(F.when(kept, F.col("is_truncated"))), F.lit(0)).alias("rows_truncated"),
    )
    return accounted(counted, spec, split)


def accounted(counted: DataFrame, spec: TokenizeSpec, split: str = "split") -> DataFrame:
    """Statistics from ``rows_total, rows_kept, rows_truncated`` per split."""
    rows, truncated = F.col("rows_kept"), F.col("rows_truncated")

    def percent(part: Column) -> Column:
        return F.when(rows <= 0, F.lit(0.0)).otherwise(part / rows * 100.0)

    fit = F.greatest(rows - truncated, F.lit(0))
    weight = spec.prompt_loss_weight if spec.loss_mode == "weighted" else None
    return counted.select(
        split,
        "rows_total",
        "rows_kept",
        rows.alias("rows_valid_before_filter"),
        fit.alias("rows_fit_fully"),
        "rows_truncated",
        (F.col("rows_total") - rows).alias("rows_dropped"),
        percent(fit).alias("fit_pct"),
        percent(truncated).alias("truncated_pct"),
        F.lit(spec.loss_mode).alias("loss_mode"),
        F.lit(weight).cast("double").alias("prompt_loss_weight"),
    )


def drop_histogram(tokenized: DataFrame, split: str = "split") -> DataFrame:
    return (
        tokenized.where(F.col("drop_reason").isNotNull())
        .groupBy(split, "drop_reason")
        .agg(F.count("*").alias("rows"))
    )


def supervised_tokens(tokenized: DataFrame, spec: TokenizeSpec, split: str = "split") -> DataFrame:
    """Per split: tokens, unmasked labels and the sum of loss weights."""
    n = F.size("input_ids").cast("bigint")
    supervised = tok.supervised_count(F.col("labels")).cast("bigint")
    if spec.loss_mode == "weighted":
        weight = F.aggregate("loss_weights", F.lit(0.0), lambda acc, w: acc + w)
    else:
        weight = supervised.cast("double")
    return (
        tokenized.where(F.col("drop_reason").isNull())
        .groupBy(split)
        .agg(
            F.sum(n).alias("tokens"),
            F.sum(supervised).alias("supervised_tokens"),
            F.round(F.sum(weight), 6).alias("weight_sum"),
        )
    )


def require_rows(statistics: DataFrame, histogram: DataFrame, split: str, column: str = "split"):
    """Fail if no row of the split survived; both inputs are small aggregates."""
    row = statistics.where(F.col(column) == split).first()
    if row is None or row["rows_kept"] == 0:
        reasons = {
            r["drop_reason"]: r["rows"]
            for r in histogram.where(F.col(column) == split).take(len(DROP_REASONS))
        }
        total = 0 if row is None else row["rows_total"]
        raise ValueError(f"no {split} row left after tokenization: total={total} reasons={reasons}")


DROP_REASONS = (INVALID_SHAPE, NO_MESSAGES, NO_USER_QUERY, TEMPLATE_ERROR)


def drop_report(classified: DataFrame, split: str = "split") -> DataFrame:
    """One row per dropped row: ids, roles, previews and the template error."""
    dropped = classified.where(F.col("drop_reason").isNotNull())
    prompt = F.when(
        F.col("drop_reason") == INVALID_SHAPE, F.slice("prompt_messages", 1, 0)
    ).otherwise(F.col("prompt_messages"))
    prompt = F.coalesce(prompt, F.slice(F.array(F.col("target_message_used")), 1, 0))
    roles = F.transform(prompt, lambda m: m["role"])
    speakers = F.filter(roles, lambda role: role != "system")
    tail = F.slice(
        prompt, F.greatest(F.size(prompt) - 2, F.lit(1)), F.lit(3)
    )
    tail = F.transform(
        tail,
        lambda m: F.struct(
            m["role"].alias("role"),
            preview(F.coalesce(m["content"], F.lit(""))).alias("content"),
        ),
    )
    # Before a template is tried, the preview shows the raw target text.
    target = F.when(
        F.col("drop_reason") == TEMPLATE_ERROR, F.col("effective_target_text")
    ).otherwise(F.coalesce(_or_null(classified, "target_text", "string"), F.lit("")))
    return dropped.select(
        F.col(split).alias("split"),
        F.col("drop_reason").alias("reason"),
        _or_null(classified, "example_id", "string").alias("example_id"),
        _or_null(classified, "session_id", "string").alias("session_id"),
        _or_null(classified, "target_turn_index", "int").alias("target_turn_index"),
        (
            F.size(prompt) + F.coalesce(_or_null(classified, "omitted_messages", "int"), F.lit(0))
        ).cast("int").alias("message_count"),
        roles.alias("role_sequence"),
        F.try_element_at(speakers, F.lit(-1)).alias("last_non_system_role"),
        preview(target).alias("target_preview"),
        tail.alias("messages_tail"),
        F.when(F.col("template_error").isNotNull(), F.lit("TemplateError")).alias("error_type"),
        F.col("template_error").alias("error"),
    )


def with_payload(report: DataFrame) -> DataFrame:
    """Add the report row as one JSON text."""
    return report.withColumn("payload", F.to_json(F.struct(*report.columns)))


def for_mode(spec: TokenizeSpec, loss_mode: str, weight: float = 0.0) -> TokenizeSpec:
    return replace(spec, loss_mode=loss_mode, prompt_loss_weight=weight)
