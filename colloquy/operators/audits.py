"""Corpus, inference, artifact and repository audits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import completions, tokens
from colloquy.functions import messages as msg

NO_FINAL_EOS = "No EOS token at end of sequence"
FINAL_EOS_WINDOW = 3


def audit_sequences(df: DataFrame, eos_id: int, ids: str = "input_ids") -> DataFrame:
    """End-token positions, final-end check and issues of each token sequence."""
    positions = tokens.eos_positions(F.col(ids), eos_id)
    audited = df.withColumns(
        {
            "sequence_length": F.size(ids),
            "eos_positions": positions,
            "first_tokens": tokens.first_tokens(F.col(ids)),
            "last_tokens": tokens.last_tokens(F.col(ids)),
        }
    )
    final = tokens.ends_with_eos(F.col(ids), F.col("eos_positions"), FINAL_EOS_WINDOW)
    audited = audited.withColumns(
        {"eos_count": F.size("eos_positions"), "has_final_eos": final}
    )
    missing = ~F.col("has_final_eos") & (F.col("sequence_length") > 0)
    return audited.withColumn(
        "issues", F.array_compact(F.array(F.when(missing, F.lit(NO_FINAL_EOS))))
    )


def audit_rendered(
    df: DataFrame, template, tokenizer, eos_id: int, decode: Callable[[Column], Column], *, family: str = "generic"
) -> DataFrame:
    """``messages`` as they go into training: normalized, rendered, encoded, audited, and decoded at both ends.

    A list that the template refuses has the error among its issues, and no tokens. Rows whose
    messages are null count as empty lists.
    """
    items = F.coalesce(msg.normalize_messages(F.col("messages"), family), F.array().cast(f"array<{msg.MESSAGE.simpleString()}>"))
    shown = df.withColumn("_items", items)
    shown = shown.withColumn("template_error", template.error(F.col("_items")))
    refused = F.col("template_error").isNotNull()
    rendered = shown.withColumn("rendered", F.when(refused, F.lit("")).otherwise(template.render(F.col("_items"))))
    encoded = rendered.withColumn("input_ids", tokenizer.encode(F.col("rendered"))).drop("_items")
    audited = audit_sequences(encoded, eos_id)
    problem = F.when(refused, F.concat(F.lit("Chat template error: "), "template_error"))
    return audited.withColumns(
        {
            "issues": F.concat(F.array_compact(F.array(problem)), "issues"),
            "first_text": decode(F.col("first_tokens")),
            "last_text": decode(F.col("last_tokens")),
        }
    )


def corpus_summary(audited: DataFrame) -> DataFrame:
    """One row of totals; lengths over non-empty sequences, zeros for no rows."""
    length = F.when(F.col("sequence_length") > 0, F.col("sequence_length"))

    def zero(value: Column) -> Column:
        return F.coalesce(value, F.lit(0))

    return audited.agg(
        F.count("*").alias("samples_analyzed"),
        F.count_if("has_final_eos").alias("samples_with_final_eos"),
        F.count_if(F.size("issues") > 0).alias("samples_with_issues"),
        zero(F.min(length)).alias("sequence_length_min"),
        zero(F.max(length)).alias("sequence_length_max"),
        zero(F.avg(length)).alias("sequence_length_avg"),
        zero(F.min("eos_count")).alias("eos_count_min"),
        zero(F.max("eos_count")).alias("eos_count_max"),
        zero(F.avg("eos_count")).alias("eos_count_avg"),
    )


def corpus_recommendation(summary: DataFrame) -> DataFrame:
    """A recommendation row if any sample lacks a final end token."""
    done, total = F.col("samples_with_final_eos"), F.col("samples_analyzed")
    return summary.where(done < total).select(
        F.format_string(
            "Only %d/%d samples have proper EOS termination. Check chat template application.",
            done,
            total,
        ).alias("recommendation")
    )


def issue_histogram(audited: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Issues with their count and ``issue (Nx)`` text, most frequent first."""
    by = by or []
    # The outer form: for the plain one Spark repeats the issue expressions, loop
    # detection included, in a filter below.
    counts = (
        audited.select(*by, F.explode_outer("issues").alias("issue"))
        .where(F.col("issue").isNotNull())
        .groupBy(*by, "issue")
        .agg(F.count("*").alias("occurrences"))
    )
    label = F.concat(F.col("issue"), F.lit(" ("), F.col("occurrences"), F.lit("x)"))
    return counts.withColumn("label", label).orderBy(F.desc("occurrences"), "issue", *by)


def audit_by_reason(df: DataFrame, text: str = "text", reason: str = "done_reason") -> DataFrame:
    """Loop and stop flags of completions that come with a done reason."""
    flagged = df.withColumns(
        {
            "loop_pattern": completions.loop_pattern(F.col(text)),
            "stopped_at_eos": completions.stopped_by_reason(F.col(reason)),
        }
    )
    return flagged.withColumns(
        {
            "detected_loop": F.col("loop_pattern").isNotNull(),
            "issues": completions.reason_stop_issues(
                F.col("stopped_at_eos"), F.col(reason), F.col("loop_pattern")
            ),
        }
    )


def audit_by_tokens(df: DataFrame, eos_id: int, text: str = "text", ids: str = "ids") -> DataFrame:
    """Loop and stop flags of completions that come with their generated ids."""
    flagged = df.withColumns(
        {
            "loop_pattern": completions.loop_pattern(F.col(text)),
            "stopped_at_eos": completions.stopped_by_tokens(F.col(ids), eos_id),
        }
    )
    return flagged.withColumns(
        {
            "detected_loop": F.col("loop_pattern").isNotNull(),
            "issues": completions.token_stop_issues(
                F.col("stopped_at_eos"), F.col("loop_pattern")
            ),
        }
    )


# What to check when completions loop, for runs judged by their token
# ids and for runs judged by the reason a server gave.
LOOP_ADVICE_BY_TOKENS = (
    "Infinite loops detected. Check: 1) pad_token != eos_token in training, "
    "2) Chat template matches training format, 3) GGUF has correct EOS token ID."
)
LOOP_ADVICE_BY_REASON = (
    "Infinite loops detected. Check: 1) GGUF has correct chat template, "
    "2) Modelfile has correct stop tokens, 3) Training used distinct pad/eos tokens."
)


def inference_summary(
    audited: DataFrame, model: str = "model", loop_advice: str = LOOP_ADVICE_BY_REASON
) -> DataFrame:
    """Prompts, stops, loops, verdict and advice per model.

    Issue texts are not gathered per model; see ``issue_histogram``.
    """
    counts = audited.groupBy(model).agg(
        F.count("*").alias("prompts_tested"),
        F.count_if("stopped_at_eos").alias("successful_stops"),
        F.count_if("detected_loop").alias("detected_loops"),
        F.sum(F.size("issues").cast("bigint")).alias("issue_count"),
    )
    verdict = (
        F.when(F.col("detected_loops") > 0, "loop")
        .when(F.col("successful_stops") == F.col("prompts_tested"), "ok")
        .otherwise("not_stopped")
    )
    advice = F.when(F.col("detected_loops") > 0, F.lit(loop_advice))
    return counts.withColumns({"verdict": verdict, "recommendation": advice})


#: What an issue code of a tokenizer or artifact says, and what to do about it (if anything).
ISSUES = {
    "pad_overwritten": ("training replaces a pad token of its own by the end token", None),
    "pad_in_loss": (
        "the pad token is the end token while the loss covers whole conversations",
        "keep the tokenizer's own pad token; fall back to the end token only without one",
    ),
    "no_chat_template": ("the tokenizer brings no chat template", "choose a model that has one, or supply it"),
    "no_packed_template": ("the artifact holds no chat template", "state the template where the artifact is served"),
    "no_packed_end": ("the artifact holds no end token", None),
    "packed_pad_is_end": ("pad and end token of the artifact are the same", None),
}


def _codes(**found: Column) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in found.items()]))


def _looked_up(issues: Column, place: int) -> Column:
    texts = F.create_map(*[F.lit(part) for code, row in ISSUES.items() if row[place] for part in (code, row[place])])
    return F.array_compact(F.transform(issues, lambda code: F.try_element_at(texts, code)))


def issue_texts(issues: Column) -> Column:
    return _looked_up(issues, 0)


def issue_advice(issues: Column) -> Column:
    return _looked_up(issues, 1)


def _with_issues(df: DataFrame, **found: Column) -> DataFrame:
    coded = df.withColumn("issues", _codes(**found))
    return coded.withColumn("recommendations", issue_advice(F.col("issues")))


def audit_tokenizers(df: DataFrame) -> DataFrame:
    """Issue codes and recommendations per tokenizer configuration.

    Input: ``loss_mode, eos_id, pad_id`` (as loaded), ``pad_id_after`` (as trained)
    and ``chat_template``.
    """
    same_before = F.coalesce(F.col("pad_id") == F.col("eos_id"), F.lit(False))
    same_after = F.coalesce(F.col("pad_id_after") == F.col("eos_id"), F.lit(False))
    whole = F.coalesce(F.col("loss_mode") == "full_conversation", F.lit(False))
    return _with_issues(
        df.withColumn("pad_equals_eos", same_after),
        pad_overwritten=~same_before & same_after,
        pad_in_loss=same_after & whole,
        no_chat_template=F.coalesce(F.col("chat_template"), F.lit("")) == "",
    )


def audit_artifacts(df: DataFrame) -> DataFrame:
    """Issue codes and recommendations per packaged artifact: ``eos_id, pad_id, chat_template``."""
    templated = F.coalesce(F.trim(F.col("chat_template")) != "", F.lit(False))
    return _with_issues(
        df.withColumn("has_chat_template", templated),
        no_packed_template=~templated,
        no_packed_end=F.col("eos_id").isNull(),
        packed_pad_is_end=F.coalesce(F.col("pad_id") == F.col("eos_id"), F.lit(False)),
    )


def repository_content(listing: DataFrame, repo: str = "repo", file: str = "file") -> DataFrame:
    """Class of each repository by the files it lists."""
    name = F.col(file)
    adapter = (name == "adapter_config.json") | name.startswith("adapter_model")
    weights = name.startswith("model.safetensors") | name.startswith("pytorch_model")
    flags = listing.groupBy(repo).agg(
        F.bool_or(adapter).alias("_adapter"),
        (F.bool_or(name == "config.json") & F.bool_or(weights)).alias("_full"),
    )
    content = (
        F.when(F.col("_adapter") & F.col("_full"), "mixed")
        .when(F.col("_adapter"), "adapter")
        .when(F.col("_full"), "full")
        .otherwise("unknown")
    )
    return flags.select(repo, content.alias("content"))


# Preferred quantizations, best first.
QUANT_PRIORITY = ("Q4_K_M", "Q4_K_S", "Q5_K_M", "Q5_K_S", "Q8_0")


def preferred_artifact(
    listing: DataFrame, repo: str = "repo", file: str = "file", position: str = "position"
) -> DataFrame:
    """The artifact to use per repository: best quantization, then first listed.

    An aggregate, not a window: partial minima leave one row per repository and task.
    """
    name = F.lower(F.col(file))
    rank = F.lit(len(QUANT_PRIORITY))
    for index in reversed(range(len(QUANT_PRIORITY))):
        rank = F.when(F.contains(name, F.lit(QUANT_PRIORITY[index].lower())), index).otherwise(rank)
    packaged = listing.where(F.col(file).endswith(".gguf"))
    order = F.struct(rank.alias("rank"), F.col(position).alias("position"))
    return packaged.groupBy(repo).agg(F.min_by(F.col(file), order).alias("selected_file"))
