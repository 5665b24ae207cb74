"""The model comparison table: one row per prompt, three columns per model.

Rows carry ``row_id``, their unique position, because "the first row with a prompt"
needs an order. Updates join on that unique id. Where rows meet a set of prompts they do so
by a digest of the text, and rows of a prompt that fills a large part of the table are
salted, so that no prompt piles up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIDDEN_SUFFIXES = ("_time", "_timestamp")

# A prompt is heavy with more rows than HEAVY_ROWS and one in HEAVY_SHARE of all rows; its
# rows are dealt over SALTS groups. So there are fewer than HEAVY_SHARE heavy prompts.
HEAVY_ROWS, HEAVY_SHARE, SALTS = 100_000, 10_000, 64


def _digested(df: DataFrame) -> DataFrame:
    return df.withColumn("_digest", F.sha2(F.col("prompt").cast("binary"), 256))


def where_prompt(rows: DataFrame, digests: DataFrame, how: str) -> DataFrame:
    """Rows whose prompt's digest is among ``_digest`` (``left_semi``), or is not (``left_anti``).

    Heavy prompts are counted first, combined before the shuffle; a broadcast of their
    bounded number marks them. No text is a join key.
    """
    rows_by_digest = _digested(rows)
    total = rows.agg(F.count("*")).scalar()
    heavy = F.broadcast(
        rows_by_digest.groupBy("_digest")
        .count()
        .where((F.col("count") > HEAVY_ROWS) & (F.col("count") * HEAVY_SHARE > total))
        .select("_digest", F.lit(True).alias("_heavy"))
    )
    dealt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    left = (
        rows_by_digest.withColumn("_dealt", dealt)
        .join(heavy, "_digest", "left")
        .withColumn("_salt", F.when(F.col("_heavy"), F.col("_dealt")).otherwise(0))
    )
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    right = (
        digests.select("_digest")
        .distinct()
        .join(heavy, "_digest", "left")
        .select(
            "_digest",
            F.explode(F.when(F.col("_heavy"), every).otherwise(F.array(F.lit(0)))).alias("_salt"),
        )
    )
    return left.join(right, ["_digest", "_salt"], how).select(*rows.columns)


def model_columns(model: str) -> tuple[str, str, str]:
    return model, f"{model}_time", f"{model}_timestamp"


def _with_model(table: DataFrame, model: str) -> DataFrame:
    kinds = dict(zip(model_columns(model), ("string", "double", "string"), strict=True))
    return table.withColumns(
        {c: F.lit(None).cast(k) for c, k in kinds.items() if c not in table.columns}
    )


def upsert_responses(
    table: DataFrame, responses: DataFrame, model: str, stamp: Column
) -> DataFrame:
    """Write ``(position, prompt, response, seconds)`` into the model's columns.

    The first table row with the prompt is updated, the last response of a prompt
    winning; responses to unknown prompts are appended, each as its own row, with
    ids after the last one. Other columns stay as they are.
    """
    table = _with_model(table, model)
    text, seconds, at = model_columns(model)
    known = _digested(table).groupBy("_digest").agg(F.min("row_id").alias("row_id"))
    latest = _digested(responses).groupBy("_digest").agg(
        F.max_by(F.struct("response", "seconds"), "position").alias("_new")
    )
    updates = known.join(latest, "_digest").select("row_id", "_new")
    updated = (
        table.join(updates, "row_id", "left")
        .withColumns(
            {
                text: F.when(F.col("_new").isNotNull(), F.col("_new.response")).otherwise(F.col(text)),
                seconds: F.when(F.col("_new").isNotNull(), F.col("_new.seconds")).otherwise(
                    F.col(seconds)
                ),
                at: F.when(F.col("_new").isNotNull(), stamp).otherwise(F.col(at)),
            }
        )
        .drop("_new")
    )
    following = table.agg(F.coalesce(F.max("row_id"), F.lit(-1)) + 1).scalar()
    appended = (
        where_prompt(responses, known, "left_anti")
        .select(
            (following + F.col("position")).alias("row_id"),
            "prompt",
            F.col("response").alias(text),
            F.col("seconds").cast("double").alias(seconds),
            stamp.alias(at),
        )
    )
    return updated.unionByName(appended, allowMissingColumns=True)


def missing_responses(prompts: DataFrame, table: DataFrame, model: str) -> DataFrame:
    """Prompts that are absent or whose first row has no response of the model."""
    if model not in table.columns:
        return prompts
    firsts = _digested(table).groupBy("_digest").agg(
        F.min_by(F.col(model).isNotNull(), "row_id").alias("_answered")
    )
    return where_prompt(prompts, firsts.where("_answered"), "left_anti")


def shown_rows(table: DataFrame, prompts: DataFrame) -> DataFrame:
    """Rows of listed prompts, with the text column of each model only."""
    hidden = {c for c in table.columns if c.endswith(HIDDEN_SUFFIXES)} | {"prompt", "vanilla"}
    models = [c for c in table.columns if c not in hidden and c != "row_id"]
    listed = where_prompt(table, _digested(prompts), "left_semi")
    lead = [c for c in ("row_id", "prompt", "vanilla") if c in table.columns]
    return listed.select(*lead, *models)


def side_by_side(table: DataFrame, prompts: DataFrame, base: str, tuned: str) -> DataFrame:
    """Base and tuned response of the first row of each listed prompt."""
    pair = F.struct(F.col(base).alias("base"), F.col(tuned).alias("tuned"))
    return (
        _digested(where_prompt(table, _digested(prompts), "left_semi"))
        .groupBy("_digest")
        .agg(F.min_by(pair, "row_id").alias("pair"), F.min_by("prompt", "row_id").alias("prompt"))
        .select("prompt", F.col("pair.base").alias("base"), F.col("pair.tuned").alias("tuned"))
    )
