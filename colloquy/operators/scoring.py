"""Reward columns, totals and group averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import rewards as rw
from colloquy.functions.text import strip


def score(
    df: DataFrame,
    completion: str = "completion",
    answer: str = "true_answer",
    tags: rw.Tags = rw.THINK_TAGS,
    rewards: Sequence[tuple[str, rw.Reward]] = rw.REWARDS,
) -> DataFrame:
    """Add one column per reward and their sum ``total``.

    Extraction, trimming and number parsing are steps of their own: each regular
    expression runs once per row however many rewards use its result.
    """
    extracted = df.withColumns(
        {
            "_guess": rw.solution(F.col(completion), tags),
            "_number": rw.solution_number(F.col(completion), tags),
            "_answer_trimmed": strip(F.col(answer)),
        }
    ).withColumn("_guess_trimmed", strip(F.col("_guess")))
    valued = extracted.withColumns(
        {
            "_guess_value": rw.to_number(F.col("_guess_trimmed")),
            "_answer_value": rw.to_number(F.col("_answer_trimmed")),
            "_number_value": rw.to_number(F.col("_number")),
        }
    )
    seen = rw.Evidence(
        tags=tags,
        completion=F.col(completion),
        answer=F.col(answer),
        guess=F.col("_guess"),
        guess_trimmed=F.col("_guess_trimmed"),
        guess_value=F.col("_guess_value"),
        answer_trimmed=F.col("_answer_trimmed"),
        answer_value=F.col("_answer_value"),
        number_value=F.col("_number_value"),
    )
    scored = valued.withColumns({name: reward(seen) for name, reward in rewards})
    total = F.lit(0.0)
    for name, _ in rewards:
        total = total + F.col(name)
    return scored.withColumn("total", total).select(
        *df.columns, *[name for name, _ in rewards], "total"
    )


def group_scores(scored: DataFrame, by: list[str], names: Sequence[str]) -> DataFrame:
    """Row count, mean of each reward and mean total per group."""
    means = [F.round(F.avg(name), 6).alias(f"{name}_avg") for name in (*names, "total")]
    return scored.groupBy(*by).agg(F.count("*").alias("completions"), *means)
