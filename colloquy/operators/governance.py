"""Governance summaries from rows, and the gates that act on a summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import policy


class PolicyGateError(RuntimeError):
    """A governance gate refused to go on."""


def class_counts(df: DataFrame, release: list[str], policy_class: str = "policy_class") -> DataFrame:
    """Rows per release and normalized class; blank classes are skipped."""
    token = policy.class_token(F.col(policy_class))
    return (
        df.select(*release, token.alias("policy_class"))
        .where(F.col("policy_class") != "")
        .groupBy(*release, "policy_class")
        .agg(F.count("*").alias("rows"))
    )


def governance_from_rows(
    df: DataFrame, release: list[str], policy_class: str = "policy_class"
) -> DataFrame:
    """Governance block per release, counted from its rows.

    Rows are counted per class first, so the lists below hold one entry per class, as
    a manifest does. Where a class column may hold free text, use ``class_counts``.
    """
    counts = class_counts(df, release, policy_class)
    ranked = F.struct(
        policy.class_rank(F.col("policy_class")).alias("rank"),
        F.col("policy_class").alias("key"),
        F.col("rows").alias("value"),
    )
    blocks = counts.groupBy(*release).agg(F.array_sort(F.collect_list(ranked)).alias("_classes"))
    classes = F.col("_classes")
    return blocks.select(
        *release,
        F.transform(classes, lambda c: c["key"]).alias("policy_classes_present"),
        F.map_from_entries(
            F.transform(classes, lambda c: F.struct(c["key"], c["value"]))
        ).alias("policy_class_counts"),
        F.element_at(classes, -1)["key"].alias("max_policy_class"),
    )


def with_gates(summary: DataFrame, classes: str = "classes_present") -> DataFrame:
    """Add ``needs_confirmation`` and ``blocks_publishing`` to summary rows."""
    return summary.withColumns(
        {
            "needs_confirmation": policy.needs_confirmation(F.col(classes)),
            "blocks_publishing": policy.blocks_publishing(F.col(classes)),
        }
    )


def gate_decision(push: Column, assume_yes: Column) -> Column:
    """``blocked``, ``needs_approval`` or ``pass`` for gated summary rows."""
    return (
        F.when(F.col("blocks_publishing") & push, F.lit("blocked"))
        .when(F.col("needs_confirmation") & ~assume_yes, F.lit("needs_approval"))
        .otherwise(F.lit("pass"))
    )


def enforce_gates(summary: DataFrame, *, push: bool, assume_yes: bool) -> None:
    """Raise unless the one-row summary passes; without approval it fails closed."""
    gated = with_gates(summary)
    decision = gate_decision(F.lit(push), F.lit(assume_yes))
    outcome = gated.select(decision.alias("decision")).first()["decision"]
    if outcome == "blocked":
        raise PolicyGateError("the release holds class P4 and must not be published")
    if outcome == "needs_approval":
        raise PolicyGateError("the release holds class P3 or P4; pass assume_yes to go on")
