"""Policy classes: rank, order, summary of a governance block."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions import jsontext, text

# Class order and the classes that need confirmation.
POLICY_CLASSES = ("P0", "P1", "P2", "P3", "P4")
CONFIRM_CLASSES = ("P3", "P4")
BLOCKED_CLASS = "P4"
UNKNOWN_RANK = 999


def class_token(value: Column) -> Column:
    return F.upper(text.strip(F.coalesce(value, F.lit(""))))


def class_rank(token: Column) -> Column:
    rank = F.when(token == POLICY_CLASSES[0], F.lit(0))
    for position, name in enumerate(POLICY_CLASSES[1:], start=1):
        rank = rank.when(token == name, F.lit(position))
    return rank.otherwise(F.lit(UNKNOWN_RANK))


def ordered_classes(tokens: Column) -> Column:
    """Distinct non-blank tokens, known classes by rank, unknown ones last."""
    distinct = F.array_distinct(F.filter(tokens, lambda token: token != ""))
    ranked = F.transform(
        distinct, lambda token: F.struct(class_rank(token).alias("rank"), token.alias("token"))
    )
    return F.transform(F.array_sort(ranked), lambda item: item["token"])


def integer_count(value: Column) -> Column:
    """A VARIANT count as integer: numbers truncate, numeral text parses, else null."""
    written = F.try_variant_get(value, "$", "string")
    numeral = F.when(
        written.rlike(rf"\A{text.WHITESPACE}*[+-]?\d+(?:_\d+)*{text.WHITESPACE}*\z"),
        F.regexp_replace(text.strip(written), "_", "").try_cast("bigint"),
    )
    return (
        F.when(jsontext.is_string(value), numeral)
        .when(jsontext.is_integer(value), F.try_variant_get(value, "$", "bigint"))
        .when(
            jsontext.is_fraction(value),
            F.try_variant_get(value, "$", "double").try_cast("bigint"),
        )
        .when(
            jsontext.is_boolean(value),
            F.try_variant_get(value, "$", "boolean").cast("bigint"),
        )
    )


def summary(governance: Column) -> dict[str, Column]:
    """Summary columns of a governance block given as VARIANT (null: no block)."""
    present = jsontext.is_object(governance)
    raw_counts = F.try_variant_get(governance, "$.policy_class_counts", "map<string,variant>")
    entries = F.filter(
        F.transform(
            F.map_entries(raw_counts),
            lambda e: F.struct(
                class_token(e["key"]).alias("key"), integer_count(e["value"]).alias("value")
            ),
        ),
        lambda e: (e["key"] != "") & e["value"].isNotNull(),
    )
    entries = F.coalesce(entries, F.array().cast("array<struct<key:string,value:bigint>>"))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    # The same class may be written in several ways; the last entry counts.
    counts = F.map_from_entries(
        F.transform(
            keys,
            lambda key: F.struct(
                key.alias("key"),
                F.element_at(F.filter(entries, lambda e: e["key"] == key), -1)["value"].alias(
                    "value"
                ),
            ),
        )
    )
    raw_classes = F.try_variant_get(governance, "$.policy_classes_present", "array<variant>")
    named = F.transform(
        raw_classes,
        lambda item: class_token(F.try_variant_get(item, "$", "string")),
    )
    named = F.filter(F.coalesce(named, F.array().cast("array<string>")), lambda t: t != "")
    classes = ordered_classes(F.when(F.size(named) > 0, named).otherwise(keys))
    declared = class_token(F.try_variant_get(governance, "$.max_policy_class", "string"))
    highest = (
        F.when(declared != "", declared)
        .when(F.size(classes) > 0, F.element_at(classes, -1))
        .otherwise(F.lit("unknown"))
    )
    return {
        "has_metadata": present,
        "classes_present": F.when(present, classes).otherwise(F.array().cast("array<string>")),
        "class_counts": F.when(present, counts).otherwise(
            F.create_map().cast("map<string,bigint>")
        ),
        "max_policy_class": F.when(present, highest).otherwise(F.lit("unknown")),
    }


def needs_confirmation(classes: Column) -> Column:
    return F.arrays_overlap(classes, F.array(*[F.lit(c) for c in CONFIRM_CLASSES]))


def blocks_publishing(classes: Column) -> Column:
    return F.array_contains(classes, BLOCKED_CLASS)
