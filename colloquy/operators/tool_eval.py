"""Evaluation of predicted tool calls against expected ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import jsontext
from colloquy.functions.text import collapse_whitespace

CALL_KEY = ["example_id", "call_index"]


def pair_calls(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """Expected calls with the prediction at the same place, if there is one.

    Both sides: ``example_id, call_index, name, arguments`` (JSON text); the key is
    unique on each side.
    """
    guesses = predicted.select(
        *CALL_KEY,
        F.col("name").alias("predicted_name"),
        F.col("arguments").alias("predicted_arguments"),
    )
    return expected.join(guesses, CALL_KEY, "left")


def _fields(parsed: Column) -> Column:
    """Normalized values by key; an empty map for what is no object."""
    values = F.try_variant_get(parsed, "$", "map<string,variant>")
    return F.coalesce(
        F.transform_values(values, lambda key, value: _scalar(value)),
        F.create_map().cast("map<string,string>"),
    )


def _scalar(value: Column) -> Column:
    """Value as normalized text: numbers by value, text without case and spacing.

    A numeral in quotes counts as the number it names.
    """
    text = F.try_variant_get(value, "$", "string")
    plain = F.lower(collapse_whitespace(F.coalesce(text, F.to_json(value))))
    number = F.when(plain.rlike(r"\A[+-]?\d+(\.\d+)?(e[+-]?\d+)?\z"), plain.try_cast("double"))
    return F.coalesce(number.cast("string"), plain)


def compare_calls(paired: DataFrame) -> DataFrame:
    """Add decision, strict and relaxed matches and key counts to paired calls.

    Strict: equal JSON values. Relaxed: the same keys with equal normalized scalars.
    Precision: share of predicted keys whose normalized value is the expected one.
    """
    wanted, got = F.col("_wanted"), F.col("_got")
    shared = F.filter(
        F.map_keys(got),
        lambda key: F.map_contains_key(wanted, key)
        & F.equal_null(F.try_element_at(wanted, key), F.try_element_at(got, key)),
    )
    right_name = F.coalesce(F.col("name") == F.col("predicted_name"), F.lit(False))
    same_json = F.to_json(F.col("_wanted_json")) == F.to_json(F.col("_got_json"))
    relaxed = (F.col("matching_keys") == F.col("expected_keys")) & (
        F.col("matching_keys") == F.col("predicted_keys")
    )
    # Parsed in a step of its own, so that each text is parsed once.
    parsed = paired.withColumns(
        {
            "_wanted_json": jsontext.strict_json(F.col("arguments")),
            "_got_json": jsontext.strict_json(F.col("predicted_arguments")),
        }
    )
    keyed = parsed.withColumns(
        {
            "_wanted": _fields(F.col("_wanted_json")),
            "_got": _fields(F.col("_got_json")),
            "decision_match": right_name,
            "strict_match": right_name & F.coalesce(same_json, F.lit(False)),
        }
    )
    counted = keyed.withColumns(
        {
            "expected_keys": F.size(wanted),
            "predicted_keys": F.size(got),
            "matching_keys": F.size(shared),
        }
    )
    valid = F.col("_got_json").isNotNull()
    return counted.withColumn("relaxed_match", F.col("decision_match") & relaxed & valid).drop(
        "_wanted", "_got", "_wanted_json", "_got_json"
    )


def evaluation_report(
    compared: DataFrame, scenario: str = "scenario_type", policy_class: str = "policy_class"
) -> DataFrame:
    """Metrics per scenario and class, per scenario, per class and overall.

    The four groupings come from one pass over the rows.
    """
    flags = compared.groupingSets(
        [[F.col(scenario), F.col(policy_class)], [F.col(scenario)], [F.col(policy_class)], []],
        F.col(scenario),
        F.col(policy_class),
    ).agg(
        F.grouping_id().alias("grouping"),
        F.count("*").alias("calls"),
        F.avg(F.col("decision_match").cast("double")).alias("decision_accuracy"),
        F.avg(F.col("strict_match").cast("double")).alias("strict_match"),
        F.avg(F.col("relaxed_match").cast("double")).alias("relaxed_match"),
        F.sum("matching_keys").alias("_matching"),
        F.sum("predicted_keys").alias("_predicted"),
    )
    precision = F.coalesce(F.try_divide("_matching", "_predicted"), F.lit(0.0))
    return flags.withColumn("argument_precision", precision).drop("_matching", "_predicted")
