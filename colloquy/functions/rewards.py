"""Per-completion reward scores as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.text import WHITESPACE, occurrences, strip

# Line anchors at \n only, dot matches all, Unicode classes.
_FLAGS = "(?dmsU)"
_FLOAT = (
    r"(?i)\A[+-]?(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)"
    r"(?:e[+-]?\d+(?:_\d+)*)?|inf|infinity)\z"
)


@dataclass(frozen=True)
class Tags:
    reasoning_start: str
    reasoning_end: str
    solution_start: str
    solution_end: str

    def all(self) -> tuple[str, str, str, str]:
        return (
            self.reasoning_start,
            self.reasoning_end,
            self.solution_start,
            self.solution_end,
        )


# The two tag sets in use.
THINK_TAGS = Tags("<think>", "</think>", "<SOLUTION>", "</SOLUTION>")
WORKING_OUT_TAGS = Tags(
    "<start_working_out>", "<end_working_out>", "<SOLUTION>", "</SOLUTION>"
)


def _quote(tag: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", tag)


def _format_pattern(tags: Tags) -> str:
    r_start, r_end, s_start, s_end = map(_quote, tags.all())
    return (
        rf"{_FLAGS}^{WHITESPACE}*{r_start}.+?{r_end}.*?{s_start}(.+?){s_end}{WHITESPACE}*$"
    )


def _or_null(extracted: Column) -> Column:
    return F.when(extracted != "", extracted)


def solution(completion: Column, tags: Tags = THINK_TAGS) -> Column:
    """Text between the solution tags of a well-formed completion, else null."""
    return _or_null(F.regexp_extract(completion, _format_pattern(tags), 1))


def solution_number(completion: Column, tags: Tags = THINK_TAGS) -> Column:
    """First run of digits and dots after the solution tag, else null."""
    pattern = rf"{_FLAGS}{_quote(tags.solution_start)}.*?([\d.]+)"
    return _or_null(F.regexp_extract(completion, pattern, 1))


def to_number(trimmed: Column) -> Column:
    """Number in a trimmed text as Python's ``float`` reads it: underscores between
    digits allowed, no type suffixes."""
    digits = F.regexp_replace(trimmed, "_", "")
    return F.when(trimmed.rlike(_FLOAT), digits.try_cast("double")).when(
        trimmed.rlike(r"(?i)\A[+-]?nan\z"), F.lit(float("nan"))
    )


@dataclass(frozen=True)
class Evidence:
    """What the rewards look at, each part computed once per completion."""

    tags: Tags
    completion: Column
    answer: Column
    guess: Column
    guess_trimmed: Column
    guess_value: Column
    answer_trimmed: Column
    answer_value: Column
    number_value: Column


def exact_format(seen: Evidence) -> Column:
    """The guess is found exactly when the whole format matches."""
    return F.when(seen.guess.isNotNull(), 3.0).otherwise(0.0)


def approximate_format(seen: Evidence) -> Column:
    """Half a point for each tag that occurs exactly once, minus half otherwise."""
    score = F.lit(0.0)
    for tag in seen.tags.all():
        score = score + F.when(occurrences(seen.completion, tag) == 1, 0.5).otherwise(-0.5)
    return score


def answer_score(seen: Evidence) -> Column:
    """Closeness of the solution to the answer; a null answer scores 0."""
    ratio = F.try_divide(seen.guess_value, seen.answer_value)
    by_ratio = (
        F.when(ratio.isNull(), -0.5)
        .when(F.isnan(ratio), -1.0)
        .when((ratio >= 0.9) & (ratio <= 1.1), 0.5)
        .when((ratio >= 0.8) & (ratio <= 1.2), 0.25)
        .otherwise(-1.0)
    )
    return (
        F.when(seen.guess.isNull() | seen.answer.isNull(), 0.0)
        .when(seen.guess == seen.answer, 3.0)
        .when(seen.guess_trimmed == seen.answer_trimmed, 1.5)
        .otherwise(by_ratio)
    )


def number_score(seen: Evidence) -> Column:
    """1.5 if the first number after the solution tag equals the answer."""
    equal = (seen.number_value == seen.answer_value) & ~F.isnan(seen.number_value)
    return F.when(equal, 1.5).otherwise(0.0)


Reward = Callable[[Evidence], Column]

# The reward list; pass a longer one to plug in more.
REWARDS: tuple[tuple[str, Reward], ...] = (
    ("format_exact", exact_format),
    ("format_approximate", approximate_format),
    ("answer", answer_score),
    ("number", number_score),
)


def hash_answer(solution_text: Column) -> Column:
    """Text between the first and second ``####``, trimmed; null without a mark."""
    parts = F.split(solution_text, "####", -1)
    return F.when(F.size(parts) > 1, strip(F.get(parts, F.lit(1))))
