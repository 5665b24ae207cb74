"""Audit expressions for model output: loops, stops, trained format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.rewards import WORKING_OUT_TAGS, Tags
from colloquy.functions.text import occurrences, quoted_literal
from colloquy.functions.tokens import ends_with_eos, eos_positions

# Tail sizes and marker texts that betray a repetition loop.
LOOP_TAIL_SIZES = (10, 20, 30, 50)
LOOP_MARKERS = ("Answer:", "Question:", "<|im_start|>", "<|endoftext|>", "<|im_end|>")
LOOP_MIN_LENGTH = 50
LOOP_TAIL_REPEATS = 3
LOOP_MARKER_REPEATS = 5

LENGTH_LIMIT_ISSUE = "Generation stopped due to max_tokens limit"
NO_EOS_ISSUE = "Generation reached max_new_tokens without EOS"


def loop_pattern(text: Column) -> Column:
    """The repeated tail or marker that makes the text a loop, else null."""
    candidates = []
    for size in LOOP_TAIL_SIZES:
        tail = F.right(text, F.lit(size))
        repeated = occurrences(text, tail) >= LOOP_TAIL_REPEATS
        candidates.append(
            F.when(F.length(text) >= size * LOOP_TAIL_REPEATS, F.when(repeated, tail))
        )
    for marker in LOOP_MARKERS:
        candidates.append(
            F.when(occurrences(text, marker) > LOOP_MARKER_REPEATS, F.lit(marker))
        )
    return F.when(F.length(text) >= LOOP_MIN_LENGTH, F.coalesce(*candidates))


def stopped_by_tokens(ids: Column, eos_id: int | Column) -> Column:
    """End token within the last two generated tokens."""
    return ends_with_eos(ids, eos_positions(ids, eos_id), within=2)


def stopped_by_reason(done_reason: Column) -> Column:
    return F.coalesce(done_reason.isin("stop", "eos"), F.lit(False))


def _loop_issue(pattern: Column) -> Column:
    return F.concat(F.lit("Loop pattern detected: "), quoted_literal(pattern))


def token_stop_issues(stopped: Column, pattern: Column) -> Column:
    """Issues of a run that is judged by its token ids."""
    return F.array_compact(
        F.array(
            F.when(~stopped & pattern.isNull(), F.lit(NO_EOS_ISSUE)),
            F.when(pattern.isNotNull(), _loop_issue(pattern)),
        )
    )


def reason_stop_issues(stopped: Column, done_reason: Column, pattern: Column) -> Column:
    """Issues of a run that is judged by the reason its server gave."""
    return F.array_compact(
        F.array(
            F.when(~stopped & (done_reason == "length"), F.lit(LENGTH_LIMIT_ISSUE)),
            F.when(pattern.isNotNull(), _loop_issue(pattern)),
        )
    )


def trained_format(text: Column, tags: Tags = WORKING_OUT_TAGS) -> Column:
    """``following``, ``partial`` or ``none`` by which tag pairs occur."""

    def pair(start: str, end: str) -> Column:
        return F.contains(text, F.lit(start)) & F.contains(text, F.lit(end))

    reasoning = pair(tags.reasoning_start, tags.reasoning_end)
    answer = pair(tags.solution_start, tags.solution_end)
    return (
        F.when(reasoning & answer, F.lit("following"))
        .when(reasoning | answer, F.lit("partial"))
        .when(text.isNotNull(), F.lit("none"))
    )
