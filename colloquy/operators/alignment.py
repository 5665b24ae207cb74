"""Expected and predicted tool calls of an example, aligned in their order.

Calls pair up only with calls of the same name, never crosswise, so one call too many or too few
does not shift all others. Of all such alignments the one with the most pairs counts, and of these
the one with the most pairs of equal arguments. It is computed inside each row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import jsontext

#: One more pair is worth more than any number of equal arguments.
PAIR = 1 << 32

STEP = "struct<score:bigint,pairs:array<struct<expected:int,predicted:int,equal:boolean>>>"


def _numbered(calls: Column) -> Column:
    calls = F.coalesce(calls, F.array().cast("array<struct<name:string,arguments:string>>"))
    return F.transform(
        calls,
        lambda call, place: F.struct(
            place.alias("place"),
            call["name"].alias("name"),
            # Equal JSON has one text; what is no JSON equals only itself, letter by letter.
            F.coalesce(F.to_json(jsontext.strict_json(call["arguments"])), F.concat(F.lit("!"), call["arguments"])).alias("arguments"),
        ),
    )


def aligned_pairs(expected: Column, predicted: Column) -> Column:
    """Pairs of places ``expected, predicted`` with ``equal`` arguments, in order.

    Both columns are lists of structs with ``name`` and ``arguments`` (JSON text), prepared by
    ``with_alignment``. Where alignments are equally good, later calls pair first.
    """
    nothing = F.struct(F.lit(0).cast("long").alias("score"), F.array().alias("pairs")).cast(STEP)
    start = F.concat(F.array(nothing), F.transform(predicted, lambda _: nothing))

    def row(before: Column, want: Column) -> Column:
        """Best alignments of the calls up to ``want`` with every beginning of the predicted ones."""

        def cell(done: Column, got: Column) -> Column:
            at = got["place"]
            same = F.equal_null(want["arguments"], got["arguments"])
            diagonal = F.get(before, at)
            paired = F.struct(
                (diagonal["score"] + F.lit(PAIR) + same.cast("long")).alias("score"),
                F.concat(diagonal["pairs"], F.array(F.struct(want["place"].alias("expected"), at.alias("predicted"), same.alias("equal")))).alias("pairs"),
            ).cast(STEP)
            above, left = F.get(before, at + 1), F.get(done, at)
            skipped = F.when(above["score"] >= left["score"], above).otherwise(left)
            best = F.when((want["name"] == got["name"]) & (paired["score"] >= skipped["score"]), paired).otherwise(skipped)
            return F.concat(done, F.array(best))

        return F.aggregate(predicted, F.array(F.get(before, F.lit(0))), cell)

    return F.element_at(F.aggregate(expected, start, row), -1)["pairs"]


def with_alignment(examples: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """The rows with ``pairs``, and how many calls were ``matched``, ``exact``, ``missing`` and ``surplus``.

    Null lists are empty ones; a call without a name pairs with none.
    """
    # Arguments are parsed once a call, in a step before the alignment compares them.
    ready = examples.withColumns({"_expected": _numbered(F.col(expected)), "_predicted": _numbered(F.col(predicted))})
    found = ready.withColumn("pairs", aligned_pairs(F.col("_expected"), F.col("_predicted")))
    return found.withColumns(
        {
            "matched": F.size("pairs"),
            "exact": F.size(F.filter("pairs", lambda pair: pair["equal"])),
            "missing": F.size("_expected") - F.size("pairs"),
            "surplus": F.size("_predicted") - F.size("pairs"),
        }
    ).drop("_expected", "_predicted")


def alignment_report(aligned: DataFrame, *by: str) -> DataFrame:
    """Calls, recall, precision and share of exact pairs, by every column of ``by`` and overall."""
    sets = [[F.col(c)] for c in by] + [[]]
    sums = aligned.groupingSets(sets, *[F.col(c) for c in by]).agg(
        F.grouping_id().alias("grouping"),
        F.count("*").alias("examples"),
        *[F.sum(name).alias(name) for name in ("matched", "exact", "missing", "surplus")],
    )
    share = lambda part, whole: F.coalesce(F.try_divide(F.col(part), whole), F.lit(0.0))
    return sums.withColumns(
        {
            "recall": share("matched", F.col("matched") + F.col("missing")),
            "precision": share("matched", F.col("matched") + F.col("surplus")),
            "exact_share": share("exact", F.col("matched")),
        }
    )
