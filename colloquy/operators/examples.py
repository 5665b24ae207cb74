"""Supervised examples from long-form conversations.

Input rows are ``(conv_id, turn, role, text)`` with ``turn`` the position of the
message in its conversation. Every assistant turn becomes one example; the turns
before it are its context.

Handing the whole context to each example costs the square of the conversation
length, and one conversation may hold a large share of all rows. So an example with a
``reach`` carries only the newest context messages within that many tokens, plus exact
totals of what lies before (``omitted_*``). Left truncation to ``reach`` tokens never
looks further back, so tokenizing such an example equals tokenizing the full one. Without
a reach the context is whole, for uses that need every message of it.

With a reach, conversations are cut into blocks of turns. Totals of earlier blocks come
from a small pre-aggregated table; the last turns of a block are copied to the next one as
context. The work of a task is then bounded by the block size. Turns are numbered first,
since unusable ones and gaps in ``turn`` would let the context reach further back than the
copied turns. ``long=False`` spares that where no conversation exceeds a block, which
``has_long_conversations`` finds out for a table in files.

An assistant turn without text is an example without a target: it is counted and dropped
as a row of invalid shape later, and is no context of others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions import messages as msg
from colloquy.functions.text import has_text

# Four blocks' worth of reach keeps the copied share below a quarter.
BLOCK_REACHES = 4


def line_tokens(role: Column, content: Column, tokenizer=None) -> Column:
    """Tokens of one message as a ``role:content`` line with its line break (default: characters).

    Content that embeds tool calls is rendered as a missing one. With a tokenizer that splits
    at lines, counts add up as long as no role begins with white space.
    """
    calls = msg.embeds_calls(role, content)
    if tokenizer is None:
        return F.length(role) + F.when(calls, F.lit(len("None"))).otherwise(F.length(content)) + 2
    shown = F.when(calls, F.lit("None")).otherwise(content)
    return tokenizer.count_line(F.concat(role, F.lit(":"), shown))


def block_turns(reach: int) -> int:
    return BLOCK_REACHES * (reach + 2)


def has_long_conversations(turns: DataFrame, reach: int) -> bool:
    """Whether a table read from files has a conversation of more than one block.

    One comparison on ``turn``, pushed down to the scan: Parquet statistics skip row groups
    without such turns. Not for derived tables or streams, which it would compute or refuse.
    """
    return not turns.where(F.col("turn") >= block_turns(reach)).select("turn").limit(1).isEmpty()


def _measured(turns: DataFrame, tokens: Column | None) -> DataFrame:
    """Usable turns with their token count; a message counts at least one token."""
    usable = turns.where(F.col("role").isNotNull() & F.col("text").isNotNull())
    counted = line_tokens(F.col("role"), F.col("text")) if tokens is None else tokens
    return usable.withColumns(
        {
            "_tokens": F.greatest(counted, F.lit(1)).cast("bigint"),
            "_asks": (F.col("role") == "user") & has_text(F.col("text")),
            "_instructs": F.col("role") == "system",
        }
    )


def _earlier_blocks() -> WindowSpec:
    return (
        Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )


def _numbered(turns: DataFrame, size: int) -> DataFrame:
    """Add ``_position``: 0, 1, 2 ... in the order of ``turn``, whatever gaps it has."""
    blocks = turns.withColumn("_block", F.floor(F.col("turn") / size).cast("bigint"))
    counts = blocks.groupBy("conv_id", "_block").agg(F.count("*").alias("_n"))
    bases = counts.select(
        "conv_id", "_block", F.sum("_n").over(_earlier_blocks()).alias("_base")
    ).where(F.col("_base") > 0)
    rank = F.row_number().over(Window.partitionBy("conv_id", "_block").orderBy("turn"))
    return (
        blocks.join(bases, ["conv_id", "_block"], "left")
        .withColumn("_position", F.coalesce(F.col("_base"), F.lit(0)) + rank - 1)
        .drop("_block", "_base")
    )


def _with_prefix(turns: DataFrame, reach: int, long: bool) -> DataFrame:
    """Add running totals before each turn: ``_start`` tokens, ``_turns``, ``_asked``, ``_instructed``.

    ``_halo`` marks copies that serve as context only.
    """
    if not long:
        before = (
            Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
        )
        return (
            turns.withColumn("_block", F.lit(0).cast("bigint"))
            .withColumn("_halo", F.lit(False))
            .withColumn("_start", F.coalesce(F.sum("_tokens").over(before), F.lit(0)))
            .withColumn("_turns", F.count("_tokens").over(before))
            .withColumn("_asked", F.coalesce(F.max("_asks").over(before), F.lit(False)))
            .withColumn("_instructed", F.coalesce(F.max("_instructs").over(before), F.lit(False)))
        )

    size, halo = block_turns(reach), reach + 2
    turns = _numbered(turns, size)
    own = F.floor(F.col("_position") / size).cast("bigint")
    blocks = turns.withColumn("_block", own)
    totals = blocks.groupBy("conv_id", "_block").agg(
        F.sum("_tokens").alias("_tokens"),
        F.count("*").alias("_turns"),
        F.max("_asks").alias("_asks"),
        F.max("_instructs").alias("_instructs"),
    )
    earlier = _earlier_blocks()
    bases = totals.select(
        "conv_id",
        "_block",
        F.sum("_tokens").over(earlier).alias("_base_tokens"),
        F.sum("_turns").over(earlier).alias("_base_turns"),
        F.max("_asks").over(earlier).alias("_base_asked"),
        F.max("_instructs").over(earlier).alias("_base_instructed"),
    ).where(F.col("_block") > 0)

    ends_block = F.col("_position") % size >= size - halo
    copies = F.when(ends_block, F.array(own, own + 1)).otherwise(F.array(own))
    spread = turns.withColumn("_block", F.explode(copies)).withColumn(
        "_halo", F.col("_block") != own
    )
    group = Window.partitionBy("conv_id", "_block")
    before = group.orderBy("_position").rowsBetween(Window.unboundedPreceding, -1)
    in_halo = F.when(F.col("_halo"), F.col("_tokens"))
    joined = spread.join(bases, ["conv_id", "_block"], "left")
    base_tokens = F.coalesce(F.col("_base_tokens"), F.lit(0)) - F.coalesce(
        F.sum(in_halo).over(group), F.lit(0)
    )
    base_turns = F.coalesce(F.col("_base_turns"), F.lit(0)) - F.count(in_halo).over(group)
    return (
        joined.withColumn(
            "_start", base_tokens + F.coalesce(F.sum("_tokens").over(before), F.lit(0))
        )
        .withColumn("_turns", base_turns + F.count("_tokens").over(before))
        .withColumn(
            "_asked",
            F.coalesce(F.col("_base_asked"), F.lit(False))
            | F.coalesce(F.max("_asks").over(before), F.lit(False)),
        )
        .withColumn(
            "_instructed",
            F.coalesce(F.col("_base_instructed"), F.lit(False))
            | F.coalesce(F.max("_instructs").over(before), F.lit(False)),
        )
        .drop("_base_tokens", "_base_turns", "_base_asked", "_base_instructed")
    )


def _with_context(prefixed: DataFrame, order: str, low: int | None) -> DataFrame:
    """Collect the context turns whose ``order`` value lies within ``low`` below, or all before."""
    start = Window.unboundedPreceding if low is None else -low
    frame = (
        Window.partitionBy("conv_id", "_block").orderBy(order).rangeBetween(start, -1)
    )
    turn = F.struct(
        "turn", "role", F.col("text").alias("content"), F.col("_tokens").alias("tokens")
    )
    return prefixed.withColumn("_context", F.collect_list(turn).over(frame))


def _example(items: Column, target_mode: str, **totals: Column) -> list[Column]:
    return [
        F.concat_ws("-", F.col("conv_id"), F.col("turn")).alias("example_id"),
        F.col("conv_id").cast("string").alias("session_id"),
        F.col("turn").cast("int").alias("target_turn_index"),
        items.alias("messages"),
        F.col("text").alias("target_text"),
        F.lit(target_mode).alias("target_mode"),
        *[value.alias(name) for name, value in totals.items()],
    ]


def _as_examples(
    windowed: DataFrame, turns: DataFrame, target_mode: str, *, whole: bool = False
) -> DataFrame:
    """Examples of the windowed turns, and those of ``turns`` that have no target text."""
    targets = windowed.where((F.col("role") == "assistant") & ~F.col("_halo"))
    context = F.col("_context")
    items = F.transform(context, lambda m: msg.message(m["role"], m["content"]))
    none = F.lit(0).cast("bigint")
    totals, no_totals = {"asked": F.col("_asked")}, {"asked": F.lit(False)}
    if not whole:
        totals["has_system"], no_totals["has_system"] = F.col("_instructed"), F.lit(False)
        kept = F.aggregate(context, none, lambda acc, m: acc + m["tokens"])
        totals |= {
            "omitted_tokens": F.col("_start") - kept,
            "omitted_messages": F.col("_turns") - F.size(context),
        }
        no_totals |= {"omitted_tokens": none, "omitted_messages": none}
    lost = turns.where((F.col("role") == "assistant") & F.col("text").isNull())
    no_items = F.array().cast(T.ArrayType(msg.MESSAGE))
    return targets.select(*_example(items, target_mode, **totals)).unionByName(
        lost.select(*_example(no_items, target_mode, **no_totals))
    )


def single_turn(
    turns: DataFrame,
    reach: int | None = None,
    *,
    tokens: Column | None = None,
    long: bool = True,
    target_mode: str = "single_turn",
) -> DataFrame:
    """One example per assistant turn, context exact for left truncation to ``reach``.

    Without ``reach`` the context is whole, and nothing is omitted. ``tokens`` counts a
    row's tokens (default: characters of its rendered line). ``asked`` tells whether any
    earlier turn, carried or omitted, is a user query; with a reach, ``has_system`` tells
    whether any is a system message. ``long=False`` promises that no conversation exceeds
    one block.
    """
    measured = _measured(turns, tokens)
    if reach is None:
        prefixed = _with_prefix(measured, 0, False)
        return _as_examples(_with_context(prefixed, "turn", None), turns, target_mode, whole=True)
    prefixed = _with_prefix(measured, reach, long)
    ended = prefixed.withColumn("_end", F.col("_start") + F.col("_tokens"))
    return _as_examples(_with_context(ended, "_end", reach + 1), turns, target_mode)


def budgeted(
    turns: DataFrame,
    token_budget: int,
    overhead: int = 0,
    *,
    tokens: Column | None = None,
    long: bool = True,
    target_mode: str = "single_turn",
) -> DataFrame:
    """One example per assistant turn with the newest context that fits the budget.

    A context message stays while its tokens and all newer ones, plus the overhead,
    fit. What does not fit is counted in ``omitted_*``.
    """
    room = max(token_budget - overhead, 0)
    prefixed = _with_prefix(_measured(turns, tokens), room, long)
    if room == 0:
        empty = F.array().cast("array<struct<turn:bigint,role:string,content:string,tokens:bigint>>")
        return _as_examples(prefixed.withColumn("_context", empty), turns, target_mode)
    return _as_examples(_with_context(prefixed, "_start", room), turns, target_mode)


def merge_consecutive_assistant(
    turns: DataFrame, *, reach: int = 2048, long: bool = True
) -> DataFrame:
    """Join runs of assistant turns with a blank line between; other turns pass.

    A merged turn takes the position of its last part. Conversations longer than a
    block of ``reach`` are worked on in blocks; the result does not depend on it.
    """
    size = block_turns(reach)
    usable = turns.where(F.col("role").isNotNull() & F.col("text").isNotNull())
    own = F.floor(F.col("turn") / size).cast("bigint") if long else F.lit(0).cast("bigint")
    blocks = usable.withColumn("_block", own)
    in_order = Window.partitionBy("conv_id", "_block").orderBy("turn")
    talks = F.col("role") == "assistant"
    # A turn opens a run unless it and the turn before it are both the assistant's.
    follows = F.coalesce(F.lag(talks).over(in_order), F.lit(False)) & talks
    marked = blocks.withColumn("_opens", F.when(~follows, F.col("turn"))).withColumn(
        "_run", F.last("_opens", ignorenulls=True).over(in_order)
    )
    if long:
        # A run may go on from earlier blocks: find where the last turn before the
        # block belongs, following blocks that are one unbroken run.
        edges = marked.groupBy("conv_id", "_block").agg(
            F.min_by(talks, "turn").alias("_first_talks"),
            F.max_by(talks, "turn").alias("_last_talks"),
            F.count_if(F.col("_opens").isNotNull()).alias("_runs"),
            F.min("turn").alias("_first"),
            F.max("_run").alias("_last_run"),
        )
        by_block = Window.partitionBy("conv_id").orderBy("_block")
        goes_on = F.col("_first_talks") & F.coalesce(
            F.lag("_last_talks").over(by_block), F.lit(False)
        )
        # The run that is open at the end of a block started in it, unless the block
        # is one run that goes on from before.
        tail_start = F.when(~(F.col("_goes_on") & (F.col("_runs") == 1)), F.col("_last_run"))
        carried = (
            edges.withColumn("_goes_on", goes_on)
            .withColumn("_tail_start", tail_start)
            .select(
                "conv_id",
                "_block",
                "_goes_on",
                "_first",
                F.last("_tail_start", ignorenulls=True)
                .over(by_block.rowsBetween(Window.unboundedPreceding, -1))
                .alias("_open_run"),
            )
            .where("_goes_on")
        )
        marked = marked.join(carried, ["conv_id", "_block"], "left").withColumn(
            "_run",
            F.when(
                F.col("_goes_on") & (F.col("_run") == F.col("_first")), F.col("_open_run")
            ).otherwise(F.col("_run")),
        )
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return (
        marked.groupBy("conv_id", "_run")
        .agg(F.max("turn").alias("turn"), F.first("role").alias("role"), parts.alias("_parts"))
        .select(
            "conv_id",
            "turn",
            "role",
            F.array_join(F.transform("_parts", lambda p: p["text"]), "\n\n").alias("text"),
            F.size("_parts").alias("merged_turns"),
        )
    )
