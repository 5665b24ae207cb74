"""Message normalization, target resolution and message predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions import jsontext, text, toolcalls
from colloquy.schemas import MESSAGE

_CALLS_TYPE = MESSAGE["tool_calls"].dataType.simpleString()


def message(
    role: Column,
    content: Column,
    tool_calls: Column | None = None,
    tool_name: Column | None = None,
    name: Column | None = None,
) -> Column:
    """A message struct with every declared field, absent ones null."""
    return F.struct(
        role.alias("role"),
        content.cast("string").alias("content"),
        (F.lit(None) if tool_calls is None else tool_calls).cast(_CALLS_TYPE).alias("tool_calls"),
        (F.lit(None) if tool_name is None else tool_name).cast("string").alias("tool_name"),
        (F.lit(None) if name is None else name).cast("string").alias("name"),
    )


def _parsed_content(role: Column, content: Column) -> Column:
    """Assistant content that may embed calls, parsed; null for all other messages."""
    return F.when(_may_hold_calls(role, content), jsontext.strict_json(content))


def _may_hold_calls(role: Column, content: Column) -> Column:
    return (role == "assistant") & content.rlike(rf"(?U)\A{text.WHITESPACE}*\{{")


def _holds_calls(parsed: Column) -> Column:
    return F.try_variant_get(parsed, "$.tool_calls", "variant").isNotNull()


def embeds_calls(role: Column, content: Column) -> Column:
    """Whether the content becomes structured calls, leaving a message without content."""
    return _holds_calls(_parsed_content(role, content))


def _normalize(
    item: Column,
    parsed: Column,
    family: str,
    nested_calls: Column | None,
    keep_null_content: bool,
) -> Column:
    role, content = item["role"], item["content"]
    if nested_calls is None:
        embedded = toolcalls.embedded_calls(parsed, family)
    else:
        # An empty list means the text held no usable call.
        embedded = F.when(F.size(nested_calls) > 0, nested_calls)

    own_calls = toolcalls.normalize_calls(item["tool_calls"], family)
    tool_name = F.when(text.has_text(item["tool_name"]), text.strip(item["tool_name"]))
    name = F.when(text.has_text(item["name"]), text.strip(item["name"])).otherwise(tool_name)

    usable = role.isNotNull() & content.isNotNull()
    if keep_null_content:
        usable = role.isNotNull() & (content.isNotNull() | own_calls.isNotNull())
    return F.when(_holds_calls(parsed), message(role, F.lit(None), embedded)).when(
        usable, message(role, content, own_calls, tool_name, name)
    )


def normalize_messages(items: Column, family: str, *, keep_null_content: bool = False) -> Column:
    """Normalize a message list and prune the unusable ones."""
    # Content is parsed in a step of its own, so that each text is parsed once.
    staged = F.transform(
        items,
        lambda item: F.struct(
            item.alias("item"), _parsed_content(item["role"], item["content"]).alias("parsed")
        ),
    )
    if toolcalls.is_nested_family(family):
        # Only texts that may hold calls leave the JVM.
        contents = F.transform(
            items, lambda item: F.when(_may_hold_calls(item["role"], item["content"]), item["content"])
        )
        calls = jsontext.canonical_calls(contents)
        pairs = F.arrays_zip(staged.alias("staged"), calls.alias("calls"))
        normalized = F.transform(
            pairs,
            lambda pair: _normalize(
                pair["staged"]["item"],
                pair["staged"]["parsed"],
                family,
                F.transform(pair["calls"], toolcalls.canonical_nested),
                keep_null_content,
            ),
        )
    else:
        normalized = F.transform(
            staged,
            lambda pair: _normalize(pair["item"], pair["parsed"], family, None, keep_null_content),
        )
    return F.filter(normalized, lambda item: item.isNotNull())


def normalize_message(item: Column, family: str, *, keep_null_content: bool = False) -> Column:
    """Normalized message, or null if role or content is missing.

    Assistant content that is a JSON object with ``tool_calls`` becomes a message
    without content that carries those calls. ``keep_null_content`` also keeps
    assistant messages that hold structured calls and no content.
    """
    one = F.when(item.isNotNull(), F.array(item))
    return F.get(normalize_messages(one, family, keep_null_content=keep_null_content), F.lit(0))


def has_user_query(items: Column) -> Column:
    return F.exists(items, lambda m: (m["role"] == "user") & text.has_text(m["content"]))


def resolve_target(target_message: Column, target_text: Column) -> Column:
    """The usable target message, else the target text as an assistant message."""
    return F.when(target_message.isNotNull(), target_message).otherwise(
        message(F.lit("assistant"), target_text)
    )


def target_content(target_message: Column, target_text: Column) -> Column:
    return F.when(
        target_message.isNotNull(), F.coalesce(target_message["content"], F.lit(""))
    ).otherwise(target_text)


def merge_system_into_user(items: Column) -> Column:
    """Fold a leading system message into the user message after it.

    For templates that reject a system role. Null when the list does not open with
    a system and a user message, because such a list cannot be rendered either.
    """
    first, second = F.try_element_at(items, F.lit(1)), F.try_element_at(items, F.lit(2))
    merged = F.concat(
        F.lit("System: "),
        F.coalesce(first["content"], F.lit("None")),
        F.lit("\n"),
        F.coalesce(second["content"], F.lit("None")),
    )
    head = second.withField("content", merged)
    rest = F.slice(items, F.lit(3), F.greatest(F.size(items) - 2, F.lit(0)))
    return F.when(
        (first["role"] == "system") & (second["role"] == "user"),
        F.concat(F.array(head), rest),
    )
