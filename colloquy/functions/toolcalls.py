"""Tool-call normalization per model family.

A call is a struct ``(id, type, name, arguments, function(name, arguments))`` whose
arguments are JSON text. A field counts as present when it is not null, because
Arrow and Parquet fill absent struct fields with null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions import jsontext, text


def _call(id=None, type=None, name=None, arguments=None, function=None) -> Column:
    no_function = F.lit(None).cast("struct<name:string,arguments:string>")
    return F.struct(
        (_null_string() if id is None else id).alias("id"),
        (_null_string() if type is None else type).alias("type"),
        (_null_string() if name is None else name).alias("name"),
        (_null_string() if arguments is None else arguments).alias("arguments"),
        (no_function if function is None else function).alias("function"),
    )


def _null_string() -> Column:
    return F.lit(None).cast("string")


def call_name(call: Column) -> Column:
    return F.when(call["function"].isNotNull(), call["function"]["name"]).otherwise(call["name"])


def call_arguments(call: Column) -> Column:
    return F.when(call["function"].isNotNull(), call["function"]["arguments"]).otherwise(
        call["arguments"]
    )


def object_arguments(arguments: Column) -> Column:
    """Arguments that a template can iterate: valid JSON text, else an empty object."""
    valid = jsontext.strict_json(arguments).isNotNull()
    return F.when(valid, arguments).otherwise(F.lit("{}"))


def flat_parsed(call: Column) -> Column:
    """Flat call with usable arguments (families whose template reads an object)."""
    return _call(name=call_name(call), arguments=object_arguments(call_arguments(call)))


def flat_verbatim(call: Column) -> Column:
    """Flat call, argument text untouched, empty object when missing."""
    return _call(
        name=call_name(call), arguments=F.coalesce(call_arguments(call), F.lit("{}"))
    )


def call_json(call: Column) -> Column:
    """Canonical JSON of a call at rest: only present keys, sorted, ASCII."""

    def member(key: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{key}": '), text.json_ascii_string(value))

    def members(*parts: Column) -> Column:
        return F.concat(F.lit("{"), F.array_join(F.array(*parts), ", "), F.lit("}"))

    function = call["function"]
    nested = F.when(
        function.isNotNull(),
        F.concat(
            F.lit('"function": '),
            members(member("arguments", function["arguments"]), member("name", function["name"])),
        ),
    )
    return members(
        member("arguments", call["arguments"]),
        nested,
        member("id", call["id"]),
        member("name", call["name"]),
        member("type", call["type"]),
    )


def call_id(call: Column) -> Column:
    """The call's own id, else a stable one derived from its content."""
    derived = F.concat(F.lit("call_"), F.substring(F.md5(call_json(call)), 1, 12))
    return F.when(call["id"] != "", call["id"]).otherwise(derived)


def nested(call: Column) -> Column:
    """Nested call with id and type (families that expect argument text)."""
    arguments = call_arguments(call)
    return _call(
        id=call_id(call),
        type=F.lit("function"),
        function=F.struct(
            call_name(call).alias("name"),
            F.when(arguments != "", arguments).otherwise(F.lit("{}")).alias("arguments"),
        ),
    )


# Normalizer registry: family tag -> Column -> Column. New families plug in here.
NORMALIZERS: dict[str, Callable[[Column], Column]] = {
    "qwen": flat_parsed,
    "gemma": flat_parsed,
    "openai": nested,
    "gpt": nested,
    "generic": flat_verbatim,
}


def normalizer_for(family: str) -> Callable[[Column], Column]:
    return NORMALIZERS.get(family.lower(), NORMALIZERS["generic"])


def is_nested_family(family: str) -> bool:
    return normalizer_for(family) is nested


def normalize_call(call: Column, family: str | Column) -> Column:
    """Normalize one call; the family may be fixed or itself a column."""
    if isinstance(family, str):
        return normalizer_for(family)(call)
    generic = NORMALIZERS["generic"]
    tags: dict[Callable[[Column], Column], list[str]] = {}
    for tag, normalizer in NORMALIZERS.items():
        if normalizer is not generic:
            tags.setdefault(normalizer, []).append(tag)
    chosen = F
    for normalizer, names in tags.items():
        chosen = chosen.when(F.lower(family).isin(*names), normalizer(call))
    return generic(call) if chosen is F else chosen.otherwise(generic(call))


def normalize_calls(calls: Column, family: str) -> Column:
    """Map over a call list; null items go, and an empty list becomes null."""
    present = F.filter(calls, lambda call: call.isNotNull())
    return F.when(
        F.size(present) > 0, F.transform(present, lambda call: normalize_call(call, family))
    )


def canonical_nested(found: Column) -> Column:
    """Nested call from canonical JSON texts (``call``, ``arguments``).

    Scalars are written as text the way the dataset's producers do: strings as they are,
    booleans capitalized; empty, zero, false and null values count as absent.
    """

    def scalar(value: Column) -> Column:
        text_value = F.try_variant_get(value, "$", "string")
        absent = ~jsontext.is_string(value) & text_value.isin("0", "0.0", "-0.0", "false", "[]", "{}")
        shown = F.when(jsontext.is_boolean(value), F.initcap(text_value)).otherwise(text_value)
        return F.when((text_value != "") & ~absent, shown)

    call = F.try_parse_json(found["call"])
    function = F.try_variant_get(call, "$.function", "variant")
    holder = F.when(jsontext.is_object(function), function).otherwise(call)
    name = F.try_variant_get(holder, "$.name", "variant")
    name_text = F.try_variant_get(holder, "$.name", "string")
    arguments = found["arguments"]
    whole = arguments.startswith("{") | arguments.startswith("[")
    derived = F.concat(F.lit("call_"), F.substring(F.md5(found["call"]), 1, 12))
    return _call(
        id=F.coalesce(scalar(F.try_variant_get(call, "$.id", "variant")), derived),
        type=F.lit("function"),
        function=F.struct(
            F.when(jsontext.is_boolean(name), F.initcap(name_text)).otherwise(name_text).alias("name"),
            F.coalesce(F.when(whole, arguments), scalar(F.try_parse_json(arguments)), F.lit("{}")).alias(
                "arguments"
            ),
        ),
    )


def embedded_calls(parsed: Column, family: str) -> Column:
    """Calls of a parsed ``{"tool_calls": [...]}`` text, normalized.

    Items that are not objects are skipped; nothing usable gives null.
    """

    def at_rest(item: Column) -> Column:
        def text_at(path: str) -> Column:
            # Text as it is, other values as JSON, JSON null as null.
            return F.try_variant_get(item, path, "string")

        has_function = jsontext.is_object(F.try_variant_get(item, "$.function", "variant"))
        return F.struct(
            text_at("$.id").alias("id"),
            text_at("$.type").alias("type"),
            text_at("$.name").alias("name"),
            text_at("$.arguments").alias("arguments"),
            F.when(
                has_function,
                F.struct(
                    text_at("$.function.name").alias("name"),
                    text_at("$.function.arguments").alias("arguments"),
                ),
            ).alias("function"),
        )

    items = F.try_variant_get(parsed, "$.tool_calls", "array<variant>")
    objects = F.filter(items, jsontext.is_object)
    return normalize_calls(F.transform(objects, at_rest), family)


def detect_family(model_name: Column, explicit: Column | None = None) -> Column:
    """Family tag from an explicit type, else from parts of the model name."""
    name = F.lower(F.coalesce(model_name, F.lit("")))

    def mentions(*parts: str) -> Column:
        found = F.contains(name, F.lit(parts[0]))
        for part in parts[1:]:
            found = found | F.contains(name, F.lit(part))
        return found

    detected = (
        F.when(mentions("qwen"), F.lit("qwen"))
        .when(mentions("gemma"), F.lit("gemma"))
        .when(mentions("gpt", "openai", "davinci", "turbo", "claude", "anthropic"), F.lit("openai"))
        .otherwise(F.lit("generic"))
    )
    if explicit is None:
        return detected
    return F.when(explicit != "", F.lower(text.strip(explicit))).otherwise(detected)
