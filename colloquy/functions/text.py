"""Small text expressions. All take and return Columns and stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters a text strip removes: Unicode white space plus the four ASCII
# separators, which Java's Unicode class leaves out.
WHITESPACE = r"[\s\x1C-\x1F]"
NON_WHITESPACE = r"[^\s\x1C-\x1F]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{WHITESPACE}+|{WHITESPACE}+\z", "")


def has_text(text: Column) -> Column:
    """True when the text holds any non-white-space character; null counts as none."""
    return F.coalesce(text.rlike(f"(?U){NON_WHITESPACE}"), F.lit(False))


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"(?U){WHITESPACE}+", " "))


def cut(text: Column, limit: int, suffix: str = "...") -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.left(text, F.lit(limit)), F.lit(suffix))
    )


def preview(text: Column, limit: int = 240, suffix: str = "...") -> Column:
    """One-line preview: white space collapsed, cut after ``limit`` characters."""
    return cut(collapse_whitespace(text), limit, suffix)


def occurrences(text: Column, needle: Column | str) -> Column:
    """Non-overlapping literal occurrences of a non-empty needle."""
    pattern = F.lit(needle) if isinstance(needle, str) else needle
    removed = F.length(text) - F.length(F.replace(text, pattern, F.lit("")))
    return (removed / F.length(pattern)).cast("int")


def _hex4(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code.cast("bigint")), 4, "0")))


def json_ascii_string(text: Column) -> Column:
    """A JSON string literal with every non-ASCII character escaped.

    Plain printable text, the usual case, takes the first branch; only text that
    needs escapes is walked character by character.
    """

    def escape(char: Column) -> Column:
        code = F.ascii(char)
        above = code - 0x10000
        high = F.lit(0xD800) + F.shiftright(above, 10)
        low = F.lit(0xDC00) + above.bitwiseAND(F.lit(0x3FF))
        return (
            F.when(char == '"', F.lit('\\"'))
            .when(char == "\\", F.lit("\\\\"))
            .when(char == "\n", F.lit("\\n"))
            .when(char == "\r", F.lit("\\r"))
            .when(char == "\t", F.lit("\\t"))
            .when(char == "\b", F.lit("\\b"))
            .when(char == "\f", F.lit("\\f"))
            .when((code >= 0x20) & (code < 0x7F), char)
            .when(code < 0x10000, _hex4(code))
            .otherwise(F.concat(_hex4(high), _hex4(low)))
        )

    plain = text.rlike(r'\A[ !#-\[\]-~]*\z')
    walked = F.array_join(F.transform(F.split(text, ""), escape), "")
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(walked), F.lit('"'))


def quoted_literal(text: Column) -> Column:
    """Source-style quoted literal as used in issue texts.

    Single quotes unless the text holds single but no double quotes; backslash,
    control and other non-printable characters are escaped.
    """
    single_free = ~F.contains(text, F.lit("'"))
    has_double = F.contains(text, F.lit('"'))
    use_single = single_free | has_double

    def escape(char: Column) -> Column:
        code = F.ascii(char)
        hexed = F.lower(F.hex(code.cast("bigint")))
        return (
            F.when(char == "\\", F.lit("\\\\"))
            .when(char == "\n", F.lit("\\n"))
            .when(char == "\r", F.lit("\\r"))
            .when(char == "\t", F.lit("\\t"))
            .when(~char.rlike(r"[\p{C}\p{Z}&&[^ ]]"), char)
            .when(code < 0x100, F.concat(F.lit("\\x"), F.lpad(hexed, 2, "0")))
            .when(code < 0x10000, F.concat(F.lit("\\u"), F.lpad(hexed, 4, "0")))
            .otherwise(F.concat(F.lit("\\U"), F.lpad(hexed, 8, "0")))
        )

    special = text.rlike(r"[\\\p{C}\p{Z}&&[^ ]]|\\")
    walked = F.when(
        special, F.array_join(F.transform(F.split(text, ""), escape), "")
    ).otherwise(text)
    return F.when(
        use_single, F.concat(F.lit("'"), F.replace(walked, F.lit("'"), F.lit("\\'")), F.lit("'"))
    ).otherwise(F.concat(F.lit('"'), walked, F.lit('"')))


def slug(value: Column) -> Column:
    """Lower-case words joined by ``_``; a value without any is an error."""
    joined = F.regexp_replace(value, "[^A-Za-z0-9]+", "_")
    cleaned = F.lower(F.regexp_replace(joined, "^_+|_+$", ""))
    return F.when(cleaned != "", cleaned).otherwise(
        F.raise_error(F.concat(F.lit("no slug for value: "), F.coalesce(value, F.lit("null"))))
    )


def manifest_uri(bucket: Column, dataset_id: Column, dataset_version: Column) -> Column:
    return F.format_string(
        "s3://%s/dataset_id=%s/dataset_version=%s/manifest.json",
        bucket,
        dataset_id,
        dataset_version,
    )


def with_adapter_suffix(stem: Column) -> Column:
    return F.when(stem.endswith("-lora"), stem).otherwise(F.concat(stem, F.lit("-lora")))


def without_adapter_suffix(stem: Column) -> Column:
    return F.regexp_replace(stem, r"-lora\z", "")


def adapter_to_gguf(repo: Column) -> Column:
    """Name of the packaged repository that belongs to an adapter repository."""
    return (
        F.when(
            F.contains(repo, F.lit("-lora-")),
            F.replace(repo, F.lit("-lora-"), F.lit("-gguf-")),
        )
        .when(F.contains(repo, F.lit("lora")), F.replace(repo, F.lit("lora"), F.lit("gguf")))
        .otherwise(F.concat(repo, F.lit("-gguf")))
    )


def pseudonym(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(value, 256), 1, 16))
