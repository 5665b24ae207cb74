"""Tokenizers, truncation and loss masks as Column expressions."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Each task has a core of its own: threads as many as the host's cores, in every worker, hold memory of their own each.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

IGNORED_LABEL = -100
NEXT_LINE = "a"  # stands for any next line where one is counted alone
#: Bytes of texts or ids that a Python task works on at a time: a token is many times larger there.
SLICE_BYTES = 1 << 18
LOSS_MODES = ("assistant_only", "full_conversation", "weighted")


def check_loss(loss_mode: str, prompt_loss_weight: float) -> None:
    if loss_mode not in LOSS_MODES:
        raise ValueError(f"unknown loss_mode {loss_mode!r}; use one of {', '.join(LOSS_MODES)}")
    if loss_mode == "weighted" and not 0.0 <= prompt_loss_weight <= 1.0:
        raise ValueError(f"prompt_loss_weight must lie in [0.0, 1.0], got {prompt_loss_weight}")


def _bytes(values: pa.Array) -> np.ndarray:
    is_text = pa.types.is_string(values.type) or pa.types.is_large_string(values.type)
    sizes = pc.binary_length(values) if is_text else pc.multiply(pc.list_value_length(values), 4)
    return pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(*columns: pa.Array) -> Iterator[tuple[pa.Array, ...]]:
    """The rows of texts or id lists in order, by runs of up to ``SLICE_BYTES``; a larger row is a run of its own."""
    ends = np.cumsum(sum(map(_bytes, columns)))
    start = 0
    while start < len(ends):
        limit = (ends[start - 1] if start else 0) + SLICE_BYTES
        stop = max(start + 1, int(np.searchsorted(ends, limit, side="right")))
        yield tuple(column.slice(start, stop - start) for column in columns)
        start = stop


class CharTokenizer:
    """One id per character, ``code point % 97 + 1``; needs no Python worker.

    Ids of a text are the ids of its parts in order, so counts come from the text
    length and a tail can be encoded without its head.
    """

    splits_by_character = True
    splits_at_lines = True

    def count(self, text: Column) -> Column:
        return F.length(text)

    def count_line(self, line: Column) -> Column:
        return F.length(line) + 1

    def encode(self, text: Column) -> Column:
        ids = F.transform(F.split(text, ""), lambda char: F.ascii(char) % 97 + 1)
        return F.when(F.length(text) > 0, ids).when(
            text.isNotNull(), F.array().cast("array<int>")
        )


class ArrowTokenizer:
    """A real tokenizer behind an Arrow function.

    ``load`` runs once per task and returns a function from a list of texts to a list
    of id lists; a large model should outlive the task, as those of files do. Texts and ids travel as Arrow batches, of which a worker encodes
    a slice at a time and hands its ids on, so its memory follows neither rows nor batches.
    ``splits_at_lines`` promises that no token spans a line break and a character after it that
    is no white space, whatever lies around them: then the ids of a text are those of its
    parts cut there, in order, and lines can be counted one by one.
    """

    splits_by_character = False

    def __init__(
        self, load: Callable[[], Callable[[list[str]], list[list[int]]]], *, splits_at_lines: bool = False
    ):
        self.splits_at_lines = splits_at_lines
        loaded: list[Callable] = []

        def ids_of(texts: pa.Array) -> list:
            if not loaded:
                loaded.append(load())
            values = texts.to_pylist()
            present = [text for text in values if text is not None]
            ids = iter(loaded[0](present) if present else [])
            return [None if text is None else next(ids) for text in values]

        def sizes_of(texts: pa.Array) -> pa.Array:
            return pa.array([None if ids is None else len(ids) for ids in ids_of(texts)], type=pa.int32())

        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                for (some,) in slices(texts):
                    yield pa.array(ids_of(some), type=pa.list_(pa.int32()))

        kinds = {"ids": T.ArrayType(T.IntegerType()), "n": T.IntegerType(), "m": T.IntegerType()}

        @F.arrow_udf(T.StructType([T.StructField(name, kind) for name, kind in kinds.items()]))
        def encode_and_count(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for columns in batches:
                for texts, some, more in slices(*columns):
                    ids = pa.array(ids_of(texts), type=pa.list_(pa.int32()))
                    yield pa.StructArray.from_arrays([ids, sizes_of(some), sizes_of(more)], names=list(kinds))

        @F.arrow_udf(T.IntegerType())
        def count(texts: pa.Array) -> pa.Array:
            return pa.concat_arrays([pa.array([], type=pa.int32()), *(sizes_of(some) for (some,) in slices(texts))])

        @F.arrow_udf(T.IntegerType())
        def count_lines(lines: pa.Array) -> pa.Array:
            if not loaded:
                loaded.append(load())
            counts = [pa.array([], type=pa.int32())]
            for (some,) in slices(lines):
                values = some.to_pylist()
                # How white space at the end of a line is cut depends on there being a next line.
                shown = [NEXT_LINE] + [f"{line}\n{NEXT_LINE}" for line in values if line is not None]
                extra, *sizes = map(len, loaded[0](shown))
                left = iter(sizes)
                counts.append(pa.array([None if line is None else next(left) - extra for line in values], type=pa.int32()))
            return pa.concat_arrays(counts)

        self._encode, self._encode_and_count, self._count, self._count_lines = encode, encode_and_count, count, count_lines

    def encode(self, text: Column) -> Column:
        return self._encode(text)

    def encode_and_count(self, text: Column, some: Column, more: Column) -> Column:
        """``ids`` of a text with the numbers ``n, m`` of ids of two others, all from one Python worker."""
        return self._encode_and_count(text, some, more)

    def count(self, text: Column) -> Column:
        return self._count(text)

    def count_line(self, line: Column) -> Column:
        """Tokens of a line and its break in a text that goes on with another line."""
        if not self.splits_at_lines:
            raise ValueError("counts of lines add up only for a tokenizer that splits at lines")
        return self._count_lines(line)


def _version(path: str) -> tuple[int, int]:
    found = os.stat(path)
    return found.st_mtime_ns, found.st_size


@functools.lru_cache(maxsize=1)
def _json_model(path: str, version: tuple[int, int]):
    """The file's model, once per Python worker: one for each task adds up to far more than the task needs."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=1)
def _piece_model(path: str, version: tuple[int, int]):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def tokenizer_file(path: str, *, splits_at_lines: bool = False) -> ArrowTokenizer:
    """A ``tokenizers`` JSON file that every worker can read; no special tokens added.

    Byte-level vocabularies that cut a text into words first split at lines.
    """

    def load():
        model = _json_model(path, _version(path))
        return lambda texts: [
            e.ids for e in model.encode_batch(texts, add_special_tokens=False)
        ]

    return ArrowTokenizer(load, splits_at_lines=splits_at_lines)


def tokenizer_file_decoder(path: str) -> Callable[[Column], Column]:
    """Ids back to text with a ``tokenizers`` JSON file; special tokens stay."""
    loaded: list = []

    @F.arrow_udf(T.StringType())
    def decode(ids: pa.Array) -> pa.Array:
        if not loaded:
            loaded.append(_json_model(path, _version(path)))
        decoded = [pa.array([], type=pa.string())]
        for (some,) in slices(ids):
            rows = some.to_pylist()
            texts = loaded[0].decode_batch([row or [] for row in rows], skip_special_tokens=False)
            shown = [None if row is None else text for row, text in zip(rows, texts, strict=True)]
            decoded.append(pa.array(shown, type=pa.string()))
        return pa.concat_arrays(decoded)

    return decode


def sentencepiece_file(path: str) -> ArrowTokenizer:
    """A SentencePiece model file that every worker can read."""

    def load():
        model = _piece_model(path, _version(path))
        return lambda texts: model.encode(texts, num_threads=1)

    return ArrowTokenizer(load)


def each_text(encode: Callable[[str], list[int]]) -> Callable[[list[str]], list[list[int]]]:
    """Adapt a function on one text to a list of texts."""
    return lambda texts: [list(encode(text)) for text in texts]


@dataclass(frozen=True)
class Truncated:
    ids: Column
    prompt_len: Column
    is_truncated: Column


def truncate_left(ids: Column, prompt_len: Column, max_len: int, omitted: Column | None = None) -> Truncated:
    """Keep the last ``max_len`` ids; the prompt loses what was cut.

    ``omitted`` ids before the given ones count as cut; they must be such as truncation would cut.
    """
    before = F.lit(0) if omitted is None else omitted
    overflow = F.greatest(before + F.size(ids) - max_len, F.lit(0))
    return Truncated(
        ids=F.slice(ids, F.greatest(F.size(ids) - max_len, F.lit(0)) + 1, F.lit(max_len)),
        prompt_len=F.greatest(before + prompt_len - overflow, F.lit(0)).cast("int"),
        is_truncated=(overflow > 0).cast("int"),
    )


def attention_mask(ids: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(ids))


def labels(ids: Column, prompt_len: Column, loss_mode: str) -> Column:
    """Ids with the prompt masked in ``assistant_only`` mode, else the ids."""
    if loss_mode != "assistant_only":
        return ids
    masked = F.least(prompt_len, F.size(ids))
    return F.concat(
        F.array_repeat(F.lit(IGNORED_LABEL), masked),
        F.slice(ids, masked + 1, F.size(ids) - masked),
    )


def loss_weights(ids: Column, prompt_len: Column, weight: float) -> Column:
    prompt = F.least(prompt_len, F.size(ids))
    return F.concat(
        F.array_repeat(F.lit(float(weight)), prompt),
        F.array_repeat(F.lit(1.0), F.size(ids) - prompt),
    )


def supervised_count(label_ids: Column) -> Column:
    return F.size(F.filter(label_ids, lambda label: label != IGNORED_LABEL))


def eos_positions(ids: Column, eos_id: int | Column) -> Column:
    eos = F.lit(eos_id) if isinstance(eos_id, int) else eos_id
    marked = F.transform(ids, lambda token, index: F.when(token == eos, index))
    return F.filter(marked, lambda index: index.isNotNull())


def ends_with_eos(ids: Column, positions: Column, within: int) -> Column:
    """Whether the last end token lies within the last ``within`` tokens."""
    return F.coalesce(F.size(ids) - F.array_max(positions) <= within, F.lit(False))


def first_tokens(ids: Column, n: int = 50) -> Column:
    return F.slice(ids, 1, n)


def last_tokens(ids: Column, n: int = 50) -> Column:
    return F.slice(ids, F.greatest(F.size(ids) - n, F.lit(0)) + 1, F.lit(n))
