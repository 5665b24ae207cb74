"""Token counts of a byte-level BPE tokenizer by a whole-token shortcut.

Before any text is read, each string of the vocabulary is encoded by the library. Those
that come back as one token are proven: wherever such a string is a pre-token, it counts
one, and no merge has to be tried. Only the other pre-tokens are merged, by the library
itself, and their counts remembered within a bound.

Pre-tokens are found by the tokenizer's pattern. Where this module's regular expressions
and the library class a character differently (other Unicode versions), texts with such a
character are encoded by the library as a whole. The characters are found at the start,
over all of Unicode, by the library's own expressions.
"""

from __future__ import annotations

import functools
import itertools
import json
import os

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # each task has a core of its own

from tokenizers import Regex, Tokenizer, normalizers  # noqa: E402

from colloquy.llm.byte_bpe import blocks  # noqa: E402
from colloquy.llm.common import doc_column, text_bytes  # noqa: E402

#: The splitting pattern of byte-level pre-tokenizers, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Counts of merged pre-tokens that a worker remembers.
REMEMBERED = 1 << 18


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: visible Latin-1 as it is, the rest from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [byte for byte in range(256) if byte not in visible]
    return {byte: chr(256 + place) for place, byte in enumerate(others)}


BYTE_LETTERS = _byte_letters()


def whole_tokens(tokenizer: Tokenizer) -> list[str]:
    """Vocabulary strings that alone encode to one token, by trial."""
    strings = [tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size())]
    encoded = tokenizer.encode_batch(strings, add_special_tokens=False)
    return [text for text, result in zip(strings, encoded, strict=True) if len(result) == 1]


def differing_characters() -> frozenset[str]:
    """The characters that the library's expressions class differently than ``regex``."""
    everything = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
    odd: set[str] = set()
    for kind, rest in ((r"\p{L}", r"\P{L}"), (r"\p{N}", r"\P{N}"), (r"\s", r"\S")):
        theirs = set(normalizers.Replace(Regex(rest), "").normalize_str(everything))
        odd |= theirs ^ set(regex.findall(kind, everything))
    return frozenset(odd)


class Counter:
    """Token counts of texts, equal to the lengths of the library's encodings."""

    def __init__(self, model: str, whole: list[str], odd: frozenset[str]):
        self.tokenizer = Tokenizer.from_str(model)
        self.whole = frozenset(whole)
        self.merged: dict[str, int] = {}
        self.merge = self.tokenizer.model.tokenize
        self.pattern, self.odd = regex.compile(PATTERN), odd
        added = [regex.escape(token.content) for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = regex.compile("|".join(sorted(added, key=len, reverse=True)) or r"(?!)")

    def count(self, text: str) -> int:
        if not text.isascii() and not self.odd.isdisjoint(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False))
        total, parts = 0, [text]
        if self.added.search(text):  # the library takes them out before anything else
            parts = self.added.split(text)
            total = len(parts) - 1
        return total + sum(self._pieces(self.pattern.findall(block)) for part in parts for block in blocks(part))

    def _pieces(self, pieces: list[str]) -> int:
        whole, merged = self.whole, self.merged
        others = [piece for piece in pieces if piece not in whole]
        if len(merged) > REMEMBERED:
            merged.clear()
        for piece in others:
            if piece not in merged:
                letters = piece.encode().decode("latin-1").translate(BYTE_LETTERS)
                merged[piece] = len(self.merge(letters))
        return len(pieces) - len(others) + sum(map(merged.__getitem__, others))


def check_supported(model: str) -> None:
    """Refuse tokenizers that the shortcut is not right for."""
    parts = json.loads(model)
    pre = parts["pre_tokenizer"] or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    tokens = parts["added_tokens"]
    if not plain or parts["normalizer"] or parts["model"]["type"] != "BPE":
        raise ValueError("only plain byte-level BPE is counted by whole tokens")
    if any(token["lstrip"] or token["rstrip"] or token["single_word"] or token["normalized"] for token in tokens):
        raise ValueError("added tokens that take in their surroundings are not supported")


@functools.lru_cache(maxsize=2)
def counter(model: str, whole: tuple[str, ...], odd: frozenset[str]) -> Counter:
    return Counter(model, list(whole), odd)


def token_counts(
    docs: DataFrame,
    tokenizer_file: str,
    limit: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: bool = False,
) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit`` (and ``doc``).

    A null text is an empty one: no byte, no token. The file's added tokens inside a text
    count as the library takes them, one each; none is added at the ends. Whole texts are
    counted. ``over_limit`` tells whether there are more than ``limit`` tokens. The file,
    whose size is the vocabulary's, is read by the driver and broadcast.
    """
    with open(tokenizer_file, encoding="utf-8") as file:
        model = file.read()
    check_supported(model)
    tokenizer = Tokenizer.from_str(model)
    parts = (model, tuple(whole_tokens(tokenizer)), differing_characters())
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    @F.arrow_udf(T.LongType())
    def counted(texts: pa.Array) -> pa.Array:
        count = counter(*shared.value).count
        return pa.array([count(text.as_py().decode("utf-8", "replace")) for text in texts], pa.int64())

    content = text_bytes(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.octet_length(content).cast("long").alias("n_bytes"),
        counted(content).alias("n_tokens"),
        *doc_column(carry),
    ).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), *(["doc"] if carry else []))
