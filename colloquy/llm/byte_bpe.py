"""Byte-level BPE with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.common import doc_column, text_bytes

#: Characters of text given to the library at once, where the text has a safe boundary.
BLOCK = 1 << 18
#: Tokens and rows that a worker hands on at once.
HELD, ROWS = 1 << 18, 2048

#: White space after anything else always begins a match of the splitting pattern: no
#: match holds white space behind another character, and what is before is no white space,
#: so no look-ahead crosses the place either.
SAFE = regex.compile(r"(?<=\S)(?=\s)")


@functools.lru_cache(maxsize=4)
def encoder(rank_bytes: bytes, pattern: str) -> tiktoken.Encoding:
    """The library's encoding for the content of a rank file, once in each worker."""
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_bytes.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def blocks(text: str, size: int = BLOCK) -> list[str]:
    """The text cut at the first safe boundary after each ``size`` characters."""
    out, begin = [], 0
    while len(text) - begin > size and (cut := SAFE.search(text, begin + size)):
        out.append(text[begin : cut.start()])
        begin = cut.start()
    return [*out, text[begin:]]


def encode(encoding: tiktoken.Encoding, text: str) -> list[int]:
    ids: list[int] = []
    for block in blocks(text):
        ids += encoding.encode_ordinary(block)
    return ids


def decode(encoding: tiktoken.Encoding, ids: list[int]) -> bytes:
    """Raw bytes; a single id need not be whole characters."""
    return encoding.decode_bytes(ids)


def encoded_rows(encoding: tiktoken.Encoding, texts: pa.Array, ids: bool) -> Iterator[pa.Array]:
    """Structs of the rows of a batch in order, handed on as they fill ``HELD`` tokens and ``ROWS`` rows at most.

    Memory follows neither the batch nor its lists of Python numbers; a larger row fills an array alone.
    """
    counts, digests, decoded, held = [], [], [], []

    def flush() -> pa.Array:
        columns = {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
        if ids:
            ends = np.r_[0, np.cumsum(counts)].astype("int32")
            columns["ids"] = pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, "int32"), *held]))
        for column in (counts, digests, decoded, held):
            column.clear()
        return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))

    total = 0
    for text in texts:
        tokens = encode(encoding, text.as_py().decode("utf-8", "replace"))
        if counts and (total + len(tokens) > HELD or len(counts) == ROWS):
            yield flush()
            total = 0
        total += len(tokens)
        counts.append(len(tokens))
        packed = np.asarray(tokens, "<u4")
        digests.append(hashlib.sha256(packed.tobytes()).hexdigest())
        decoded.append(hashlib.sha256(decode(encoding, tokens)).hexdigest())
        if ids:
            held.append(packed.astype("int32"))
    yield flush()


def byte_bpe(
    docs: DataFrame,
    rank_file: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    ids: bool = True,
    carry: bool = False,
) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``, ``doc``).

    A null text is an empty one and has no token. Special tokens do not exist: their
    strings are ordinary text. Whole texts are encoded, however long. The decoded digest is
    of the bytes that the ids decode to. The rank file, whose size is the vocabulary's, is
    read by the driver and broadcast; executors need no copy of it.
    """
    with open(rank_file, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = T.StructType(
        [
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
            *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else []),
        ]
    )

    @F.arrow_udf(kind)
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield from encoded_rows(encoder(ranks.value, pattern), texts, ids)

    out = docs.select(
        F.col(id_col).alias("doc_id"), encoded(text_bytes(text_col)).alias("e"), *doc_column(carry)
    )
    return out.select("doc_id", "e.*", *(["doc"] if carry else []))
