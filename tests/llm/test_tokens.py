"""op2 and op9 against the libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from colloquy.llm import byte_bpe, token_counts
from tests.llm.fixtures import TEXTS, all_null, documents, empty, rows

MODEL = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Parts that meet in odd ways: blanks, contractions, special strings, other scripts and Unicode versions.
PARTS = ["a", " ", "  ", "\n", "\t", "'s", "'", "<|endoftext|>", "<|endof", "é", "1", "٣", "中", "🙂", "　", " "]
PARTS += ["​", "!!", "ing", " the", "՘", "�", "x" * 50, "\r\n", "\x1c", "\x85", "\U0001fa9a", "꟎"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(MODEL)


@pytest.fixture(scope="module")
def encoding():
    with open(RANKS, "rb") as file:
        return byte_bpe.encoder(file.read(), public_tokenizers.PATTERN)


def test_token_counts(spark, library):
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows(token_counts.token_counts(documents(spark), MODEL))), key=repr)
    want = []
    for i, text in TEXTS:
        n = len(library.encode(text or "", add_special_tokens=False))
        want.append((i, len((text or "").encode()), n, n > 512))
    assert got == sorted(want, key=repr)


def test_token_counts_of_null_and_empty_tables(spark):
    assert token_counts.token_counts(empty(spark), MODEL).count() == 0
    assert [r["n_tokens"] for r in rows(token_counts.token_counts(all_null(spark), MODEL))] == [0] * 4


def test_counter_equals_the_library_on_odd_texts(library):
    with open(MODEL, encoding="utf-8") as file:
        counter = token_counts.Counter(file.read(), token_counts.whole_tokens(library), token_counts.differing_characters())
    draw = random.Random(3)
    for _ in range(5000):
        text = "".join(draw.choices(PARTS, k=draw.randint(0, 12)))
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False)), repr(text)


def test_whole_tokens_are_proven(library):
    whole = token_counts.whole_tokens(library)
    assert len(whole) > 50_000
    assert all(len(library.encode(text, add_special_tokens=False)) == 1 for text in whole[::997])


def test_other_tokenizers_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file, pytest.raises(ValueError):
        token_counts.check_supported(file.read())


def test_byte_bpe(spark, encoding):
    got = rows(byte_bpe.byte_bpe(documents(spark), RANKS, public_tokenizers.PATTERN))
    want = []
    for i, text in TEXTS:
        ids = encoding.encode_ordinary(text or "")
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((i, len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest(), ids))
    key = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")
    assert sorted((tuple(r[k] for k in key) for r in got), key=repr) == sorted(want, key=repr)


def test_byte_bpe_of_null_and_empty_tables(spark):
    assert byte_bpe.byte_bpe(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0
    got = rows(byte_bpe.byte_bpe(all_null(spark), RANKS, public_tokenizers.PATTERN))
    assert [(r["n_tokens"], r["ids"]) for r in got] == [(0, [])] * 4


@pytest.mark.parametrize("ids", [True, False])
def test_rows_are_handed_on_before_the_batch_ends(encoding, monkeypatch, ids):
    """A worker that kept the ids of a whole batch took its memory from the pipeline's last stage."""
    monkeypatch.setattr(byte_bpe, "HELD", 50)
    monkeypatch.setattr(byte_bpe, "ROWS", 8)
    draw = random.Random(5)
    texts = ["".join(draw.choices(PARTS, k=draw.randint(0, 40))) for _ in range(200)] + ["", "word " * 500, ""] + [""] * 20
    parts = list(byte_bpe.encoded_rows(encoding, pa.array([t.encode() for t in texts], pa.binary()), ids))
    rows = [row for part in parts for row in part.to_pylist()]
    want = [encoding.encode_ordinary(t) for t in texts]
    assert [r["n_tokens"] for r in rows] == list(map(len, want))
    assert [r["ids_sha256"] for r in rows] == [hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest() for i in want]
    assert [r.get("ids") for r in rows] == (want if ids else [None] * len(want))
    for part in parts:
        assert len(part) <= 8 and (len(part) == 1 or sum(r["n_tokens"] for r in part.to_pylist()) <= 50)
    assert not sum(map(len, byte_bpe.encoded_rows(encoding, pa.array([], pa.binary()), ids)))


def test_blocks_are_cut_where_no_match_crosses(encoding):
    draw = random.Random(4)
    for _ in range(2000):
        text = "".join(draw.choices(PARTS, k=draw.randint(0, 40)))
        parts = byte_bpe.blocks(text, 3)
        assert "".join(parts) == text
        assert [i for part in parts for i in encoding.encode_ordinary(part)] == encoding.encode_ordinary(text)
        assert byte_bpe.decode(encoding, encoding.encode_ordinary(text)) == text.encode()


def test_very_long_texts_are_cut_and_whole(encoding):
    text = ("lorem ipsum  dolor\n" * 60_000) + "x" * 400_000
    assert len(byte_bpe.blocks(text)) > 3
    assert byte_bpe.decode(encoding, byte_bpe.encode(encoding, text)) == text.encode()


def test_encoding_is_the_library_itself(encoding):
    assert isinstance(encoding, tiktoken.Encoding)
