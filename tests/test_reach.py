"""Contexts within reach give what whole contexts give: facts, and ids of real tokenizers."""

import pytest
from pyspark.sql import functions as F

import public_tokenizers
from colloquy.functions import tokens as tok
from colloquy.functions.rendering import ChatMLTemplate, PlainTemplate
from colloquy.operators import examples
from colloquy.operators import tokenization as tz
from colloquy.plans import supervised as plans

SF_DIR = "/root/testdata/sf0.01"
TURNS = "conv_id long, turn int, role string, text string"
# Ends and beginnings of messages that a tokenizer might join across a line break.
EDGES = [
    "plain words", "ends with blanks   ", "ends with breaks\n\n", "carriage\r\n", "  begins with blanks", "\n\nbegins with breaks",
    "", " ", "\n", "tab\t", "12345", "67890", "it", "'s", "'ll do", "...", "?!\n", "<|endoftext|>", "a<|endoftext|>\n", "\u00a0", "\u2028", "\u3000x\u3000",
    "\u00e9\u00e8", "\U0001f600", "e\u0301", "\u4f60\u597d\n", "x" * 300, "word " * 200, "\n" * 50,
]


def edge_turns(spark):
    rows = [(0, i, "user" if i % 2 == 0 else "assistant", text) for i, text in enumerate(EDGES + EDGES[::-1])]
    rows += [(1, 3 * i, ["user", "assistant", "assistant", "system"][i % 4], EDGES[i * 7 % len(EDGES)]) for i in range(120)]
    rows += [(2, 0, "assistant", "alone"), (2, 5, "assistant", None), (3, 0, "system", "rules"), (3, 1, "user", "hi"), (3, 2, "assistant", "yes")]
    return spark.createDataFrame(rows, TURNS)


def tokenized(rows, spec):
    out = tz.tokenize(rows, spec)
    return sorted(map(tuple, out.select("example_id", "drop_reason", "input_ids", "prompt_len", "n_tokens", "is_truncated").collect()), key=str)


def utf8():
    return tok.ArrowTokenizer(lambda: tok.each_text(lambda text: text.encode("utf-8")), splits_at_lines=True)


def by_bytes(limit):
    return tz.assistant_only(limit, tokenizer=utf8())


def by_words(limit):
    return plans.bpe_spec(limit)


@pytest.mark.parametrize("limit", [1, 60])
@pytest.mark.parametrize("kind", [by_words, by_bytes])
def test_ids_within_reach_equal_those_of_whole_contexts(spark, kind, limit):
    turns, spec = edge_turns(spark), kind(limit)
    tokens = examples.line_tokens(F.col("role"), F.col("text"), spec.tokenizer)
    want = tokenized(examples.single_turn(turns), spec)
    assert tokenized(examples.single_turn(turns, limit, tokens=tokens), spec) == want
    assert tokenized(examples.single_turn(turns, limit, tokens=tokens, long=False), spec) == want


def test_byte_pairs_of_all_given_conversations(spark):
    got = plans.bpe_truncated_masks(spark, SF_DIR)
    want = plans._checked_ids(tz.tokenize(plans.irregular_rows(spark, SF_DIR), by_words(plans.BPE_LIMIT)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.where("is_truncated = 1").count() > 0


def test_counts_of_lines_add_up(spark):
    """The whole text has as many ids as its lines, whatever they end with."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lines = [f"user:{text}" for text in EDGES]
    df = spark.createDataFrame([(line,) for line in lines], "line string").repartition(3)
    total = df.agg(F.sum(by_words(1).tokenizer.count_line(F.col("line")))).first()[0]
    whole = model.encode("\n".join(lines) + "\nassistant:", add_special_tokens=False).ids
    assert total + len(model.encode("assistant:", add_special_tokens=False).ids) == len(whole)


def test_null_lines_and_no_lines(spark):
    df = spark.createDataFrame([(None,), ("",)], "line string")
    counts = df.select(by_words(1).tokenizer.count_line(F.col("line")).alias("n"))
    assert sorted(counts.collect(), key=str) == [(1,), (None,)]
    assert counts.limit(0).collect() == []


@pytest.mark.parametrize("reach", [0, 40])
def test_system_messages_out_of_reach_are_refused_all_the_same(spark, reach):
    spec = tz.assistant_only(64, template=PlainTemplate(rejects_system=True))
    turns = edge_turns(spark)

    def reasons(rows):
        return sorted(map(tuple, tz.classify(rows, spec).select("example_id", "drop_reason").collect()), key=str)

    want = reasons(examples.single_turn(turns))
    assert reasons(examples.single_turn(turns, reach)) == want
    assert reasons(examples.single_turn(turns, reach, long=False)) == want
    assert len([r for r in want if r[1] == tz.TEMPLATE_ERROR]) > 20


def test_what_cannot_be_shortened_is_an_error(spark):
    rows = examples.single_turn(edge_turns(spark), 8)
    with pytest.raises(ValueError, match="has_system"):
        tz.classify(rows.drop("has_system"), tz.assistant_only(8, template=PlainTemplate(rejects_system=True)))
    with pytest.raises(ValueError, match="line by"):
        tz.classify(rows, tz.assistant_only(8, template=ChatMLTemplate()))
    pieces = tok.sentencepiece_file(public_tokenizers.path("piece_bpe_32k.model"))
    with pytest.raises(ValueError, match="at lines"):
        tz.tokenize(rows, tz.assistant_only(8, tokenizer=pieces))
    with pytest.raises(ValueError, match="at lines"):
        examples.line_tokens(F.col("role"), F.col("text"), pieces)


def test_more_omitted_tokens_than_an_int_holds(spark):
    rows = examples.single_turn(edge_turns(spark), 64).withColumn("omitted_tokens", F.lit(3_000_000_000).cast("bigint"))
    out = tz.tokenize(rows, tz.assistant_only(64)).where("drop_reason IS NULL")
    assert out.select(F.min("is_truncated"), F.max("n_tokens")).first() == (1, 64)
