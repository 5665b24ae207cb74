"""Row classification, masks, truncation, statistics and batches."""

import pytest
from pyspark.sql import functions as F

from colloquy.functions import tokens as tok
from colloquy.functions.rendering import ChatMLTemplate, PlainTemplate
from colloquy.operators import batching
from colloquy.operators import tokenization as tz
from colloquy.schemas import SFT_ROW


def sft(spark, *rows):
    filled = [tuple(row.get(name) for name in SFT_ROW.fieldNames()) for row in rows]
    return spark.createDataFrame(filled, SFT_ROW).withColumn("split", F.lit("train"))


def say(role, content, **more):
    return {"role": role, "content": content, **more}


def ids(text):
    return [ord(c) % 97 + 1 for c in text]


BASIC = {"messages": [say("system", "be concise"), say("user", "say hi")], "target_text": "hi"}


def test_assistant_only_masks_the_prompt(spark):
    row = tz.tokenize(sft(spark, BASIC), tz.assistant_only(512)).first()
    full = "system:be concise\nuser:say hi\nassistant:hi"
    prompt = len("system:be concise\nuser:say hi\nassistant:")
    assert row.input_ids == ids(full)
    assert row.attention_mask == [1] * len(full)
    assert row.labels == [-100] * prompt + ids(full)[prompt:]
    assert (row.is_truncated, row.drop_reason) == (0, None)


def test_full_conversation_labels_are_ids(spark):
    row = tz.tokenize(sft(spark, BASIC), tz.TokenizeSpec(512, "full_conversation")).first()
    assert row.labels == row.input_ids


@pytest.mark.parametrize("weight", [0.25, 0.5, 1.0])
def test_weighted_loss(spark, weight):
    row = tz.tokenize(sft(spark, BASIC), tz.TokenizeSpec(512, "weighted", weight)).first()
    prompt = len("system:be concise\nuser:say hi\nassistant:")
    assert row.loss_weights == [weight] * prompt + [1.0, 1.0]
    assert -100 not in row.labels
    assert tz.model_columns(tz.tokenize(sft(spark, BASIC), tz.TokenizeSpec(9, "weighted", weight))
                            ).columns == ["input_ids", "attention_mask", "labels", "loss_weights"]


def test_zero_weight_warns():
    with pytest.warns(UserWarning):
        tz.TokenizeSpec(8, "weighted")


@pytest.mark.parametrize("mode,weight", [("invalid_mode", 0.0), ("weighted", 1.5), ("weighted", -0.1)])
def test_bad_loss_settings(mode, weight):
    with pytest.raises(ValueError):
        tz.TokenizeSpec(8, mode, weight)


def test_fit_statistics(spark):
    long = {"messages": [say("user", "a" * 400)], "target_text": "b" * 400}
    short = {"messages": [say("user", "short")], "target_text": "ok"}
    spec = tz.TokenizeSpec(128, "full_conversation")
    rows = tz.tokenize(sft(spark, short, long), spec)
    s = tz.fit_statistics(rows, spec).first()
    assert (s.rows_total, s.rows_kept, s.rows_truncated, s.rows_fit_fully) == (2, 2, 1, 1)
    assert (s.fit_pct, s.truncated_pct, s.loss_mode, s.prompt_loss_weight) == (
        50.0, 50.0, "full_conversation", None)
    assert max(r.n_tokens for r in rows.collect()) == 128


def test_truncation_keeps_the_tail(spark):
    long = {"messages": [say("user", "a" * 40)], "target_text": "xyz"}
    row = tz.tokenize(sft(spark, long), tz.assistant_only(10)).first()
    full = "user:" + "a" * 40 + "\nassistant:xyz"
    assert row.input_ids == ids(full[-10:])
    assert row.prompt_len == 7 and row.labels[:7] == [-100] * 7 and row.is_truncated == 1


def test_drop_reasons_and_report(spark):
    rows = sft(
        spark,
        {**BASIC, "example_id": "ok"},
        {"example_id": "no target", "messages": [say("user", "x")]},
        {"example_id": "no list", "target_text": "x"},
        {"example_id": "empty", "messages": [say("user", None)], "target_text": "x"},
        {"example_id": "unasked", "messages": [say("assistant", "hi"), say("user", " \n")],
         "target_text": "x  y"},
        {"example_id": "only message", "messages": [say("assistant", "hi")],
         "target_message": say("assistant", "yo")},
    )
    spec = tz.assistant_only(64)
    tokenized = tz.tokenize(rows, spec)
    reasons = {r.example_id: r.drop_reason for r in tokenized.collect()}
    assert reasons == {
        "ok": None, "no target": tz.INVALID_SHAPE, "no list": tz.INVALID_SHAPE,
        "empty": tz.NO_MESSAGES, "unasked": tz.NO_USER_QUERY, "only message": tz.NO_USER_QUERY,
    }
    kept, dropped = tz.valid_and_dropped(tokenized)
    assert (kept.count(), dropped.count()) == (1, 5)
    assert all(r.input_ids == [] for r in dropped.collect())
    report = {r.example_id: r for r in tz.with_payload(tz.drop_report(tz.classify(rows, spec))).collect()}
    unasked = report["unasked"]
    assert unasked.role_sequence == ["assistant", "user"] and unasked.message_count == 2
    assert unasked.last_non_system_role == "user" and unasked.target_preview == "x y"
    assert [m.content for m in unasked.messages_tail] == ["hi", ""]
    assert report["no list"].message_count == 0 and report["no list"].last_non_system_role is None
    assert report["only message"].target_preview == ""
    assert '"reason":"missing_user_query"' in unasked.payload


def test_template_error_is_a_drop_reason(spark):
    spec = tz.assistant_only(64, template=PlainTemplate(rejects_system=True))
    row = tz.classify(sft(spark, BASIC), spec).first()
    assert row.drop_reason == tz.TEMPLATE_ERROR and row.template_error
    assert tz.drop_report(tz.classify(sft(spark, BASIC), spec)).first().error_type == "TemplateError"


def test_shortened_contexts_tokenize_like_whole_ones(spark):
    import random

    from colloquy.operators.examples import single_turn

    rng = random.Random(9)
    texts = ['{"tool_calls": [{"name": "f"}]}', "hello", "", "x" * 50, '{"a": 1}', " \n"]
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(texts))
            for c in range(20) for t in range(rng.randrange(1, 30))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for limit in (5, 60, 400):
        spec = tz.assistant_only(limit)
        names = ("example_id", "drop_reason", "input_ids", "labels", "is_truncated", "prompt_len")

        def shown(reach, long):
            out = tz.tokenize(single_turn(turns, reach, long=long), spec)
            return sorted(map(tuple, out.select(*names).collect()))

        whole = shown(100_000, False)
        assert shown(limit, False) == whole
        assert shown(limit, True) == whole
    with pytest.raises(ValueError, match="line by line"):
        tz.tokenize(single_turn(turns, 9), tz.assistant_only(9, template=ChatMLTemplate()))


def test_empty_result_guard(spark):
    spec = tz.assistant_only(64)
    rows = tz.tokenize(sft(spark, {"messages": [say("assistant", "x")], "target_text": "y"}), spec)
    stats, histogram = tz.fit_statistics(rows, spec), tz.drop_histogram(rows)
    with pytest.raises(ValueError, match="missing_user_query"):
        tz.require_rows(stats, histogram, "train")
    good = tz.tokenize(sft(spark, BASIC), spec)
    tz.require_rows(tz.fit_statistics(good, spec), tz.drop_histogram(good), "train")


def test_structured_target_with_tool_calls(spark):
    target = say("assistant", '{"tool_calls": [{"name": "lights", "arguments": {"on": true}}]}')
    row = {"messages": [say("user", "lights on")], "target_text": "unused", "target_message": target}
    out = tz.tokenize(sft(spark, row), tz.assistant_only(512, template=ChatMLTemplate(), family="qwen"))
    r = out.first()
    assert r.full_text.endswith(
        '<|im_start|>assistant\n<tool_call>\n{"name": "lights", "arguments": {"on":true}}\n</tool_call>'
    )
    assert len(r.input_ids) == len(r.labels) == len(r.attention_mask)


def test_thinking_is_switched_off_for_one_family_only(spark):
    for family, expected in (("qwen", True), ("gemma", False)):
        spec = tz.assistant_only(512, template=ChatMLTemplate(), family=family, enable_thinking=False)
        assert ("<think>\n\n</think>" in tz.classify(sft(spark, BASIC), spec).first().prompt_text) == expected


def word_lengths(text):
    """Ids that are not one per character."""
    return [len(word) for word in text.split(" ")]


def test_arrow_tokenizer(spark):
    spec = tz.assistant_only(3, tokenizer=tok.ArrowTokenizer(lambda: tok.each_text(word_lengths)))
    row = {"messages": [say("user", "one three five")], "target_text": "and more words"}
    r = tz.tokenize(sft(spark, row), spec).first()
    # user:one three five\nassistant:and more words -> 8, 5, 18, 4, 5
    assert r.input_ids == [18, 4, 5] and r.is_truncated == 1
    # The prompt alone has three words, of which the first two were cut.
    assert r.labels == [-100, 4, 5]


def test_tokenizer_files(spark):
    public = pytest.importorskip("public_tokenizers")
    sentencepiece = pytest.importorskip("sentencepiece")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    row = {"messages": [say("user", "Where do the Élan files go?")], "target_text": "Into the folder 😀."}
    text = "user:Where do the Élan files go?\nassistant:Into the folder 😀."
    rows = sft(spark, row, {"messages": [], "target_text": "dropped"})
    spec = tz.TokenizeSpec(999, "full_conversation", tokenizer=tok.tokenizer_file(path))
    kept, dropped = tz.valid_and_dropped(tz.tokenize(rows, spec))
    assert kept.first().input_ids == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert dropped.first().input_ids == []
    path = public.path("piece_bpe_32k.model")
    spec = tz.TokenizeSpec(999, "full_conversation", tokenizer=tok.sentencepiece_file(path))
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert tz.tokenize(sft(spark, row), spec).first().input_ids == model.encode(text)


def test_pad_batches(spark):
    rows = spark.createDataFrame(
        [(0, [1, 2, 3], [1, 1, 1], [-100, 2, 3], [0.3, 1.0, 1.0]),
         (0, [1, 2, 3, 4, 5], [1] * 5, [-100, 2, 3, 4, 5], [0.3, 1.0, 1.0, 1.0, 1.0])],
        "batch_id long, input_ids array<int>, attention_mask array<int>, labels array<int>,"
        " loss_weights array<double>",
    )
    short, _ = sorted(batching.pad_batches(rows, pad_id=9).collect(), key=lambda r: sum(r.attention_mask))
    assert short.input_ids == [1, 2, 3, 9, 9] and short.attention_mask == [1, 1, 1, 0, 0]
    assert short.labels == [-100, 2, 3, -100, -100] and short.loss_weights[3:] == [0.0, 0.0]
    with pytest.raises(ValueError):
        batching.require_features(rows.limit(0))
    with pytest.raises(ValueError):
        batching.assign_batches(rows, ["batch_id"], 0)


@pytest.mark.parametrize("batch_size", [1, 3, 7, 1000])
def test_padded_batches_equal_the_two_steps(spark, batch_size):
    n = F.pmod(F.xxhash64("id"), F.lit(9)).cast("int")
    # Every fifth row repeats the key of the one before it, with a length of its own.
    key = F.when(F.col("id") % 5 == 4, F.col("id") - 1).otherwise(F.col("id"))
    rows = spark.range(200).select(
        key.alias("key"), F.array_repeat(F.lit(1), n).alias("input_ids"),
        F.array_repeat(F.lit(1), n).alias("attention_mask"), F.array_repeat(F.lit(2), n).alias("labels"),
    )
    got = batching.padded_batches(rows, ["key"], batch_size, 5, pad_id=9)
    assert set(got.columns) == {*rows.columns, "ordinal", "batch_id", "batch_len"}
    found = got.collect()
    sizes = {}
    for row in found:
        sizes[row.batch_id] = max(sizes.get(row.batch_id, 0), sum(row.attention_mask))
    assert sorted(r.ordinal for r in found) == list(range(200))
    assert all(r.batch_id == r.ordinal // batch_size for r in found)
    assert all(len(r.input_ids) == len(r.labels) == r.batch_len == sizes[r.batch_id] for r in found)
    two = batching.assign_batches(rows, ["key"], batch_size, 5)
    assert sorted((r.ordinal, r.key) for r in two.collect()) == sorted((r.ordinal, r.key) for r in found)
    with pytest.raises(ValueError):
        batching.padded_batches(rows, ["key"], 0)


def test_batch_loss_reduction(spark):
    rows = spark.createDataFrame(
        [(0, [5, -100, 6, 7], [0.5, 0.5, 0.25, 1.0], [2.0, 3.0, 4.0, 9.0]),
         (1, [5, 6], [0.0, 0.0], [2.0, 3.0])],
        "batch_id long, labels array<int>, loss_weights array<double>, token_loss array<double>",
    )
    loss = {r.batch_id: (r.loss, r.weight_sum) for r in batching.batch_loss(rows).collect()}
    # Position 0 predicts label 1 (ignored), 1 predicts 2, 2 predicts 3.
    assert loss[0] == ((3.0 * 0.25 + 4.0 * 1.0) / 1.25, 1.25)
    assert loss[1] == (0.0, 0.0)
