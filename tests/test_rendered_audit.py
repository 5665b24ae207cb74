"""Audits of rendered examples, and lists that no template takes."""

import public_tokenizers

from colloquy.functions import rendering
from colloquy.functions import tokens as tok
from colloquy.functions.messages import MESSAGE
from colloquy.operators import audits, formatters

PATH = public_tokenizers.path("byte_bpe_50k.json")
END, END_ID = "<|endoftext|>", 50256


def say(role, content):
    return {"role": role, "content": content}


def audited(spark, lists, template):
    kind = f"id int, messages array<{MESSAGE.simpleString()}>"
    df = spark.createDataFrame(list(enumerate(lists)), kind)
    out = audits.audit_rendered(df, template, tok.tokenizer_file(PATH), END_ID, tok.tokenizer_file_decoder(PATH))
    return {row.id: row for row in out.collect()}, out


def test_ids_and_decoded_ends_are_those_of_the_library(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(PATH)
    lists = [
        [say("user", "hi"), say("assistant", "yes" + END)],
        [say("user", "a " * 400), say("assistant", "never ends")],
        [say("user", "mid" + END), say("assistant", "and on and on and on")],
    ]
    rows, _ = audited(spark, lists, rendering.PlainTemplate())
    for n, items in enumerate(lists):
        text = "\n".join(f"{m['role']}:{m['content']}" for m in items)
        ids = model.encode(text, add_special_tokens=False).ids
        row = rows[n]
        assert (row.rendered, row.input_ids) == (text, ids)
        assert row.eos_positions == [i for i, x in enumerate(ids) if x == END_ID]
        assert row.first_text == model.decode(ids[:50], skip_special_tokens=False)
        assert row.last_text == model.decode(ids[-50:], skip_special_tokens=False)
    assert [rows[n].has_final_eos for n in range(3)] == [True, False, False]
    assert [rows[n].issues for n in range(3)] == [[], [audits.NO_FINAL_EOS], [audits.NO_FINAL_EOS]]


def test_refused_empty_and_null_lists(spark):
    lists = [[say("system", "rules"), say("user", "hi")], [], None, [None], [say("user", None)]]
    rows, out = audited(spark, lists, rendering.PlainTemplate(rejects_system=True))
    assert rows[0].issues == ["Chat template error: System role not supported"]
    for n in range(5):
        assert (rows[n].rendered, rows[n].sequence_length, rows[n].has_final_eos, rows[n].first_text) == ("", 0, False, "")
    assert [rows[n].issues for n in range(1, 5)] == [[]] * 4
    assert audits.corpus_summary(out).first().samples_with_issues == 1
    assert audits.corpus_summary(out.limit(0)).first().samples_analyzed == 0


def test_reasons_of_refused_merges(spark):
    def turns(*pairs):
        return [{"from": who, "value": text} for who, text in pairs]

    s, u, a = ("system", "rules"), ("human", "hi"), ("gpt", "yes")
    lists = [turns(s, u, a), turns(u, a), turns(u, s, a), turns(s, s, u), turns(s, u, s, a), turns(s), [], None]
    df = spark.createDataFrame(list(enumerate(lists)), "id int, conversations array<struct<`from`: string, value: string>>")
    strict = rendering.PlainTemplate(rejects_system=True)
    refused = formatters.refused_conversations(df, strict)
    lost, again = rendering.NO_PLACE_TO_MERGE, "System role not supported"
    assert {row.id: row.reason for row in refused.collect()} == {2: lost, 3: lost, 4: again, 5: lost, 7: rendering.NO_LIST}
    kept = formatters.shared_conversation(df, strict).where("text IS NOT NULL")
    assert sorted(r.text for r in kept.collect()) == ["", "user:System: rules\nhi\nassistant:yes", "user:hi\nassistant:yes"]
    assert [r.id for r in formatters.refused_conversations(df).collect()] == [7]
