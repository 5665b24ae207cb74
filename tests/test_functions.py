"""Functions against plain Python on generated values."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from colloquy.functions import completions, jsontext, policy, rewards, text, toolcalls
from colloquy.functions import messages as msg
from colloquy.operators import scoring
from colloquy.schemas import MESSAGE, TOOL_CALL


def column(spark, values, build, kind="string"):
    """Apply a Column function to Python values."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}").repartition(3)
    return [r.out for r in df.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


def noise(seed, n, alphabet):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(n)]


ODD = "ab '\"\\\n\t\r\x00\x1c\x85\xa0é中😀 /{}:"


def test_strip_and_blank(spark):
    values = noise(1, 300, " \n\t\x1c\x1f\x85\xa0　a.")
    assert column(spark, values, text.strip) == [v.strip() for v in values]
    assert column(spark, values, text.has_text) == [bool(v.strip()) for v in values]
    assert column(spark, [None], text.has_text) == [False]


def test_preview(spark):
    values = [v * 9 for v in noise(2, 100, "ab \n\x1c\xa0")]

    def plain(v):
        flat = " ".join(v.split())
        return flat if len(flat) <= 20 else flat[:20] + "..."

    assert column(spark, values, lambda c: text.preview(c, 20)) == [plain(v) for v in values]


def test_occurrences_do_not_overlap(spark):
    values = noise(3, 200, "ab") + ["aaaa"]
    assert column(spark, values, lambda c: text.occurrences(c, "aa")) == [v.count("aa") for v in values]


def test_json_string_and_quoted_literal(spark):
    values = noise(4, 400, ODD) + ["plain", "it's", 'a"b', "both'\""]
    assert column(spark, values, text.json_ascii_string) == [json.dumps(v) for v in values]
    assert column(spark, values, text.quoted_literal) == [repr(v) for v in values]


def test_slug(spark):
    assert column(spark, ["Qwen/Qwen3.5 0.8B!", "__a__"], text.slug) == ["qwen_qwen3_5_0_8b", "a"]
    with pytest.raises(Exception, match="no slug"):
        column(spark, ["---"], text.slug)


def test_names(spark):
    names = ["m-lora-v1", "x-lora", "lora1", "plain"]
    assert column(spark, names, text.adapter_to_gguf) == ["m-gguf-v1", "x-gguf", "gguf1", "plain-gguf"]
    assert column(spark, names, text.with_adapter_suffix) == ["m-lora-v1-lora", "x-lora", "lora1-lora", "plain-lora"]
    assert column(spark, names, text.without_adapter_suffix) == ["m-lora-v1", "x", "lora1", "plain"]
    host = "host-1"
    assert column(spark, [host], text.pseudonym) == ["sha256:" + hashlib.sha256(host.encode()).hexdigest()[:16]]


JSON_TEXTS = ['{"a": 1}', '{"a": 1}x', "[1, 2]", "1],[2", '1},{"v":2', "1,2", "", " ", '"s"', "null",
              '{"a": 1}]', "{", '{"a": [1, {"b": "]"}]}', "nul", "tru e", '{"a":1} ']


def test_strict_json(spark):
    def valid(t):
        try:
            json.loads(t)
            return True
        except ValueError:
            return False

    got = column(spark, JSON_TEXTS, lambda c: jsontext.strict_json(c).isNotNull())
    assert got == [valid(t) for t in JSON_TEXTS]


def test_canonical_json(spark):
    values = ['{"b": 1.50, "a": "é"}', "[1,2]", "{", None, '{"a": 1e5, "A": null}']
    expected = []
    for v in values:
        try:
            expected.append(json.dumps(json.loads(v), sort_keys=True))
        except (ValueError, TypeError):
            expected.append(None)
    assert column(spark, values, jsontext.canonical_json) == expected


# Tool calls ---------------------------------------------------------------

def call(**fields):
    return {name: fields.get(name) for name in TOOL_CALL.fieldNames()}


CALLS = [
    call(name="light", arguments='{"room": "living", "n": [1, {"x": "é"}]}'),
    call(function={"name": "light", "arguments": '{"on": true}'}),
    call(name="only"),
    call(name="broken", arguments="{oops"),
    call(id="custom_id_123", name="a", arguments="{}"),
    call(function={"name": "f", "arguments": None}, type="function"),
    call(name='quo"te\n', arguments=""),
]


def plain_call(c, family):
    """The rules of each family, on a dict without absent fields."""
    inner = c["function"] if c["function"] is not None else c
    name, arguments = inner["name"], inner["arguments"]
    if family in ("qwen", "gemma"):
        try:
            json.loads(arguments)
        except (ValueError, TypeError):
            arguments = "{}"
        return name, arguments, None
    if family == "openai":
        body = {k: v for k, v in c.items() if v is not None}
        if "function" in body:
            body["function"] = {k: v for k, v in body["function"].items() if v is not None}
        digest = hashlib.md5(json.dumps(body, sort_keys=True).encode()).hexdigest()
        return name, arguments or "{}", c["id"] or f"call_{digest[:12]}"
    return name, "{}" if arguments is None else arguments, None


@pytest.mark.parametrize("family", ["qwen", "gemma", "openai", "generic"])
def test_call_normalization(spark, family):
    got = column(
        spark, [[c] for c in CALLS],
        lambda v: toolcalls.normalize_calls(v, family), f"array<{TOOL_CALL.simpleString()}>",
    )
    shown = [
        (c[0].function.name if c[0].function else c[0].name,
         c[0].function.arguments if c[0].function else c[0].arguments, c[0].id)
        for c in got
    ]
    assert shown == [plain_call(c, family) for c in CALLS]
    if family == "openai":
        assert all(c[0].type == "function" and c[0].name is None for c in got)


def test_call_list_guard(spark):
    kind = f"array<{TOOL_CALL.simpleString()}>"
    got = column(spark, [None, [], [None], [None, CALLS[2]]],
                 lambda v: F.size(toolcalls.normalize_calls(v, "generic")), kind)
    assert got == [None, None, None, 1]


@pytest.mark.parametrize("tag,same", [("GPT", "openai"), ("Qwen", "qwen"), ("nobody", "generic")])
def test_registry(tag, same):
    assert toolcalls.normalizer_for(tag) is toolcalls.normalizer_for(same)


def test_family_detection(spark):
    names = ["Qwen/Qwen3.5-0.8B", "google/gemma-2", "gpt-4", "text-davinci-003", "Claude-3", "llama", None, ""]
    assert column(spark, names, toolcalls.detect_family) == [
        "qwen", "gemma", "openai", "openai", "openai", "generic", "generic", "generic"]
    assert column(spark, [" GEMMA "], lambda c: toolcalls.detect_family(F.lit("qwen"), c)) == ["gemma"]


# Messages -----------------------------------------------------------------

def message(**fields):
    return {name: fields.get(name) for name in MESSAGE.fieldNames()}


def normalize(spark, items, family="generic", **options):
    return column(spark, [items],
                  lambda v: msg.normalize_messages(v, family, **options),
                  f"array<{MESSAGE.simpleString()}>")[0]


def test_message_rules(spark):
    items = [
        message(role="user", content="hi"),
        message(role="assistant", content=None, tool_calls=[CALLS[0]]),
        message(role=None, content="x"),
        message(role="tool", content="42", tool_name=" calc ", name=""),
        message(role="tool", content="42", tool_name="calc", name=" mine "),
        message(role="assistant", content="called", tool_calls=[CALLS[1]]),
        None,
    ]
    got = normalize(spark, items)
    assert [(m.role, m.tool_name, m.name) for m in got] == [
        ("user", None, None), ("tool", "calc", "calc"), ("tool", "calc", "mine"), ("assistant", None, None)]
    assert got[3].tool_calls[0].name == "light"
    kept = normalize(spark, items, keep_null_content=True)
    assert [m.role for m in kept] == ["user", "assistant", "tool", "tool", "assistant"]


@pytest.mark.parametrize("family", ["qwen", "generic", "openai"])
def test_embedded_calls(spark, family):
    body = {"tool_calls": [{"name": "f", "arguments": {"b": 1, "a": "é"}}, 3, {"function": {"name": "g"}}]}
    items = [
        message(role="assistant", content=" \n" + json.dumps(body), name="lost"),
        message(role="assistant", content='{"tool_calls": null}'),
        message(role="assistant", content='{"tool_calls": [1, "x"]}'),
        message(role="assistant", content='{"other": 1}', name="kept"),
        message(role="assistant", content='{"tool_calls": []} trailing'),
        message(role="user", content=json.dumps(body)),
    ]
    got = normalize(spark, items, family)
    assert [m.content is None for m in got] == [True, True, True, False, False, False]
    assert [m.tool_calls is None for m in got] == [False, True, True, True, True, True]
    assert [m.name for m in got] == [None, None, None, "kept", None, None]
    first = got[0].tool_calls
    if family == "openai":
        expected = hashlib.md5(json.dumps(body["tool_calls"][0], sort_keys=True).encode()).hexdigest()
        assert first[0].id == "call_" + expected[:12]
        assert first[0].function.arguments == json.dumps({"a": "é", "b": 1})
        assert first[1].function.name == "g" and first[1].function.arguments == "{}"
    else:
        assert json.loads(first[0].arguments) == {"a": "é", "b": 1}
        assert [c.name for c in first] == ["f", "g"] and first[1].arguments == "{}"


# Rewards ------------------------------------------------------------------

def plain_rewards(t, completion, answer):
    start, stop, sol, end = t.all()
    fmt = re.compile(rf"^[\s]*{start}.+?{stop}.*?{sol}(.+?){end}[\s]*$", re.M | re.S)
    num = re.compile(rf"{sol}.*?([\d\.]+)", re.M | re.S)
    m, n = fmt.search(completion), num.search(completion)
    approx = sum(0.5 if completion.count(tag) == 1 else -0.5 for tag in t.all())
    score = 0.0
    if m and answer is not None:
        guess = m.group(1)
        if guess == answer:
            score = 3.0
        elif guess.strip() == answer.strip():
            score = 1.5
        else:
            try:
                r = float(guess) / float(answer)
                score = 0.5 if 0.9 <= r <= 1.1 else 0.25 if 0.8 <= r <= 1.2 else -1.0
            except (ValueError, ZeroDivisionError):
                score = -0.5
    number = 0.0
    if n and answer is not None:
        try:
            number = 1.5 if float(answer.strip()) == float(n.group(1).strip()) else 0.0
        except ValueError:
            number = 0.0
    return (3.0 if m else 0.0, approx, score, number)


@pytest.mark.parametrize("tags", [rewards.THINK_TAGS, rewards.WORKING_OUT_TAGS])
def test_rewards_equal_plain_python(spark, tags):
    rng = random.Random(5)
    values = ["4", " 4 ", "4.0", "1_0", "1__0", "10", "0", "nan", "inf", "-4", "+4", "4d", "1e1", ".5", "5.", "x",
              "", "1,000", "9.5", "8.1", "12", "\xa04", "Infinity", "1.2.3", "4f"]
    pieces = [*tags.all(), "\n", " ", "why", " ", *values]
    rows = []
    for _ in range(3000):
        if rng.random() < 0.7:
            s = (rng.choice(["", "\n", " ", "pre\n", "x"]) + tags.reasoning_start + rng.choice(["r", "a\nb", ""])
                 + tags.reasoning_end + rng.choice(["", "\n", " z "]) + tags.solution_start
                 + rng.choice(values) + tags.solution_end + rng.choice(["", " ", "\nend", " end", "\n"]))
        else:
            s = "".join(rng.choice(pieces) for _ in range(rng.randrange(10)))
        rows.append((s, rng.choice([*values, None])))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, completion string, true_answer string")
    got = scoring.score(df.repartition(4), tags=tags).orderBy("i").collect()
    names = [name for name, _ in rewards.REWARDS]
    for r, (completion, answer) in zip(got, rows, strict=True):
        expected = plain_rewards(tags, completion, answer)
        assert tuple(r[n] for n in names) == expected, (completion, answer)
        assert r.total == sum(expected)


def test_hash_answer(spark):
    values = ["a #### 4 ", "none", "#### 1 #### 2", "####", None]
    assert column(spark, values, rewards.hash_answer) == ["4", None, "1", "", None]


# Output audits ------------------------------------------------------------

def plain_loop(t):
    if len(t) < 50:
        return None
    for n in (10, 20, 30, 50):
        if len(t) >= n * 3 and t.count(t[-n:]) >= 3:
            return t[-n:]
    for m in ("Answer:", "Question:", "<|im_start|>", "<|endoftext|>", "<|im_end|>"):
        if t.count(m) > 5:
            return m
    return None


def test_loops_equal_plain_python(spark):
    rng = random.Random(6)
    parts = ["Answer:", "Question:", "<|im_end|>", "ab", "abc def ", "x" * 9, "é", "😀", "\n"]
    texts = [
        "".join(rng.choice(parts) for _ in range(rng.randrange(8))) * rng.randrange(1, 9)
        + rng.choice(["", "tail", "z" * 40]) for _ in range(1500)
    ]
    got = column(spark, texts, completions.loop_pattern)
    assert got == [plain_loop(t) for t in texts]
    assert 100 < sum(g is not None for g in got) < 1400


def test_stops(spark):
    ids = [[1, 2, 9], [9, 1, 2], [9, 1], [], [1]]
    assert column(spark, ids, lambda c: completions.stopped_by_tokens(c, 9), "array<int>") == [
        True, False, True, False, False]
    reasons = ["stop", "eos", "length", None, ""]
    assert column(spark, reasons, completions.stopped_by_reason) == [True, True, False, False, False]


# Policy -------------------------------------------------------------------

def summarize(spark, governance):
    df = spark.createDataFrame([(json.dumps({"governance": governance}),)], "t string")
    block = F.try_variant_get(jsontext.strict_json(F.col("t")), "$.governance", "variant")
    r = df.select(*[c.alias(n) for n, c in policy.summary(block).items()]).first()
    return r.has_metadata, list(r.classes_present), dict(r.class_counts), r.max_policy_class


def test_policy_summary(spark):
    assert summarize(spark, None) == (False, [], {}, "unknown")
    assert summarize(spark, "text") == (False, [], {}, "unknown")
    given = {"policy_classes_present": ["p3", "P1", "P3", "p2", " "],
             "policy_class_counts": {"p2": 9, "P3": 2, "P1": 3}, "max_policy_class": "p3"}
    assert summarize(spark, given) == (True, ["P1", "P2", "P3"], {"P2": 9, "P3": 2, "P1": 3}, "P3")
    counts = {"x": "2", "p4": 2.9, "P0": "many", " p1 ": " 7 ", "P1": "1_0", "": 3, "p2": None, "p3": True}
    assert summarize(spark, {"policy_class_counts": counts}) == (
        True, ["P1", "P3", "P4", "X"], {"X": 2, "P4": 2, "P1": 10, "P3": 1}, "X")
    assert summarize(spark, {}) == (True, [], {}, "unknown")
