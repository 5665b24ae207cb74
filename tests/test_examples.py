"""Contexts of long conversations against a plain walk over each conversation."""

import random

import pytest

from colloquy.operators import examples


def conversations(seed):
    """A few short conversations and one that spans many blocks.

    Turn numbers have gaps, small and large, and some turns have no text.
    """
    rng = random.Random(seed)
    rows = []
    for conv, n in ((1, 400), (2, 7), (3, 1), (4, 97)):
        turn = 0
        for _ in range(n):
            role = rng.choice(["user", "assistant", "assistant", "system"])
            text = "".join(rng.choice("ab ") for _ in range(rng.choice([0, 1, 3, 30])))
            rows.append((conv, turn, role, text if rng.random() < 0.8 else None))
            turn += rng.choice([1, 1, 1, 2, 200])
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def walk(rows):
    """``(conv, turn, earlier turns, text)`` of every assistant turn."""
    by_conv = {}
    for conv, turn, role, text in sorted(r for r in rows if r[3] is not None):
        by_conv.setdefault(conv, []).append((turn, role, text))
    for conv, items in by_conv.items():
        for i, (turn, role, text) in enumerate(items):
            if role == "assistant":
                yield conv, turn, items[:i], text


def size(item):
    return len(item[1]) + len(item[2]) + 2


@pytest.mark.parametrize("long", [True, False])
@pytest.mark.parametrize("reach", [1, 10, 40])
def test_single_turn_keeps_what_truncation_needs(spark, long, reach):
    rows = conversations(reach)
    got = {
        (r["session_id"], r["target_turn_index"]): r
        for r in examples.single_turn(frame(spark, rows), reach, long=long)
        .where("target_text IS NOT NULL")
        .collect()
    }
    expected = list(walk(rows))
    assert len(got) == len(expected)
    for conv, turn, earlier, text in expected:
        r = got[(str(conv), turn)]
        full = "\n".join([f"{role}:{said}" for _, role, said in earlier] + [f"assistant:{text}"])
        carried = "\n".join([f"{m.role}:{m.content}" for m in r.messages] + [f"assistant:{text}"])
        assert carried[-reach:] == full[-reach:]
        assert r.omitted_tokens + len(carried) == len(full)
        assert r.omitted_messages + len(r.messages) == len(earlier)
        assert r.asked == any(role == "user" and said.strip() for _, role, said in earlier)


@pytest.mark.parametrize("long", [True, False])
@pytest.mark.parametrize("budget,overhead", [(60, 10), (25, 0), (10, 10)])
def test_budget_keeps_newest_that_fit(spark, long, budget, overhead):
    rows = conversations(budget)
    got = {
        (r["session_id"], r["target_turn_index"]): r
        for r in examples.budgeted(frame(spark, rows), budget, overhead, long=long).collect()
    }
    for conv, turn, earlier, _ in walk(rows):
        kept, used = [], overhead
        for item in reversed(earlier):
            used += size(item)
            if used > budget:
                break
            kept.insert(0, item)
        r = got[(str(conv), turn)]
        assert [(m.role, m.content) for m in r.messages] == [(i[1], i[2]) for i in kept]
        assert r.omitted_messages == len(earlier) - len(kept)
        assert r.omitted_tokens == sum(map(size, earlier[: len(earlier) - len(kept)]))


def merged(rows):
    out = []
    for conv, turn, role, text in sorted(r for r in rows if r[3] is not None):
        last = out[-1] if out else None
        if last and last[0] == conv and role == "assistant" == last[2]:
            out[-1] = (conv, turn, role, last[3] + "\n\n" + text, last[4] + 1)
        else:
            out.append((conv, turn, role, text, 1))
    return out


@pytest.mark.parametrize("long", [True, False])
def test_merge_runs_across_blocks(spark, long):
    rows = conversations(3)
    # One run that covers several blocks whole, and one that starts inside a block.
    rows += [(5, t, "user" if t in (0, 200) else "assistant", f"t{t}") for t in range(300)]
    rows += [(6, t, "assistant", f"t{t}") for t in range(150)]
    got = examples.merge_consecutive_assistant(frame(spark, rows), reach=10, long=long)
    assert sorted(map(tuple, got.collect())) == sorted(merged(rows))


def test_examples_of_merged_turns_cross_blocks(spark):
    rows = [(1, t, "user" if t % 70 == 0 else "assistant", "x" * (t % 5)) for t in range(300)]
    turns = examples.merge_consecutive_assistant(frame(spark, rows), reach=10, long=True)
    got = {
        r["target_turn_index"]: r
        for r in examples.single_turn(turns, 10, long=True).collect()
    }
    plain = [row[:4] for row in merged(rows)]
    for _, turn, earlier, text in walk(plain):
        r = got[turn]
        full = "\n".join([f"{role}:{said}" for _, role, said in earlier] + [f"assistant:{text}"])
        carried = "\n".join([f"{m.role}:{m.content}" for m in r.messages] + [f"assistant:{text}"])
        assert carried[-10:] == full[-10:]
        assert r.omitted_tokens + len(carried) == len(full)


@pytest.mark.parametrize("reach", [None, 10])
def test_turns_without_text_are_rows_without_target(spark, reach):
    rows = conversations(2)
    out = examples.single_turn(frame(spark, rows), reach).where("target_text IS NULL").collect()
    lost = [(str(conv), turn) for conv, turn, role, text in rows if role == "assistant" and text is None]
    assert sorted((r.session_id, r.target_turn_index) for r in out) == sorted(lost)
    assert all(not r.messages for r in out)


def test_whole_contexts(spark):
    rows = conversations(4)
    out = examples.single_turn(frame(spark, rows)).where("target_text IS NOT NULL").collect()
    got = {(r.session_id, r.target_turn_index): r for r in out}
    expected = list(walk(rows))
    assert len(got) == len(expected)
    for conv, turn, earlier, text in expected:
        r = got[str(conv), turn]
        assert [(m.role, m.content) for m in r.messages] == [item[1:] for item in earlier]
        assert r.target_text == text and "omitted_tokens" not in out[0].asDict()


@pytest.mark.parametrize("long", [True, False])
def test_budget_in_tokens_of_a_real_tokenizer(spark, long):
    from pyspark.sql import functions as F

    from colloquy.functions.tokens import ArrowTokenizer, each_text

    words = ArrowTokenizer(lambda: each_text(lambda t: [1] * len(t.split())))
    rows = [(1, t, "assistant" if t % 2 else "user", "w " * (t % 7)) for t in range(120)]
    out = examples.budgeted(
        frame(spark, rows), 12, tokens=words.count(F.col("text")), long=long
    )
    got = {r.target_turn_index: len(r.messages) for r in out.collect()}
    for _, turn, earlier, _ in walk(rows):
        used, kept = 0, 0
        for item in reversed(earlier):
            used += max(1, len(item[2].split()))
            if used > 12:
                break
            kept += 1
        assert got[turn] == kept
