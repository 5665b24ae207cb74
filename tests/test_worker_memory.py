"""A Python worker holds a slice of a batch at a time, however many rows the batch has."""

import os
import random
import shutil
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.serializers import CloudPickleSerializer
from pyspark.sql import functions as F

from colloquy.functions import tokens as tok
from colloquy.functions.messages import MESSAGE
from colloquy.functions.rendering import PlainTemplate
from colloquy.operators import audits, examples
from colloquy.operators import tokenization as tz

#: What a call may get: a slice, and for each line what stands for the next one.
ROOM = tok.SLICE_BYTES * 5 // 4
LARGE = "z" * (2 * tok.SLICE_BYTES)


def careful():
    """A byte per token; a call with several texts beyond a slice is an error."""

    def ids(texts):
        if len(texts) > 2 and sum(len(t.encode()) for t in texts) > ROOM:
            raise MemoryError(f"{len(texts)} texts at once")
        return [list(t.encode()) for t in texts]

    return tok.ArrowTokenizer(lambda: ids, splits_at_lines=True)


def texts(n):
    rng = random.Random(n)
    rows = ["é" * rng.randrange(400) for _ in range(n)] + [None, "", LARGE, None, "end"]
    return [(i, t) for i, t in enumerate(rows)]


def size(text):
    return None if text is None else len(text.encode())


@pytest.mark.parametrize("n", [0, 3000])
def test_batches_are_encoded_by_slices(spark, n):
    rows = texts(n)
    df = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    by = careful()
    ids = {r.id: r.ids for r in df.select("id", by.encode(F.col("text")).alias("ids")).collect()}
    assert ids == {i: None if t is None else list(t.encode()) for i, t in rows}
    counts = df.select("id", by.count(F.col("text")).alias("n")).collect()
    assert {r.id: r.n for r in counts} == {i: size(t) for i, t in rows}


def test_slices_hold_all_rows_in_order():
    lists = pa.array([[1] * 1000, None, [], [2] * tok.SLICE_BYTES, [3]] * 200, pa.list_(pa.int32()))
    words = pa.array(["ab", None, "", "c" * 100, "d"] * 200)
    found = list(tok.slices(lists, words))
    assert pa.concat_arrays([a for a, _ in found]).equals(lists) and pa.concat_arrays([b for _, b in found]).equals(words)
    assert all(len(a) == 1 or 4 * len(a.flatten()) <= tok.SLICE_BYTES for a, _ in found)
    assert list(tok.slices(words[:0])) == []
    assert [len(a) for (a,) in tok.slices(words)] == [len(words)]


def test_ids_with_counts_of_other_texts(spark):
    rows = texts(2000)
    df = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    other, none = F.concat("text", F.lit("!")), F.lit(None).cast("string")
    coded = df.select("id", careful().encode_and_count(F.col("text"), other, none).alias("c")).select("id", "c.*")
    want = {i: (None, None, None) if t is None else (list(t.encode()), size(t) + 1, None) for i, t in rows}
    assert {r.id: (r.ids, r.n, r.m) for r in coded.collect()} == want


def test_ids_are_decoded_by_slices(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = texts(3000)
    df = spark.createDataFrame(rows, "id int, text string").coalesce(1).withColumn("ids", tok.tokenizer_file(path).encode(F.col("text")))
    back = df.select("id", tok.tokenizer_file_decoder(path)(F.col("ids")).alias("text")).collect()
    assert {r.id: r.text for r in back} == dict(rows)


def test_lines_are_counted_by_slices(spark):
    rows = texts(3000)
    df = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    counts = df.select("id", careful().count_line(F.col("text")).alias("n")).collect()
    assert {r.id: r.n for r in counts} == {i: None if t is None else size(t) + 1 for i, t in rows}


@pytest.mark.parametrize("limit", [100, 1 << 30])
def test_rows_are_tokenized_by_slices(spark, limit):
    """Whole contexts and contexts within reach; the targets are as long as the texts."""
    turns = [(c, n, "user" if n % 2 == 0 else "assistant", f"{c} {n} " + "x" * 300) for c in range(400) for n in range(6)]
    turns = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").coalesce(1)
    spec = tz.assistant_only(limit, tokenizer=careful())
    reach = limit if limit < 1000 else None
    tokens = examples.line_tokens(F.col("role"), F.col("text"), spec.tokenizer)
    rows = examples.single_turn(turns, reach, tokens=tokens, long=False).coalesce(1)
    out = tz.tokenize(rows, spec).select("example_id", "n_tokens", "prompt_len", "is_truncated").collect()
    want = set()
    for c in range(400):
        for n in (1, 3, 5):
            sizes = [len(f"{'user' if k % 2 == 0 else 'assistant'}:{c} {k} ") + 301 for k in range(n + 1)]
            whole, over = sum(sizes) - 1, max(sum(sizes) - 1 - limit, 0)
            prompt = sum(sizes[:-1]) + len("assistant:")
            want.add((f"{c}-{n}", min(whole, limit), max(prompt - over, 0), int(over > 0)))
    assert set(map(tuple, out)) == want and len(out) == 1200


def rendered(spark, decode):
    pairs = [[{"role": "user", "content": "q" * 500}, {"role": "assistant", "content": f"{n}" + ("!" if n % 3 else "")}] for n in range(2000)]
    df = spark.createDataFrame(list(enumerate(pairs)), f"id int, messages array<{MESSAGE.simpleString()}>").coalesce(1)
    return audits.audit_rendered(df, PlainTemplate(), careful(), ord("!"), decode)


def test_issues_of_rendered_rows_are_found_by_slices(spark):
    rows = audits.issue_histogram(rendered(spark, lambda ids: F.lit("")), []).collect()
    assert [(r.issue, r.occurrences) for r in rows] == [(audits.NO_FINAL_EOS, 667)]


def test_both_ends_of_rendered_rows_are_decoded(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    rows = rendered(spark, tok.tokenizer_file_decoder(path)).select("id", "rendered", "first_text", "last_text", "issues").collect()
    assert len(rows) == 2000
    for r in rows:
        ids = list(r.rendered.encode())
        assert r.first_text == model.decode(ids[:50], skip_special_tokens=False)
        assert r.last_text == model.decode(ids[-50:], skip_special_tokens=False)
        assert r.issues == ([] if r.id % 3 else [audits.NO_FINAL_EOS])


def tasks(function, values, n=5):
    """What ``n`` tasks of a worker get: each unpickles the function anew."""
    sent = CloudPickleSerializer().dumps(function.func)
    return [CloudPickleSerializer().loads(sent)(values).to_pylist() for _ in range(n)]


def test_a_worker_reads_a_tokenizer_file_once_for_all_tasks(tmp_path, monkeypatch):
    import public_tokenizers
    import tokenizers

    real, reads = tokenizers.Tokenizer, []

    class Counted:
        @staticmethod
        def from_file(path):
            reads.append(path)
            return real.from_file(path)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    path = str(tmp_path / "model.json")
    shutil.copy(public_tokenizers.path("byte_bpe_50k.json"), path)
    ids = real.from_file(path).encode("one two\nthree", add_special_tokens=False).ids
    values = pa.array(["one two\nthree", None, ""])
    assert tasks(tok.tokenizer_file(path)._count, values) == [[len(ids), None, 0]] * 5
    back = tasks(tok.tokenizer_file_decoder(path), pa.array([ids, None, []], pa.list_(pa.int32())))
    assert back == [["one two\nthree", None, ""]] * 5
    assert reads == [path]
    # A file that was written again is another model.
    real.from_file(path).save(path, pretty=True)
    assert tasks(tok.tokenizer_file(path)._count, values) == [[len(ids), None, 0]] * 5
    assert reads == [path] * 2


def test_a_worker_reads_a_piece_file_once_for_all_tasks(monkeypatch):
    import public_tokenizers
    import sentencepiece

    real, reads = sentencepiece.SentencePieceProcessor, []

    def counted(model_file):
        reads.append(model_file)
        return real(model_file=model_file)

    path = public_tokenizers.path("piece_bpe_32k.model")
    want = len(real(model_file=path).encode("one two"))
    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", counted)
    assert tasks(tok.sentencepiece_file(path)._count, pa.array(["one two", None])) == [[want, None]] * 5
    assert reads == [path]


def test_a_worker_decodes_both_ends_of_all_tasks_with_one_model(tmp_path, monkeypatch):
    import public_tokenizers
    import tokenizers

    real, reads = tokenizers.Tokenizer, []

    class Counted:
        @staticmethod
        def from_file(path):
            reads.append(path)
            return real.from_file(path)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    path = str(tmp_path / "model.json")
    shutil.copy(public_tokenizers.path("byte_bpe_50k.json"), path)
    ids = real.from_file(path).encode("one <|endoftext|> é", add_special_tokens=False).ids
    decode = tok.tokenizer_file_decoder(path)
    for end, text in ((ids, "one <|endoftext|> é"), (ids[-1:], real.from_file(path).decode(ids[-1:]))):
        assert tasks(decode, pa.array([end, None], pa.list_(pa.int32()))) == [[text, None]] * 5
    assert reads == [path]


THREADS = """
import os
import public_tokenizers
import pyarrow as pa
from colloquy.functions import tokens as tok

path = public_tokenizers.path("byte_bpe_50k.json")
encode, decode = tok.tokenizer_file(path)._encode, tok.tokenizer_file_decoder(path)
texts = pa.array(["one two", None, "", "three <|endoftext|> four"] * 100)
before = len(os.listdir("/proc/self/task"))
ids = pa.concat_arrays(encode.func(iter([texts])))
assert decode.func(ids).equals(texts)
print(len(os.listdir("/proc/self/task")) - before)
"""


def test_a_worker_starts_no_threads_of_its_own(tmp_path):
    """Whatever number of cores the host has: each thread holds memory of its own, in every worker."""
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    env |= {"RAYON_NUM_THREADS": "16", "PYTHONPATH": str(Path(tok.__file__).parents[2])}
    done = subprocess.run([sys.executable, "-c", THREADS], env=env, cwd=tmp_path, capture_output=True, text=True, check=True)
    assert done.stdout.split() == ["0"]
