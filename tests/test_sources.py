"""Manifests, releases, stores and settings on local folders."""

import hashlib
import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from colloquy.operators import governance
from colloquy.schemas import DPO_ROW, SFT_ROW
from colloquy.sources import comparison_store, prompts, records, registry, release, storage
from colloquy.sources import manifest as mf


def write(path, rows):
    pq.write_table(pa.Table.from_pylist(rows), path)


def write_manifest(folder, splits, **more):
    body = {"dataset_id": "general", "dataset_version": "v1", "splits": splits, **more}
    (folder / "manifest.json").write_text(json.dumps(body), encoding="utf-8")
    return str(folder / "manifest.json")


SFT = {"messages": [{"role": "user", "content": "hi"}], "target_text": "hello"}
PAIR = {"prompt": "p", "chosen": "c", "rejected": "r"}


def test_sft_manifest(spark, tmp_path):
    write(tmp_path / "train.parquet", [SFT])
    write(tmp_path / "eval.parquet", [SFT, SFT])
    uri = write_manifest(tmp_path, [{"split": "train", "key": str(tmp_path / "train.parquet")},
                                    {"split": "eval", "key": "eval.parquet"}])
    got = mf.load_sft_release(spark, uri)
    assert got.split("train").count() == 1 and got.split("eval").count() == 2
    assert [f.dataType for f in got.rows.schema.fields[: len(SFT_ROW.fields)]] == [
        f.dataType for f in SFT_ROW.fields]
    digest = hashlib.sha256((tmp_path / "manifest.json").read_bytes()).hexdigest()
    assert got.lineage().first().manifest_sha256 == digest
    mf.load_sft_release(spark, uri, expected_sha256=f" {digest.upper()} ")
    with pytest.raises(ValueError, match="digest mismatch"):
        mf.load_sft_release(spark, uri, expected_sha256="0" * 64)


def test_file_names_with_special_characters(spark, tmp_path):
    folder = tmp_path / "a b%20+ü"
    folder.mkdir()
    write(folder / "tr ain+1%.parquet", [SFT])
    write(folder / "eval=é.parquet", [SFT])
    (folder / "in").mkdir()
    uri = write_manifest(folder, [{"split": "train", "key": "in/../tr ain+1%.parquet"},
                                  {"split": "eval", "key": "./eval=é.parquet"}])
    assert mf.load_sft_release(spark, uri).rows.count() == 2


def test_first_rows_follow_manifest_and_file_order(spark, tmp_path):
    for name, first in (("b", 0), ("a", 10), ("c", 20)):
        write(tmp_path / f"{name}.parquet", [{**SFT, "example_id": str(first + i)} for i in range(10)])
    keys = [{"split": "train", "key": f"{n}.parquet"} for n in "bac"]
    uri = write_manifest(tmp_path, keys + [{"split": "eval", "key": "a.parquet"}])

    def ids(limit):
        rows = mf.load_sft_release(spark, uri, max_train_samples=limit, max_eval_samples=0).rows
        return sorted(int(r.example_id) for r in rows.collect())

    assert ids(14) == list(range(14))
    assert ids(0) == [] and ids(99) == list(range(30)) == ids(None)
    assert ids(10) == list(range(10)) and ids(20) == list(range(20)) and ids(3) == [0, 1, 2]
    uris = [str(tmp_path / f"{n}.parquet") for n in "bac"]
    ordered = mf.with_file_order(spark, uris).orderBy("file_pos", "row_index").collect()
    assert [int(r.example_id) for r in ordered] == list(range(30))


def test_splits_may_disagree_on_argument_types(spark, tmp_path):
    def row(arguments):
        calls = [{"name": "control", "arguments": arguments}]
        return {"messages": [{"role": "assistant", "content": "call", "tool_calls": calls}],
                "target_text": "done"}

    write(tmp_path / "train.parquet", [row({"action": "off", "n": 1})])
    write(tmp_path / "eval.parquet", [row({"trigger": {"id": "x"}})])
    uri = write_manifest(tmp_path, [{"split": s, "key": f"{s}.parquet"} for s in ("train", "eval")])
    rows = {r["split"]: r for r in mf.load_sft_release(spark, uri).rows.collect()}
    texts = {s: r.messages[0].tool_calls[0].arguments for s, r in rows.items()}
    assert json.loads(texts["train"]) == {"action": "off", "n": 1}
    assert json.loads(texts["eval"]) == {"trigger": {"id": "x"}}


def differing_files(tmp_path):
    """Files of one split with different columns, and with contradicting types of one."""
    said = {"role": "assistant", "content": "from a message"}
    write(tmp_path / "a.parquet", [{"example_id": "a", "target_text": "from a text", "session_id": 1}])
    write(tmp_path / "b.parquet", [{"example_id": "b", "target_message": said, "session_id": "two"}])
    write(tmp_path / "c.parquet", [{"example_id": "c", "target_text": "c", "target_mode": "m"}])


@pytest.mark.parametrize("order", ["abc", "cba", "bac"])
def test_files_of_a_split_may_differ(spark, tmp_path, order):
    differing_files(tmp_path)
    split = {"train": [f"{name}.parquet" for name in order], "eval": ["a.parquet"]}
    uri = write_manifest(tmp_path, [{"split": k, "key": f} for k, files in split.items() for f in files])
    rows = mf.load_sft_release(spark, uri).split("train").collect()
    got = {r.example_id: (r.target_text, r.target_message and r.target_message.content, r.session_id) for r in rows}
    assert got == {"a": ("from a text", None, "1"), "b": (None, "from a message", "two"), "c": ("c", None, None)}
    first = mf.load_sft_release(spark, uri, max_train_samples=2).split("train").collect()
    assert sorted(r.example_id for r in first) == sorted(order[:2])
    uris = [f"{tmp_path}/{name}.parquet" for name in order]
    placed = mf.with_file_order(spark, uris, SFT_ROW).orderBy("file_pos", "row_index").collect()
    assert "".join(r.example_id for r in placed) == order


def test_manifest_errors(spark, tmp_path):
    write(tmp_path / "train.parquet", [SFT])
    uri = write_manifest(tmp_path, [{"split": "train", "key": "train.parquet"}, {"split": "eval", "key": 5},
                                    "text", {"split": 1, "key": "x"}])
    with pytest.raises(ValueError, match="no files in manifest split 'eval'"):
        mf.load_sft_release(spark, uri)
    with pytest.raises(ValueError, match="no files"):
        mf.load_sft_release(spark, write_manifest(tmp_path, "none"))
    with pytest.raises(ValueError, match="cache_mode"):
        mf.load_sft_release(spark, uri, cache_mode="never")
    for text in ("[1]", "{", '{"a": 1} x'):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(Exception, match="manifest must be a JSON object"):
            mf.read_manifest(spark, str(tmp_path / "bad.json")).collect()


def test_dpo_manifest(spark, tmp_path):
    write(tmp_path / "train.parquet", [PAIR] * 3)
    write(tmp_path / "eval.parquet", [PAIR] * 2)
    uri = write_manifest(tmp_path, [{"split": s, "key": f"{s}.parquet"} for s in ("train", "eval")])
    got = mf.load_dpo_release(spark, uri, max_train_samples=2, max_eval_samples=1, cache_mode="refresh")
    assert got.split("train").count() == 2 and got.split("eval").count() == 1
    assert set(DPO_ROW.fieldNames()) <= set(got.rows.columns)
    write(tmp_path / "eval.parquet", [{"prompt": "p", "chosen": "c"}])
    with pytest.raises(ValueError, match=r"split eval: \['rejected'\]"):
        mf.load_dpo_release(spark, uri)


def test_refresh_sees_replaced_files(spark, tmp_path):
    write(tmp_path / "train.parquet", [SFT])
    write(tmp_path / "eval.parquet", [SFT])
    uri = write_manifest(tmp_path, [{"split": s, "key": f"{s}.parquet"} for s in ("train", "eval")])
    assert mf.load_sft_release(spark, uri).rows.count() == 2
    write(tmp_path / "train.parquet", [SFT] * 5)
    assert mf.load_sft_release(spark, uri, cache_mode="refresh").rows.count() == 6


def test_uri_resolution(spark):
    cases = [
        ("s3://b/x/manifest.json", "/k/p", "s3://b/k/p"),
        ("s3a://b/x/manifest.json", "k/p", "s3://b/k/p"),
        ("s3://b/x/manifest.json", "s3://c/p", "s3://c/p"),
        ("/d/x/manifest.json", "k/p", "/d/x/k/p"),
        ("/d/x/manifest.json", "/k/p", "/k/p"),
    ]
    df = spark.createDataFrame(cases, "base string, key string, uri string")
    out = df.select(mf.resolve_uri(F.col("base"), F.col("key")).alias("got"), "uri").collect()
    assert all(r.got == r.uri for r in out)


def test_release_round_trip_with_governance(spark, tmp_path):
    rows = spark.range(40).select(
        F.lit("p").alias("prompt"), F.lit("c").alias("chosen"), F.lit("r").alias("rejected"),
        F.when(F.col("id") % 4 == 0, "eval").otherwise("train").alias("split"),
        F.when(F.col("id") == 3, " p4").otherwise("P1").alias("policy_class"),
    )
    uri = release.write_release(rows, str(tmp_path), "pairs", "v1", policy_class="policy_class",
                                construction={"split_seed": 42, "target_mode": "single_turn"})
    assert uri == f"{tmp_path}/dataset_id=pairs/dataset_version=v1/manifest.json"
    manifest = json.loads(open(uri).read())
    assert manifest["stats"] == {"train_rows": 30, "eval_rows": 10, "total_rows": 40}
    assert manifest["governance"] == {"policy_classes_present": ["P1", "P4"],
                                      "policy_class_counts": {"P1": 39, "P4": 1}, "max_policy_class": "P4"}
    got = mf.load_dpo_release(spark, uri)
    assert got.split("train").count() == 30 and got.split("eval").count() == 10
    record = {r.key: (r.kind, r.value) for r in records.lineage_record(got.manifest).collect()}
    assert record["dataset_split_seed"] == ("param", "42")
    assert record["total_rows"] == ("metric", "40.0")
    assert "dataset_token_budget" not in record
    summary = mf.policy_summary(got.manifest)
    with pytest.raises(governance.PolicyGateError, match="P4"):
        governance.enforce_gates(summary, push=True, assume_yes=True)
    with pytest.raises(governance.PolicyGateError, match="assume_yes"):
        governance.enforce_gates(summary, push=False, assume_yes=False)
    governance.enforce_gates(summary, push=False, assume_yes=True)
    with pytest.raises(Exception, match="(?i)exists"):
        release.write_release(rows, str(tmp_path), "pairs", "v1")


def test_release_names_with_special_characters(spark, tmp_path):
    rows = spark.range(6).select(
        F.col("id").cast("string").alias("example_id"), F.lit("x").alias("target_text"),
        F.when(F.col("id") < 2, "e:v/l").otherwise("tr ain").alias("split"))
    uri = release.write_release(rows, str(tmp_path), "a b", "v1 é+%")
    got = mf.load_sft_release(spark, uri, train_split="tr ain", eval_split="e:v/l")
    assert got.split("tr ain").count() == 4 and got.split("e:v/l").count() == 2


def test_records_append(spark, tmp_path):
    rows = spark.createDataFrame([("param", "a", "1")], "kind string, key string, value string")
    for _ in range(2):
        records.append_records(rows, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_comparison_store(spark, tmp_path):
    root = str(tmp_path)
    empty = comparison_store.load_comparison(spark, root, "org/base")
    assert empty.columns == ["row_id", "prompt", "vanilla"] and empty.count() == 0
    for version, text in (("v1", "old"), ("v2", "new")):
        table = spark.createDataFrame([(0, "p", text)], "row_id long, prompt string, vanilla string")
        comparison_store.save_comparison(table, root, "org/base", version)
    assert comparison_store.load_comparison(spark, root, "base").first().vanilla == "new"


def test_prompt_list(spark, tmp_path):
    uri = str(tmp_path / "prompts.json")
    assert prompts.load_prompts(spark, uri).count() == 0
    prompts.save_prompts(spark, uri, ["What is 25 * 13?", "zwei\n"])
    got = prompts.load_prompts(spark, uri).orderBy("position").collect()
    assert [r.prompt for r in got] == ["What is 25 * 13?", "zwei\n"]
    (tmp_path / "prompts.json").write_text("[broken")
    assert prompts.load_prompts(spark, uri).count() == 0


def test_storage_options():
    assert storage.s3_options({}) == {}
    assert storage.s3_options({"STORAGE_ACCOUNT": "k", "AWS_SECRET_ACCESS_KEY": "s", "STORAGE_KEY": "no"}) == {
        "fs.s3a.access.key": "k", "fs.s3a.secret.key": "s"}
    full = storage.s3_options({"AWS_ENDPOINT_URL": "http://x"})
    assert full == {"fs.s3a.endpoint": "http://x", "fs.s3a.endpoint.region": "us-east-1"}
    assert storage.hadoop_uri("s3://b/k") == "s3a://b/k"


def test_named_dataset_from_files(spark, tmp_path):
    for subset in ("ARC-Challenge", "ARC-Easy"):
        rows = [{"id": f"{subset}{i}", "question": "q?", "answerKey": "A", "split": s,
                 "choices": {"label": ["A", "B"], "text": ["x", "y"]}}
                for i, s in enumerate(["train", "test", "validation"])]
        folder = tmp_path / "allenai_ai2_arc" / subset
        folder.mkdir(parents=True)
        write(folder / "part.parquet", rows)
    got = registry.load_named(spark, "allenai/ai2_arc", str(tmp_path)).collect()
    assert sorted(r.split for r in got) == ["test", "test", "train", "train"]
    assert got[0].text == (
        "user:Question: q?\n\nChoices:\nA. x\nB. y\n\nProvide the correct answer label (A, B, C, or D).\n"
        "assistant:The correct answer is A.")
