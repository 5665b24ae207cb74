"""Whole runs: what is written, what is counted, and what stops them."""

import json

import pytest
from pyspark.sql import functions as F

from colloquy.operators import tokenization as tz
from colloquy.operators.governance import PolicyGateError
from colloquy.session import scratch_dir
from colloquy.sources import manifest as mf
from colloquy.sources import runs
from colloquy.sources.release import write_release

SPEC = tz.assistant_only(40)


def messages(*turns):
    return [{"role": r, "content": c, "tool_calls": None, "tool_name": None, "name": None} for r, c in turns]


def release(spark, policy_class="P1", rows=None):
    rows = rows or [
        ("1", "train", messages(("user", "hi")), "short"),
        ("2", "train", messages(("user", "hi")), "a long answer " * 9),
        ("3", "train", messages(("system", "x")), "no question"),
        ("4", "eval", [], "nothing before"),
        ("5", "eval", messages(("user", "hi")), "fine"),
        ("6", "train", messages(("user", "hi")), None),
    ]
    kinds = "example_id string, split string, messages array<struct<role:string,content:string,tool_calls:array<string>,tool_name:string,name:string>>, target_text string"
    df = spark.createDataFrame(rows, kinds).withColumn("policy_class", F.lit(policy_class))
    df = df.withColumn("messages", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))))
    return write_release(df, scratch_dir(spark, "runs"), "chat", "v1", policy_class="policy_class")


def test_one_run_writes_rows_and_records(spark):
    uri = release(spark)
    run = runs.sft_run(spark, uri, SPEC, scratch_dir(spark, "run"))
    assert {(r["split"], r["example_id"]) for r in run.kept.collect()} == {("train", "1"), ("train", "2"), ("eval", "5")}
    dropped = {r["example_id"]: r["drop_reason"] for r in run.quarantine.collect()}
    assert dropped == {"3": "missing_user_query", "4": "empty_prompt_messages", "6": "invalid_row_shape"}
    values = {r["key"]: r["value"] for r in run.records.collect()}
    assert values["train_rows_total_raw"] == "4.0" and values["train_rows_truncated"] == "1.0"
    assert values["train_drop_invalid_row_shape"] == values["eval_drop_empty_prompt_messages"] == "1.0"
    assert values["dataset_manifest_sha256"] and values["total_rows"] == "6.0"
    # The counts taken while writing are those of the rows written.
    assert run.statistics.agg(F.sum("rows_kept")).first()[0] == run.kept.count()


def test_statistics_equal_those_of_the_tokenized_rows(spark):
    uri = release(spark)
    run = runs.sft_run(spark, uri, SPEC, scratch_dir(spark, "run"))
    rows = tz.tokenize(mf.load_sft_release(spark, uri).rows, SPEC)
    assert sorted(map(tuple, run.statistics.collect())) == sorted(map(tuple, tz.fit_statistics(rows, SPEC).collect()))
    assert sorted(map(tuple, run.histogram.collect())) == sorted(map(tuple, tz.drop_histogram(rows).collect()))


def broken(spark, uri):
    """The release without its files: only what stops before they are opened gets past them."""
    text = "\n".join(r[0] for r in spark.read.text(uri).collect())
    manifest = json.loads(text)
    manifest["splits"] = [{**s, "key": "missing/" + s["key"]} for s in manifest["splits"]]
    folder = scratch_dir(spark, "broken")
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(folder)
    return next(f for f in spark.read.text(folder).inputFiles())


def test_digest_and_gates_come_before_any_split(spark):
    out = scratch_dir(spark, "run")
    p3 = broken(spark, release(spark, "P3"))
    with pytest.raises(ValueError, match="digest"):
        runs.sft_run(spark, p3, SPEC, out, expected_sha256="0" * 64, assume_yes=True)
    with pytest.raises(PolicyGateError, match="assume_yes"):
        runs.sft_run(spark, p3, SPEC, out)
    p4 = broken(spark, release(spark, "P4"))
    with pytest.raises(PolicyGateError, match="P4"):
        runs.sft_run(spark, p4, SPEC, out, push=True, assume_yes=True)
    with pytest.raises(Exception, match="missing|PATH_NOT_FOUND"):
        runs.sft_run(spark, p4, SPEC, out, assume_yes=True)
    # With approval, and the right digest in any case, the run goes through.
    uri = release(spark, "P3")
    digest = mf.read_manifest(spark, uri).first()["manifest_sha256"]
    assert runs.sft_run(spark, uri, SPEC, out, assume_yes=True, expected_sha256=f" {digest.upper()} ").kept.count() == 3


def test_a_run_without_training_rows_is_an_error(spark):
    rows = [("3", "train", messages(("system", "x")), "no question"), ("5", "eval", messages(("user", "hi")), "fine")]
    with pytest.raises(ValueError, match="total=1.*missing_user_query"):
        runs.sft_run(spark, release(spark, rows=rows), SPEC, scratch_dir(spark, "run"))


def test_preference_run(spark):
    df = spark.createDataFrame([(s, "p", "c", "r", "P2") for s in ("train", "train", "eval")], "split string, prompt string, chosen string, rejected string, policy_class string")
    uri = write_release(df, scratch_dir(spark, "runs"), "pairs", "v1", policy_class="policy_class")
    run = runs.dpo_run(spark, uri, scratch_dir(spark, "run"))
    assert run.kept.groupBy("split").count().count() == 2 and run.quarantine.count() == 0
    assert {r["key"]: r["value"] for r in run.records.collect()}["train_rows_read"] == "2.0"
    bad = write_release(df.drop("rejected"), scratch_dir(spark, "runs"), "pairs", "v1", policy_class="policy_class")
    with pytest.raises(ValueError, match="rejected"):
        runs.dpo_run(spark, bad, scratch_dir(spark, "run"))
