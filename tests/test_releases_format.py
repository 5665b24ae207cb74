"""Releases as data sources: scans in manifest order, whole manifests, versions as a stream."""

import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.schemas import SFT_ROW
from colloquy.sources import manifest as mf
from colloquy.sources import release
from colloquy.sources import releases_format as rf
from colloquy.sources.arrow_rows import conformed
from colloquy.streaming import jobs
from tests.test_sources import SFT, differing_files, write, write_manifest

PLACED = "example_id string, split string, file_pos long, row_index long, ordinal long"


def three_files(tmp_path, rows=10):
    for name, first in (("b", 0), ("a", 10), ("c", 20)):
        write(tmp_path / f"{name}.parquet", [{**SFT, "example_id": str(first + i)} for i in range(rows)])
    keys = [{"split": "train", "key": f"{n}.parquet"} for n in "bac"]
    junk = [7, {"split": "train"}, {"split": "train", "key": 5}]
    return write_manifest(tmp_path, keys[:1] + junk + keys[1:] + [{"split": "eval", "key": "a.parquet"}])


@pytest.mark.parametrize("slices", ["1", "4"])
@pytest.mark.parametrize("limit", [0, 3, 10, 14, 20, 99, None])
def test_scan_keeps_manifest_and_file_order(spark, tmp_path, limit, slices):
    uri = three_files(tmp_path)
    options = {"slices": slices, **({} if limit is None else {"limit": str(limit)})}
    rows = rf.scan(spark, uri, PLACED, split="train", **options).orderBy("file_pos", "row_index").collect()
    want = list(range(30))[:limit] if limit is not None else list(range(30))
    assert [int(r.example_id) for r in rows] == want
    assert [r.ordinal for r in rows] == want
    assert {r.file_pos for r in rows} <= {0, 4, 5} and {r.split for r in rows} <= {"train"}


def test_many_row_groups_are_shared_without_loss(spark, tmp_path):
    table = pa.table({"example_id": [str(n) for n in range(1000)]})
    pa.parquet.write_table(table, tmp_path / "big.parquet", row_group_size=70)
    uri = write_manifest(tmp_path, [{"split": "train", "key": "big.parquet"}])
    for slices in ("1", "4", "40"):
        rows = rf.scan(spark, uri, PLACED, slices=slices).orderBy("row_index").collect()
        assert [(r.example_id, r.row_index) for r in rows] == [(str(n), n) for n in range(1000)]
        assert rf.scan(spark, uri, PLACED, slices=slices, limit="333").count() == 333
        assert rf.scan(spark, uri, "split string", slices=slices).count() == 1000


@pytest.mark.parametrize("order", ["abc", "cba", "bac"])
def test_files_of_differing_schemas_equal_the_other_scan(spark, tmp_path, order):
    differing_files(tmp_path)
    uri = write_manifest(tmp_path, [{"split": "train", "key": f"{n}.parquet"} for n in order] + [{"split": "eval", "key": "a.parquet"}])
    names = SFT_ROW.fieldNames()
    got = rf.scan(spark, uri, split="train").orderBy("file_pos", "row_index").select(*names).collect()
    uris = [f"{tmp_path}/{name}.parquet" for name in order]
    want = mf.with_file_order(spark, uris, SFT_ROW).orderBy("file_pos", "row_index").select(*names).collect()
    assert got == want and "".join(r.example_id for r in got) == order


def test_nested_arguments_become_text(spark, tmp_path):
    calls = [{"name": "control", "arguments": {"action": "é", "n": 1, "none": None}}]
    said = [{"role": "assistant", "content": "call", "tool_calls": calls}]
    write(tmp_path / "train.parquet", [{"messages": said}, {"messages": None}, {"messages": []}])
    uri = write_manifest(tmp_path, [{"split": s, "key": "train.parquet"} for s in ("train", "eval")])
    rows = rf.scan(spark, uri, split="train").orderBy("row_index").collect()
    assert json.loads(rows[0].messages[0].tool_calls[0].arguments) == {"action": "é", "n": 1}
    assert rows[1].messages is None and rows[2].messages == []
    want = mf.load_sft_release(spark, uri).split("train").select("messages").collect()
    assert sorted(map(str, (r.messages for r in rows))) == sorted(map(str, (r.messages for r in want)))


def test_arrays_of_every_shape_conform():
    want = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.string())]))
    have = pa.array([None, [], [{"a": "1"}, None, {"a": "x"}], [{"a": None}]])
    right = [None, [], [{"a": 1, "b": None}, None, {"a": None, "b": None}], [{"a": None, "b": None}]]
    assert conformed(have, want).to_pylist() == right
    assert conformed(have.slice(1, 2), want).to_pylist() == right[1:3]
    assert conformed(have.slice(4), want).to_pylist() == []
    assert conformed(pa.array([1, 2]), want).to_pylist() == [None, None]


def test_scan_errors(spark, tmp_path):
    uri = three_files(tmp_path)
    with pytest.raises(Exception, match="no files in manifest split 'test'"):
        rf.scan(spark, uri, split="test").collect()
    with pytest.raises(Exception, match="digest mismatch"):
        rf.scan(spark, uri, sha256="0" * 64).collect()
    with pytest.raises(Exception, match="missing required preference columns in split train"):
        rf.scan(spark, uri, kind="dpo").collect()
    with pytest.raises(Exception, match="kind must be"):
        rf.scan(spark, uri, kind="other").collect()
    (tmp_path / "manifest.json").write_text("[1]")
    with pytest.raises(Exception, match="manifest must be a JSON object"):
        rf.scan(spark, uri).collect()


def labelled(spark, n=400):
    return spark.range(0, n, 1, 8).select(
        F.col("id").cast("string").alias("example_id"), F.lit("text").alias("target_text"),
        F.when(F.col("id") % 10 == 0, "eval").otherwise("train").alias("split"), "id",
    )


def test_a_failed_task_leaves_no_manifest(spark, tmp_path):
    bad = F.when(F.col("id") == 399, F.raise_error(F.lit("a row fails"))).otherwise(F.col("target_text"))
    rows = labelled(spark).withColumn("target_text", bad.cast("string"))
    with pytest.raises(Exception, match="a row fails"):
        release.write_release(rows, str(tmp_path), "chat", "v1")
    folder = tmp_path / "dataset_id=chat" / "dataset_version=v1"
    assert not (folder / "manifest.json").exists()
    # What is left of the failed attempt doesn't count once the version is written.
    uri = release.write_release(labelled(spark), str(tmp_path), "chat", "v1")
    manifest = json.loads(open(uri).read())
    assert manifest["stats"] == {"train_rows": 360, "eval_rows": 40, "total_rows": 400}
    assert sum(item["rows"] for item in manifest["splits"]) == 400
    assert sorted(int(r.example_id) for r in rf.scan(spark, uri).collect()) == list(range(400))
    with pytest.raises(Exception, match="exists"):
        release.write_release(labelled(spark), str(tmp_path), "chat", "v1")


def test_release_of_no_rows_and_rows_without_a_split(spark, tmp_path):
    uri = release.write_release(labelled(spark).where("id < 0"), str(tmp_path), "chat", "v0")
    assert json.loads(open(uri).read())["stats"] == {"total_rows": 0}
    assert rf.scan(spark, uri).count() == 0
    with pytest.raises(Exception, match="rows without a split"):
        release.write_release(labelled(spark).withColumn("split", F.lit(None).cast("string")), str(tmp_path), "chat", "v1")


def test_files_end_and_held_rows_are_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr(rf, "FILE_ROWS", 50)
    monkeypatch.setattr(rf, "HELD_BYTES", 200)
    writer = rf.ReleaseWriter({"path": str(tmp_path), "dataset_id": "d", "dataset_version": "v"})
    batches = [pa.RecordBatch.from_pydict({"split": ["a", "b"] * 20, "n": list(range(i, i + 40))}) for i in range(0, 400, 40)]
    said = writer.write(iter(batches))
    writer.commit([said, None])
    found = [pa.parquet.read_table(tmp_path / name)["n"].to_pylist() for _, name, _ in sorted(said.files)]
    assert len(found) > 4 and sorted(n for part in found for n in part) == list(range(400))
    assert [len(part) for part in found] == [rows for _, _, rows in sorted(said.files)]
    other = writer.write(iter(batches))
    writer.abort([other, None])
    assert not any((tmp_path / name).exists() for _, name, _ in other.files)
    assert all((tmp_path / name).exists() for _, name, _ in said.files)


def test_versions_arrive_once_also_after_a_restart(spark, tmp_path):
    root, out = str(tmp_path / "releases"), str(tmp_path / "out")

    def run():
        arrivals = jobs.read_releases(spark, root, "example_id string, manifest_uri string")
        writer = arrivals.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()
        return sorted((r.manifest_uri.split("dataset_version=")[1][:2], int(r.example_id)) for r in spark.read.parquet(out).collect())

    rows = labelled(spark, 40)
    release.write_release(rows.where("id < 10"), root, "chat", "v1")
    first = [("v1", n) for n in range(10)]
    assert run() == first
    assert run() == first  # nothing new
    # A version in the making, files without a manifest, isn't there yet.
    os.makedirs(f"{root}/dataset_id=chat/dataset_version=v3/split=train")
    release.write_release(rows.where("id >= 10"), root, "chat", "v2")
    assert run() == first + [("v2", n) for n in range(10, 40)]
