"""Streams over several triggers against the same work as one batch."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from colloquy.operators import tokenization as tz
from colloquy.operators.audits import audit_by_reason
from colloquy.schemas import SFT_ROW
from colloquy.streaming import jobs

SAMPLES = "ts timestamp, key string, value double"


def arrive(spark, folder, name, rows):
    df = spark.createDataFrame([(None, *r) for r in rows], "d string, t string, key string, value double")
    df.select(F.to_timestamp("t").alias("ts"), "key", "value").coalesce(1).write.mode("append").parquet(
        f"{folder}/{name}")


def test_late_samples_are_dropped(spark, tmp_path):
    schema = spark.sql("SELECT current_timestamp() ts, 'k' key, 1.0D value").schema

    def run(name, rows):
        arrive(spark, tmp_path / "in", name, rows)
        stream = jobs.read_arrivals(spark, str(tmp_path / "in" / "*"), schema)
        jobs.stream_rollup(stream, str(tmp_path / "out"), str(tmp_path / "cp"), window="10 minutes",
                           delay="5 minutes", available_now=True).awaitTermination()

    run("a", [("2024-01-01 00:01:00", "k", 1.0), ("2024-01-01 00:20:00", "k", 5.0)])
    run("b", [("2024-01-01 00:02:00", "k", 99.0), ("2024-01-01 00:21:00", "k", 7.0)])
    run("c", [("2024-01-01 00:50:00", "k", 0.0)])
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("window_start").collect()
    assert [(r.avg, r.peak, r.samples) for r in got] == [(1.0, 1.0, 1), (6.0, 7.0, 2)]


def test_stream_tokenize_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [{"example_id": str(i), "messages": [{"role": "user" if i % 3 else "assistant", "content": f"q{i}"}],
             "target_text": f"answer {i}"} for i in range(30)]
    for n in range(3):
        pq.write_table(pa.Table.from_pylist(rows[n * 10:(n + 1) * 10]), folder / f"{n}.parquet")
    schema = spark.read.parquet(str(folder)).schema
    spec = tz.assistant_only(20)
    from colloquy.sources.conform import conform

    stream = conform(jobs.read_arrivals(spark, str(folder), schema, max_files=1), SFT_ROW)
    jobs.stream_tokenize(stream, spec, str(tmp_path / "kept"), str(tmp_path / "dropped"),
                         str(tmp_path / "cp"), available_now=True).awaitTermination()
    kept, dropped = tz.valid_and_dropped(tz.tokenize(conform(spark.read.parquet(str(folder)), SFT_ROW), spec))

    def shown(df):
        return sorted(map(tuple, df.select("example_id", "input_ids", "labels", "drop_reason").collect()))

    assert shown(spark.read.parquet(str(tmp_path / "kept"))) == shown(kept)
    assert shown(spark.read.parquet(str(tmp_path / "dropped"))) == shown(dropped)
    assert kept.count() == 20


def test_stream_audit_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame(
        [(i, "abcdefghij" * (i % 9) + "z", "stop" if i % 2 else "length") for i in range(40)],
        "id int, text string, done_reason string")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_arrivals(spark, str(tmp_path / "in"), rows.schema, max_files=2)
    jobs.stream_audit(stream, str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    expected = audit_by_reason(rows)
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.select(got.columns).collect()))
