"""Streaming forms of the row-local operators and of the metric rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from colloquy.operators.audits import audit_by_reason
from colloquy.operators.telemetry import windowed_rollup
from colloquy.operators.tokenization import TokenizeSpec, tokenize, valid_and_dropped
from colloquy.sources.releases_format import register
from colloquy.sources.storage import hadoop_uri


def read_arrivals(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    *,
    names: str = "*.parquet",
    max_files: int | None = None,
) -> DataFrame:
    """Parquet files of matching name as they arrive in the folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", names)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(hadoop_uri(folder))


def read_releases(
    spark: SparkSession, root: str, schema: T.StructType | None = None, **options: str
) -> DataFrame:
    """Rows of every release version below a root, as their manifests appear."""
    register(spark)
    reader = spark.readStream.format("manifest").options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(root)


def _start(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_rollup(
    samples: DataFrame,
    out: str,
    checkpoint: str,
    *,
    window: str = "1 hour",
    delay: str = "10 minutes",
    available_now: bool = False,
) -> StreamingQuery:
    """Closed windows, each once; samples later than the delay are dropped."""
    closed = windowed_rollup(samples, window, delay)
    writer = closed.writeStream.outputMode("append").format("parquet").option("path", out)
    return _start(writer, checkpoint, available_now)


def stream_tokenize(
    rows: DataFrame,
    spec: TokenizeSpec,
    kept_out: str,
    dropped_out: str,
    checkpoint: str,
    *,
    available_now: bool = False,
) -> StreamingQuery:
    """Tokenize arriving rows into a kept and a quarantine table.

    Each batch writes a folder of its own number, so a batch that runs again after a
    failure replaces its output instead of adding to it.
    """

    def write(batch: DataFrame, number: int) -> None:
        tokenized = tokenize(batch, spec).persist()
        kept, dropped = valid_and_dropped(tokenized)
        for part, out in ((kept, kept_out), (dropped, dropped_out)):
            part.write.mode("overwrite").parquet(f"{out}/batch={number}")
        tokenized.unpersist()

    return _start(rows.writeStream.foreachBatch(write), checkpoint, available_now)


def stream_audit(
    completions: DataFrame, out: str, checkpoint: str, *, available_now: bool = False
) -> StreamingQuery:
    """Loop and stop flags of arriving completions."""
    audited = audit_by_reason(completions)
    writer = audited.writeStream.outputMode("append").format("parquet").option("path", out)
    return _start(writer, checkpoint, available_now)
