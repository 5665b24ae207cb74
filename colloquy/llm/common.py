"""What the operators of this subpackage share.

Every operator takes any DataFrame and the names of the columns it reads. It returns
columns of its own, and with ``carry=True`` the whole input row as the struct ``doc``
besides, so that other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.session import scratch_dir

#: A table written by an operator is broadcast up to this size and joined by a shuffle beyond.
BROADCAST_BYTES = 24 << 20

#: Words are runs of anything but these six ASCII characters; bytes.split() without an argument agrees.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(text: str) -> Column:
    """UTF-8 bytes of a text column, nulls as empty."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def doc_column(carry: bool) -> list[Column]:
    return [F.struct("*").alias("doc")] if carry else []


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key's text, modulo; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written below the shared folder and read again.

    Cuts the lineage: lost executors cost at most the tasks since this table, and row
    numbers given before it stay what they are.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a stored table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def stored_bytes(df: DataFrame) -> int:
    """Size of the files of a stored table."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    total = 0
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        total += path.getFileSystem(conf).getContentSummary(path).getLength()
    return total


def lookup(df: DataFrame) -> DataFrame:
    """A stored table as the small side of a join: broadcast only if its size allows it.

    Beyond the limit the join shuffles both sides, which adaptive execution splits where
    a key is hot, since both sides are plain scans.
    """
    return F.broadcast(df) if stored_bytes(df) * 4 <= BROADCAST_BYTES else df


def training_ids(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    modulus: int,
    held_out: int,
    bound: int,
    per_class: bool = False,
) -> DataFrame:
    """Stored ``id, sha, label, copies, weight`` of the texts to learn from, about ``bound`` at most.

    Rows with a null id, a label other than 0 or 1, or an id that the split holds out teach
    nothing; of several labels for an id the largest counts. Of copies of one text with one
    label only that of the smallest id stays. ``sha`` is the text's digest: an id may stand on several
    texts, and ``copies`` says how many rows are alike in both. Beyond ``bound`` rows (of each label, if ``per_class``) the sample is by a digest of
    id and text; ``weight`` is how many texts a sampled one stands for.
    """
    marked = stored(
        labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label"))
        .filter("id IS NOT NULL AND label IN (0, 1)")
        .filter(remainder("id", modulus) != held_out)
        .groupBy("id")
        .agg(F.max("label").alias("label")),
        "training-labels",
    )
    texts = docs.select(F.col("doc_id").alias("id"), _sha(text_bytes("text")))
    same = texts.join(lookup(marked), "id").groupBy("sha", "label", "id").agg(F.count("*").alias("copies"))
    least = same.groupBy("sha", "label").agg(F.min(F.struct("id", "copies")).alias("least"))
    one = stored(least.select("sha", "label", "least.*"), "training-ids")
    found = dict(one.groupBy("label").count().collect())
    total = sum(found.values())
    share = {k: min(1.0, bound / (n if per_class else total)) for k, n in found.items()}
    keep = F.lit(0.0)
    for value, part in share.items():
        keep = F.when(F.col("label") == value, part).otherwise(keep)
    place = F.pmod(F.xxhash64(F.lit("training"), "id", "sha"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return stored(one.filter(place < keep).withColumn("weight", F.try_divide(F.lit(1.0), keep)), "training-sample")


def training_rows(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``label, weight, bytes`` of the sampled texts, each once however often its row is repeated."""
    texts = docs.select(F.col("doc_id").alias("id"), text_bytes("text").alias("bytes")).withColumn("sha", _sha(F.col("bytes")))
    small = stored_bytes(ids) <= BROADCAST_BYTES
    found = texts.join(F.broadcast(ids) if small else ids, ["id", "sha"])
    if ids.filter("copies > 1").isEmpty():
        return found.select("label", "weight", "bytes")
    once = found.groupBy("sha", "label").agg(F.first("weight").alias("weight"), F.first("bytes").alias("bytes"))
    return once.select("label", "weight", "bytes")


def _sha(data: Column) -> Column:
    return F.unhex(F.sha2(data, 256)).alias("sha")
