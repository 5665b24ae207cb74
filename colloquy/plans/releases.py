"""Queries that write a release and load it back through its manifest.

Releases go to a new folder below the cluster's shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import examples, governance, splits
from colloquy.plans.formatting import PAIRS_SQL, preference_rows
from colloquy.plans.inputs import has_long, EVAL_PERCENT, SEED, split_sql, turns
from colloquy.plans.registry import plan, table
from colloquy.plans.supervised import OVERHEAD, TOKEN_BUDGET
from colloquy.session import scratch_dir
from colloquy.sources import manifest as mf
from colloquy.sources import releases_format
from colloquy.sources.records import lineage_record
from colloquy.sources.release import split_row_counts, write_release

CONSTRUCTION = {
    "target_mode": "single_turn",
    "token_budget": TOKEN_BUDGET,
    "context_overhead_tokens": OVERHEAD,
    "split_seed": SEED,
    "eval_percent": EVAL_PERCENT,
}


def supervised_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a supervised release: contexts within the budget, split by session."""
    long = has_long(spark, sf_dir, TOKEN_BUDGET)
    rows = examples.budgeted(turns(spark, sf_dir), TOKEN_BUDGET, OVERHEAD, long=long)
    labeled = splits.percent_split(rows, "session_id", EVAL_PERCENT, SEED)
    return labeled.drop("omitted_tokens", "omitted_messages", "asked")


def write_supervised(spark: SparkSession, sf_dir: str) -> str:
    return write_release(
        supervised_rows(spark, sf_dir),
        scratch_dir(spark, "release"),
        "chat",
        "v1",
        construction=CONSTRUCTION,
    )


EXAMPLES_SQL = f"""WITH rows AS (SELECT *, {split_sql("conv_id")} AS split FROM conversations
  WHERE role = 'assistant')"""


@plan(
    EXAMPLES_SQL
    + """ SELECT conv_id || '-' || turn AS example_id, conv_id::VARCHAR AS session_id,
  turn::INTEGER AS target_turn_index, md5(text) AS target, split, 'single_turn' AS target_mode
FROM rows"""
)
def sft_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a supervised release and load both splits through the manifest."""
    release = mf.load_sft_release(spark, write_supervised(spark, sf_dir))
    return release.rows.select(
        "example_id",
        "session_id",
        "target_turn_index",
        F.md5("target_text").alias("target"),
        "split",
        "target_mode",
    )


CAP = {"train": 150, "eval": 10}


@plan(
    EXAMPLES_SQL
    + f""" SELECT split, least(count(*), CASE split WHEN 'train' THEN {CAP["train"]}
  ELSE {CAP["eval"]} END) AS rows FROM rows GROUP BY split"""
)
def capped_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of each split in file order; only their number is fixed."""
    release = mf.load_sft_release(
        spark,
        write_supervised(spark, sf_dir),
        max_train_samples=CAP["train"],
        max_eval_samples=CAP["eval"],
        cache_mode="refresh",
    )
    return release.rows.groupBy("split").agg(F.count("*").alias("rows"))


ORDERED_SQL = (
    EXAMPLES_SQL
    + """, placed AS (SELECT conv_id || '-' || turn AS example_id, split, md5(text) AS target,
  row_number() OVER (PARTITION BY split ORDER BY conv_id, turn) - 1 AS ordinal FROM rows)
SELECT example_id, split, target, ordinal FROM placed"""
)
#: The columns a scan reads, and the place of a row in its split.
SCANNED = "example_id string, target_text string, split string, ordinal long"


def write_ordered(spark: SparkSession, sf_dir: str) -> str:
    """A release whose rows lie in the order of conversations and turns."""
    rows = supervised_rows(spark, sf_dir)
    ordered = rows.withColumn("_c", F.col("session_id").cast("bigint")).orderBy("_c", "target_turn_index").drop("_c")
    return write_release(ordered, scratch_dir(spark, "release"), "chat", "v1", construction=CONSTRUCTION)


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.select("example_id", "split", F.md5("target_text").alias("target"), "ordinal")


@plan(ORDERED_SQL)
def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of a release with its number in manifest and file order."""
    return _ordered(releases_format.scan(spark, write_ordered(spark, sf_dir), SCANNED, slices="3"))


@plan(ORDERED_SQL + f" WHERE ordinal < {CAP['train']}")
def manifest_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of each split of a release, which rows they are and in which order."""
    uri = write_ordered(spark, sf_dir)
    return _ordered(releases_format.scan(spark, uri, SCANNED, limit=str(CAP["train"])))


@plan(
    PAIRS_SQL
    + f""", rows AS (SELECT {split_sql("conv_id")} AS split, 'P' || conv_id % 4 AS class FROM pairs)
SELECT 'listed' AS kind, split AS key, count(*) AS rows FROM rows GROUP BY split
UNION ALL SELECT 'stats', split || '_rows', count(*) FROM rows GROUP BY split
UNION ALL SELECT 'stats', 'total_rows', count(*) FROM rows
UNION ALL SELECT 'class', class, count(*) FROM rows GROUP BY class
UNION ALL SELECT 'stored', split, count(*) FROM rows GROUP BY split"""
)
def release_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a manifest says its tasks wrote, next to the rows that a scan of it finds."""
    uri = write_preferences(spark, sf_dir)
    manifest = mf.read_manifest(spark, uri).select("manifest")

    def counts(kind: str, path: str) -> DataFrame:
        entries = F.try_variant_get("manifest", path, "map<string,bigint>")
        return manifest.select(F.lit(kind).alias("kind"), F.explode(entries).alias("key", "rows"))

    files = F.try_variant_get("manifest", "$.splits", "array<struct<split:string,rows:bigint>>")
    listed = manifest.select(F.inline(files)).groupBy(F.lit("listed").alias("kind"), F.col("split").alias("key")).agg(F.sum("rows").alias("rows"))
    scanned = releases_format.scan(spark, uri, "split string", kind="dpo")
    stored = scanned.groupBy(F.lit("stored").alias("kind"), F.col("split").alias("key")).agg(F.count("*").alias("rows"))
    said = counts("stats", "$.stats").unionByName(counts("class", "$.governance.policy_class_counts"))
    return said.unionByName(listed).unionByName(stored)


@plan(
    EXAMPLES_SQL
    + """ SELECT 'param' AS kind, k AS key, v AS value FROM (VALUES ('dataset_id', 'chat'),
  ('dataset_version', 'v1'), ('dataset_target_mode', 'single_turn'), ('dataset_token_budget', '1500'),
  ('dataset_context_overhead_tokens', '100'), ('dataset_split_seed', '42')) t(k, v)
UNION ALL SELECT 'metric', split || '_rows', count(*)::DOUBLE::VARCHAR FROM rows GROUP BY split
UNION ALL SELECT 'metric', 'total_rows', count(*)::DOUBLE::VARCHAR FROM rows"""
)
def release_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage record of a written release, without its address and digest."""
    release = mf.load_sft_release(spark, write_supervised(spark, sf_dir))
    record = lineage_record(release.manifest)
    located = ("dataset_manifest_uri", "dataset_manifest_sha256", "dataset_eval_percent")
    return record.where(~F.col("key").isin(*located))


@plan(EXAMPLES_SQL + " SELECT split, count(*) AS rows FROM rows GROUP BY ROLLUP (split)")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per split and in total."""
    return split_row_counts(supervised_rows(spark, sf_dir))


@plan(
    PAIRS_SQL
    + f""" SELECT conv_id || '-' || turn AS example_id, md5(question) AS prompt, md5(chosen) AS chosen,
  rejected, 'P' || conv_id % 4 AS policy_class, {split_sql("conv_id")} AS split FROM pairs"""
)
def dpo_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a preference release and load both splits, columns checked."""
    release = mf.load_dpo_release(spark, write_preferences(spark, sf_dir))
    return release.rows.select(
        "example_id",
        F.md5("prompt").alias("prompt"),
        F.md5("chosen").alias("chosen"),
        "rejected",
        "policy_class",
        "split",
    )


def write_preferences(spark: SparkSession, sf_dir: str) -> str:
    rows = preference_rows(spark, sf_dir).select(
        F.concat_ws("-", "conv_id", "turn").alias("example_id"),
        F.col("conv_id").cast("string").alias("session_id"),
        F.col("question").alias("prompt"),
        "chosen",
        "rejected",
        F.concat(F.lit("P"), F.col("conv_id") % 4).alias("policy_class"),
    )
    labeled = splits.percent_split(rows, "session_id", EVAL_PERCENT, SEED)
    return write_release(
        labeled, scratch_dir(spark, "release"), "pairs", "v2", policy_class="policy_class"
    )


@plan(
    PAIRS_SQL
    + """, counts AS (SELECT 'P' || conv_id % 4 AS c, count(*) AS n FROM pairs GROUP BY 1)
SELECT true AS has_metadata, string_agg(c, ',' ORDER BY c) AS classes,
  string_agg(c || '=' || n, ';' ORDER BY c) AS counts, max(c) AS max_policy_class,
  true AS needs_confirmation, false AS blocks_publishing FROM counts"""
)
def release_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Governance block of a written release, summarized and gated."""
    manifest = mf.read_manifest(spark, write_preferences(spark, sf_dir))
    gated = governance.with_gates(mf.policy_summary(manifest))
    counts = F.transform(
        F.array_sort(F.map_entries("class_counts")), lambda e: F.concat_ws("=", e["key"], e["value"])
    )
    return gated.select(
        "has_metadata",
        F.array_join("classes_present", ",").alias("classes"),
        F.array_join(counts, ";").alias("counts"),
        "max_policy_class",
        "needs_confirmation",
        "blocks_publishing",
    )


# Manifest texts derive from orders, fifty to a manifest, with entries of several forms.
@plan(
    """WITH placed AS (SELECT o_orderkey, o_orderkey // 50 AS m,
  row_number() OVER (PARTITION BY o_orderkey // 50 ORDER BY o_orderkey) - 1 AS file_pos FROM orders)
SELECT 's3://bucket/' || m || '/manifest.json' AS manifest_uri, file_pos::INTEGER AS file_pos,
  CASE WHEN o_orderkey % 6 = 5 THEN 'eval' ELSE 'train' END AS split, CASE o_orderkey % 4
  WHEN 1 THEN 's3://bucket/in/' || o_orderkey WHEN 2 THEN 'gs://other/' || o_orderkey
  ELSE 's3://bucket/' || o_orderkey END AS uri
FROM placed WHERE o_orderkey % 4 <> 3"""
)
def split_file_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable split entries of manifests, keys resolved; others are skipped."""
    key = F.col("o_orderkey")
    split = F.when(key % 6 == 5, "eval").otherwise("train")
    place = (
        F.when(key % 4 == 0, F.format_string('"/%d"', key))
        .when(key % 4 == 1, F.format_string('"in/%d"', key))
        .when(key % 4 == 2, F.format_string('"gs://other/%d"', key))
        .otherwise(key.cast("string"))  # a number is no usable key
    )
    entry = F.format_string('{"split": "%s", "key": %s}', split, place)
    listed = F.array_sort(F.collect_list(F.struct(key, entry.alias("entry"))))
    texts = (
        table(spark, sf_dir, "orders")
        .groupBy(F.floor(key / 50).alias("m"))
        .agg(F.array_join(F.transform(listed, lambda item: item["entry"]), ",").alias("entries"))
        .select(
            F.format_string("s3://bucket/%d/manifest.json", "m").alias("manifest_uri"),
            F.concat(F.lit('{"splits": ['), "entries", F.lit("]}")).alias("body"),
        )
    )
    files = mf.split_files(mf.parse_manifest(texts, "body"))
    return files.select("manifest_uri", "file_pos", "split", "uri")


@plan(
    """SELECT o_orderkey, sha256('{"dataset_id": "é' || o_orderpriority || '", "dataset_version": "' ||
  o_custkey || '"}') AS manifest_sha256, 'é' || o_orderpriority AS dataset_id,
  o_custkey::VARCHAR AS dataset_version FROM orders"""
)
def manifest_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest and identity of manifest texts."""
    body = F.format_string(
        '{"dataset_id": "é%s", "dataset_version": "%d"}', "o_orderpriority", "o_custkey"
    )
    names = ("o_orderkey", "o_orderpriority", "o_custkey")
    texts = table(spark, sf_dir, "orders", *names).select("o_orderkey", body.alias("body"))
    parsed = mf.parse_manifest(texts, "body")
    names = ("dataset_id", "dataset_version")
    fields = [F.try_variant_get("manifest", f"$.{n}", "string").alias(n) for n in names]
    return parsed.select("o_orderkey", "manifest_sha256", *fields)


@plan(
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN false ELSE true END AS matches
FROM customer"""
)
def digest_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected digests compared to actual ones: equal, absent or different."""
    actual = F.sha2("c_name", 256)
    kind = F.col("c_custkey") % 3
    expected = (
        F.when(kind == 0, F.concat(F.lit(" "), F.upper(actual)))
        .when(kind == 1, "")
        .otherwise(F.md5("c_name"))
    )
    return table(spark, sf_dir, "customer").select(
        "c_custkey", mf.expected_digest_matches(expected, actual).alias("matches")
    )

