"""Queries on policy classes: counts, blocks, summaries and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import jsontext, policy
from colloquy.operators import governance
from colloquy.plans.registry import plan, table

# Classes derive from labels, written the way hand-made metadata is.
CLASSES_SQL = """WITH classed AS (
  SELECT d.source, d.lang, CASE WHEN l.doc_id % 17 = 0 THEN 'x9' WHEN l.doc_id % 19 = 0 THEN ' '
    WHEN toxic = 1 AND quality = 0 THEN 'p4' WHEN toxic = 1 THEN ' P3' WHEN quality = 0 THEN 'P1 '
    ELSE 'p0' END AS policy_class
  FROM labels l JOIN documents d USING (doc_id)),
tokens AS (SELECT source, lang, upper(trim(policy_class)) AS token FROM classed
  WHERE trim(policy_class) <> ''),
counts AS (SELECT source, token, count(*) AS n,
  CASE WHEN token IN ('P0', 'P1', 'P2', 'P3', 'P4') THEN substr(token, 2)::INTEGER ELSE 999 END AS rank
  FROM tokens GROUP BY source, token)"""


def classed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic, good = F.col("toxic") == 1, F.col("quality") == 1
    raw = (
        F.when(F.col("doc_id") % 17 == 0, "x9")
        .when(F.col("doc_id") % 19 == 0, " ")
        .when(toxic & ~good, "p4")
        .when(toxic, " P3")
        .when(~good, "P1 ")
        .otherwise("p0")
    )
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return (
        table(spark, sf_dir, "labels")
        .join(documents, "doc_id")
        .select("source", "lang", raw.alias("policy_class"))
    )


@plan(CLASSES_SQL + " SELECT source, token AS policy_class, n AS rows FROM counts")
def policy_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.class_counts(classed_rows(spark, sf_dir), ["source"])


@plan(CLASSES_SQL + " SELECT DISTINCT token AS policy_class, rank FROM counts")
def policy_class_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = policy.class_token(F.col("policy_class"))
    rows = classed_rows(spark, sf_dir).select(token.alias("policy_class")).distinct()
    return rows.where(F.col("policy_class") != "").withColumn(
        "rank", policy.class_rank(F.col("policy_class"))
    )


def _shown_counts(counts: str) -> Column:
    """Counts map as text in class order."""
    return F.array_join(
        F.transform(
            F.array_sort(F.map_entries(counts)),
            lambda e: F.concat_ws("=", e["key"], e["value"]),
        ),
        ";",
    )


@plan(
    CLASSES_SQL
    + """ SELECT source, string_agg(token, ',' ORDER BY rank, token) AS classes,
  string_agg(token || '=' || n, ';' ORDER BY token) AS counts,
  last(token ORDER BY rank, token) AS max_policy_class
FROM counts GROUP BY source"""
)
def governance_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Governance block per release; the source stands for the release."""
    blocks = governance.governance_from_rows(classed_rows(spark, sf_dir), ["source"])
    return blocks.select(
        "source",
        F.array_join("policy_classes_present", ",").alias("classes"),
        _shown_counts("policy_class_counts").alias("counts"),
        "max_policy_class",
    )


# Manifests as text: one without a list, one without a block, one with a declared
# maximum, and counts that are numerals, text, fractions or no numbers.
SUMMARY_SQL = (
    CLASSES_SQL
    + """,
releases AS (SELECT DISTINCT source, substr(source, 4)::INTEGER % 4 AS kind FROM documents),
summaries AS (
  SELECT source, kind, CASE WHEN kind = 1 THEN [] ELSE
    coalesce((SELECT list(token ORDER BY rank, token) FROM counts c WHERE c.source = r.source), [])
    END AS classes FROM releases r)"""
)


def manifest_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest text per source, with governance blocks of different forms."""
    kind = F.substring("source", 4, 9).cast("int") % 4
    blocks = governance.governance_from_rows(classed_rows(spark, sf_dir), ["source"])
    counts = F.transform_keys("policy_class_counts", lambda k, v: F.lower(k))
    body = F.struct(
        F.when(kind != 0, F.reverse("policy_classes_present")).alias("policy_classes_present"),
        F.map_concat(
            F.transform_values(counts, lambda k, v: v.cast("string")),
            F.create_map(F.lit("bad"), F.lit("many")),
        ).alias("policy_class_counts"),
        F.when(kind == 2, " p9 ").alias("max_policy_class"),
    )
    governed = blocks.select("source", F.to_json(body).alias("body"))
    sources = table(spark, sf_dir, "documents").select("source").distinct()
    text = F.when(kind == 1, '{"dataset_id": "x", "governance": "none"}').otherwise(
        F.concat(F.lit('{"governance": '), F.coalesce("body", F.lit("{}")), F.lit("}"))
    )
    return sources.join(governed, "source", "left").select("source", text.alias("text"))


def summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = jsontext.strict_json(F.col("text"))
    block = F.try_variant_get("manifest", "$.governance", "variant")
    columns = [c.alias(name) for name, c in policy.summary(block).items()]
    return (
        manifest_texts(spark, sf_dir)
        .withColumn("manifest", parsed)
        .select("source", *columns)
    )


@plan(
    SUMMARY_SQL
    + """ SELECT s.source, kind <> 1 AS has_metadata, array_to_string(classes, ',') AS classes,
  CASE WHEN kind = 1 THEN '' ELSE coalesce((SELECT string_agg(token || '=' || n, ';' ORDER BY token)
    FROM counts c WHERE c.source = s.source), '') END AS counts,
  CASE WHEN kind = 1 OR (kind <> 2 AND len(classes) = 0) THEN 'unknown' WHEN kind = 2 AND
    EXISTS (SELECT 1 FROM counts c WHERE c.source = s.source) THEN 'P9'
    ELSE coalesce(classes[-1], 'unknown') END AS max_policy_class
FROM summaries s"""
)
def manifest_policy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary_rows(spark, sf_dir).select(
        "source",
        "has_metadata",
        F.array_join("classes_present", ",").alias("classes"),
        _shown_counts("class_counts").alias("counts"),
        "max_policy_class",
    )


@plan(
    SUMMARY_SQL
    + """ SELECT source, list_has_any(classes, ['P3', 'P4']) AS needs_confirmation,
  list_contains(classes, 'P4') AS blocks_publishing,
  CASE WHEN list_contains(classes, 'P4') AND kind = 3 THEN 'blocked'
    WHEN list_has_any(classes, ['P3', 'P4']) AND kind = 0 THEN 'needs_approval'
    ELSE 'pass' END AS decision
FROM summaries"""
)
def policy_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate decisions for releases that publish, run unattended or were approved."""
    kind = F.substring("source", 4, 9).cast("int") % 4
    gated = governance.with_gates(summary_rows(spark, sf_dir))
    decision = governance.gate_decision(kind == 3, kind != 0)
    return gated.select(
        "source", "needs_confirmation", "blocks_publishing", decision.alias("decision")
    )
