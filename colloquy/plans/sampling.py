"""Queries on positions, samples, pages and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import ordering, splits
from colloquy.plans.inputs import EVAL_PERCENT, SEED, split_sql, turns
from colloquy.plans.registry import plan, table
from colloquy.sources import registry

SAMPLE, PAGE_SIZE, PAGE = 400, 300, 1


@plan(
    f"""SELECT doc_id, md5(text) AS text FROM documents
QUALIFY row_number() OVER (ORDER BY md5(doc_id || '|{SEED}'), doc_id) <= {SAMPLE}"""
)
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reproducible training sample."""
    sample = ordering.sample_train(table(spark, sf_dir, "documents"), ["doc_id"], SAMPLE, SEED)
    return sample.select("doc_id", F.md5("text").alias("text"))


@plan(
    f"""SELECT o_orderkey FROM orders
QUALIFY row_number() OVER (ORDER BY md5(o_orderkey || '|{SEED}'), o_orderkey) <= 2000"""
)
def seeded_eval_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation sample of a fifth of the training limit."""
    return ordering.sample_eval(
        table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 10_000, SEED
    )


@plan(
    f"""WITH ranked AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal,
  count(*) OVER () AS n FROM documents)
SELECT doc_id, ordinal, (CASE WHEN n < {PAGE_SIZE} THEN 0 ELSE {PAGE + 1} END)::BIGINT AS next_index,
  CASE WHEN n < {PAGE_SIZE} THEN 0 ELSE n / {PAGE_SIZE} + 1 END::DOUBLE AS page_count
FROM ranked WHERE n < {PAGE_SIZE} OR ordinal // {PAGE_SIZE} = {PAGE}"""
)
def partition_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of a table in key order."""
    rows = table(spark, sf_dir, "documents").select("doc_id")
    return ordering.page(rows, "doc_id", PAGE, PAGE_SIZE)


@plan(
    f"""SELECT doc_id FROM documents QUALIFY count(*) OVER () < greatest(500, {PAGE_SIZE} // 5)
  OR row_number() OVER (ORDER BY md5(doc_id || '|{SEED}'), doc_id) <= 100"""
)
def partition_page_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation rows that go with a page of a table."""
    rows = table(spark, sf_dir, "documents").select("doc_id")
    return ordering.page_eval(rows, ["doc_id"], PAGE_SIZE, SEED)


@plan(
    """SELECT doc_id, quality FROM labels
QUALIFY row_number() OVER (ORDER BY doc_id) <= count(*) OVER () // 4 * 4"""
)
def multiple_of_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows up to the largest multiple of the generation group size."""
    rows = table(spark, sf_dir, "labels", "doc_id", "quality")
    return ordering.multiple_of(rows, "doc_id", 4)


@plan(
    f"""SELECT doc_id, CASE WHEN ('0x' || substr(md5(doc_id || '|{SEED}'), 1, 8))::BIGINT % 10000
  < 1000 THEN 'test' ELSE 'train' END AS split FROM documents"""
)
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id")
    return splits.holdout_split(rows, ["doc_id"], SEED)


@plan(f"SELECT conv_id, turn, {split_sql('conv_id')} AS split FROM conversations")
def session_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent split with the session as the unit."""
    rows = turns(spark, sf_dir).select("conv_id", "turn")
    return splits.percent_split(rows, "conv_id", EVAL_PERCENT, SEED)


# Named datasets derive from whole tables; their split labels from the key.
CHOICE_TEXT_SQL = (
    "'user:Question: ' || p_name || chr(10) || chr(10) || 'Choices:' || chr(10) || 'A. ' || p_brand "
    "|| chr(10) || 'B. ' || p_type || chr(10) || chr(10) || "
    "'Provide the correct answer label (A, B, C, or D).' || chr(10) || "
    "'assistant:The correct answer is B.'"
)


def _choices(spark: SparkSession, sf_dir: str, split: Column) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("question"),
        F.struct(
            F.array(F.lit("A"), F.lit("B")).alias("label"),
            F.array("p_brand", "p_type").alias("text"),
        ).alias("choices"),
        F.lit("B").alias("answerKey"),
        split.alias("split"),
    )


@plan(
    f"""WITH t AS (SELECT p_partkey % 3 AS k, {CHOICE_TEXT_SQL} AS text FROM part)
SELECT CASE k WHEN 0 THEN 'train' ELSE 'test' END AS split, text, count(*) * 2 AS rows
FROM t WHERE k <> 1 GROUP BY ALL"""
)
def named_dataset_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two subsets joined, the named train and test splits kept, rows formatted."""
    labels = F.array(F.lit("train"), F.lit("validation"), F.lit("test"))
    subset = _choices(spark, sf_dir, F.get(labels, (F.col("p_partkey") % 3).cast("int")))
    joined = splits.concat_subsets({"ARC-Challenge": subset, "ARC-Easy": subset})
    rows = registry.prepare(joined, registry.REGISTRY["allenai/ai2_arc"])
    return rows.groupBy("split", "text").agg(F.count("*").alias("rows"))


@plan(
    f"""WITH t AS (SELECT p_partkey, {CHOICE_TEXT_SQL} AS text FROM part WHERE p_partkey % 3 < 2)
SELECT CASE WHEN ('0x' || substr(md5(p_partkey || '|{SEED}'), 1, 8))::BIGINT % 10000 < 1000
  THEN 'test' ELSE 'train' END AS split, text, count(*) AS rows FROM t GROUP BY ALL"""
)
def named_dataset_odd_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a train split, each listed split is held out and the parts joined."""
    labels = F.array(F.lit("ita_Latn"), F.lit("fra_Latn"), F.lit("other"))
    rows = _choices(spark, sf_dir, F.get(labels, (F.col("p_partkey") % 3).cast("int")))
    dataset = registry.NamedDataset(
        keys=("id",),
        splits=("ita_Latn", "fra_Latn"),
        formatter=registry.formatters.multiple_choice,
    )
    return registry.prepare(rows, dataset).groupBy("split", "text").agg(F.count("*").alias("rows"))


@plan(
    """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'train' ELSE 'test' END AS split
FROM conversations WHERE turn % 3 < 2"""
)
def aliased_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliased preference splits under their plain names."""
    names = F.array(F.lit("train_prefs"), F.lit("test_prefs"), F.lit("train_gen"))
    rows = turns(spark, sf_dir).select(
        "conv_id", "turn", F.get(names, (F.col("turn") % 3).cast("int")).alias("split")
    )
    aliases = registry.REGISTRY["allenai/ultrafeedback_binarized_cleaned"].split_aliases
    return splits.resolve_splits(rows, None, ["conv_id"], aliases=aliases)


@plan(
    """SELECT subset, count(*) AS rows, sum(k)::BIGINT AS keys FROM (
  SELECT 'documents' AS subset, doc_id AS k FROM documents UNION ALL
  SELECT 'labels', doc_id FROM labels UNION ALL SELECT 'benchmark', item_id FROM benchmark)
GROUP BY subset"""
)
def concatenated_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {
        name: table(spark, sf_dir, name).select(F.col(key).alias("k"))
        for name, key in (("documents", "doc_id"), ("labels", "doc_id"), ("benchmark", "item_id"))
    }
    joined = splits.concat_subsets(parts)
    return joined.groupBy("subset").agg(F.count("*").alias("rows"), F.sum("k").alias("keys"))
