"""Aligned tool calls: eight events make an example; predictions leave out, add and change calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import alignment
from colloquy.plans.registry import plan, table

ALIGNED_SQL = """
WITH RECURSIVE wanted AS (
  SELECT event_id // 8 AS example_id, list(event_type ORDER BY event_id) AS names, list(props ORDER BY event_id) AS args,
    'P' || (event_id // 8) % 5 AS policy_class FROM events GROUP BY event_id // 8),
made AS (
  SELECT event_id // 8 AS example_id, event_id * 2 + 1 AS place, CASE WHEN event_id % 9 = 4 THEN 'other' ELSE event_type END AS name,
    CASE WHEN event_id % 4 = 3 THEN '{"k": -1}' ELSE regexp_replace(props, ':', ' :  ') END AS args FROM events WHERE event_id % 6 <> 1
  UNION ALL
  SELECT event_id // 8, event_id * 2, 'lookup', '{}' FROM events WHERE event_id % 7 = 2),
got AS (
  SELECT example_id, list(name ORDER BY place) AS got_names, list(replace(args, ' ', '') ORDER BY place) AS got_args FROM made GROUP BY example_id),
examples AS MATERIALIZED (
  SELECT example_id, policy_class, names, list_transform(args, lambda x: replace(x, ' ', '')) AS args,
    coalesce(got_names, []) AS got_names, coalesce(got_args, []) AS got_args
  FROM wanted LEFT JOIN got USING (example_id)),
rows_done AS (
  SELECT example_id, 0 AS i, list_transform(range(len(got_names) + 1), lambda x: 0::BIGINT) AS best FROM examples
  UNION ALL
  SELECT r.example_id, r.i + 1, list_reduce(
    list_prepend([0::BIGINT], list_transform(range(1, len(e.got_names) + 1), lambda j: [j::BIGINT])),
    lambda done, j: list_append(done, greatest(done[len(done)], r.best[j[1] + 1],
      CASE WHEN e.names[r.i + 1] = e.got_names[j[1]] THEN r.best[j[1]] + 4294967296
        + CASE WHEN e.args[r.i + 1] = e.got_args[j[1]] THEN 1 ELSE 0 END ELSE 0 END)))
  FROM rows_done r JOIN examples e USING (example_id) WHERE r.i < len(e.names)),
aligned AS (
  SELECT example_id, policy_class, (best[len(best)] >> 32)::INTEGER AS matched, (best[len(best)] & 4294967295)::INTEGER AS exact,
    (len(names) - (best[len(best)] >> 32))::INTEGER AS missing, (len(got_names) - (best[len(best)] >> 32))::INTEGER AS surplus
  FROM rows_done JOIN examples USING (example_id) WHERE i = len(names))"""


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events", "event_id", "event_type", "props")
    event, example = F.col("event_id"), F.expr("event_id div 8").alias("example_id")

    def calls(place, name, arguments):
        listed = F.array_sort(F.collect_list(F.struct(place.alias("place"), name.alias("name"), arguments.alias("arguments"))))
        return F.transform(listed, lambda call: F.struct(call["name"].alias("name"), call["arguments"].alias("arguments")))

    expected = events.groupBy(example).agg(calls(event, F.col("event_type"), F.col("props")).alias("expected"))
    made = events.where(event % 6 != 1).select(
        example,
        (event * 2 + 1).alias("place"),
        F.when(event % 9 == 4, "other").otherwise(F.col("event_type")).alias("name"),
        F.when(event % 4 == 3, F.lit('{"k": -1}')).otherwise(F.regexp_replace("props", ":", " :  ")).alias("arguments"),
    )
    added = events.where(event % 7 == 2).select(example, (event * 2).alias("place"), F.lit("lookup").alias("name"), F.lit("{}").alias("arguments"))
    predicted = made.unionByName(added).groupBy("example_id").agg(calls(F.col("place"), F.col("name"), F.col("arguments")).alias("predicted"))
    examples = expected.join(predicted, "example_id", "left").withColumn("policy_class", F.concat(F.lit("P"), F.col("example_id") % 5))
    return alignment.with_alignment(examples)


@plan(ALIGNED_SQL + " SELECT example_id, matched, exact, missing, surplus FROM aligned")
def aligned_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many calls of every example were found, missed and made without need."""
    return aligned(spark, sf_dir).select("example_id", "matched", "exact", "missing", "surplus")


@plan(
    ALIGNED_SQL
    + """ SELECT policy_class, grouping(policy_class)::BIGINT AS grouping, count(*) AS examples, sum(matched)::BIGINT AS matched,
  sum(exact)::BIGINT AS exact, sum(missing)::BIGINT AS missing, sum(surplus)::BIGINT AS surplus,
  round(coalesce(sum(matched) / nullif(sum(matched + missing), 0), 0.0), 6) AS recall,
  round(coalesce(sum(matched) / nullif(sum(matched + surplus), 0), 0.0), 6) AS precision,
  round(coalesce(sum(exact) / nullif(sum(matched), 0), 0.0), 6) AS exact_share
FROM aligned GROUP BY GROUPING SETS ((policy_class), ())"""
)
def aligned_call_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and precision of calls by policy class and overall; calls nobody asked for lower precision."""
    report = alignment.alignment_report(aligned(spark, sf_dir), "policy_class")
    return report.withColumns({name: F.round(name, 6) for name in ("recall", "precision", "exact_share")})
