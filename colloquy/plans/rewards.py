"""Queries on completions: rewards, answers, loops, stops and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import completions, rewards, text
from colloquy.operators import audits, scoring
from colloquy.plans.registry import plan, table

NAMES = tuple(name for name, _ in rewards.REWARDS)

# Completions derive from whole lineitem rows: the guess is the quantity, the true
# answer near or off it, and the shape varies with the part key.
COMPLETIONS_SQL = """WITH shaped AS (
  SELECT l_orderkey, l_partkey, l_returnflag, l_linestatus, l_quantity::INTEGER AS q,
    l_partkey % 12 AS kind FROM lineitem),
completions AS (
  SELECT *,
    CASE kind WHEN 0 THEN q::VARCHAR WHEN 1 THEN ' ' || q WHEN 2 THEN (q + 1)::VARCHAR
      WHEN 3 THEN (q * 2)::VARCHAR WHEN 4 THEN '0' WHEN 5 THEN 'about ' || q
      WHEN 6 THEN '1_0' WHEN 7 THEN NULL ELSE q::VARCHAR END AS answer,
    CASE kind WHEN 8 THEN '<SOLUTION>' || q || '</SOLUTION>'
      WHEN 9 THEN '<think>a</think><think>b</think>' || chr(10) || '<SOLUTION>' || q || '</SOLUTION> end'
      WHEN 10 THEN 'no tags ' || q
      WHEN 11 THEN 'x' || chr(10) || '  <think>l1' || chr(10) || 'l2</think> so' || chr(10)
        || '<SOLUTION>' || q || '.</SOLUTION>' || chr(10) || 'tail'
      ELSE '<think>count</think> then <SOLUTION>' || q || '</SOLUTION>' END AS completion
  FROM shaped)"""
SCORED_SQL = (
    COMPLETIONS_SQL
    + """,
guesses AS (
  SELECT *, nullif(regexp_extract(completion,
      '(?ms)^\\s*<think>.+?</think>.*?<SOLUTION>(.+?)</SOLUTION>\\s*$', 1), '') AS guess,
    nullif(regexp_extract(completion, '(?ms)<SOLUTION>.*?([\\d\\.]+)', 1), '') AS num
  FROM completions),
parsed AS (
  SELECT *, TRY_CAST(replace(trim(guess), '_', '') AS DOUBLE) AS g,
    TRY_CAST(replace(trim(answer), '_', '') AS DOUBLE) AS a,
    TRY_CAST(num AS DOUBLE) AS n FROM guesses),
scored AS (
  SELECT *,
    CASE WHEN guess IS NOT NULL THEN 3.0 ELSE 0.0 END::DOUBLE AS format_exact,
    list_sum(list_transform(['<think>', '</think>', '<SOLUTION>', '</SOLUTION>'], lambda t:
      CASE WHEN (length(completion) - length(replace(completion, t, ''))) // length(t) = 1
        THEN 0.5 ELSE -0.5 END))::DOUBLE AS format_approximate,
    CASE WHEN guess IS NULL OR answer IS NULL THEN 0.0 WHEN guess = answer THEN 3.0
      WHEN trim(guess) = trim(answer) THEN 1.5
      WHEN g IS NULL OR a IS NULL OR a = 0 THEN -0.5
      WHEN g / a BETWEEN 0.9 AND 1.1 THEN 0.5 WHEN g / a BETWEEN 0.8 AND 1.2 THEN 0.25
      ELSE -1.0 END::DOUBLE AS answer_score,
    CASE WHEN n = a THEN 1.5 ELSE 0.0 END::DOUBLE AS number_score
  FROM parsed)"""
)


def completion_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, q = F.col("l_partkey") % 12, F.col("l_quantity").cast("int")
    answer = (
        F.when(kind == 1, F.concat(F.lit(" "), q))
        .when(kind == 2, (q + 1).cast("string"))
        .when(kind == 3, (q * 2).cast("string"))
        .when(kind == 4, "0")
        .when(kind == 5, F.concat(F.lit("about "), q))
        .when(kind == 6, "1_0")
        .when(kind == 7, F.lit(None).cast("string"))
        .otherwise(q.cast("string"))
    )
    completion = (
        F.when(kind == 8, F.format_string("<SOLUTION>%d</SOLUTION>", q))
        .when(
            kind == 9,
            F.format_string(
                "<think>a</think><think>b</think>\n<SOLUTION>%d</SOLUTION> end", q
            ),
        )
        .when(kind == 10, F.format_string("no tags %d", q))
        .when(
            kind == 11,
            F.format_string(
                "x\n  <think>l1\nl2</think> so\n<SOLUTION>%d.</SOLUTION>\ntail", q
            ),
        )
        .otherwise(F.format_string("<think>count</think> then <SOLUTION>%d</SOLUTION>", q))
    )
    columns = ("l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
    return table(spark, sf_dir, "lineitem", *columns).select(
        "l_returnflag",
        "l_linestatus",
        kind.alias("kind"),
        completion.alias("completion"),
        answer.alias("true_answer"),
    )


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(completion_rows(spark, sf_dir))


@plan(
    SCORED_SQL
    + """ SELECT kind, completion, answer AS true_answer, format_exact, format_approximate,
  answer_score AS answer, number_score AS number,
  format_exact + format_approximate + answer_score + number_score AS total, count(*) AS rows
FROM scored GROUP BY ALL"""
)
def reward_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four rewards of every completion, counted per distinct completion."""
    keys = ["kind", "completion", "true_answer", *NAMES, "total"]
    return scored_rows(spark, sf_dir).groupBy(*keys).agg(F.count("*").alias("rows"))


@plan(
    SCORED_SQL
    + """ SELECT l_returnflag, l_linestatus, count(*) AS completions,
  round(avg(format_exact), 6) AS format_exact_avg,
  round(avg(format_approximate), 6) AS format_approximate_avg,
  round(avg(answer_score), 6) AS answer_avg, round(avg(number_score), 6) AS number_avg,
  round(avg(format_exact + format_approximate + answer_score + number_score), 6) AS total_avg
FROM scored GROUP BY l_returnflag, l_linestatus"""
)
def reward_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_rows(spark, sf_dir)
    return scoring.group_scores(rows, ["l_returnflag", "l_linestatus"], NAMES)


# Order texts hold the guess, a rounded price holds the truth; both keyed by order.
@plan(
    """WITH g AS (SELECT o_orderkey, '<start_working_out>' || o_orderpriority ||
    '<end_working_out><SOLUTION>' || floor(o_totalprice)::BIGINT || '</SOLUTION>' AS completion,
    floor(o_totalprice)::BIGINT AS guess FROM orders),
t AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT * (7 + o_custkey % 5) // 10 AS truth FROM orders)
SELECT o_orderkey AS example_id, truth::VARCHAR AS true_answer, 3.0::DOUBLE AS format_exact,
  2.0::DOUBLE AS format_approximate,
  CASE WHEN guess = truth THEN 3.0 WHEN truth = 0 THEN -0.5
    WHEN guess::DOUBLE / truth BETWEEN 0.9 AND 1.1 THEN 0.5
    WHEN guess::DOUBLE / truth BETWEEN 0.8 AND 1.2 THEN 0.25 ELSE -1.0 END::DOUBLE AS answer,
  CASE WHEN guess = truth THEN 1.5 ELSE 0.0 END::DOUBLE AS number
FROM g JOIN t USING (o_orderkey)"""
)
def paired_answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guesses joined to true answers on an explicit id, with the other tag set."""
    tags = rewards.WORKING_OUT_TAGS
    columns = ("o_orderkey", "o_orderpriority", "o_totalprice", "o_custkey")
    orders = table(spark, sf_dir, "orders", *columns)
    price = F.floor("o_totalprice").cast("bigint")
    guesses = orders.select(
        F.col("o_orderkey").alias("example_id"),
        F.concat(
            F.lit(tags.reasoning_start),
            F.col("o_orderpriority"),
            F.lit(tags.reasoning_end + tags.solution_start),
            price,
            F.lit(tags.solution_end),
        ).alias("completion"),
    )
    tenths = price * (7 + F.col("o_custkey") % 5)
    truths = orders.select(
        F.col("o_orderkey").alias("example_id"),
        ((tenths - tenths % 10) / 10).cast("bigint").cast("string").alias("true_answer"),
    )
    paired = guesses.join(truths, "example_id")
    return scoring.score(paired, tags=tags).select("example_id", "true_answer", *NAMES)


@plan(
    """SELECT l_orderkey, l_linenumber, l_quantity::INTEGER AS q, count(*) AS rows,
  CASE WHEN l_partkey % 4 = 3 THEN NULL WHEN l_partkey % 4 = 2 THEN '' ELSE
    l_quantity::INTEGER::VARCHAR END AS answer
FROM lineitem GROUP BY ALL"""
)
def hash_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers behind the ``####`` mark."""
    kind, q = F.col("l_partkey") % 4, F.col("l_quantity").cast("int")
    worked = (
        F.when(kind == 0, F.format_string("so %d in all\n#### %d", q, q))
        .when(kind == 1, F.format_string("####\t%d \n#### 7", q))
        .when(kind == 2, F.format_string("%d####", q))
        .otherwise(F.format_string("%d ### none", q))
    )
    columns = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return (
        table(spark, sf_dir, "lineitem", *columns)
        .select("l_orderkey", "l_linenumber", q.alias("q"), rewards.hash_answer(worked).alias("answer"))
        .groupBy("l_orderkey", "l_linenumber", "q", "answer")
        .agg(F.count("*").alias("rows"))
    )


# Outputs derive from whole documents: a third end in a repeated tail, some repeat
# a marker, the rest are as they are.
OUTPUTS_SQL = """WITH outputs AS (
  SELECT doc_id, source, (['stop', 'length', 'eos', NULL])[doc_id % 4 + 1] AS done_reason,
    CASE WHEN doc_id % 9 < 2 THEN text || repeat('0123456789abc ', 4)
         WHEN doc_id % 9 = 2 THEN text || repeat(' it''s' || chr(10), 12)
         WHEN doc_id % 9 = 3 THEN text || repeat('Answer:' || doc_id, 6) || ' done and dusted'
         ELSE text END AS text
  FROM documents),
tails AS (
  SELECT *, list_transform([10, 20, 30, 50], lambda n: right(text, n)) AS tails FROM outputs),
looped AS (
  SELECT * EXCLUDE (tails), CASE WHEN length(text) >= 50 THEN coalesce(
    list_filter(tails, lambda t, i: length(text) >= ([10, 20, 30, 50])[i] * 3 AND
      (length(text) - length(replace(text, t, ''))) // length(t) >= 3)[1],
    list_filter(['Answer:', 'Question:', '<|im_start|>', '<|endoftext|>', '<|im_end|>'], lambda m:
      (length(text) - length(replace(text, m, ''))) // length(m) > 5)[1]) END AS loop_pattern
  FROM tails)"""


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, doc = F.col("doc_id") % 9, F.col("doc_id")
    body = F.col("text")
    reasons = F.array(F.lit("stop"), F.lit("length"), F.lit("eos"), F.lit(None))
    changed = (
        F.when(kind < 2, F.concat(body, F.lit("0123456789abc " * 4)))
        .when(kind == 2, F.concat(body, F.lit(" it's\n" * 12)))
        .when(
            kind == 3,
            F.concat(
                body,
                F.repeat(F.concat(F.lit("Answer:"), doc.cast("string")), 6),
                F.lit(" done and dusted"),
            ),
        )
        .otherwise(body)
    )
    return table(spark, sf_dir, "documents", "doc_id", "source", "text").select(
        "doc_id",
        "source",
        F.get(reasons, (doc % 4).cast("int")).alias("done_reason"),
        changed.alias("text"),
    )


@plan(OUTPUTS_SQL + " SELECT doc_id, loop_pattern FROM looped")
def loop_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outputs(spark, sf_dir).select(
        "doc_id", completions.loop_pattern(F.col("text")).alias("loop_pattern")
    )


# Literal form of a pattern: the derived texts hold no control characters but \\n.
QUOTED_SQL = """CASE WHEN contains(loop_pattern, '''') AND NOT contains(loop_pattern, '"')
    THEN '"' || replace(replace(loop_pattern, '\\', '\\\\'), chr(10), '\\n') || '"'
    ELSE '''' || replace(replace(replace(loop_pattern, '\\', '\\\\'), chr(10), '\\n'), '''', '\\''')
      || '''' END"""
AUDITED_SQL = (
    OUTPUTS_SQL
    + f""",
audited AS (
  SELECT *, coalesce(done_reason IN ('stop', 'eos'), false) AS stopped_at_eos,
    loop_pattern IS NOT NULL AS detected_loop,
    list_filter([
      CASE WHEN done_reason = 'length' THEN 'Generation stopped due to max_tokens limit' END,
      CASE WHEN loop_pattern IS NOT NULL THEN 'Loop pattern detected: ' || {QUOTED_SQL} END],
      lambda x: x IS NOT NULL) AS issues
  FROM looped)"""
)


@plan(
    AUDITED_SQL
    + """ SELECT doc_id, stopped_at_eos, detected_loop, array_to_string(issues, ' | ') AS issues
FROM audited"""
)
def stop_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop and loop flags with issue texts, by done reason."""
    return audits.audit_by_reason(outputs(spark, sf_dir)).select(
        "doc_id",
        "stopped_at_eos",
        "detected_loop",
        F.array_join("issues", " | ").alias("issues"),
    )


@plan(
    AUDITED_SQL
    + """ SELECT source, count(*) AS prompts_tested,
  count(*) FILTER (stopped_at_eos) AS successful_stops,
  count(*) FILTER (detected_loop) AS detected_loops, sum(len(issues))::BIGINT AS issue_count,
  CASE WHEN count(*) FILTER (detected_loop) > 0 THEN 'loop'
       WHEN count(*) FILTER (stopped_at_eos) = count(*) THEN 'ok' ELSE 'not_stopped' END AS verdict,
  CASE WHEN count(*) FILTER (detected_loop) > 0 THEN 'Infinite loops detected. Check: 1) GGUF has correct chat template, 2) Modelfile has correct stop tokens, 3) Training used distinct pad/eos tokens.' END
    AS recommendation
FROM audited GROUP BY source"""
)
def inference_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops, loops and verdict per model; the source stands for the model."""
    return audits.inference_summary(audits.audit_by_reason(outputs(spark, sf_dir)), "source")


@plan(
    AUDITED_SQL
    + """, each AS (SELECT source, unnest(issues) AS issue FROM audited)
SELECT source, issue, count(*) AS occurrences, issue || ' (' || count(*) || 'x)' AS label
FROM each GROUP BY source, issue"""
)
def inference_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    audited = audits.audit_by_reason(outputs(spark, sf_dir))
    return audits.issue_histogram(audited, ["source"])


@plan(
    """WITH flat AS (SELECT doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS line
  FROM documents)
SELECT doc_id, CASE WHEN length(line) <= 240 THEN line ELSE line[:240] || '...' END AS preview,
  CASE WHEN length(text) <= 200 THEN text ELSE text[:200] || '...' END AS cut_200,
  md5(CASE WHEN length(text) <= 500 THEN text ELSE text[:500] || '... [truncated]' END) AS cut_500,
  md5(CASE WHEN length(text) <= 1000 THEN text ELSE text[:1000] || '... [truncated]' END) AS cut_1000
FROM flat"""
)
def text_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.col("text")
    return table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id",
        text.preview(body).alias("preview"),
        text.cut(body, 200).alias("cut_200"),
        F.md5(text.cut(body, 500, "... [truncated]")).alias("cut_500"),
        F.md5(text.cut(body, 1000, "... [truncated]")).alias("cut_1000"),
    )


def _tagged(body: Column, kind: Column) -> Column:
    return (
        F.when(
            kind == 0,
            F.concat(
                F.lit("<start_working_out>"), body, F.lit("<end_working_out><SOLUTION>1</SOLUTION>")
            ),
        )
        .when(kind == 1, F.concat(F.lit("<start_working_out>"), body, F.lit("<SOLUTION></SOLUTION>")))
        .when(kind == 2, F.concat(F.lit("<start_working_out>"), body))
        .otherwise(body)
    )


@plan(
    """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'following' WHEN 1 THEN 'partial'
  ELSE 'none' END AS format FROM conversations"""
)
def trained_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = _tagged(F.col("text"), F.col("turn") % 4)
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", completions.trained_format(tagged).alias("format")
    )
