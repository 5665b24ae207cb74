"""Queries on dataset formatters and small name functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import messages as msg
from colloquy.functions import text
from colloquy.functions.rendering import PlainTemplate
from colloquy.operators import formatters
from colloquy.plans.inputs import turns
from colloquy.plans.registry import plan, table
from colloquy.sources import prompts


def _counted(df: DataFrame) -> DataFrame:
    """Texts repeat across parts, so count them."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("rows"))


@plan(
    """WITH t AS (SELECT 'user:Question: ' || p_name || chr(10) || chr(10) || 'Choices:' || chr(10) ||
  'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || 'C. ' || p_size || chr(10) ||
  chr(10) || 'Provide the correct answer label (A, B, C, or D).' || chr(10) ||
  'assistant:The correct answer is ' || (['A', 'B', 'C'])[p_partkey % 3 + 1] || '.' AS text FROM part)
SELECT text, count(*) AS rows FROM t GROUP BY text"""
)
def multiple_choice_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(F.lit("A"), F.lit("B"), F.lit("C"))
    rows = table(spark, sf_dir, "part").select(
        F.col("p_name").alias("question"),
        F.struct(
            names.alias("label"),
            F.array("p_brand", "p_type", F.col("p_size").cast("string")).alias("text"),
        ).alias("choices"),
        F.get(names, (F.col("p_partkey") % 3).cast("int")).alias("answerKey"),
    )
    return _counted(formatters.multiple_choice(rows))


LANGS_SQL = """CASE lang WHEN 'de' THEN 'deu_Latn' WHEN 'fr' THEN 'fra_Latn' WHEN 'en' THEN 'eng_Latn'
  ELSE lang END"""


def _language_tag(lang: Column) -> Column:
    return (
        F.when(lang == "de", "deu_Latn")
        .when(lang == "fr", "fra_Latn")
        .when(lang == "en", "eng_Latn")
        .otherwise(lang)
    )


@plan(
    f"""SELECT doc_id, CASE {LANGS_SQL} WHEN 'deu_Latn' THEN 'german' WHEN 'fra_Latn' THEN 'french'
  WHEN 'eng_Latn' THEN 'english' ELSE 'randomly selected' END AS language FROM documents"""
)
def language_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language tags looked up in a code table with a default."""
    tag = _language_tag(F.col("lang"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", formatters.language_name(tag).alias("language")
    )


@plan(
    """SELECT md5('user:Your task is to identify the correct answer within the passage. The language is '
  || CASE lang WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' WHEN 'en' THEN 'english'
     ELSE 'randomly selected' END || '. Passage: ' || text || chr(10) || chr(10) || 'Question: ' ||
  source || '?' || chr(10) || chr(10) || 'Choices:' || chr(10) || '1. ' || lang || chr(10) || '2. ' ||
  source || chr(10) || '3. ' || n_chars || chr(10) || '4. none' || chr(10) || chr(10) ||
  'Provide the correct answer label (1, 2, 3, or 4).' || chr(10) ||
  'assistant:The correct answer is ' || (doc_id % 4 + 1) || '.') AS text, count(*) AS rows
FROM documents GROUP BY ALL"""
)
def passage_choice_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        _language_tag(F.col("lang")).alias("dialect"),
        F.col("text").alias("flores_passage"),
        F.concat("source", F.lit("?")).alias("question"),
        F.col("lang").alias("mc_answer1"),
        F.col("source").alias("mc_answer2"),
        F.col("n_chars").cast("string").alias("mc_answer3"),
        F.lit("none").alias("mc_answer4"),
        (F.col("doc_id") % 4 + 1).alias("correct_answer_num"),
    )
    return _counted(formatters.passage_choice(rows).withColumn("text", F.md5("text")))


@plan(
    """SELECT md5('user:You are given a context and your task is to answer the question asked only by using the context given.Context:'
  || chr(10) || ' ' || text || chr(10) || 'Question: ' || source || chr(10) || 'assistant:' ||
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END) AS text, count(*) AS rows
FROM documents GROUP BY ALL"""
)
def context_question_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    no_answer = F.array().cast("array<string>")
    answers = F.when(F.col("doc_id") % 3 == 0, no_answer).otherwise(F.array("lang", "source"))
    rows = table(spark, sf_dir, "documents").select(
        F.col("text").alias("context"),
        F.col("source").alias("question"),
        F.struct(answers.alias("text")).alias("answers"),
    )
    return _counted(formatters.context_question(rows).withColumn("text", F.md5("text")))


@plan(
    """SELECT md5(CASE WHEN turn % 3 = 0
  THEN 'user:System: ' || role || chr(10) || text || chr(10) || 'unknown role:' || role
  ELSE 'user:' || text || chr(10) || 'assistant:' || role END) AS text, count(*) AS rows
FROM conversations GROUP BY ALL"""
)
def shared_conversation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared turns with other role names; the template refuses system turns."""

    def said(who: str, value: str) -> Column:
        return F.struct(F.lit(who).alias("from"), F.col(value).alias("value"))

    conversations = F.when(
        F.col("turn") % 3 == 0,
        F.array(said("system", "role"), said("human", "text"), said("bot", "role")),
    ).otherwise(F.array(said("human", "text"), said("gpt", "role")))
    rows = turns(spark, sf_dir).select(conversations.alias("conversations"))
    texts = formatters.shared_conversation(rows, PlainTemplate(rejects_system=True))
    return _counted(texts.withColumn("text", F.md5("text")))


@plan(
    """SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'System role not supported'
  ELSE 'no user message follows a leading system message' END AS reason
FROM conversations WHERE turn % 4 IN (1, 2, 3)"""
)
def refused_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared turns whose system texts stand where they cannot be merged, or are more than one."""

    def said(who: str, value: str) -> Column:
        return F.struct(F.lit(who).alias("from"), F.col(value).alias("value"))

    system, asked, answer = said("system", "role"), said("human", "text"), said("gpt", "role")
    case = F.col("turn") % 4
    conversations = (
        F.when(case == 0, F.array(system, asked, answer))
        .when(case == 1, F.array(asked, system, answer))
        .when(case == 2, F.array(system, system, asked))
        .otherwise(F.array(system, asked, system, answer))
    )
    rows = turns(spark, sf_dir).select("conv_id", "turn", conversations.alias("conversations"))
    refused = formatters.refused_conversations(rows, PlainTemplate(rejects_system=True))
    return refused.select("conv_id", "turn", "reason")


@plan(
    """SELECT md5('user:' || source || chr(10) || 'assistant:' || text) AS text, count(*) AS rows
FROM documents GROUP BY ALL"""
)
def prompt_response_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        F.md5(formatters.two_message_text(F.col("source"), F.col("text"))).alias("text")
    )
    return _counted(rows)


PAIRS_SQL = """WITH pairs AS (
  SELECT a.conv_id, a.turn, u.role AS asked_by, u.text AS question, a.text AS chosen,
    'I cannot say: ' || md5(a.text) AS rejected
  FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1
  WHERE a.role = 'assistant')"""


def preference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn against a refusal, asked by the turn before it."""
    rows = turns(spark, sf_dir)
    answers = rows.where(F.col("role") == "assistant").select(
        "conv_id",
        "turn",
        F.col("text").alias("chosen"),
        F.concat(F.lit("I cannot say: "), F.md5("text")).alias("rejected"),
    )
    questions = rows.select(
        "conv_id",
        (F.col("turn") + 1).alias("turn"),
        F.col("role").alias("asked_by"),
        F.col("text").alias("question"),
    )
    return answers.join(questions, ["conv_id", "turn"])


@plan(
    PAIRS_SQL
    + """ SELECT md5('system:' || asked_by || chr(10) || 'user:' || question) AS prompt,
  md5(chosen) AS chosen, rejected FROM pairs"""
)
def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = preference_rows(spark, sf_dir).withColumn("system", F.col("asked_by"))
    return formatters.preference_pair(rows).select(
        F.md5("prompt").alias("prompt"), F.md5("chosen").alias("chosen"), "rejected"
    )


@plan(
    PAIRS_SQL
    + """ SELECT md5('system:' || asked_by || chr(10) || 'user:' || question) AS prompt,
  md5('user:' || question || chr(10) || 'assistant:' || chosen) AS chosen,
  md5('user:' || question || chr(10) || 'assistant:' || rejected) AS rejected FROM pairs"""
)
def preference_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    def dialog(answer: str) -> Column:
        return F.array(
            msg.message(F.lit("user"), F.col("question")),
            msg.message(F.lit("assistant"), F.col(answer)),
        )

    rows = preference_rows(spark, sf_dir).select(
        F.array(msg.message(F.lit("system"), F.col("asked_by"))).alias("messages"),
        F.col("question").alias("prompt"),
        dialog("chosen").alias("chosen"),
        dialog("rejected").alias("rejected"),
    )
    return formatters.preference_messages(rows).select(
        *[F.md5(c).alias(c) for c in ("prompt", "chosen", "rejected")]
    )


@plan(
    """SELECT md5(text) AS question, 'system' AS first_role, 'user' AS last_role,
  CASE WHEN item_id % 4 = 0 THEN NULL ELSE item_id::VARCHAR END AS answer FROM benchmark"""
)
def reward_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    worked = F.when(F.col("item_id") % 4 != 0, F.concat(F.lit("so\n#### "), F.col("item_id")))
    rows = table(spark, sf_dir, "benchmark").select(
        F.col("text").alias("question"), F.coalesce(worked, F.lit("so")).alias("answer")
    )
    prompt = F.col("prompt")
    return formatters.reward_prompt(rows).select(
        F.md5(prompt[1]["content"]).alias("question"),
        prompt[0]["role"].alias("first_role"),
        prompt[1]["role"].alias("last_role"),
        "answer",
    )


@plan(
    """SELECT item_id // 16 AS list_id, unnest(list(md5(text) ORDER BY item_id)) AS prompt,
  unnest(range(count(*)))::INTEGER AS position
FROM benchmark GROUP BY item_id // 16 HAVING item_id // 16 % 3 <> 2"""
)
def prompt_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt lists as JSON text; every third list is broken and gives none."""
    items = F.array_sort(F.collect_list(F.struct("item_id", "text")))
    # Sixteen prompts per list.
    lists = (
        table(spark, sf_dir, "benchmark")
        .groupBy(F.floor(F.col("item_id") / 16).alias("list_id"))
        .agg(F.to_json(F.transform(items, lambda i: i["text"])).alias("body"))
    )
    broken = F.when(F.col("list_id") % 3 == 2, F.concat("body", F.lit("]"))).otherwise(F.col("body"))
    parsed = prompts.parse_prompts(broken)
    return lists.select("list_id", F.posexplode(parsed).alias("position", "prompt")).withColumn(
        "prompt", F.md5("prompt")
    )


@plan(
    """SELECT p_partkey, lower(trim(regexp_replace(p_name || ' (' || p_brand || ')', '[^A-Za-z0-9]+',
  '_', 'g'), '_')) AS slug FROM part"""
)
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(name).alias("slug"))


@plan(
    """SELECT p_partkey, 's3://' || p_type || '/dataset_id=' || p_name || '/dataset_version=v' ||
  p_size || '/manifest.json' AS uri FROM part"""
)
def manifest_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.concat(F.lit("v"), F.col("p_size"))
    uri = text.manifest_uri(F.col("p_type"), F.col("p_name"), version)
    return table(spark, sf_dir, "part").select("p_partkey", uri.alias("uri"))


@plan(
    """WITH stems AS (SELECT p_partkey, (['m-' || p_size || '-lora', 'lora-' || p_size,
  'm-lora-v' || p_size, 'plain' || p_size])[p_partkey % 4 + 1] AS stem FROM part)
SELECT p_partkey, CASE WHEN stem LIKE '%-lora' THEN stem ELSE stem || '-lora' END AS adapter,
  CASE WHEN stem LIKE '%-lora' THEN stem[:-6] ELSE stem END AS bare,
  CASE WHEN contains(stem, '-lora-') THEN replace(stem, '-lora-', '-gguf-')
    WHEN contains(stem, 'lora') THEN replace(stem, 'lora', 'gguf') ELSE stem || '-gguf' END AS packaged
FROM stems"""
)
def repository_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    stems = F.array(
        F.concat(F.lit("m-"), size, F.lit("-lora")),
        F.concat(F.lit("lora-"), size),
        F.concat(F.lit("m-lora-v"), size),
        F.concat(F.lit("plain"), size),
    )
    stem = F.col("stem")
    named = table(spark, sf_dir, "part").withColumn(
        "stem", F.get(stems, (F.col("p_partkey") % 4).cast("int"))
    )
    return named.select(
        "p_partkey",
        text.with_adapter_suffix(stem).alias("adapter"),
        text.without_adapter_suffix(stem).alias("bare"),
        text.adapter_to_gguf(stem).alias("packaged"),
    )


@plan("SELECT c_custkey, 'sha256:' || substr(sha256(c_name), 1, 16) AS pseudonym FROM customer")
def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey", text.pseudonym(F.col("c_name")).alias("pseudonym")
    )
