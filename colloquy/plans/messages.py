"""Queries on messages: tool calls, normalization, targets and chat rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import jsontext, rendering, toolcalls
from colloquy.functions import messages as msg
from colloquy.plans.inputs import IRREGULAR_TURNS_SQL, whole_sql, irregular_turns, turns
from colloquy.plans.registry import plan, table
from colloquy.plans.supervised import irregular_rows

# Calls derive from events: every third is nested, every eleventh has broken
# arguments, every thirteenth none, every fifth an id of its own.
CALLS_SQL = """WITH raw AS (
  SELECT event_id, event_type AS name, event_id % 3 = 0 AS is_nested,
    CASE WHEN event_id % 5 = 0 THEN 'custom_' || event_id END AS id,
    CASE WHEN event_id % 13 = 0 THEN NULL
         WHEN event_id % 11 = 0 THEN props || 'é'
         ELSE props END AS arguments
  FROM events)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    eid = F.col("event_id")
    arguments = (
        F.when(eid % 13 == 0, F.lit(None))
        .when(eid % 11 == 0, F.concat("props", F.lit("é")))
        .otherwise(F.col("props"))
    )
    call_id = F.when(eid % 5 == 0, F.concat(F.lit("custom_"), eid))
    nothing = F.lit(None).cast("string")
    flat = F.struct(
        call_id.alias("id"),
        nothing.alias("type"),
        F.col("event_type").alias("name"),
        arguments.alias("arguments"),
        F.lit(None).cast("struct<name:string,arguments:string>").alias("function"),
    )
    nested = F.struct(
        call_id.alias("id"),
        nothing.alias("type"),
        nothing.alias("name"),
        nothing.alias("arguments"),
        F.struct(F.col("event_type").alias("name"), arguments.alias("arguments")).alias("function"),
    )
    return table(spark, sf_dir, "events", "event_id", "event_type", "props").select(
        "event_id", F.when(eid % 3 == 0, nested).otherwise(flat).alias("call")
    )


FLAT_PARSED_SQL = (
    CALLS_SQL
    + """ SELECT event_id, name,
  CASE WHEN json_valid(arguments) THEN arguments ELSE '{}' END AS arguments FROM raw"""
)


def _flat(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    normalized = F.get(toolcalls.normalize_calls(F.array("call"), family), F.lit(0))
    return calls(spark, sf_dir).withColumn("call", normalized).select(
        "event_id", "call.name", "call.arguments"
    )


@plan(FLAT_PARSED_SQL)
def tool_calls_qwen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir, "qwen")


@plan(FLAT_PARSED_SQL)
def tool_calls_gemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir, "gemma")


@plan(CALLS_SQL + " SELECT event_id, name, coalesce(arguments, '{}') AS arguments FROM raw")
def tool_calls_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir, "unheard-of")


NESTED_SQL = (
    CALLS_SQL
    + """,
pieces AS (
  SELECT *, array_to_string(list_filter([
      CASE WHEN arguments IS NOT NULL THEN '"arguments": ' ||
        replace(json_quote(arguments)::VARCHAR, 'é', '\\u00e9') END,
      '"name": "' || name || '"'], lambda x: x IS NOT NULL), ', ') AS body FROM raw),
identified AS (
  SELECT *, coalesce(id, 'call_' || substr(md5(CASE WHEN is_nested
      THEN '{"function": {' || body || '}}' ELSE '{' || body || '}' END), 1, 12)) AS call_id
  FROM pieces)"""
)


@plan(
    NESTED_SQL
    + """ SELECT event_id, call_id AS id, 'function' AS type, name,
  coalesce(arguments, '{}') AS arguments FROM identified"""
)
def tool_calls_openai(spark: SparkSession, sf_dir: str) -> DataFrame:
    normalized = F.get(toolcalls.normalize_calls(F.array("call"), "openai"), F.lit(0))
    return calls(spark, sf_dir).withColumn("call", normalized).select(
        "event_id", "call.id", "call.type", "call.function.name", "call.function.arguments"
    )


@plan(NESTED_SQL + " SELECT event_id, call_id FROM identified")
def tool_call_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own id, else a stable id from the canonical JSON of the call."""
    return calls(spark, sf_dir).select(
        "event_id", toolcalls.call_id(F.col("call")).alias("call_id")
    )


@plan("SELECT event_id, props AS canonical, md5(props) AS digest FROM events")
def canonical_json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON through Arrow; the input has its separators removed first."""
    compact = F.replace(F.col("props"), F.lit(": "), F.lit(":"))
    canonical = jsontext.canonical_json(compact)
    return (
        table(spark, sf_dir, "events", "event_id", "props")
        .select("event_id", canonical.alias("canonical"))
        .withColumn("digest", F.md5("canonical"))
    )


# Model names derive from customers: brand by key, an explicit tag on every ninth.
MODEL_NAME_PARTS = ("Qwen3-", "gemma-2-", "GPT-4-", "davinci-", "turbo-", "Claude-", "anthropic/", "Llama-")


def _model_name(key: Column) -> Column:
    parts = F.array(*[F.lit(p) for p in MODEL_NAME_PARTS])
    return F.concat(
        F.get(parts, (key % len(MODEL_NAME_PARTS)).cast("int")), F.col("c_mktsegment")
    )


MODELS_SQL = """WITH models AS (
  SELECT c_custkey, (['Qwen3-', 'gemma-2-', 'GPT-4-', 'davinci-', 'turbo-', 'Claude-',
      'anthropic/', 'Llama-'])[c_custkey % 8 + 1] || c_mktsegment AS model,
    CASE WHEN c_custkey % 9 = 0 THEN ' Gemma ' WHEN c_custkey % 9 = 1 THEN '' END AS explicit
  FROM customer),
detected AS (
  SELECT *, CASE WHEN explicit <> '' THEN lower(trim(explicit))
    WHEN lower(model) LIKE '%qwen%' THEN 'qwen' WHEN lower(model) LIKE '%gemma%' THEN 'gemma'
    WHEN regexp_matches(lower(model), 'gpt|openai|davinci|turbo|claude|anthropic') THEN 'openai'
    ELSE 'generic' END AS family FROM models)"""


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    explicit = F.when(key % 9 == 0, " Gemma ").when(key % 9 == 1, "")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", _model_name(key).alias("model"), explicit.alias("explicit")
    )


@plan(MODELS_SQL + " SELECT c_custkey, model, family FROM detected")
def model_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = toolcalls.detect_family(F.col("model"), F.col("explicit"))
    return _models(spark, sf_dir).select("c_custkey", "model", family.alias("family"))


@plan(
    CALLS_SQL
    + """,
tagged AS (SELECT *, (['QWEN', 'gemma', 'OpenAI', 'gpt', 'generic', 'other'])[event_id % 6 + 1]
  AS family FROM raw)
SELECT event_id, family, event_id % 6 IN (2, 3) AS nested, name,
  CASE WHEN event_id % 6 < 2 AND NOT coalesce(json_valid(arguments), false) THEN '{}'
       ELSE coalesce(arguments, '{}') END AS arguments
FROM tagged"""
)
def family_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalization where the family is a column."""
    tags = F.array(*[F.lit(t) for t in ("QWEN", "gemma", "OpenAI", "gpt", "generic", "other")])
    tagged = calls(spark, sf_dir).withColumn(
        "family", F.get(tags, (F.col("event_id") % 6).cast("int"))
    )
    out = tagged.withColumn("out", toolcalls.normalize_call(F.col("call"), F.col("family")))
    return out.select(
        "event_id",
        "family",
        F.col("out.function").isNotNull().alias("nested"),
        toolcalls.call_name(F.col("out")).alias("name"),
        toolcalls.call_arguments(F.col("out")).alias("arguments"),
    )


# Assistant texts that embed calls as JSON derive from events: two calls and one
# item that is no call, no list, broken text after the object, or plain text.
EMBEDDED_SQL = """WITH said AS (
  SELECT event_id, event_type, props, event_id % 6 AS kind,
    CASE event_id % 6
      WHEN 0 THEN '{"tool_calls": [{"name": "' || event_type || '", "arguments": ' || props ||
        '}, 7, {"function": {"name": "again", "arguments": "{}"}}]}'
      WHEN 1 THEN '{"tool_calls": null}'
      WHEN 2 THEN '{"tool_calls": [{"name": "x"}]} and more'
      WHEN 3 THEN '{"answer": ' || props || '}'
      WHEN 4 THEN event_type ELSE NULL END AS content
  FROM events)"""


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 6
    content = (
        F.when(
            kind == 0,
            F.concat(
                F.lit('{"tool_calls": [{"name": "'),
                F.col("event_type"),
                F.lit('", "arguments": '),
                F.col("props"),
                F.lit('}, 7, {"function": {"name": "again", "arguments": "{}"}}]}'),
            ),
        )
        .when(kind == 1, '{"tool_calls": null}')
        .when(kind == 2, '{"tool_calls": [{"name": "x"}]} and more')
        .when(kind == 3, F.concat(F.lit('{"answer": '), F.col("props"), F.lit("}")))
        .when(kind == 4, F.col("event_type"))
    )
    item = msg.message(F.lit("assistant"), content, tool_name=F.lit(" tool "))
    events = table(spark, sf_dir, "events", "event_id", "event_type", "props")
    return events.select("event_id", F.array(item).alias("items"))


def _embedded_result(df: DataFrame, family: str) -> DataFrame:
    first = F.get(msg.normalize_messages(F.col("items"), family), F.lit(0))
    shown = F.transform(
        F.col("m.tool_calls"),
        lambda c: F.concat_ws(
            "=", toolcalls.call_name(c), F.replace(toolcalls.call_arguments(c), F.lit(" "), F.lit(""))
        ),
    )
    return df.withColumn("m", first).select(
        "event_id",
        F.col("m").isNotNull().alias("kept"),
        F.col("m.content").alias("content"),
        F.col("m.name").alias("name"),
        F.size("m.tool_calls").alias("n_calls"),
        F.array_join(shown, ";").alias("calls"),
    )


EMBEDDED_RESULT_SQL = (
    EMBEDDED_SQL
    + """ SELECT event_id, kind <> 5 AS kept, CASE WHEN kind IN (2, 3, 4) THEN content END AS content,
  CASE WHEN kind IN (2, 3, 4) THEN 'tool' END AS name,
  CASE WHEN kind = 0 THEN 2 END AS n_calls,
  CASE WHEN kind = 0 THEN event_type || '=' || replace(props, ' ', '') || ';again={}' END AS calls
FROM said"""
)


@plan(EMBEDDED_RESULT_SQL)
def embedded_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls embedded in assistant text become structured calls; others fall through."""
    return _embedded_result(_embedded(spark, sf_dir), "qwen")


@plan(EMBEDDED_RESULT_SQL)
def embedded_tool_calls_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embedded_result(_embedded(spark, sf_dir), "openai")


NAMED_SQL = f"""WITH {IRREGULAR_TURNS_SQL}
SELECT conv_id, turn, CASE WHEN text IS NOT NULL THEN role END AS role, md5(text) AS text,
  CASE WHEN text IS NULL OR turn % 3 = 1 THEN NULL ELSE 'probe' END AS tool_name,
  CASE WHEN text IS NULL THEN NULL WHEN turn % 2 = 1 THEN 'named'
       WHEN turn % 3 = 1 THEN NULL ELSE 'probe' END AS name,
  CASE WHEN text IS NULL OR turn % 4 <> 0 THEN NULL ELSE 1 END AS n_calls
FROM irregular"""


@plan(NAMED_SQL)
def normalized_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message rules: content required, tool name sets the name, an own name wins."""
    call = F.struct(
        F.lit(None).cast("string").alias("id"),
        F.lit(None).cast("string").alias("type"),
        F.lit("look").alias("name"),
        F.lit("{}").alias("arguments"),
        F.lit(None).cast("struct<name:string,arguments:string>").alias("function"),
    )
    kind = f"array<{msg.MESSAGE['tool_calls'].dataType.elementType.simpleString()}>"
    none = F.array(F.lit(None)).cast(kind)
    item = msg.message(
        F.col("role"),
        F.col("text"),
        F.when(F.col("turn") % 4 == 0, F.array(call).cast(kind)).otherwise(none),
        F.when(F.col("turn") % 3 == 1, " ").otherwise(" probe\n"),
        F.when(F.col("turn") % 2 == 1, "named ").otherwise(""),
    )
    rows = irregular_turns(spark, sf_dir).select("conv_id", "turn", item.alias("item"))
    out = rows.withColumn("m", msg.normalize_message(F.col("item"), "generic"))
    return out.select(
        "conv_id",
        "turn",
        F.col("m.role").alias("role"),
        F.md5("m.content").alias("text"),
        F.col("m.tool_name").alias("tool_name"),
        F.col("m.name").alias("name"),
        F.size("m.tool_calls").alias("n_calls"),
    )


@plan(
    """SELECT conv_id, turn,
  CASE WHEN turn % 3 = 0 THEN role ELSE 'assistant' END AS role,
  CASE WHEN turn % 3 = 0 THEN md5(text) WHEN turn % 3 = 1 THEN md5('said') END AS content,
  CASE WHEN turn % 3 = 0 THEN text WHEN turn % 3 = 1 THEN 'said' ELSE '' END AS effective
FROM conversations"""
)
def resolved_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A usable target message wins over the target text."""
    kind = F.col("turn") % 3
    embedded = '{"tool_calls": [{"name": "go", "arguments": {}}]}'
    item = (
        F.when(kind == 0, msg.message(F.col("role"), F.col("text")))
        .when(kind == 1, msg.message(F.lit("assistant"), F.lit(None)))
        .otherwise(msg.message(F.lit("assistant"), F.lit(embedded)))
    )
    rows = turns(spark, sf_dir).withColumn("m", msg.normalize_message(item, "gemma"))
    said = F.lit("said")
    target = msg.resolve_target(F.col("m"), said)
    return rows.select(
        "conv_id",
        "turn",
        target["role"].alias("role"),
        F.md5(target["content"]).alias("content"),
        msg.target_content(F.col("m"), said).alias("effective"),
    )


CONTEXTS_SQL = (
    whole_sql(IRREGULAR_TURNS_SQL)
    + ", targets AS (SELECT example_id, items, target_text AS text FROM examples)"
)


@plan(
    CONTEXTS_SQL
    + """ SELECT example_id,
  md5(array_to_string(list_append(list_transform(items, lambda m: m.role || ':' || m.text),
      'assistant:'), chr(10))) AS prompt,
  md5(array_to_string(list_append(list_transform(items, lambda m: m.role || ':' || m.text),
      'assistant:' || text), chr(10))) AS full_text
FROM targets"""
)
def plain_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = rendering.PlainTemplate()
    full = F.concat("messages", F.array(msg.message(F.lit("assistant"), F.col("target_text"))))
    return irregular_rows(spark, sf_dir).select(
        "example_id",
        F.md5(template.render(F.col("messages"), generation_prompt=True)).alias("prompt"),
        F.md5(template.render(full)).alias("full_text"),
    )


# Tool turns and calls derive from position: the second user turn answers a call.
CHATML_SQL = (
    CONTEXTS_SQL
    + """,
recast AS (
  SELECT example_id, text, list_transform(items, lambda m, i:
    {'role': CASE WHEN m.role = 'user' AND i % 4 = 3 THEN 'tool' ELSE m.role END,
     'text': m.text, 'call': m.role = 'assistant' AND i % 4 = 2}) AS items FROM targets),
pieces AS (
  SELECT example_id, text, array_to_string(list_transform(
      list_filter(items, lambda m: m.role = 'system' AND m.text <> ''), lambda m: m.text),
      chr(10) || chr(10)) AS system_text,
    array_to_string(list_transform(items, lambda m:
      CASE WHEN m.role = 'user' THEN '<|im_start|>user' || chr(10) || m.text || '<|im_end|>' || chr(10)
           WHEN m.role = 'tool' THEN '<|im_start|>user' || chr(10) || '<tool_response>' || chr(10)
             || m.text || chr(10) || '</tool_response><|im_end|>' || chr(10)
           WHEN m.role = 'assistant' THEN '<|im_start|>assistant' || chr(10) ||
             CASE WHEN m.call THEN '<tool_call>' || chr(10) || '{"name": "look", "arguments": {"k": 1}}'
               || chr(10) || '</tool_call>' ELSE m.text END || '<|im_end|>' || chr(10)
           ELSE '' END), '') AS body
  FROM recast),
headed AS (
  SELECT *, CASE WHEN system_text <> '' THEN '<|im_start|>system' || chr(10) || system_text
    || '<|im_end|>' || chr(10) ELSE '' END AS head FROM pieces)
SELECT example_id,
  md5(head || body || '<|im_start|>assistant' || chr(10)) AS prompt,
  md5(head || body || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10)
      || '</think>' || chr(10) || chr(10)) AS prompt_without_thinking,
  md5(head || body || '<|im_start|>assistant' || chr(10) || text) AS full_text,
  md5(replace(CASE WHEN head = '' THEN '<|im_start|>system' || chr(10) || '<|im_end|>' || chr(10)
    ELSE head END, '<|im_end|>', chr(10) || chr(10) || '# Tools' || chr(10) || chr(10) ||
    'You are provided with function signatures within <tools></tools> XML tags:' || chr(10) ||
    '<tools>' || chr(10) || '{"type": "function", "function": {"name": "look"}}' || chr(10) ||
    '</tools>' || chr(10) || chr(10) || 'For each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:'
    || chr(10) || '<tool_call>' || chr(10) || '{"name": <function-name>, "arguments": <args-json-object>}'
    || chr(10) || '</tool_call><|im_end|>')
    || body || '<|im_start|>assistant' || chr(10) || text) AS with_tools
FROM headed"""
)


def _recast(items: Column) -> Column:
    call = F.struct(
        F.lit(None).cast("string").alias("id"),
        F.lit(None).cast("string").alias("type"),
        F.lit("look").alias("name"),
        F.lit('{"k": 1}').alias("arguments"),
        F.lit(None).cast("struct<name:string,arguments:string>").alias("function"),
    )

    def one(m: Column, i: Column) -> Column:
        called = (m["role"] == "assistant") & (i % 4 == 1)
        answers = (m["role"] == "user") & (i % 4 == 2)
        return msg.message(
            F.when(answers, "tool").otherwise(m["role"]),
            F.when(~called, m["content"]),
            F.when(called, F.array(call)),
        )

    return F.transform(items, one)


@plan(CHATML_SQL)
def chatml_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ChatML prompts and full texts, with tool turns, tools and thinking switched off."""
    rows = irregular_rows(spark, sf_dir).withColumn("items", _recast(F.col("messages")))
    items = F.col("items")
    full = F.concat(items, F.array(msg.message(F.lit("assistant"), F.col("target_text"))))
    plain = rendering.ChatMLTemplate()
    tooled = rendering.ChatMLTemplate(tools=('{"name": "look"}',))
    return rows.select(
        "example_id",
        F.md5(plain.render(items, generation_prompt=True)).alias("prompt"),
        F.md5(plain.render(items, generation_prompt=True, enable_thinking=False)).alias(
            "prompt_without_thinking"
        ),
        F.md5(plain.render(full)).alias("full_text"),
        F.md5(tooled.render(full)).alias("with_tools"),
    )


@plan(
    """SELECT conv_id, turn, md5(CASE WHEN turn % 2 = 0 THEN '<|im_start|>system' || chr(10) || role ||
    '<|im_end|>' || chr(10) ELSE '' END || '<|im_start|>user' || chr(10) || text || '<|im_end|>' ||
  chr(10) || '<|im_start|>assistant' || chr(10) ||
  CASE WHEN turn % 3 = 0 THEN '' ELSE text || '<|im_end|>' END) AS rendered FROM conversations"""
)
def chatml_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single prompts with and without a system text and a response."""
    rendered = rendering.ChatMLTemplate().exchange(
        F.col("text"),
        F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("text")),
        F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise(""),
    )
    return turns(spark, sf_dir).select("conv_id", "turn", F.md5(rendered).alias("rendered"))


@plan(
    CONTEXTS_SQL
    + """ SELECT example_id, CASE
  WHEN NOT list_contains(list_transform(items, lambda m: m.role), 'system')
    THEN md5(array_to_string(list_transform(items, lambda m: m.role || ':' || m.text), chr(10)))
  WHEN items[1].role = 'system' AND items[2].role = 'user' THEN md5(array_to_string(
    list_prepend('user:System: ' || items[1].text || chr(10) || items[2].text,
      list_transform(items[3:], lambda m: m.role || ':' || m.text)), chr(10)))
  END AS rendered
FROM targets WHERE len(items) > 0"""
)
def system_merge_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System text folded into the user turn where the template refuses it."""
    template = rendering.PlainTemplate(rejects_system=True)
    rows = irregular_rows(spark, sf_dir).where(F.size("messages") > 0)
    return rows.select(
        "example_id", F.md5(rendering.render_or_merge(template, F.col("messages"))).alias("rendered")
    )
