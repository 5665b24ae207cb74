"""Dataset formatters: rows of a named dataset to prompt, text or preference rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import messages as msg
from colloquy.functions.rendering import PlainTemplate, merge_refusal, render_or_merge
from colloquy.functions.rewards import THINK_TAGS, Tags, hash_answer

# Language tags, and role names of shared conversations.
LANGUAGE_NAMES = {
    "acm_Arab": "arabic",
    "ita_Latn": "italian",
    "fra_Latn": "french",
    "hun_Latn": "hungarian",
    "deu_Latn": "german",
    "rus_Cyrl": "russian",
    "spa_Latn": "spanish",
    "eng_Latn": "english",
}
LANGUAGE_DEFAULT = "randomly selected"
SHARED_ROLES = {"system": "system", "human": "user", "gpt": "assistant"}
ROLE_DEFAULT = "unknown role"


def lookup(code: Column, table: Mapping[str, str], default: str) -> Column:
    """Look a code up in a fixed table; a literal map beats a join here."""
    entries = F.create_map(*[F.lit(part) for pair in table.items() for part in pair])
    return F.coalesce(F.try_element_at(entries, code), F.lit(default))


def language_name(tag: Column) -> Column:
    return lookup(tag, LANGUAGE_NAMES, LANGUAGE_DEFAULT)


def shared_role(role: Column) -> Column:
    return lookup(role, SHARED_ROLES, ROLE_DEFAULT)


# The instructions and answer sentences in the prompts below are given texts.


def multiple_choice_prompt(question: Column, choice_labels: Column, choice_texts: Column) -> Column:
    n = F.least(F.size(choice_labels), F.size(choice_texts))
    pairs = F.slice(
        F.arrays_zip(choice_labels.alias("label"), choice_texts.alias("text")), F.lit(1), n
    )
    lines = F.transform(pairs, lambda c: F.concat(c["label"], F.lit(". "), c["text"], F.lit("\n")))
    return F.concat(
        F.lit("Question: "),
        question,
        F.lit("\n\nChoices:\n"),
        F.array_join(lines, ""),
        F.lit("\nProvide the correct answer label (A, B, C, or D)."),
    )


def passage_choice_prompt(
    language_tag: Column, passage: Column, question: Column, options: list[Column]
) -> Column:
    parts = [
        F.lit("Your task is to identify the correct answer within the passage. The language is "),
        language_name(language_tag),
        F.lit(". Passage: "),
        passage,
        F.lit("\n\nQuestion: "),
        question,
        F.lit("\n\nChoices:\n"),
    ]
    for number, option in enumerate(options, start=1):
        parts += [F.lit(f"{number}. "), option, F.lit("\n")]
    parts.append(F.lit("\nProvide the correct answer label (1, 2, 3, or 4)."))
    return F.concat(*parts)


def choice_response(answer: Column) -> Column:
    return F.concat(F.lit("The correct answer is "), answer, F.lit("."))


def context_question_prompt(context: Column, question: Column) -> Column:
    return F.concat(
        F.lit(
            "You are given a context and your task is to answer the question asked only by "
            "using the context given.Context:\n "
        ),
        context,
        F.lit("\nQuestion: "),
        question,
    )


def first_answer(answers: Column) -> Column:
    """First listed answer, empty if there is none."""
    return F.coalesce(F.get(answers, F.lit(0)), F.lit(""))


def _say(role: str, content: Column) -> Column:
    return msg.message(F.lit(role), content)


def two_message_text(prompt: Column, response: Column, template=PlainTemplate()) -> Column:
    return template.render(F.array(_say("user", prompt), _say("assistant", response)))


def multiple_choice(df: DataFrame, template=PlainTemplate()) -> DataFrame:
    """``question, choices(label, text), answerKey`` to ``text``."""
    prompt = multiple_choice_prompt(
        F.col("question"), F.col("choices.label"), F.col("choices.text")
    )
    return df.select(
        two_message_text(prompt, choice_response(F.col("answerKey")), template).alias("text")
    )


def passage_choice(df: DataFrame, template=PlainTemplate()) -> DataFrame:
    """``dialect, flores_passage, question, mc_answer1..4, correct_answer_num`` to ``text``."""
    options = [F.col(f"mc_answer{i}") for i in range(1, 5)]
    prompt = passage_choice_prompt(
        F.col("dialect"), F.col("flores_passage"), F.col("question"), options
    )
    answer = choice_response(F.col("correct_answer_num").cast("string"))
    return df.select(two_message_text(prompt, answer, template).alias("text"))


def context_question(df: DataFrame, template=PlainTemplate()) -> DataFrame:
    """``context, question, answers(text)`` to ``text``."""
    prompt = context_question_prompt(F.col("context"), F.col("question"))
    answer = first_answer(F.col("answers.text"))
    return df.select(two_message_text(prompt, answer, template).alias("text"))


def shared_conversation(df: DataFrame, template=PlainTemplate()) -> DataFrame:
    """``conversations(from, value)`` to ``text``, merging system if it is refused."""
    items = F.transform(
        "conversations", lambda t: msg.message(shared_role(t["from"]), t["value"])
    )
    return df.select(render_or_merge(template, items).alias("text"))


def refused_conversations(df: DataFrame, template=PlainTemplate()) -> DataFrame:
    """The rows that ``shared_conversation`` has no text for, with the ``reason``."""
    items = F.transform(
        "conversations", lambda t: msg.message(shared_role(t["from"]), t["value"])
    )
    return df.withColumn("reason", merge_refusal(template, items)).where("reason IS NOT NULL")


def preference_pair(df: DataFrame, template=PlainTemplate()) -> DataFrame:
    """``system, question, chosen, rejected`` to a preference row."""
    items = F.array(_say("system", F.col("system")), _say("user", F.col("question")))
    return df.select(
        render_or_merge(template, items).alias("prompt"), "chosen", "rejected"
    )


def preference_messages(df: DataFrame, template=PlainTemplate()) -> DataFrame:
    """``messages, prompt, chosen, rejected`` message lists to a preference row."""
    asked = F.concat(F.col("messages"), F.array(_say("user", F.col("prompt"))))
    return df.select(
        template.render(asked).alias("prompt"),
        template.render(F.col("chosen")).alias("chosen"),
        template.render(F.col("rejected")).alias("rejected"),
    )


def reward_system_prompt(tags: Tags = THINK_TAGS) -> str:
    return (
        "You are given a problem.\nThink about the problem and provide your working out.\n"
        f"Place it between {tags.reasoning_start} and {tags.reasoning_end}.\n"
        f"Then, provide your solution between {tags.solution_start}{tags.solution_end}"
    )


def reward_prompt(df: DataFrame, system_prompt: str | None = None) -> DataFrame:
    """``question, answer`` to a message-list ``prompt`` and the bare ``answer``."""
    system = reward_system_prompt() if system_prompt is None else system_prompt
    items = F.array(_say("system", F.lit(system)), _say("user", F.col("question")))
    return df.select(items.alias("prompt"), hash_answer(F.col("answer")).alias("answer"))
