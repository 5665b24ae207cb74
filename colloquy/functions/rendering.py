"""Chat templates: message list in, text out, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions import messages as msg
from colloquy.functions import toolcalls


@dataclass(frozen=True)
class PlainTemplate:
    """``role:content`` lines; ``assistant:`` is the generation prompt.

    With ``rejects_system`` the template refuses lists that hold a system message,
    as some model families do.
    """

    rejects_system: bool = False
    name: str = "plain"
    renders_tails = True  # the text of the last messages is the end of the whole text
    opening = "assistant:"  # the generation prompt

    @staticmethod
    def line(role: Column, content: Column) -> Column:
        return F.concat(role, F.lit(":"), F.coalesce(content, F.lit("None")))

    def error(self, items: Column, omitted_system: Column | None = None) -> Column:
        """Why the list is refused, if it is; ``omitted_system``: a left-out message is the system's."""
        if not self.rejects_system:
            return F.lit(None).cast("string")
        held = F.exists(items, lambda m: m["role"] == "system")
        if omitted_system is not None:
            held = held | omitted_system
        return F.when(held, F.lit("System role not supported"))

    def render(
        self, items: Column, *, generation_prompt: bool = False, enable_thinking: bool = True
    ) -> Column:
        lines = F.transform(items, lambda m: self.line(m["role"], m["content"]))
        if generation_prompt:
            lines = F.concat(lines, F.array(F.lit(self.opening)))
        return F.array_join(lines, "\n")


# The markers and the tool preamble of the ChatML template.
IM_START = "<|im_start|>"
IM_END = "<|im_end|>"
TOOLS_OPEN = (
    "\n\n# Tools\n\nYou are provided with function signatures within <tools></tools> XML tags:"
    "\n<tools>"
)
TOOLS_CLOSE = (
    "\n</tools>\n\nFor each function call, return a json object with function name and arguments "
    "within <tool_call></tool_call> XML tags:\n<tool_call>\n"
    '{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>'
)
EMPTY_THINKING = "<think>\n\n</think>\n\n"


@dataclass(frozen=True)
class ChatMLTemplate:
    """Turns between start and end markers, with tool calls and tool responses.

    A final assistant turn has no end marker; any other final turn is followed by a
    generation prompt. System messages form the head of the text. ``tools`` are
    function signatures as JSON text.
    """

    system: str | None = None
    tools: tuple[str, ...] = ()
    name: str = "chatml"
    renders_tails = False  # system messages move to the head

    def error(self, items: Column, omitted_system: Column | None = None) -> Column:
        return F.lit(None).cast("string")

    def _head(self, items: Column) -> Column:
        turns = F.filter(items, lambda m: (m["role"] == "system") & (m["content"] != ""))
        system = F.array_join(F.transform(turns, lambda m: m["content"]), "\n\n")
        if self.system:
            system = F.when(system != "", system).otherwise(F.lit(self.system))
        tools = ""
        if self.tools:
            signatures = "".join(
                '\n{"type": "function", "function": ' + tool + "}" for tool in self.tools
            )
            tools = TOOLS_OPEN + signatures + TOOLS_CLOSE
        block = F.concat(
            F.lit(f"{IM_START}system\n"), system, F.lit(tools), F.lit(f"{IM_END}\n")
        )
        if tools:
            return block
        return F.when(system != "", block).otherwise(F.lit(""))

    @staticmethod
    def _call_block(calls: Column) -> Column:
        rendered = F.transform(
            calls,
            lambda call: F.concat(
                F.lit('{"name": "'),
                F.coalesce(toolcalls.call_name(call), F.lit("")),
                F.lit('", "arguments": '),
                F.coalesce(toolcalls.call_arguments(call), F.lit("{}")),
                F.lit("}\n"),
            ),
        )
        return F.concat(F.lit("<tool_call>\n"), F.array_join(rendered, ""), F.lit("</tool_call>"))

    def _turn(self, m: Column, is_final: Column) -> Column:
        content = F.coalesce(m["content"], F.lit(""))
        said = (
            F.when(content != "", content)
            .when(F.size(m["tool_calls"]) > 0, self._call_block(m["tool_calls"]))
            .otherwise(F.lit(""))
        )
        end = F.lit(f"{IM_END}\n")
        assistant = F.concat(
            F.lit(f"{IM_START}assistant\n"), said, F.when(is_final, F.lit("")).otherwise(end)
        )
        tool = F.concat(
            F.lit(f"{IM_START}user\n<tool_response>\n"),
            content,
            F.lit(f"\n</tool_response>{IM_END}\n"),
        )
        return (
            F.when(m["role"] == "user", F.concat(F.lit(f"{IM_START}user\n"), content, end))
            .when(m["role"] == "assistant", assistant)
            .when(m["role"] == "tool", tool)
            .otherwise(F.lit(""))
        )

    def render(
        self, items: Column, *, generation_prompt: bool = False, enable_thinking: bool = True
    ) -> Column:
        last = F.size(items) - 1

        def turn(m: Column, index: Column) -> Column:
            return self._turn(m, F.lit(False) if generation_prompt else index == last)

        turns = F.array_join(F.transform(items, turn), "")
        opening = f"{IM_START}assistant\n" + ("" if enable_thinking else EMPTY_THINKING)
        if generation_prompt:
            tail = F.lit(opening)
        else:
            ends_open = F.coalesce(F.try_element_at(items, F.lit(-1))["role"], F.lit(""))
            tail = F.when(ends_open == "assistant", F.lit("")).otherwise(F.lit(opening))
        return F.concat(self._head(items), turns, tail)


    def exchange(
        self, prompt: Column, response: Column | None = None, system: Column | None = None
    ) -> Column:
        """One prompt and its response, if any; blank parts are left out."""

        def part(opening: str, value: Column | None, closing: str) -> Column:
            if value is None:
                return F.lit("")
            text = F.concat(F.lit(opening), value, F.lit(closing))
            return F.when(value != "", text).otherwise(F.lit(""))

        return F.concat(
            part(f"{IM_START}system\n", system, f"{IM_END}\n"),
            part(f"{IM_START}user\n", prompt, f"{IM_END}\n"),
            F.lit(f"{IM_START}assistant\n"),
            part("", response, IM_END),
        )


NO_LIST = "no messages"
NO_PLACE_TO_MERGE = "no user message follows a leading system message"


def render_or_merge(template, items: Column) -> Column:
    """Render; if the template refuses the system message, merge it and render that.

    Null where that is refused too; ``merge_refusal`` tells why.
    """
    merged = msg.merge_system_into_user(items)
    return F.when(template.error(items).isNull(), template.render(items)).when(
        template.error(merged).isNull(), template.render(merged)
    )


def merge_refusal(template, items: Column) -> Column:
    """Why a list has no text even with its system message merged; null where it has one."""
    merged = msg.merge_system_into_user(items)
    reason = F.when(merged.isNull(), F.lit(NO_PLACE_TO_MERGE)).otherwise(template.error(merged))
    return F.when(items.isNull(), F.lit(NO_LIST)).when(template.error(items).isNotNull(), reason)
