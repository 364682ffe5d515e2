"""Prompt templates, payloads and chat text as Columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import cut_before_last, reduce_whitespace

NULL_TARGET = "NULL"
MESSAGES = "messages array<struct<role:string,content:string>>"
PAYLOAD_JSON_SCHEMA = f"{MESSAGES}, target array<string>"

_TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_VARIABLE = re.compile(r"\{\{\s*(.*?)\s*\}\}")
_BRANCH = re.compile(r"(if|elif)\s+(\w+)\s*(==|!=)\s*(['\"])(.*)\4$", re.S)

# Our own wording.
USER_TEMPLATE = """Below is one answer written by a learner in grade {{ grade }}.
{% if trait == 'dev' %}Judge how the ideas are developed.
{% elif trait == 'org' %}Judge how the answer is organised.
{% else %}Judge the answer as a whole.
{% endif %}Task type: {{ mode }}. Allowed scores: {{ min_score }} to {{ max_score }}.

--- answer ---
{{ text }}
--- end ---

Reply with the score only."""

ASSISTANT_TEMPLATE = "{'score':'{{ score }}'}"


def compile_template(
    template: str, columns: list[str], defaults: dict | None = None,
    given: dict[str, Column] | None = None,
) -> Column:
    """Variables and if/elif/else on equality become one Column.

    A given Column wins over a record field, which wins over a default; an unknown or NULL
    variable renders as nothing.
    """
    defaults, given = defaults or {}, given or {}

    def variable(name: str) -> Column:
        if name in given:
            return given[name]
        if name in columns:
            return F.coalesce(F.col(name).cast("string"), F.lit(""))
        return F.lit(str(defaults.get(name, "")))

    tokens = [t for t in _TAG.split(template) if t]

    def block(at: int) -> tuple[Column, int]:
        parts: list[Column] = []
        while at < len(tokens):
            token = tokens[at]
            if token.startswith("{{"):
                parts.append(variable(token[2:-2].strip()))
            elif token.startswith("{%"):
                tag = token[2:-2].strip()
                if not tag.startswith("if "):
                    break
                chosen, at = branches(at)
                parts.append(chosen)
                continue
            else:
                parts.append(F.lit(token))
            at += 1
        return (F.concat(*parts) if parts else F.lit("")), at

    def branches(at: int) -> tuple[Column, int]:
        cases: list[tuple[Column, Column]] = []
        otherwise = F.lit("")
        while True:
            tag = tokens[at][2:-2].strip()
            if tag == "endif":
                break
            if tag == "else":
                otherwise, at = block(at + 1)
                continue
            found = _BRANCH.match(tag)
            if not found:
                raise ValueError(f"unsupported template tag: {tag}")
            same = variable(found[2]) == F.lit(found[5])
            body, at = block(at + 1)
            cases.append((same if found[3] == "==" else ~same, body))
            if at >= len(tokens):
                raise ValueError("template has an if without endif")
        chosen = otherwise
        for condition, body in reversed(cases):
            chosen = F.when(condition, body).otherwise(chosen)
        return chosen, at + 1

    rendered, end = block(0)
    if end != len(tokens):
        raise ValueError(f"unexpected template tag: {tokens[end]}")
    return rendered


def render_prompt(
    template: str, columns: list[str], defaults: dict | None = None,
    given: dict[str, Column] | None = None,
) -> Column:
    """Render, strip, and shorten long whitespace."""
    return reduce_whitespace(compile_template(template, columns, defaults, given))


def infer_target(template: str) -> str | None:
    """Name of the last variable of the assistant template."""
    names = _VARIABLE.findall(template)
    return names[-1] if names else None


def target_value(name: str, columns: list[str]) -> Column:
    if name not in columns:
        return F.lit(NULL_TARGET)
    return F.coalesce(F.col(name).cast("string"), F.lit(NULL_TARGET))


def build_payload(
    columns: list[str],
    user_template: str = USER_TEMPLATE,
    assistant_template: str = ASSISTANT_TEMPLATE,
    defaults: dict | None = None,
) -> Column:
    """User and assistant message plus the target, as one struct."""
    name = infer_target(assistant_template)
    if name is None:
        raise ValueError("the assistant template has no variable to predict")
    value = target_value(name, columns)
    # The target is filled in even when the record lacks it.
    given = {name: value} if name not in columns else {}

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.struct(
        F.array(
            message("user", render_prompt(user_template, columns, defaults, given)),
            message("assistant", render_prompt(assistant_template, columns, defaults, given)),
        ).alias("messages"),
        F.struct(F.lit(name).alias("name"), value.alias("value")).alias("target"),
    )


def payload_json(payload: Column) -> Column:
    """JSON text of a payload; the target becomes a two-element array of strings."""
    target = F.array(payload["target"]["name"], payload["target"]["value"])
    return F.to_json(F.struct(payload["messages"].alias("messages"), target.alias("target")))


def parse_payload(text: Column) -> Column:
    """Back from JSON; NULL for malformed text."""
    return F.from_json(text, PAYLOAD_JSON_SCHEMA)


@dataclass(frozen=True)
class ChatFormat:
    """How one message is written, and what opens an answer."""

    before_role: str = "<|"
    after_role: str = "|>\n"
    after_content: str = "<|end|>\n"
    open_answer: str = "<|assistant|>\n"


def chat_text(
    messages: Column,
    target: Column | None = None,
    style: ChatFormat = ChatFormat(),
    add_generation_prompt: bool = True,
) -> Column:
    """Messages as one text, cut before the last occurrence of the target value.

    The opening of an answer is added only when the last message is the user's.
    """
    lines = F.transform(
        messages,
        lambda m: F.concat(
            F.lit(style.before_role), m["role"], F.lit(style.after_role),
            m["content"], F.lit(style.after_content),
        ),
    )
    text = F.array_join(lines, "")
    if add_generation_prompt:
        asks = F.element_at(messages, -1)["role"] == "user"
        text = F.concat(text, F.when(asks, F.lit(style.open_answer)).otherwise(F.lit("")))
    if target is None:
        return text
    return F.when(target.isNull(), text).otherwise(cut_before_last(text, target))


def fallback_prompt(
    payload_text: Column,
    template: str,
    columns: list[str],
    style: ChatFormat = ChatFormat(),
    tail: str = "{'score':'",
) -> Column:
    """Chat text of a stored payload, or a prompt rendered from the fields if it is unusable."""
    parsed = parse_payload(payload_text)
    stored = chat_text(parsed["messages"], F.element_at(parsed["target"], -1), style)
    prompt = F.array(
        F.struct(F.lit("user").alias("role"), render_prompt(template, columns).alias("content"))
    )
    rendered = F.concat(chat_text(prompt, None, style), F.lit(tail))
    usable = F.size(F.coalesce(parsed["messages"], F.array().cast("array<struct<role:string,content:string>>"))) > 0
    return F.when(usable, stored).otherwise(rendered)
