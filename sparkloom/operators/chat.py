"""Chat templates: named ones as native expressions, and models' own by ``template``."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.template import Template


def conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, messages): one row a conversation, its messages in turn order.

    A conversation is one prompt, so its messages belong in one row.
    """
    message = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    return df.groupBy(conv).agg(F.array_sort(F.collect_list(message)).alias("messages"))


def _chatml(m: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), m.role, F.lit("\n"), F.coalesce(m.text, F.lit("")), F.lit("<|im_end|>\n"))


def _header(m: Column) -> Column:
    return F.concat(F.lit("<|start_header_id|>"), m.role, F.lit("<|end_header_id|>\n\n"), F.trim(F.coalesce(m.text, F.lit(""))), F.lit("<|eot_id|>"))


def _inst(m: Column) -> Column:
    text = F.trim(F.coalesce(m.text, F.lit("")))
    return (
        F.when(m.role == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]")))
        .when(m.role == "assistant", F.concat(F.lit(" "), text, F.lit("</s>")))
        .when(m.role == "system", F.concat(F.lit("<<SYS>>\n"), text, F.lit("\n<</SYS>>\n\n")))
        .otherwise(F.raise_error(F.concat(F.lit("unknown role: "), F.coalesce(m.role, F.lit("null")))))
    )


#: name: (message, in front of all, what asks for an answer)
TEMPLATES: dict[str, tuple[Callable[[Column], Column], str, str]] = {
    "chatml": (_chatml, "", "<|im_start|>assistant\n"),
    "header": (_header, "<|begin_of_text|>", "<|start_header_id|>assistant<|end_header_id|>\n\n"),
    "inst": (_inst, "<s>", ""),
}


def render(messages: Column, name: str = "chatml", add_generation_prompt: bool = False) -> Column:
    """The prompt of an array of (turn, role, text) messages."""
    if name not in TEMPLATES:
        raise ValueError(f"unknown chat template: {name!r}; there are {sorted(TEMPLATES)}")
    one, lead, ask = TEMPLATES[name]
    body = F.array_join(F.transform(messages, one), "")
    return F.concat(F.lit(lead), body, F.lit(ask if add_generation_prompt else ""))


def choose(template: str | list[dict] | None, tools: bool = False) -> str:
    """A model's template: of several, tool_use with tools, else default, else the first."""
    if isinstance(template, list):
        by = {t.get("name"): t.get("template") for t in template}
        wanted = ["tool_use"] * bool(tools) + ["default", *by]
        template = next((by[name] for name in wanted if by.get(name)), None)
    if not template:
        raise ValueError("this tokenizer has no chat template")
    return template


def render_own(messages: Column | str, template: str, values: dict, add_generation_prompt: bool = False, tools: Column | None = None) -> Column:
    """The prompt by a model's own template, for an array of (turn, role, text) messages or their JSON.

    ``values`` are further names that the template sees; ``tools`` is a column of JSON.  Null for null.
    The template is compiled on the driver first, so a faulty one raises here.
    """
    Template(template)
    messages = F.col(messages) if isinstance(messages, str) else messages
    tools = F.lit(None).cast("string") if tools is None else tools
    known = values | {"add_generation_prompt": add_generation_prompt}

    @F.arrow_udf("string")
    def run(rows: pa.Array, tool_rows: pa.Array) -> pa.Array:
        made, out = compiled(template), []
        for row, tool in zip(rows.to_pylist(), tool_rows.to_pylist()):
            if row is None:
                out.append(None)
                continue
            talk = [{**m, "content": m.get("content", m.get("text"))} for m in (json.loads(row) if isinstance(row, str) else row)]
            out.append(made.render(**known | {"messages": talk, "tools": json.loads(tool) if tool else None}))
        return pa.array(out, pa.string())

    return run(messages, tools)


_cache: dict[str, Template] = {}


def compiled(template: str) -> Template:
    """The compiled template, kept by its source."""
    if template not in _cache:
        _cache[template] = Template(template)
    return _cache[template]
