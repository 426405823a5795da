"""Text rendering of records, chat templates, and nested names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Message and prompt formats.
DEFAULT_TEMPLATE = "<|{role}|>\n{text}\n"
CONTEXT_PROMPT = "Based on the following context, answer the question.\n\nContext:\n{context}\n\nQuestion: {question}\n\nAnswer:"
INSTRUCTION_HEAD = "### Instruction:\n"
RESPONSE_HEAD = "\n\n### Response:\n"


def _instruction(instruction: Column, answer: Column) -> Column:
    return F.concat(F.lit(INSTRUCTION_HEAD), instruction, F.lit(RESPONSE_HEAD), answer)


def render_training_text(df: DataFrame, null_text: str = "None") -> Column:
    """Text of a uniform table's rows.  Which form applies depends on the columns
    that exist (not on nulls), so it is chosen once, at plan time.  ``text`` is taken as it
    is, null included; joined fields print a null as ``null_text``.  Nested and boolean
    values print as Spark casts them."""
    def s(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(null_text))

    names = df.columns
    if "text" in names:
        return F.col("text").cast("string")
    if "input" in names and "output" in names:
        return F.concat(s("input"), F.lit("\n"), s("output"))
    if "instruction" in names:
        answer = s("output") if "output" in names else s("response") if "response" in names else F.lit("")
        return _instruction(s("instruction"), answer)
    return F.concat_ws(" ", *[s(n) for n in names])


def render_map_text(m: Column, raw: Column, null_text: str = "None") -> Column:
    """The same for ragged rows held as ``map<string,string>``; ``raw`` is used
    where the row is no object (null map)."""
    def has(k: str) -> Column:
        return F.map_contains_key(m, F.lit(k))

    def s(k: str) -> Column:
        return F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(null_text))

    answer = F.when(has("output"), s("output")).when(has("response"), s("response")).otherwise("")
    rest = F.array_join(F.transform(F.map_values(m), lambda v: F.coalesce(v, F.lit(null_text))), " ")
    return F.when(m.isNull(), raw).when(has("text"), F.try_element_at(m, F.lit("text"))) \
        .when(has("input") & has("output"), F.concat(s("input"), F.lit("\n"), s("output"))) \
        .when(has("instruction"), _instruction(s("instruction"), answer)).otherwise(rest)


def json_map(value: Column) -> Column:
    """A JSON object as ``map<string,string>``; null for anything else."""
    return F.when(F.ltrim(value).startswith("{"), F.from_json(value, T.MapType(T.StringType(), T.StringType())))


def extract_document_text(m: Column, raw: Column) -> Column:
    """``text``, else ``content`` (by key presence), else the record as JSON."""
    return F.when(F.map_contains_key(m, F.lit("text")), F.try_element_at(m, F.lit("text"))) \
        .when(F.map_contains_key(m, F.lit("content")), F.try_element_at(m, F.lit("content"))).otherwise(raw)


def nested_names(value: Column) -> Column:
    """``config_name``, else ``name``, else an empty string of each object in a
    JSON array; an empty list when there is none."""
    items = F.from_json(value, T.ArrayType(T.StringType()))
    objects = F.filter(items, lambda x: x.startswith("{"))
    named = F.transform(objects, lambda x: F.coalesce(
        F.get_json_object(x, "$.config_name"), F.get_json_object(x, "$.name"), F.lit("")))
    return F.coalesce(named, F.array().cast("array<string>"))


def apply_template(messages: Column, template: str = DEFAULT_TEMPLATE) -> Column:
    """Messages (array of role, text) to one string by a per-message template."""
    return F.array_join(F.transform(messages, lambda m: fill(template, {"role": m["role"], "text": m["text"]})), "")


def chat_turns(turns: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """The rendered turns as rows (conv_id, turn, text), for conversations too long for one value."""
    return turns.select("conv_id", "turn", fill(template, {"role": F.col("role"), "text": F.col("text")}).alias("text"))


def apply_chat_template(turns: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """One text per conversation.  A text is one value, so each conversation must fit a task; ``chat_turns`` has no such
    bound."""
    msg = F.struct("turn", "role", "text")
    return turns.groupBy("conv_id").agg(
        apply_template(F.sort_array(F.collect_list(msg)), template).alias("text"),
        F.count(F.lit(1)).alias("turns"))


def fill(template: str, values: Mapping[str, Column]) -> Column:
    """A template with ``{name}`` slots as one concatenation (values are not rescanned)."""
    parts: list[Column] = []
    rest = template
    while rest:
        cuts = [(rest.find("{" + k + "}"), k) for k in values if "{" + k + "}" in rest]
        if not cuts:
            parts.append(F.lit(rest))
            break
        at, k = min(cuts)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(values[k])
        rest = rest[at + len(k) + 2:]
    return F.concat(*parts)
