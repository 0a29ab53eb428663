"""Prompts from layers of templates, and conversations of threads."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_ANSWER = "I could not generate a response."
_VARIABLE = re.compile(r"\$(?:(\w+)|\{(\w+)\})")
# How roles of stored messages are named to a model.
ROLES = {"human": "user", "ai": "assistant", "tool": "tool"}


def _rendered(template: str, values: dict[str, Column]) -> Column:
    """A template with its variables replaced. It is taken apart here, so that inserted text is never looked at again."""
    parts, at = [], 0
    for m in _VARIABLE.finditer(template):
        name = m[1] or m[2]
        if name in values:
            parts += [F.lit(template[at : m.start()]), F.coalesce(values[name].cast("string"), F.lit(""))]
            at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def render_prompts(queries: DataFrame, contexts: DataFrame, layers: list[str], pipeline_id: str = "default", version: str = "1") -> DataFrame:
    """(query_id, prompt, prompt_hash, pipeline_id, pipeline_version) for queries(query_id, query, verbosity,
    question_type) and contexts(query_id, context). Unknown variables stay; empty layers are left out."""
    joined = queries.join(contexts.select("query_id", "context"), "query_id", "left")
    values = {"context": F.col("context"), "question": F.col("query"), "verbosity": F.col("verbosity"), "question_type": F.col("question_type")}
    trimmed = F.array(*[F.regexp_replace(_rendered(layer, values), r"^\s+|\s+$", "") for layer in layers])
    prompt = F.array_join(F.filter(trimmed, lambda t: t != ""), "\n\n")
    out = joined.select("query_id", prompt.alias("prompt"))
    return out.withColumns({"prompt_hash": F.substring(F.sha2("prompt", 256), 1, 12), "pipeline_id": F.lit(pipeline_id), "pipeline_version": F.lit(version)})


def map_role(role: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, role), role)


def assemble_threads(conversations: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(conv_id, messages): ordered (role, text) of each thread; its query is appended as a user turn unless the
    last turn is a user's."""
    own = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", map_role(F.col("role")).alias("role"), "text"))).alias("m"))
    own = own.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("messages"))
    if queries is None:
        return own
    joined = own.join(queries.select("conv_id", "query"), "conv_id", "full")
    messages = F.coalesce("messages", F.array().cast(own.schema["messages"].dataType))
    asked = F.struct(F.lit("user").alias("role"), F.col("query").alias("text"))
    last = F.try_element_at(messages, F.lit(-1))["role"]
    return joined.select("conv_id", F.when(F.col("query").isNull() | (F.coalesce(last, F.lit("")) == "user"), messages).otherwise(F.array_append(messages, asked)).alias("messages"))


def last_assistant(conversations: DataFrame) -> DataFrame:
    """(conv_id, text): the latest assistant message of each thread that is not empty, else a fixed text."""
    said = (map_role(F.col("role")) == "assistant") & (F.coalesce("text", F.lit("")) != "")
    last = F.max_by("text", F.when(said, F.col("turn"))).alias("text")
    return conversations.groupBy("conv_id").agg(last, F.bool_or(said).alias("_any")).select("conv_id", F.when(F.col("_any"), F.col("text")).otherwise(NO_ANSWER).alias("text"))
