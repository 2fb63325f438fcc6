"""Callbacks of agent frameworks as events of one form.

raw is a VARIANT column; each function gives struct(type, node_id, name, from_node, to_node,
payload, duration_ms), or null for what is no known callback. Payloads are JSON texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dagframe.functions import variants
from dagframe.functions.scalars import model_from_repr, strip_provider
from dagframe.functions.variants import json_at, text_at


def _event(kind: str, node: Column | None = None, name: Column | None = None, payload: Column | None = None, duration: Column | None = None, source: Column | None = None, target: Column | None = None) -> Column:
    text = F.lit(None).cast("string")
    pick = lambda c: text if c is None else c.cast("string")
    return F.struct(F.lit(kind).alias("type"), pick(node).alias("node_id"), pick(name).alias("name"), pick(source).alias("from_node"), pick(target).alias("to_node"), pick(payload).alias("payload"), (F.lit(None).cast("long") if duration is None else duration).alias("duration_ms"))


def _or(c: Column, default: str) -> Column:
    return F.coalesce(c, F.lit(default))


def _took(raw: Column) -> Column:
    return F.coalesce(variants.as_count(variants.field(raw, "duration_ms")), F.lit(0).cast("long"))


def _ids(raw: Column) -> Column:
    return variants.as_array(variants.field(raw, "serialized.id"))


def _first_generation(raw: Column) -> Column:
    outer = variants.as_array(variants.field(raw, "response.generations"))
    return F.try_element_at(variants.as_array(F.try_element_at(outer, F.lit(1))), F.lit(1))


def _chosen(*fields: Column) -> Column:
    """The first that is there at all, if it is a string."""
    return variants.as_string(F.coalesce(*fields))


def langchain(raw: Column) -> Column:
    node = _or(text_at(raw, "run_id"), "unknown")
    at = lambda p: variants.field(raw, p)
    model = F.coalesce(
        text_at(raw, "model"),
        _chosen(at("serialized.kwargs.model_name"), at("serialized.kwargs.model"), at("serialized.kwargs.kwargs.model_name"), at("serialized.kwargs.kwargs.model")),
        model_from_repr(text_at(raw, "serialized.repr")),
        variants.as_string(F.try_element_at(_ids(raw), F.lit(-1))),
        F.lit("unknown"),
    )
    provider = F.coalesce(text_at(raw, "provider"), strip_provider(variants.as_string(F.try_element_at(_ids(raw), F.lit(1)))), F.lit("langchain"))
    request = F.to_json(F.struct(variants.field(raw, "prompts").alias("messages"), model.alias("model"), provider.alias("provider")), {"ignoreNullFields": "false"})
    one = _first_generation(raw)
    content = F.coalesce(variants.field(one, "text"), F.parse_json(F.lit('""')))
    used = _or(_chosen(at("response.llm_output.model_name"), at("response.llm_output.model"), variants.field(one, "generation_info.model")), "unknown")
    usage = F.struct(*[at(f"response.llm_output.token_usage.{n}").alias(n) for n in ("completion_tokens", "prompt_tokens", "total_tokens")])
    response = F.to_json(F.struct(content.alias("content"), used.alias("model"), usage.alias("usage")), {"ignoreNullFields": "false"})
    chain = _or(variants.as_string(F.try_element_at(_ids(raw), F.lit(-1))), "chain")
    cb = text_at(raw, "callback")
    return (
        F.when(cb == "on_llm_start", _event("llm_start", node, payload=request))
        .when(cb == "on_llm_end", _event("llm_end", node, payload=response, duration=_took(raw)))
        .when(cb == "on_tool_start", _event("tool_start", node, _or(text_at(raw, "serialized.name"), "unknown"), json_at(raw, "input_str", '""')))
        .when(cb == "on_tool_end", _event("tool_end", node, _or(text_at(raw, "tool_name"), "unknown"), json_at(raw, "output"), _took(raw)))
        .when(cb == "on_chain_start", _event("step_start", name=chain, payload=json_at(raw, "inputs")))
        .when(cb == "on_chain_end", _event("step_end", name=chain, payload=json_at(raw, "outputs")))
    )


def langgraph(raw: Column) -> Column:
    node = _or(text_at(raw, "node"), "unknown")
    cb = text_at(raw, "callback")
    return (
        F.when(cb == "node_start", _event("step_start", name=node, payload=json_at(raw, "state")))
        .when(cb == "node_end", _event("step_end", name=node, payload=json_at(raw, "state")))
        .when(cb == "edge", _event("node_transition", source=_or(text_at(raw, "from"), "unknown"), target=_or(text_at(raw, "to"), "unknown")))
        .when(cb == "on_llm_start", _event("llm_start", node, payload=json_at(raw, "request")))
        .when(cb == "on_llm_end", _event("llm_end", node, payload=json_at(raw, "response"), duration=_took(raw)))
        .when(cb == "state_update", _event("step_start", name=F.concat(_or(text_at(raw, "node"), "state"), F.lit("_state_update")), payload=json_at(raw, "updates")))
    )


def semantic_kernel(raw: Column) -> Column:
    function = _or(text_at(raw, "function_name"), "unknown")
    node = F.concat(_or(text_at(raw, "plugin_name"), "unknown"), F.lit("."), function)
    service = _or(text_at(raw, "service_id"), "llm")
    rendering = F.lit("prompt_rendering")
    cb = text_at(raw, "callback")
    return (
        F.when(cb == "function_invoking", _event("tool_start", node, function, json_at(raw, "arguments")))
        .when(cb == "function_invoked", _event("tool_end", node, function, json_at(raw, "result"), _took(raw)))
        .when(cb == "prompt_rendering", _event("step_start", name=rendering, payload=json_at(raw, "template")))
        .when(cb == "prompt_rendered", _event("step_end", name=rendering, payload=json_at(raw, "rendered_prompt")))
        .when(cb == "on_llm_start", _event("llm_start", service, payload=json_at(raw, "request")))
        .when(cb == "on_llm_end", _event("llm_end", service, payload=json_at(raw, "response"), duration=_took(raw)))
    )


FRAMEWORKS = {"langchain": langchain, "langgraph": langgraph, "semantic_kernel": semantic_kernel}


def translated(raw: DataFrame, framework: str, column: str = "raw") -> DataFrame:
    """The other columns of raw with the event's; rows without an event go. column is a JSON text."""
    # exploded, so that the event is made once and not again for each of its fields
    event = F.filter(F.array(FRAMEWORKS[framework](F.col("_v"))), lambda e: e.isNotNull())
    return raw.withColumn("_v", F.try_parse_json(column)).select(*[c for c in raw.columns if c != column], F.inline(event))


def recorded(events: DataFrame, order: str = "ord") -> DataFrame:
    """Log records (run_id, ord, event_type, node_id, name, inputs, outputs, duration_ms) of translated events of runs.

    Model and tool ends stand with the start right before them (tools take its name); an ended
    step is ``name_end``.
    """
    family = F.regexp_replace("type", "_(start|end)$", "")
    w = Window.partitionBy("run_id", "node_id", "_family").orderBy(order)
    marked = events.withColumn("_family", family).withColumn("_before", F.lag(F.struct("type", "name", "payload")).over(w))
    fits = F.col("_before.type").endswith("_start")
    start, own = F.when(fits, F.col("_before.payload")).otherwise("{}"), F.col("payload")
    ends = marked.where(F.col("type").isin("llm_end", "tool_end")).select("run_id", order, F.when(F.col("type") == "llm_end", "llm_invocation").otherwise("tool_invocation").alias("event_type"), "node_id", F.when(F.col("type") == "tool_end", F.when(fits, F.col("_before.name")).otherwise(F.col("name"))).alias("name"), start.alias("inputs"), own.alias("outputs"), "duration_ms")
    steps = events.where(F.col("type").isin("step_start", "step_end")).select("run_id", order, F.lit("step_recorded").alias("event_type"), "node_id", F.when(F.col("type") == "step_end", F.concat("name", F.lit("_end"))).otherwise(F.col("name")).alias("name"), F.lit(None).cast("string").alias("inputs"), own.alias("outputs"), "duration_ms")
    return ends.unionByName(steps)


def node_changes(visits: DataFrame, order: str = "ord", node: str = "node") -> DataFrame:
    """(run_id, ord, from_node, to_node) where a run goes on to another node."""
    before = F.lag(node).over(Window.partitionBy("run_id").orderBy(order))
    return visits.withColumn("_before", before).where(F.col("_before") != F.col(node)).select("run_id", order, F.col("_before").alias("from_node"), F.col(node).alias("to_node"))
