"""Scalar functions of flows, logs and model calls."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from dagframe.functions import variants

#: What stands for a value of each sensitivity.
SECRET, MASKED, PII, CUSTOM = "[REDACTED]", "[MASKED]", "[PII_REDACTED]", "[CUSTOM_REDACTED]"


def redact(value: Column, sensitivity: Column | str, is_string: Column | None = None) -> Column:
    """A text by sensitivity; masked strings of four bytes or more keep their last four characters."""
    s = F.lit(sensitivity) if isinstance(sensitivity, str) else sensitivity
    long_enough = (F.octet_length(value) >= 4) & (F.lit(True) if is_string is None else is_string)
    return (
        F.when(s == "none", value)
        .when(s == "secret", SECRET)
        .when(s == "masked", F.when(long_enough, F.concat(F.lit("****"), F.right(value, F.lit(4)))).otherwise(MASKED))
        .when(s == "pii", PII)
        .otherwise(CUSTOM)
    )


def redact_messages(messages: Column, sensitivity: str) -> Column:
    """array<struct<..., content, ...>> with the contents redacted and all else kept."""
    return messages if sensitivity == "none" else F.transform(messages, lambda m: m.withField("content", redact(m["content"], sensitivity)))


def redact_ports(ports: Column, policy: Mapping[str, str]) -> Column:
    """map<string,string> whose values are redacted by port name; ports without a policy stay."""
    if not policy:
        return ports
    known = F.create_map(*[F.lit(x) for kv in policy.items() for x in kv])
    return F.transform_values(ports, lambda k, v: redact(v, F.coalesce(F.try_element_at(known, k), F.lit("none"))))


def redact_custom(data: Column, policy: Mapping[str, str]) -> Column:
    """A custom event's data, wholly PII if any output port is sensitive."""
    return F.lit(PII) if any(s != "none" for s in policy.values()) else data


def deterministic_id(*parts: Column, digits: int) -> Column:
    """First hex digits of the SHA-256 of the parts, each followed by a colon."""
    return F.left(F.sha2(F.concat(*[x for p in parts for x in (p.cast("string"), F.lit(":"))]).cast("binary"), 256), F.lit(digits))


def trace_id(run: Column) -> Column:
    return deterministic_id(run, digits=32)


def span_id(run: Column, node: Column, attempt: Column) -> Column:
    return deterministic_id(run, node, attempt, digits=16)


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def token_estimate(text: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def mock_prompt_tokens(text: Column) -> Column:
    return F.greatest(F.floor(F.octet_length(text) / 4), F.lit(1)).cast("long")


def mock_completion_tokens(most: Column) -> Column:
    """Midpoint of half the limit and the limit, or 30 without one."""
    half = F.floor(most / 2)
    return F.coalesce(half + F.floor((most - half) / 2), F.lit(30)).cast("long")


def model_from_repr(text: Column) -> Column:
    """The quoted name behind the first ``model=``, or null."""
    behind = F.try_element_at(F.split(text, "model="), F.lit(2))
    quote = F.left(behind, F.lit(1))
    name = F.when(quote.isin("'", '"'), F.when(quote == "'", F.substring_index(F.substr(behind, F.lit(2)), "'", 1)).otherwise(F.substring_index(F.substr(behind, F.lit(2)), '"', 1)))
    return F.when(name != "", name)


def strip_provider(text: Column) -> Column:
    return F.regexp_replace(text, "^langchain[_-]", "")


#: Model families that take their limit under the newer name.
NEWER_STARTS = ("o1", "o3")
NEWER_PARTS = ("gpt-4-turbo", "gpt-4o", "gpt-4.5", "gpt-5")


def limit_parameter(model: Column) -> Column:
    name = F.lower(model)
    newer = F.lit(False)
    for start in NEWER_STARTS:
        newer = newer | name.startswith(start)
    for part in NEWER_PARTS:
        newer = newer | name.contains(part)
    return F.when(newer, "max_completion_tokens").otherwise("max_tokens")


def chat_url(base: Column) -> Column:
    """The chat address of a base address that may already hold a part of it."""
    return F.when(base.contains("/v1/chat/completions"), base).when(base.endswith("/v1"), F.concat(base, F.lit("/chat/completions"))).otherwise(F.concat(base, F.lit("/v1/chat/completions")))


def fill_key(template: Column, key: Column) -> Column:
    return F.replace(template, F.lit("{key}"), key)


#: Message types of frameworks and the roles they stand for.
ROLES = {
    "human": "user",
    "HumanMessage": "user",
    "HumanMessageChunk": "user",
    "ai": "assistant",
    "AIMessage": "assistant",
    "AIMessageChunk": "assistant",
    "system": "system",
    "SystemMessage": "system",
    "SystemMessageChunk": "system",
    "tool": "tool",
    "ToolMessage": "tool",
    "ToolMessageChunk": "tool",
    "function": "function",
    "chat": "assistant",
}


def map_role(role: Column) -> Column:
    """Known roles by the table, others as they are."""
    known = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, role), role)


def fold_system_turns(messages: Column) -> Column:
    """array<struct<role,content>> without system turns: their texts, joined by line ends, stand before the next user turn.

    Assistants become models and unknown roles users; system texts behind the last user turn are lost.
    """
    none = F.lit(None).cast("string")
    start = F.struct(none.alias("held"), F.array().cast("array<struct<role:string,content:string>>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        turn = lambda role, text: F.array_append(acc["out"], F.struct(F.lit(role).alias("role"), text.alias("content")))
        return (
            F.when(m["role"] == "system", F.struct(F.concat_ws("\n", acc["held"], m["content"]).alias("held"), acc["out"].alias("out")))
            .when(m["role"] == "user", F.struct(none.alias("held"), turn("user", F.concat_ws("\n\n", acc["held"], m["content"])).alias("out")))
            .when(m["role"] == "assistant", F.struct(acc["held"].alias("held"), turn("model", m["content"]).alias("out")))
            .otherwise(F.struct(acc["held"].alias("held"), turn("user", m["content"]).alias("out")))
        )

    return F.aggregate(messages, start, step, lambda acc: acc["out"])


def arguments_object(text: Column) -> Column:
    """VARIANT of tool-call arguments given as text; what is no JSON becomes an empty object."""
    return F.coalesce(F.try_parse_json(text), F.parse_json(F.lit("{}")))


def arguments_text(v: Column) -> Column:
    return F.to_json(v)


def cron_key(flow: Column, at: Column) -> Column:
    """Idempotency key of a timed trigger."""
    return F.concat_ws(":", F.lit("cron"), flow, F.unix_timestamp(at).cast("string"))


def cron_fields(expression: str) -> str:
    """A cron line of five fields with seconds before and any year behind, one of six with seconds before."""
    parts = expression.split()
    return " ".join(["0", *parts, "*"] if len(parts) == 5 else ["0", *parts] if len(parts) == 6 else parts)


def error_text(kind: Column, message: Column, elapsed_ms: Column) -> Column:
    return (
        F.when(kind == "retryable", F.concat(F.lit("retryable: "), message))
        .when(kind == "fatal", F.concat(F.lit("fatal: "), message))
        .when(kind == "timeout", F.concat(F.lit("timeout after "), elapsed_ms.cast("string"), F.lit("ms")))
        .otherwise(F.concat(F.lit("validation: "), message))
    )


def tool_message(call_id: Column, name: Column, content: Column) -> Column:
    """A tool's answer as JSON text; content is a JSON text and goes in as a string."""
    return F.to_json(F.struct(content.alias("content"), name.alias("name"), F.lit("tool").alias("role"), call_id.alias("tool_call_id")))


def tool_spec(name: Column, description: Column, parameters: Column) -> Column:
    """A tool's declaration as JSON text; parameters is VARIANT."""
    return F.to_json(F.struct(F.lit("function").alias("type"), F.struct(name.alias("name"), description.alias("description"), parameters.alias("parameters")).alias("function")))


def token_usage(v: Column) -> Column:
    """struct(input, output, total) from either naming of a usage object."""
    first = lambda *names: F.coalesce(*[variants.as_count(variants.field(v, n)) for n in names])
    return F.struct(first("prompt_tokens", "input_tokens").alias("input"), first("completion_tokens", "output_tokens").alias("output"), first("total_tokens").alias("total"))


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two timestamps, 0 at least."""
    return F.greatest(F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp")), F.lit(0).cast("long"))


def backoff_ms(first: Column, factor: Column, attempt: Column) -> Column:
    return first * F.pow(factor, attempt - 1)
