"""Model and service calls as steps of a flow: requests are Columns, the call itself is a function that is given.

A call function takes a list of request texts and gives as many (answer or None, error or None)
pairs; it runs in tasks, a batch at a time. What it reaches (a service, a stub in tests) is not
this library's matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dagframe.functions import variants

Call = Callable[[list[str]], list[tuple[str | None, str | None]]]


def input_messages(value: Column, system: str | None = None) -> Column:
    """The first turn's messages of an input (VARIANT) as array<struct<role,content>>.

    An array of messages is taken as it is, an object with role and content is one message, all
    else is a user's text: strings as they are, other values as JSON.
    """
    message = lambda m: F.struct(F.coalesce(variants.text_at(m, "role"), F.lit("user")).alias("role"), F.coalesce(variants.text_at(m, "content"), F.to_json(variants.field(m, "content")), F.lit("")).alias("content"))
    text = F.coalesce(variants.as_string(value), F.to_json(value), F.lit("null"))
    turns = (
        F.when(variants.kind(value) == "array", F.transform(variants.as_array(value), message))
        .when(variants.text_at(value, "role").isNotNull(), F.array(message(value)))
        .otherwise(F.array(F.struct(F.lit("user").alias("role"), text.alias("content"))))
    )
    return turns if system is None else F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))), turns)


def request(provider: str, model: str, messages: Column, tools: Column | None = None, **options: float | int) -> Column:
    """A request as JSON text; options such as temperature or max_tokens go in where given."""
    fields = [F.lit(v).alias(k) for k, v in sorted(options.items())] + [messages.alias("messages"), F.lit(model).alias("model"), F.lit(provider).alias("provider")]
    return F.to_json(F.struct(*fields, *([tools.alias("tools")] if tools is not None else [])))


def chosen_tools(tools: DataFrame, names: Sequence[str] | None = None, enabled: bool = True) -> DataFrame:
    """The tool declarations that a call is given: all, those named, or none."""
    if not enabled:
        return tools.where("false")
    return tools if names is None else tools.where(F.col("name").isin(list(names)))


def called(df: DataFrame, call: Call, column: str = "request", batch: int = 64) -> DataFrame:
    """df with answer and error: one call for each row, in batches of so many."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", answer string, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                pairs = call(part[column].tolist())
                yield part.assign(answer=pd.Series([a for a, _ in pairs], part.index, dtype=object), error=pd.Series([e for _, e in pairs], part.index, dtype=object))

    return df.mapInPandas(run, schema)


def outputs(answer: Column) -> Column:
    """A model answer's ports as JSON text: content, tool_calls and finish_reason."""
    v = F.try_parse_json(answer)
    return F.to_json(F.struct(variants.field(v, "content").alias("content"), F.coalesce(variants.text_at(v, "finish_reason"), F.lit("stop")).alias("finish_reason"), F.coalesce(variants.as_array(variants.field(v, "tool_calls")), F.array().cast("array<variant>")).alias("tool_calls")), {"ignoreNullFields": "false"})


def http_outcome(status: Column, body: Column) -> Column:
    """struct(kind, value): ``ok`` with the body as JSON or as a JSON string, ``retryable`` for 5xx or no status, else ``fatal``."""
    text = F.when(F.try_parse_json(body).isNotNull(), body).otherwise(F.to_json(F.array(body)).substr(F.lit(2), F.length(F.to_json(F.array(body))) - 2))
    kind = F.when(status.isNull() | (status >= 500), "retryable").when((status >= 200) & (status < 300), "ok").otherwise("fatal")
    return F.struct(kind.alias("kind"), F.when(kind == "ok", text).alias("value"))
