"""Answers of model services that come in pieces, as chunk rows.

lines (call_id, ord, line) are the lines of a response; each parser gives rows of CHUNK, which
``stream_chunks_folded`` puts together. A line that is not JSON where JSON is due fails the query;
what comes after the end mark is left out. Token counts go with the chunk that ends the answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dagframe.functions import variants
from dagframe.functions.variants import text_at

CHUNK = ("call_id", "ord", "kind", "text", "tool_index", "tool_id", "tool_name", "input_tokens", "output_tokens", "finish_reason")


def response_lines(spark: SparkSession, path: str) -> DataFrame:
    """Files of responses, one a call: (call_id, ord, line); an unterminated last line is dropped."""
    whole = spark.read.text(path, wholetext=True).withColumn("call_id", F.input_file_name())
    parts = F.split("value", "\n")
    return whole.select("call_id", F.posexplode(F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("ord", "line")).withColumn("line", F.regexp_replace("line", "\\r$", ""))


def _payloads(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("line").startswith("data: ")).withColumn("line", F.substring("line", 7, 2**31 - 1))


def _until(rows: DataFrame, last: Column, keep: bool) -> DataFrame:
    """Rows up to the first where last holds, with it or without."""
    w = Window.partitionBy("call_id").orderBy("ord")
    ended = F.coalesce(F.max(last.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumn("_ended", ended).where("_ended = 0").drop("_ended")
    return out if keep else out.where(~last)


def _chunk(kind: str | Column, **fields: Column) -> list[Column]:
    kinds = {"tool_index": "int", "input_tokens": "long", "output_tokens": "long"}
    named = {"kind": F.lit(kind) if isinstance(kind, str) else kind, **fields}
    return [F.col(c) if c in ("call_id", "ord") else named.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in CHUNK]


def openai_chunks(lines: DataFrame) -> DataFrame:
    """``data:`` lines up to ``[DONE]``."""
    v = F.parse_json("line")
    rows = _until(_payloads(lines), F.col("line") == "[DONE]", keep=False).withColumn("v", v)
    choice = F.try_element_at(variants.as_array(variants.field(F.col("v"), "choices")), F.lit(1))
    rows = rows.withColumn("c", choice)
    usage = variants.field(F.col("v"), "usage")
    text = rows.where(text_at(F.col("c"), "delta.content").isNotNull()).select(*_chunk("text_delta", text=text_at(F.col("c"), "delta.content")))
    calls = rows.select("call_id", "ord", F.explode(variants.as_array(variants.field(F.col("c"), "delta.tool_calls"))).alias("t"))
    calls = calls.select(*_chunk("tool_call_delta", text=text_at(F.col("t"), "function.arguments"), tool_index=F.coalesce(variants.as_count(variants.field(F.col("t"), "index")), F.lit(0)), tool_id=text_at(F.col("t"), "id"), tool_name=text_at(F.col("t"), "function.name")))
    ends = rows.select(*_chunk("done", input_tokens=variants.as_count(variants.field(usage, "prompt_tokens")), output_tokens=variants.as_count(variants.field(usage, "completion_tokens")), finish_reason=text_at(F.col("c"), "finish_reason"))).where("input_tokens is not null or output_tokens is not null or finish_reason is not null")
    return text.unionByName(calls).unionByName(ends)


def anthropic_chunks(lines: DataFrame) -> DataFrame:
    """Typed events: prompt tokens from ``message_start``, completion tokens and reason from ``message_delta``, the end at ``message_stop``."""
    rows = _payloads(lines).withColumn("v", F.parse_json("line")).withColumn("type", text_at(F.col("v"), "type"))
    rows = _until(rows, F.col("type") == "message_stop", keep=True)
    text = rows.where("type = 'content_block_delta'").where(text_at(F.col("v"), "delta.text").isNotNull()).select(*_chunk("text_delta", text=text_at(F.col("v"), "delta.text")))
    count = lambda p: variants.as_count(variants.field(F.col("v"), p))
    start = rows.where("type = 'message_start'").select(*_chunk("usage", input_tokens=count("message.usage.input_tokens")))
    delta = rows.where("type = 'message_delta'").select(*_chunk("done", output_tokens=count("usage.output_tokens"), finish_reason=text_at(F.col("v"), "delta.stop_reason")))
    return text.unionByName(start).unionByName(delta)


def gemini_chunks(lines: DataFrame) -> DataFrame:
    """``data:`` lines with candidates."""
    rows = _payloads(lines).withColumn("v", F.parse_json("line"))
    one = F.try_element_at(variants.as_array(variants.field(F.col("v"), "candidates")), F.lit(1))
    rows = rows.withColumn("c", one)
    parts = F.transform(variants.as_array(variants.field(F.col("c"), "content.parts")), lambda p: F.coalesce(text_at(p, "text"), F.lit("")))
    text = rows.select(*_chunk("text_delta", text=F.array_join(parts, ""))).where("text <> ''")
    count = lambda p: variants.as_count(variants.field(F.col("v"), p))
    ends = rows.select(*_chunk("done", input_tokens=count("usageMetadata.promptTokenCount"), output_tokens=count("usageMetadata.candidatesTokenCount"), finish_reason=F.lower(text_at(F.col("c"), "finishReason")))).where("finish_reason is not null")
    return text.unionByName(ends)


def ollama_chunks(lines: DataFrame) -> DataFrame:
    """JSON lines up to the one that is ``done``."""
    rows = lines.where("trim(line) <> ''").withColumn("v", F.parse_json("line"))
    done = F.coalesce(F.try_variant_get("v", "$.done", "boolean"), F.lit(False))
    rows = _until(rows.withColumn("done", done), F.col("done"), keep=True)
    text = rows.select(*_chunk("text_delta", text=text_at(F.col("v"), "message.content"))).where("text <> ''")
    count = lambda p: variants.as_count(variants.field(F.col("v"), p))
    ends = rows.where("done").select(*_chunk("done", input_tokens=count("prompt_eval_count"), output_tokens=count("eval_count"), finish_reason=F.coalesce(text_at(F.col("v"), "done_reason"), F.lit("stop"))))
    return text.unionByName(ends)


def simulated_chunks(calls: DataFrame, n: int, text: str = "text", prompt_tokens: str = "prompt_tokens", completion_tokens: str = "completion_tokens") -> DataFrame:
    """A text cut into n equal chunks, what is left over in the last, tokens with the last."""
    size = F.floor(F.length(text) / n).cast("int")
    rows = calls.select("call_id", text, prompt_tokens, completion_tokens, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("ord"))
    last = F.col("ord") == n - 1
    cut = F.substr(F.col(text), F.col("ord") * size + 1, F.when(last, F.length(text)).otherwise(size))
    return rows.select(*_chunk("text_delta", text=cut, input_tokens=F.when(last, F.col(prompt_tokens)), output_tokens=F.when(last, F.col(completion_tokens)), finish_reason=F.when(last, "stop")))
