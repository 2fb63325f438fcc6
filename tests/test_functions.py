from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from dagframe.functions import pricing, scalars, transforms, variants
from dagframe.functions.numeric import as_number
from dagframe.functions.predicates import condition, edge_condition, row_condition


def value(spark, column, **fields):
    """A column's value over one row of string fields."""
    df = spark.createDataFrame([tuple(fields.values()) or ("x",)], ", ".join(f"{k} string" for k in fields) or "x string")
    return df.select(column.alias("out")).first().out


NUMBERS = {"1": 1.0, " 1": None, "1 ": None, "1d": None, "1.0F": None, "0x1p3": None, "+1": 1.0, ".5": 0.5, "5.": 5.0, ".": None, "": None, "-2e3": -2000.0, "1e": None, "1_000": None, "٣": None}


def test_numbers_in_texts(spark):
    rows = spark.createDataFrame([(k,) for k in [*NUMBERS, "inf", "-Infinity", "NaN", None]], "k string").select("k", as_number(F.col("k")).alias("n")).collect()
    got = {r.k: r.n for r in rows}
    assert {k: got[k] for k in NUMBERS} == NUMBERS
    assert got["inf"] == math.inf and got["-Infinity"] == -math.inf and math.isnan(got["NaN"]) and got[None] is None


DATA = '{"s": "ok", "n": 5, "big": 0.30000000000000004, "t": true, "f": false, "z": 0, "e": "", "nil": null, "o": {"p": {"q": "deep"}}, "arr": [], "obj": {}}'
TRUTHS = {
    "s == 'ok'": True,
    's != "ok"': False,
    "n > 4 && n <= 5": True,
    "n > 5 || s == 'ok'": True,
    "big == 0.3": True,
    "big >= 0.3": True,
    "!n == 5": False,
    "!s == 'no'": True,
    "!!t": True,
    "t == true": True,
    "t != false": True,
    "t > false": False,
    "n == -5": False,
    "n > -5": True,
    "missing == null": True,
    "missing != null": False,
    "missing != 'x'": True,
    "nil == null": True,
    "nil != 'x'": True,
    "nil > 1": False,
    "n != 'x'": False,
    "n == '5'": False,
    "s > 1": False,
    "o.p.q == 'deep'": True,
    "o.p.none == null": True,
    "obj == obj": False,
    "arr != 1": False,
    "n": True,
    "z": False,
    "e": False,
    "nil": False,
    "missing": False,
    "arr": True,
    "obj": True,
    "f || t && z": False,
    "t || f && z": True,
    "s < 'pk'": True,
    "s >= 'ok'": True,
}


def test_conditions(spark):
    df = spark.createDataFrame([(DATA,)], "d string").select(F.parse_json("d").alias("v"))
    row = df.select([condition(c, F.col("v")).alias(str(i)) for i, c in enumerate(TRUTHS)]).first()
    assert {c: row[str(i)] for i, c in enumerate(TRUTHS)} == TRUTHS


def test_conditions_over_typed_columns_agree(spark):
    schema = "s string, n long, big double, t boolean, f boolean, z int, e string, nil string, o struct<p:struct<q:string>>, arr array<int>, obj map<string,int>"
    df = spark.createDataFrame([("ok", 5, 0.30000000000000004, True, False, 0, "", None, (("deep",),), [], {})], schema)
    row = df.select([row_condition(c, df).alias(str(i)) for i, c in enumerate(TRUTHS)]).first()
    assert {c: row[str(i)] for i, c in enumerate(TRUTHS)} == TRUTHS


@pytest.mark.parametrize("text", ["", "  ", "a = 1", "a & b", "a | b", "a == ", "a b", "(a)", "'open", "1.2.3", "a < b < c", "#"])
def test_faulty_conditions(spark, text):
    with pytest.raises(ValueError):
        condition(text, F.lit(None))
    assert value(spark, edge_condition(text, F.parse_json(F.lit("{}")))) is False


def test_no_condition_passes(spark):
    assert value(spark, edge_condition(None, F.lit(None))) is True


def test_variants(spark):
    v = F.parse_json(F.lit(DATA))
    assert value(spark, variants.text_at(v, "n")) is None and value(spark, variants.text_at(v, "s")) == "ok"
    assert value(spark, variants.as_count(variants.field(v, "n"))) == 5
    assert [value(spark, variants.kind(variants.field(v, k))) for k in ("s", "n", "t", "nil", "missing", "arr", "obj")] == ["str", "num", "bool", "null", "null", "array", "object"]


def test_transforms(spark):
    v = F.parse_json(F.lit('{"items": [{"price": 2, "qty": 3, "active": true}, {"price": 1.5, "qty": 2, "active": null}, {"price": 1, "qty": 1, "active": 0}], "n": 7, "s": "x", "h": 2.5}'))
    items = transforms.items(v, "items")
    assert value(spark, transforms.map_product(items, "price", "qty")) == [6.0, 3.0, 1.0]
    assert value(spark, F.size(transforms.select(items, "active"))) == 2
    assert tuple(value(spark, transforms.totals(transforms.map_product(items, "price", "qty")))) == (10.0, 3)
    assert value(spark, transforms.add(F.array().cast("array<double>"))) is None
    assert [value(spark, transforms.to_string(transforms.path(v, k))) for k in ("n", "s", "h", "none")] == ["7", "x", "2.5", "null"]
    assert value(spark, transforms.if_else(F.lit(None).cast("boolean"), F.lit(1), F.lit(2))) == 2
    assert value(spark, transforms.build(b=F.lit(1), a=F.lit(None).cast("string"))) == '{"a":null,"b":1}'


def test_redaction(spark):
    cut = lambda text, s: value(spark, scalars.redact(F.col("t"), s), t=text)
    assert [cut("4111222233334444", s) for s in ("none", "secret", "masked", "pii", "odd")] == ["4111222233334444", "[REDACTED]", "****4444", "[PII_REDACTED]", "[CUSTOM_REDACTED]"]
    assert cut("abc", "masked") == "[MASKED]" and cut("éé", "masked") == "****éé" and cut("日本語テキスト", "masked") == "****キスト"[:4] + "テキスト"
    messages = F.from_json(F.lit('[{"role":"user","content":"secret"}]'), "array<struct<role:string,content:string>>")
    assert value(spark, scalars.redact_messages(messages, "pii"))[0].asDict() == {"role": "user", "content": "[PII_REDACTED]"}
    ports = F.create_map(F.lit("a"), F.lit("xxxx1234"), F.lit("b"), F.lit("y"))
    assert value(spark, scalars.redact_ports(ports, {"a": "masked"})) == {"a": "****1234", "b": "y"}
    assert value(spark, scalars.redact_custom(F.lit("d"), {"a": "none"})) == "d" and value(spark, scalars.redact_custom(F.lit("d"), {"a": "pii"})) == "[PII_REDACTED]"


def test_texts_and_names(spark):
    s = scalars
    cases = [
        (s.token_estimate(F.lit("aé")), 1), (s.token_estimate(F.lit("")), 0), (s.token_estimate(F.lit("12345")), 2),
        (s.mock_prompt_tokens(F.lit("abc")), 1), (s.mock_completion_tokens(F.lit(None).cast("int")), 30), (s.mock_completion_tokens(F.lit(101)), 75),
        (s.model_from_repr(F.lit("ChatX(model='m-3:b', k=1)")), "m-3:b"), (s.model_from_repr(F.lit('X(model="q")')), "q"), (s.model_from_repr(F.lit("X(model=bare)")), None), (s.model_from_repr(F.lit("none")), None), (s.model_from_repr(F.lit("X(model='')")), None),
        (s.strip_provider(F.lit("langchain_ollama")), "ollama"), (s.strip_provider(F.lit("langchain-x")), "x"), (s.strip_provider(F.lit("openai")), "openai"),
        (s.limit_parameter(F.lit("GPT-4o-mini")), "max_completion_tokens"), (s.limit_parameter(F.lit("o1-x")), "max_completion_tokens"), (s.limit_parameter(F.lit("gpt-4")), "max_tokens"), (s.limit_parameter(F.lit("foo1")), "max_tokens"),
        (s.chat_url(F.lit("http://h")), "http://h/v1/chat/completions"), (s.chat_url(F.lit("http://h/v1")), "http://h/v1/chat/completions"), (s.chat_url(F.lit("http://h/v1/chat/completions?x")), "http://h/v1/chat/completions?x"),
        (s.fill_key(F.lit("Bearer {key}"), F.lit("k")), "Bearer k"), (s.map_role(F.lit("ai")), "assistant"), (s.map_role(F.lit("odd")), "odd"),
        (s.cron_key(F.lit("f"), F.timestamp_seconds(F.lit(60))), "cron:f:60"),
        (s.error_text(F.lit("timeout"), F.lit(None).cast("string"), F.lit(30)), "timeout after 30ms"), (s.error_text(F.lit("fatal"), F.lit("m"), F.lit(0)), "fatal: m"),
        (s.trace_id(F.lit("r")), __import__("hashlib").sha256(b"r:").hexdigest()[:32]), (s.span_id(F.lit("r"), F.lit("n"), F.lit(1)), __import__("hashlib").sha256(b"r:n:1:").hexdigest()[:16]),
        (s.backoff_ms(F.lit(1000), F.lit(2.0), F.lit(3)), 4000.0), (s.elapsed_ms(F.timestamp_seconds(F.lit(5)), F.timestamp_seconds(F.lit(3))), 0),
        (F.to_json(s.arguments_object(F.lit("not json"))), "{}"), (F.to_json(s.arguments_object(F.lit('{"a":1}'))), '{"a":1}'),
    ]
    row = spark.range(1).select([c.alias(str(i)) for i, (c, _) in enumerate(cases)]).first()
    assert [row[str(i)] for i in range(len(cases))] == [want for _, want in cases]
    assert scalars.cron_fields("0 9 * * *") == "0 0 9 * * * *" and scalars.cron_fields("1 0 9 * * *") == "0 1 0 9 * * *" and scalars.cron_fields("x") == "x"


def test_messages(spark):
    text = F.from_json(F.lit('[{"role":"system","content":"a"},{"role":"system","content":"b"},{"role":"odd","content":"c"},{"role":"user","content":"d"},{"role":"assistant","content":"e"},{"role":"system","content":"lost"}]'), "array<struct<role:string,content:string>>")
    assert [tuple(m) for m in value(spark, scalars.fold_system_turns(text))] == [("user", "c"), ("user", "a\nb\n\nd"), ("model", "e")]
    message = json.loads(value(spark, scalars.tool_message(F.lit("c1"), F.lit("query"), F.lit('{"x":1}'))))
    assert message == {"role": "tool", "tool_call_id": "c1", "name": "query", "content": '{"x":1}'}
    spec = json.loads(value(spark, scalars.tool_spec(F.lit("n"), F.lit("d"), F.parse_json(F.lit('{"type":"object"}')))))
    assert spec == {"type": "function", "function": {"name": "n", "description": "d", "parameters": {"type": "object"}}}
    assert tuple(value(spark, scalars.token_usage(F.parse_json(F.lit('{"prompt_tokens":3,"output_tokens":4}'))))) == (3, 4, None)


def test_prices(spark):
    prices = spark.createDataFrame([("m", 1.0, 2.0), ("m-2", 0.5, 0.5)], "model string, prompt double, completion double")
    calls = spark.createDataFrame([(1, "m", 1, 1), (2, "m-0613", 2, 0), (3, "m-2", 2, 2), (4, "x-1", 1, 1), (5, None, 1, 1)], "id int, model string, prompt_tokens int, completion_tokens int")
    got = {r.id: (r.priced_model, r.cost) for r in pricing.with_cost(calls, prices).collect()}
    assert got == {1: ("m", 3.0), 2: ("m", 2.0), 3: ("m-2", 2.0), 4: ("x-1", None), 5: (None, None)}


def test_port_types():
    from dagframe.functions.types import port_type

    assert port_type({"list": {"map": "number"}}).simpleString() == "array<map<string,double>>"
    assert port_type({"custom": "P"}, {"P": {"x": "string", "tags": {"list": "any"}}}).simpleString() == "struct<x:string,tags:array<variant>>"
    with pytest.raises(ValueError):
        port_type("odd")
