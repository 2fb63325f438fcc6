"""Further named queries with their SQL: sources read back, tool answers, message and usage texts, adapters, stores, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from dagframe.catalog import _LOG, _condition_query, log, query, t
from dagframe.functions import scalars, transforms, variants
from dagframe.operators import adapters, dataflow, eventlog, models, stores, tabular, triggers
from dagframe.plans import graph as graphs
from dagframe.plans.flow import Flow, scalar
from dagframe.sources import files, model_streams
from dagframe.sources.rounds import round_folder
from dagframe.streaming import log as streams

# sources: tables written in a format and read back ------------------------------------------


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, coalesce(p_name, '') AS p_name, coalesce(p_brand, '') AS p_brand FROM part")
def scan_delimited(spark, d):
    path = f"{round_folder(spark)}/part"
    t(spark, d, "part").select("p_partkey", "p_name", "p_brand").write.option("header", True).option("escape", '"').csv(path)
    return files.csv_table(spark, path)


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def scan_json_array(spark, d):
    path = f"{round_folder(spark)}/nation"
    one = F.to_json(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))))
    t(spark, d, "nation").agg(one.alias("value")).coalesce(1).write.text(path)
    return files.json_array(spark, path, "id long, name string")


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS seq, CAST(event_id % 3 AS INTEGER) AS attempt, props AS inputs FROM events WHERE user_id = 7")
def scan_log_lines(spark, d):
    path = f"{round_folder(spark)}/log"
    log(spark, d).write.json(path)
    return files.event_log(spark, path, "7").select("run_id", "seq", "attempt", "inputs")


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS seq, props AS inputs FROM events WHERE user_id = 11")
def scan_log_table(spark, d):
    path = f"{round_folder(spark)}/log"
    files.append_events(spark, log(spark, d), path)
    return files.log_table(spark, path, "11").select("run_id", "seq", "inputs")


@query("SELECT r_regionkey AS id, r_name AS name FROM region")
def scan_records(spark, d):
    path = f"{round_folder(spark)}/records"
    t(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")).write.option("maxRecordsPerFile", 1).json(path)
    return files.records(spark, path, "id long, name string")


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, count(*) AS n_events, max(event_id) AS last FROM events GROUP BY user_id")
def stream_appended(spark, d):
    """The log as it comes, appended once although half of it comes twice."""
    root = round_folder(spark)
    rows = log(spark, d)
    rows.write.json(f"{root}/in")
    rows.where("seq % 2 = 0").write.mode("append").json(f"{root}/in")
    streams.append_stream(streams.log_stream(spark, f"{root}/in"), f"{root}/log", f"{root}/offsets", available_now=True).awaitTermination()
    return files.log_table(spark, f"{root}/log").groupBy("run_id").agg(F.count(F.lit(1)).alias("n_events"), F.max("seq").alias("last"))


@query("WITH e AS (SELECT user_id, max(event_id) FILTER (event_type = 'signup') AS s, count(*) AS n FROM events GROUP BY user_id) SELECT CAST(user_id AS VARCHAR) AS run_id, CASE WHEN s IS NULL THEN 'pending' ELSE 'running' END AS status, n AS n_events FROM e")
def stream_live_runs(spark, d):
    root = round_folder(spark)
    log(spark, d).write.json(f"{root}/in")
    live = streams.live_runs(streams.log_stream(spark, f"{root}/in"))
    name = "live_" + root.rsplit("-", 1)[-1]
    live.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select("run_id", "status", "n_events")


@query("SELECT conv_id AS call_id, string_agg(text, '' ORDER BY turn) AS content, max(turn) * 10 AS input_tokens, max(turn) AS output_tokens, 'length' AS finish_reason FROM conversations GROUP BY conv_id")
def stream_lines_parsed(spark, d):
    """Turns as the lines of a model's answer, parsed and folded."""
    c = t(spark, d, "conversations")
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))
    turns = c.select(F.col("conv_id").alias("call_id"), F.col("turn").alias("ord"), F.concat(F.lit("data: "), body).alias("line"))
    ends = c.groupBy("conv_id").agg(F.max("turn").alias("k"))
    last = F.to_json(F.struct(F.array(F.struct(F.lit("length").alias("finish_reason"))).alias("choices"), F.struct((F.col("k") * 10).alias("prompt_tokens"), F.col("k").alias("completion_tokens")).alias("usage")))
    lines = turns.unionByName(ends.select(F.col("conv_id").alias("call_id"), (F.col("k") + 1).alias("ord"), F.concat(F.lit("data: "), last).alias("line")))
    lines = lines.unionByName(ends.select(F.col("conv_id").alias("call_id"), (F.col("k") + 2).alias("ord"), F.lit("data: [DONE]").alias("line")))
    out = eventlog.stream_chunks_folded(model_streams.openai_chunks(lines))
    return out.select("call_id", "content", "input_tokens", "output_tokens", "finish_reason")


# tabular answers on texts -------------------------------------------------------------------


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey FROM customer WHERE c_acctbal > 5000.5")
def csv_query_on_texts(spark, d):
    rows = tabular.as_texts(t(spark, d, "customer").select("c_custkey", "c_acctbal"))
    return tabular.query(rows, "c_acctbal", "5000.5", "gt", limit=None).select("c_custkey")


@query("SELECT coalesce(l_returnflag, '') AS l_returnflag, round(sum(l_quantity), 2) AS result FROM lineitem GROUP BY ALL")
def csv_agg_on_texts(spark, d):
    out = tabular.aggregate(tabular.as_texts(t(spark, d, "lineitem").select("l_returnflag", "l_quantity")), "l_quantity", "sum", "l_returnflag")
    return out.withColumn("result", F.round("result", 2))


@query("SELECT 3 AS place, (SELECT count(*) FROM nation) AS row_count, '{\"n_name\":\"' || n_name || '\",\"n_nationkey\":\"' || n_nationkey || '\",\"n_regionkey\":\"' || n_regionkey || '\"}' AS row_text FROM nation WHERE n_nationkey = 10")
def csv_sample_rows(spark, d):
    report = tabular.list_columns(tabular.as_texts(t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")), "n_nationkey")
    rows = report.select(F.size("sample_rows").alias("place"), "row_count", F.array_sort("sample_rows").alias("r"), F.element_at("sample_rows", 1).alias("first"))
    third = F.filter("r", lambda x: F.get_json_object(x, "$.n_nationkey") == "10")[0]
    return rows.select("place", "row_count", third.alias("row_text"))


@query("SELECT count(*) AS n, string_agg('{\"p_brand\":\"Brand#3\",\"p_partkey\":' || p_partkey || '}', ';' ORDER BY p_partkey) AS rows FROM (SELECT p_partkey FROM part WHERE p_brand = 'Brand#3' ORDER BY p_partkey LIMIT 20)")
def csv_query_report(spark, d):
    report = tabular.query_report(t(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "Brand#3", order="p_partkey")
    return report.select(F.col("count").alias("n"), F.array_join("matches", ";").alias("rows"))


@query("SELECT CAST(NULL AS DOUBLE) AS result")
def csv_agg_unknown_of_nothing(spark, d):
    return tabular.aggregate(t(spark, d, "region").where("false").select("r_regionkey"), "r_regionkey", "median")


# conditions ---------------------------------------------------------------------------------

_condition_query("expr_bool", "true == true && k >= 0 && false != true", "true")
_condition_query("expr_bool_order", "true > false || k == 3", "CAST(json_extract(props, '$.k') AS DOUBLE) = 3")
_condition_query("expr_string_order", "'b' > 'a' && k <= 4 && 'a' != 'b'", "CAST(json_extract(props, '$.k') AS DOUBLE) <= 4")
_condition_query("expr_epsilon", "k == 5.0000000000000001 || k == 6.001", "CAST(json_extract(props, '$.k') AS DOUBLE) = 5")


@query("SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) > 90")
def expr_faulty_edges(spark, d):
    """A faulty condition never passes and no condition always does."""
    rows = t(spark, d, "events").select("event_id", F.parse_json("props").alias("value"))
    faulty = dataflow.passing(rows, "k >").unionByName(dataflow.passing(rows, "(k)"))
    return faulty.unionByName(dataflow.passing(dataflow.passing(rows, None), "k > 90")).select("event_id")


# JSON transforms ----------------------------------------------------------------------------


@query("SELECT event_id, props AS whole, '{\"a\":' || event_id || ',\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',\"none\":null}' AS built FROM events")
def jq_build(spark, d):
    v = F.parse_json("props")
    built = transforms.build(k=transforms.path(v, "k"), a=F.col("event_id"), none=F.lit(None).cast("string"))
    return t(spark, d, "events").select("event_id", F.regexp_replace(F.to_json(transforms.identity(v)), ":", ": ").alias("whole"), built.alias("built"))


# dataflow -----------------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(json_extract(props, '$.k') AS VARCHAR) ELSE '{\"x\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' END AS value FROM events")
def port_projection(spark, d):
    """The port's field where the output has one, else all of it."""
    k = F.get_json_object("props", "$.k").cast("int")
    v = F.parse_json(F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(k.alias("k")))).otherwise(F.to_json(F.struct(k.alias("x")))))
    return t(spark, d, "events").select("event_id", F.to_json(dataflow.port_value(v, "k")).alias("value"))


@query("SELECT o_custkey, string_agg(CASE WHEN o_orderstatus = 'F' THEN '{\"error\":\"late\",\"fan_out_index\":' || o_orderkey || '}' WHEN o_orderstatus = 'P' THEN 'null' ELSE CAST(o_orderkey AS VARCHAR) END, ',' ORDER BY o_orderkey) AS results FROM orders GROUP BY o_custkey")
def fanin_failure_markers(spark, d):
    o = t(spark, d, "orders")
    rows = o.select("o_custkey", F.col("o_orderkey").alias("fan_out_index"), F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey").cast("string")).alias("result"), F.when(F.col("o_orderstatus") == "F", F.lit("late")).alias("error"))
    return dataflow.fan_in_results(rows, ["o_custkey"]).select("o_custkey", F.array_join("results", ",").alias("results"))


_READY = "e(edge_id, from_node, to_node) AS (VALUES ('e1', 'a', 'c'), ('e2', 'b', 'c'), ('e3', 'a', 'd')), s AS (SELECT CAST(o_orderkey AS VARCHAR) AS run_id, n AS node_id, CASE WHEN n = 'a' THEN 'completed' WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'completed' END AS state FROM orders, (VALUES ('a'), ('b')) v(n) WHERE n = 'a' OR o_orderstatus <> 'P')"


def _ready(spark, d, asks: bool):
    o = t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), "o_orderstatus")
    a = o.select("run_id", F.lit("a").alias("node_id"), F.lit("completed").alias("state"))
    b = o.where("o_orderstatus <> 'P'").select("run_id", F.lit("b").alias("node_id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("completed").alias("state"))
    edges = spark.createDataFrame([("e1", "a", "c"), ("e2", "b", "c"), ("e3", "a", "d")], "edge_id string, from_node string, to_node string")
    passed = o.select("run_id", F.explode(F.array(F.lit("e2"), F.lit("e3"))).alias("edge_id"))
    return dataflow.ready_nodes(edges, a.unionByName(b), passed if asks else None)


@query(f"WITH {_READY} SELECT DISTINCT run_id, 'd' AS node_id FROM s UNION ALL SELECT run_id, 'c' FROM s WHERE node_id = 'b' AND state = 'completed'")
def ready_nodes(spark, d):
    """c waits for both of its sources and needs one that completed over an edge that passed."""
    return _ready(spark, d, True)


@query(f"WITH {_READY} SELECT DISTINCT run_id, 'd' AS node_id FROM s UNION ALL SELECT run_id, 'c' FROM s WHERE node_id = 'b'")
def ready_after_failure(spark, d):
    """Behind a failure no condition is asked."""
    return _ready(spark, d, False)


def _add(value, config):
    v = F.parse_json(value)
    at = lambda n: F.coalesce(variants.as_double(variants.field(v, n)), F.lit(0.0)).cast("long")
    return F.to_json(F.struct((at("n") + 1).alias("n"), at("limit").alias("limit")))


_TWO_LOOPS = graphs.Graph("two", (graphs.Node("start", "conditional"), graphs.Node("x", "add"), graphs.Node("y", "add")), (graphs.Edge("s", "start", "x"), graphs.Edge("f", "x", "y"), graphs.Edge("b1", "y", "x", condition="n < limit"), graphs.Edge("b2", "x", "x", condition="n < 2")))


@query(None)
def cycle_of_two_back_edges(spark, d):
    """Two back edges that take turns, each with its own limit; held against a plain run in the tests."""
    inputs = t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("run_id"), F.to_json(F.struct(F.lit(0).alias("n"), (F.col("c_custkey") % 30).alias("limit"))).alias("value"))
    outputs, _ = Flow(_TWO_LOOPS, {"add": scalar(_add)}, max_traversals=5).run(inputs)
    return outputs["y"].select("run_id", F.get_json_object("value", "$.n").cast("long").alias("n"))


_LAYERS = 10
_DIAMONDS = graphs.Graph("diamonds", (graphs.Node("n0", "conditional"), *(graphs.Node(f"{s}{k}", "conditional") for k in range(1, _LAYERS + 1) for s in "abn")), tuple(e for k in range(_LAYERS) for e in (graphs.Edge(f"a{k}", f"n{k}", f"a{k + 1}"), graphs.Edge(f"b{k}", f"n{k}", f"b{k + 1}"), graphs.Edge(f"c{k}", f"a{k + 1}", f"n{k + 1}"), graphs.Edge(f"d{k}", f"b{k + 1}", f"n{k + 1}"))))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS run_id, 'completed' AS status FROM nation")
def flow_diamonds(spark, d):
    """Ten diamonds, one behind the other."""
    inputs = t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("run_id"), F.lit("{}").alias("value"))
    return Flow(_DIAMONDS).run(inputs)[1]


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n_calls FROM events")
def tool_router(spark, d):
    calls = F.array(F.struct(F.lit("a").alias("id")), F.struct(F.lit("b").alias("id")))
    k = F.col("event_id") % 3
    v = F.when(k == 0, F.to_json(F.struct(calls.alias("tool_calls")))).when(k == 1, F.to_json(F.slice(calls, 1, 1))).otherwise("{}")
    return t(spark, d, "events").select("event_id", F.size(dataflow.tool_calls(F.parse_json(v))).alias("n_calls"))


@query("SELECT conv_id, CAST(count(*) AS INTEGER) AS n, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def conversation_append(spark, d):
    """Stored turns and later ones behind them."""
    c = t(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))
    stored = dataflow.history(c.where("turn < 3"), ["conv_id"])
    out = dataflow.append_turns(stored, c.where("turn >= 3").withColumnRenamed("turn", "pos"), ["conv_id"])
    return out.select("conv_id", F.size("messages").alias("n"), F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"))


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' ELSE 'user' END AS role, CASE turn % 3 WHEN 2 THEN '[1,2]' ELSE text END AS content, 'be brief' AS first FROM conversations WHERE turn % 3 <> 2")
def model_input_messages(spark, d):
    """A text is a user's turn, an object with a role is a message; a system turn stands first."""
    k = F.col("turn") % 3
    v = F.parse_json(F.when(k == 0, F.to_json(F.struct(F.col("text").alias("t"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("text").alias("t")))) - 6)).otherwise(F.to_json(F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content")))))
    made = models.input_messages(v, "be brief")
    rows = t(spark, d, "conversations").where("turn % 3 <> 2").select("conv_id", "turn", made.alias("m"))
    return rows.select("conv_id", "turn", F.col("m")[1]["role"].alias("role"), F.col("m")[1]["content"].alias("content"), F.col("m")[0]["content"].alias("first"))


# event log ----------------------------------------------------------------------------------


@query(f"WITH {_LOG} SELECT run_id, seq, CASE WHEN node_id IN ('n1', 'n2') THEN '[PII_REDACTED]' ELSE props END AS inputs FROM e WHERE kind = 'view'")
def log_redacted(spark, d):
    policy = spark.createDataFrame([("n1", "pii", "none"), ("n2", "pii", "secret")], "node_id string, inputs_sensitivity string, outputs_sensitivity string")
    return eventlog.redacted(log(spark, d).withColumn("data", F.lit(None).cast("string")), policy).where("event_type = 'node_started'").select("run_id", "seq", "inputs")


@query("SELECT conv_id, count(*) AS n, min(CASE WHEN true THEN '[REDACTED]' END) AS content FROM conversations GROUP BY conv_id")
def redact_messages(spark, d):
    found = dataflow.history(t(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content")), ["conv_id"])
    hidden = found.select("conv_id", F.explode(scalars.redact_messages(F.col("messages"), "secret")).alias("m"))
    return hidden.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("m.content").alias("content"))


@query("SELECT c_custkey, '****' || right(c_name, 4) AS a, c_name AS b, CASE WHEN c_custkey % 2 = 0 THEN '[PII_REDACTED]' ELSE c_mktsegment END AS custom FROM customer")
def redact_ports(spark, d):
    ports = scalars.redact_ports(F.create_map(F.lit("a"), F.col("c_name"), F.lit("b"), F.col("c_name")), {"a": "masked"})
    custom = F.when(F.col("c_custkey") % 2 == 0, scalars.redact_custom(F.col("c_mktsegment"), {"out": "secret"})).otherwise(scalars.redact_custom(F.col("c_mktsegment"), {"out": "none"}))
    return t(spark, d, "customer").select("c_custkey", ports["a"].alias("a"), ports["b"].alias("b"), custom.alias("custom"))


# scalar functions ---------------------------------------------------------------------------


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'm-' || lang WHEN 1 THEN 'x''y' WHEN 2 THEN NULL ELSE NULL END AS model, source AS provider FROM documents")
def model_names_in_texts(spark, d):
    k = F.col("doc_id") % 4
    text = F.when(k == 0, F.concat(F.lit("Chat(model='m-"), "lang", F.lit("', model='z')"))).when(k == 1, F.lit('C(model="x\'y")')).when(k == 2, F.lit("C(model=bare)")).otherwise("none")
    return t(spark, d, "documents").select("doc_id", scalars.model_from_repr(text).alias("model"), scalars.strip_provider(F.concat(F.when(F.col("doc_id") % 2 == 0, "langchain_").otherwise("langchain-"), "source")).alias("provider"))


@query("SELECT event_id, CASE WHEN event_id % 6 IN (0, 1, 2, 3) THEN 'max_completion_tokens' ELSE 'max_tokens' END AS parameter, CASE WHEN event_id % 3 = 2 THEN 'http://h/v1/chat/completions?x=1' ELSE 'http://h/v1/chat/completions' END AS url, 'http://h?key=k' || event_id AS keyed FROM events")
def model_requests(spark, d):
    names = F.array(*[F.lit(x) for x in ("O1-mini", "o3", "x-gpt-4o-y", "GPT-5", "gpt-4", "xo1")])
    bases = F.array(F.lit("http://h"), F.lit("http://h/v1"), F.lit("http://h/v1/chat/completions?x=1"))
    at = lambda n: (F.col("event_id") % n + 1).cast("int")
    return t(spark, d, "events").select("event_id", scalars.limit_parameter(F.element_at(names, at(6))).alias("parameter"), scalars.chat_url(F.element_at(bases, at(3))).alias("url"), scalars.fill_key(F.lit("http://h?key={key}"), F.concat(F.lit("k"), F.col("event_id").cast("string"))).alias("keyed"))


@query("WITH g AS (SELECT *, coalesce(sum(CAST(role = 'user' AS INT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM conversations), s AS (SELECT conv_id, g, string_agg(text, chr(10) ORDER BY turn) AS held FROM g WHERE role = 'system' GROUP BY ALL), f AS (SELECT g.conv_id, turn, CASE role WHEN 'assistant' THEN 'model' ELSE 'user' END AS role, CASE WHEN role = 'user' AND held IS NOT NULL THEN held || chr(10) || chr(10) || text ELSE text END AS content FROM g LEFT JOIN s ON s.conv_id = g.conv_id AND s.g = g.g WHERE role <> 'system') SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, sha256(string_agg(content, '|' ORDER BY turn)) AS contents FROM f GROUP BY conv_id")
def system_turns_folded(spark, d):
    found = dataflow.history(t(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content")), ["conv_id"])
    folded = found.select("conv_id", scalars.fold_system_turns(F.col("messages")).alias("m"))
    of = lambda c, sep: F.array_join(F.transform("m", lambda x: x[c]), sep)
    return folded.where(F.size("m") > 0).select("conv_id", of("role", ",").alias("roles"), scalars.content_hash(of("content", "|")).alias("contents"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 2 = 0 THEN '{\"k\":' || json_extract_string(props, '$.k') || '}' ELSE '{}' END AS text, '{\"content\":\"7\",\"name\":\"t\",\"role\":\"tool\",\"tool_call_id\":\"c' || event_id || '\"}' AS message, '{\"type\":\"function\",\"function\":{\"name\":\"t\",\"description\":\"does\",\"parameters\":{\"k\":' || json_extract_string(props, '$.k') || '}}}' AS spec FROM events")
def tool_texts(spark, d):
    given = scalars.arguments_object(F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise("{broken"))
    call = F.concat(F.lit("c"), F.col("event_id").cast("string"))
    return t(spark, d, "events").select("event_id", F.to_json(variants.field(given, "k")).alias("k"), scalars.arguments_text(given).alias("text"), scalars.tool_message(call, F.lit("t"), F.lit("7")).alias("message"), scalars.tool_spec(F.lit("t"), F.lit("does"), F.parse_json("props")).alias("spec"))


@query("SELECT event_id, CAST(event_id % 100 AS DOUBLE) AS input, CAST(CASE WHEN event_id % 3 <> 2 THEN event_id % 7 END AS DOUBLE) AS output, CAST(CASE WHEN event_id % 3 = 0 THEN event_id % 9 END AS DOUBLE) AS total FROM events")
def usage_of_calls(spark, d):
    e, k = F.col("event_id"), F.col("event_id") % 3
    newer, older = F.struct((e % 100).alias("prompt_tokens"), (e % 7).alias("completion_tokens"), (e % 9).alias("total_tokens")), F.struct((e % 100).alias("input_tokens"), (e % 7).alias("output_tokens"))
    v = F.parse_json(F.when(k == 0, F.to_json(newer)).when(k == 1, F.to_json(older)).otherwise(F.to_json(F.struct((e % 100).alias("prompt_tokens"), F.lit(-1).alias("completion_tokens")))))
    return t(spark, d, "events").select("event_id", scalars.token_usage(v).alias("u")).select("event_id", *[F.col(f"u.{c}").cast("double").alias(c) for c in ("input", "output", "total")])


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'retryable: m' WHEN 1 THEN 'fatal: m' WHEN 2 THEN 'timeout after ' || event_id || 'ms' ELSE 'validation: m' END AS error, 'cron:f:' || CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS cron_key, CAST(1000 * pow(2.0, event_id % 5) AS DOUBLE) AS wait, CAST(greatest(0, (event_id % 3 - 1) * 1500) AS BIGINT) AS took FROM events")
def errors_and_times(spark, d):
    e = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("retryable", "fatal", "timeout", "other")]), (e % 4 + 1).cast("int"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    end = F.timestamp_millis(F.unix_millis(start) + (e % 3 - 1) * 1500)
    return t(spark, d, "events").select("event_id", scalars.error_text(kind, F.lit("m"), e).alias("error"), scalars.cron_key(F.lit("f"), F.col("ts").cast("timestamp")).alias("cron_key"), scalars.backoff_ms(F.lit(1000), F.lit(2.0), e % 5 + 1).alias("wait"), scalars.elapsed_ms(start, end).alias("took"))


@query("SELECT * FROM (VALUES ('1 2 3 4 5', '0 1 2 3 4 5 *'), ('0 1 2 3 4 5', '0 0 1 2 3 4 5'), ('0 1 2 3 4 5 2024', '0 1 2 3 4 5 2024')) v(line, fields)")
def cron_lines(spark, d):
    return spark.createDataFrame([(x, scalars.cron_fields(x)) for x in ("1 2 3 4 5", "0 1 2 3 4 5", "0 1 2 3 4 5 2024")], "line string, fields string")


@query("SELECT '/' || lower(r_name) AS path, 'POST' AS method FROM region")
def trigger_routes(spark, d):
    names = [r.r_name for r in t(spark, d, "region").select("r_name").collect()]  # a region is a route
    return spark.createDataFrame([triggers.http_route(f"/{n.lower()}") for n in names], "path string, method string")


# graphs -------------------------------------------------------------------------------------


def _small_graph(secret: str, order: int = 1) -> graphs.Graph:
    nodes = (graphs.Node("a", "conditional", {"api_key": secret, "n": 1}), graphs.Node("b", "conditional", {"x": [1, {"password": secret}]}))
    return graphs.Graph("g", nodes[::order], (graphs.Edge("ab", "a", "b"), graphs.Edge("ba", "b", "a", condition="n < 3"), graphs.Edge("aa", "a", "a")))


@query("SELECT 'ba' AS edge_id UNION ALL SELECT 'aa'")
def graph_back_edges(spark, d):
    return spark.createDataFrame([(e,) for e in sorted(graphs.back_edges(_small_graph("s")))], "edge_id string")


@query("""SELECT sha256('{"edges":[{"condition":null,"from_node":"a","from_port":"output","id":"ab","to_node":"b","to_port":"input"},{"condition":{"expression":"n < 3"},"from_node":"b","from_port":"output","id":"ba","to_node":"a","to_port":"input"},{"condition":null,"from_node":"a","from_port":"output","id":"aa","to_node":"a","to_port":"input"}],"id":"g","metadata":{},"name":"","nodes":[{"config":{"api_key":"s","n":1},"instance_id":"a","node_type":"conditional"},{"config":{"x":[1,{"password":"s"}]},"instance_id":"b","node_type":"conditional"}],"schema_version":1,"tool_definitions":{},"version":"1"}') AS version_id, sha256('[{"api_key":"[SECRET_PLACEHOLDER]","n":1},{"x":[1,{"password":"[SECRET_PLACEHOLDER]"}]}]') AS config_hash, true AS same""")
def graph_hashes(spark, d):
    """Secrets and the order of nodes don't count for the configurations' hash."""
    one, other = _small_graph("s"), _small_graph("t", -1)
    return spark.createDataFrame([(graphs.version_id(one), graphs.config_hash(one), graphs.config_hash(one) == graphs.config_hash(other))], "version_id string, config_hash string, same boolean")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'unknown node types: [''odd'']' ELSE 'sound' END AS said FROM nation")
def flow_node_types(spark, d):
    def said(k: int) -> str:
        try:
            Flow(graphs.Graph("g", (graphs.Node("a", "odd" if k % 2 == 0 else "conditional"),)))
        except ValueError as e:
            return str(e)
        return "sound"

    keys = [r.n_nationkey for r in t(spark, d, "nation").select("n_nationkey").collect()]  # a nation is a graph
    return spark.createDataFrame([(str(k), said(k)) for k in keys], "name string, said string")


# stores -------------------------------------------------------------------------------------


@query("WITH h AS (SELECT o_custkey AS flow_id, max(o_orderkey) AS v FROM orders GROUP BY o_custkey) SELECT flow_id, v AS version_id, o_totalprice AS graph FROM h JOIN orders ON o_orderkey = v WHERE v % 3 <> 0")
def head_versions(spark, d):
    o = t(spark, d, "orders")
    heads = o.groupBy(F.col("o_custkey").alias("flow_id")).agg(F.max("o_orderkey").alias("current_version_id"))
    versions = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("flow_id"), F.col("o_totalprice").alias("graph"))
    return stores.current_versions(heads, versions).select("flow_id", "version_id", "graph")


@query("SELECT (SELECT n_name FROM nation WHERE n_nationkey = 3) AS first_graph, (SELECT n_name FROM nation WHERE n_nationkey = 7) AS second_graph")
def version_pair(spark, d):
    return stores.version_pair(t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("version_id"), F.col("n_name").alias("graph")), "3", "7")


@query("WITH o AS (SELECT o_custkey, o_orderkey, o_orderkey % 2 = 0 AS gone FROM orders), l AS (SELECT *, lag(gone) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM o) SELECT o_custkey AS flow_id, o_orderkey AS updated_at, coalesce(NOT b, false) AS existed FROM l WHERE gone")
def tag_deletions(spark, d):
    rows = t(spark, d, "orders").select(F.col("o_custkey").alias("flow_id"), F.lit("t").alias("tag"), F.col("o_orderkey").alias("updated_at"), (F.col("o_orderkey") % 2 == 0).alias("deleted"))
    return stores.tag_deletions(rows).select("flow_id", "updated_at", "existed")


# adapters -----------------------------------------------------------------------------------


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'step_start' WHEN 'click' THEN 'step_end' WHEN 'purchase' THEN 'node_transition' WHEN 'error' THEN 'llm_end' ELSE 'step_start' END AS kind, CASE event_type WHEN 'view' THEN 'g' WHEN 'click' THEN 'g' WHEN 'signup' THEN 'g_state_update' END AS name, CASE WHEN event_type = 'purchase' THEN 'p' END AS from_node, CASE WHEN event_type = 'purchase' THEN 'unknown' END AS to_node, CASE event_type WHEN 'view' THEN '{\"s\":1}' WHEN 'click' THEN '{\"s\":1}' WHEN 'signup' THEN 'null' WHEN 'error' THEN '\"r\"' END AS payload, CASE WHEN event_type = 'error' THEN CAST(event_id AS DOUBLE) END AS took FROM events")
def adapter_langgraph(spark, d):
    cb = F.create_map(*[F.lit(x) for kv in {"view": "node_start", "click": "node_end", "purchase": "edge", "error": "on_llm_end", "signup": "state_update"}.items() for x in kv])
    raw = F.to_json(F.struct(cb[F.col("event_type")].alias("callback"), F.lit("g").alias("node"), F.struct(F.lit(1).alias("s")).alias("state"), F.lit("p").alias("from"), F.lit("r").alias("response"), F.col("event_id").alias("duration_ms")))
    found = adapters.translated(t(spark, d, "events").select("event_id", raw.alias("raw")), "langgraph")
    return found.select("event_id", F.col("type").alias("kind"), "name", "from_node", "to_node", "payload", F.col("duration_ms").cast("double").alias("took"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'tool_start' WHEN 'click' THEN 'tool_end' WHEN 'purchase' THEN 'step_start' WHEN 'error' THEN 'step_end' ELSE 'llm_start' END AS kind, CASE WHEN event_type IN ('view', 'click') THEN 'math.add' WHEN event_type = 'signup' THEN 'llm' END AS node_id, CASE WHEN event_type IN ('view', 'click') THEN 'add' WHEN event_type IN ('purchase', 'error') THEN 'prompt_rendering' END AS name, CASE event_type WHEN 'view' THEN '{\"x\":' || event_id || '}' ELSE 'null' END AS payload FROM events")
def adapter_semantic_kernel(spark, d):
    cb = F.create_map(*[F.lit(x) for kv in {"view": "function_invoking", "click": "function_invoked", "purchase": "prompt_rendering", "error": "prompt_rendered", "signup": "on_llm_start"}.items() for x in kv])
    raw = F.to_json(F.struct(cb[F.col("event_type")].alias("callback"), F.lit("add").alias("function_name"), F.lit("math").alias("plugin_name"), F.struct(F.col("event_id").alias("x")).alias("arguments")))
    found = adapters.translated(t(spark, d, "events").select("event_id", raw.alias("raw")), "semantic_kernel")
    return found.select("event_id", F.col("type").alias("kind"), "node_id", "name", "payload")


@query("WITH e AS (SELECT user_id, event_id, event_type, props, lag(event_type) OVER w AS bk, lag(props) OVER w AS bp FROM events WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS ord, 'tool_invocation' AS event_type, CASE WHEN bk = 'view' THEN 't' ELSE 'u' END AS name, CASE WHEN bk = 'view' THEN bp ELSE '{}' END AS inputs, props AS outputs FROM e WHERE event_type = 'click' UNION ALL SELECT CAST(user_id AS VARCHAR), event_id, 'step_recorded', 's_end', NULL, props FROM events WHERE event_type = 'error'")
def session_records(spark, d):
    kind = F.when(F.col("event_type") == "view", "tool_start").when(F.col("event_type") == "click", "tool_end").when(F.col("event_type") == "error", "step_end")
    name = F.when(F.col("event_type") == "view", "t").when(F.col("event_type") == "click", "u").otherwise("s")
    events = t(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("ord"), kind.alias("type"), F.lit("n").alias("node_id"), name.alias("name"), F.col("props").alias("payload"), F.lit(None).cast("long").alias("duration_ms"))
    return adapters.recorded(events.where("type is not null")).select("run_id", "ord", "event_type", "name", "inputs", "outputs")
