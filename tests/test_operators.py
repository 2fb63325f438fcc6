from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from dagframe.operators import adapters, dataflow, eventlog, lookup, models, stores, tabular, triggers

SALES = [("2024-01-05", "Mouse", "Accessories", "10", "20", "North"), ("2024-01-06", "Laptop", "Electronics", "2", "1200.5", "South"), ("2024-01-07", "Cable", "Accessories", " 5", "3", "North"), ("2024-01-08", "Desk", "Furniture", "x", "nan", "East"), ("2024-01-09", "Lamp", "Furniture", "", "inf", "East")]


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(SALES, "date string, product string, category string, quantity string, price string, region string")


def test_list_columns(sales):
    row = tabular.list_columns(sales, "date").first()
    assert row["columns"] == sales.columns and row.row_count == 5 and len(row.sample_rows) == 3
    first = json.loads(row.sample_rows[0])
    assert list(first) == sorted(sales.columns) and first["product"] == "Mouse"


def test_query_operators(sales):
    ids = lambda *a, **k: [r["product"] for r in tabular.query(sales, *a, order="date", **k).collect()]
    assert ids("category", "Accessories") == ["Mouse", "Cable"]
    assert ids("price", 20.0) == [] and ids("price", 20) == ["Mouse"]
    assert ids("product", "CA", "contains") == ["Cable"] and ids("product", "%", "contains") == []
    assert ids("price", 3, "gte") == ["Mouse", "Laptop", "Cable", "Lamp"]
    assert ids("quantity", "2", "gt") == ["Mouse"] and ids("quantity", "abc", "gt") == []
    assert ids("region", "North", limit=1) == ["Mouse"] and ids("region", "North", limit=0) == ["Mouse"]
    with pytest.raises(ValueError):
        tabular.query(sales, "region", "x", "like")
    with pytest.raises(ValueError):
        tabular.query(sales, "nope", "x")
    report = tabular.query_report(sales, "region", "North", order="date").first()
    assert report["count"] == 2 and [json.loads(m)["product"] for m in report.matches] == ["Mouse", "Cable"]


def test_aggregates(sales):
    one = lambda *a: tabular.aggregate(sales, *a).first().result
    assert one("quantity", "sum") == 12 and one("quantity", "avg") == 6 and one("quantity", "count") == 5
    assert one("price", "min") == 3 and one("price", "max") is None and one("product", "sum") is None
    by = lambda op: {r.category: r.result for r in tabular.aggregate(sales, "quantity", op, "category").collect()}
    assert by("sum") == {"Accessories": 10, "Electronics": 2} and by("count") == {"Accessories": 2, "Electronics": 1, "Furniture": 2}
    empty = sales.where("false")
    assert [tabular.aggregate(empty, "quantity", op).first().result for op in tabular.OPERATIONS] == [None] * 5
    assert tabular.aggregate(empty, "quantity", "median").first().result is None
    with pytest.raises(Exception, match="unknown aggregate operation: median"):
        tabular.aggregate(sales, "quantity", "median").collect()
    typed = sales.select(tabular.as_number(F.col("quantity")).alias("quantity"), "category")
    assert tabular.aggregate(typed, "quantity", "sum").first().result == 12
    assert tabular.query(typed, "quantity", "2", "gt", limit=None).count() == tabular.query(sales, "quantity", "2", "gt", limit=None).count()
    assert tabular.query(typed, "quantity", "two", "gt", limit=None).count() == 0


CATALOG = [("A", "Wired Mouse", "basic", "Mice", 10.0, 3, 0), ("B", "Board", "clicky mouse friend", "Keyboards", 50.0, 0, 1), ("C", "Hub", None, "Cables", None, None, 2), ("A", "Second A", "x", "Mice", 1.0, 9, 3), ("D", "Cam", "x", "Webcams", 10.0, -1, 4)]


@pytest.fixture(scope="module")
def goods(spark):
    return spark.createDataFrame(CATALOG, "sku string, name string, description string, category string, price double, stock long, place int")


def test_search(goods):
    ids = lambda **k: [r.place for r in lookup.search(goods, order="place", **k).collect()]
    assert ids(text="MOUSE") == [0, 1] and ids(category="mICE") == [0, 3] and ids(min_price=10, max_price=50) == [0, 1, 2, 4]
    assert ids(text="mouse", max_price=20) == [0] and ids(limit=0) == [0] and len(ids()) == 5


def test_stock_and_prices(spark, goods):
    asked = lookup.request_rows(spark, ["B", "A", "B", 7, "none", "C", "D"])
    rows = [tuple(r) for r in lookup.check_stock(asked, goods).orderBy("pos").collect()]
    assert rows == [(0, "B", "Board", 0, False, None), (1, "A", "Wired Mouse", 3, True, None), (2, "B", "Board", 0, False, None), (3, "none", None, None, None, "SKU not found"), (4, "C", "Hub", 0, False, None), (5, "D", "Cam", 0, False, None)]
    compared = lookup.compare_prices(lookup.request_rows(spark, ["A", "D", "B", "none"]), goods)
    assert [(r.sku, r.price) for r in compared.orderBy("pos").collect()] == [("A", 10.0), ("D", 10.0), ("B", 50.0), ("none", None)]
    assert tuple(lookup.price_extremes(compared).first()) == ("A", 10.0, "B", 50.0)
    ties = lookup.compare_prices(lookup.request_rows(spark, ["A", "D"]), goods)
    assert tuple(lookup.price_extremes(ties).first()) == ("A", 10.0, "D", 10.0)
    assert tuple(lookup.price_extremes(compared.where("false")).first()) == (None, None, None, None)


def test_ports_and_fans(spark):
    rows = spark.createDataFrame([(1, '{"a": 1, "b": [1, 2]}'), (2, "[]"), (3, '"x"')], "run_id int, j string").withColumn("v", F.parse_json("j"))
    assert {r.run_id: r.p for r in rows.select("run_id", F.to_json(dataflow.port_value(F.col("v"), "a")).alias("p")).collect()} == {1: "1", 2: "[]", 3: '"x"'}
    spread = dataflow.fan_out(spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "run_id int, xs array<string>"), "xs").orderBy("run_id", "fan_out_index")
    assert [tuple(r) for r in spread.collect()] == [(1, 0, "a"), (1, 1, "b"), (2, None, None), (3, None, None)]
    back = dataflow.fan_in_results(spark.createDataFrame([(1, 1, None, "bad"), (1, 0, "5", None), (1, 2, None, None)], "run_id int, fan_out_index int, result string, error string"), ["run_id"])
    assert back.first().results == ["5", '{"error":"bad","fan_out_index":1}', "null"]


def test_merging(spark):
    rows = spark.createDataFrame([(1, "x", "1", 0), (1, "x", "2", 5), (1, 'y"', "[3]", 2), (2, "x", "7", 0)], "run_id int, to_port string, value string, edge_ordinal int")
    got = {r.run_id: r.v for r in dataflow.merge_ports(rows, ["run_id"]).select("run_id", dataflow.merged_input(F.col("ports")).alias("v")).collect()}
    assert json.loads(got[1]) == {"x": 2, 'y"': [3]} and got[2] == "7"
    assert spark.range(1).select(dataflow.merged_input(F.lit(None).cast("map<string,string>")).alias("v")).first().v == "{}"


def test_readiness_and_status(spark):
    edges = spark.createDataFrame([("e1", "a", "c"), ("e2", "b", "c"), ("e3", "a", "d")], "edge_id string, from_node string, to_node string")
    status = spark.createDataFrame([(1, "a", "completed"), (1, "b", "failed"), (2, "a", "completed"), (2, "b", "running"), (3, "a", "failed"), (3, "b", "failed")], "run_id int, node_id string, state string")
    passed = spark.createDataFrame([(1, "e1"), (2, "e1"), (2, "e3")], "run_id int, edge_id string")
    assert {(r.run_id, r.node_id) for r in dataflow.ready_nodes(edges, status, passed).collect()} == {(1, "c"), (2, "d")}
    assert {(r.run_id, r.node_id) for r in dataflow.ready_nodes(edges, status, None).collect()} == {(1, "c"), (1, "d"), (2, "d")}
    states = spark.createDataFrame([(1, "a", "completed"), (1, "b", "completed"), (2, "a", "completed"), (3, "a", "failed"), (3, "b", "completed")], "run_id int, node_id string, state string")
    assert {r.run_id: r.status for r in dataflow.run_status(states, 2).collect()} == {1: "completed", 2: "failed", 3: "failed"}
    assert {r.status for r in dataflow.run_status(states, 2, F.lit(True)).collect()} == {"cancelled"}


def test_conversations(spark):
    turns = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", "c")], "run int, turn int, role string, content string")
    got = {r.run: [tuple(m) for m in r.messages] for r in dataflow.history(turns, ["run"], system="s").collect()}
    assert got == {1: [("system", "s"), ("user", "a"), ("assistant", "b")], 2: [("system", "s"), ("user", "c")]}
    more = spark.createDataFrame([(1, 0, "tool", "t"), (3, 0, "user", "n")], "run int, pos int, role string, content string")
    after = {r.run: [m.content for m in r.messages] for r in dataflow.append_turns(dataflow.history(turns, ["run"]), more, ["run"]).collect()}
    assert after == {1: ["a", "b", "t"], 2: ["c"], 3: ["n"]}
    calls = spark.createDataFrame([(1, '{"tool_calls": [{"id": "x"}]}'), (2, "[1, 2]"), (3, '{"a": 1}'), (4, "5")], "i int, j string")
    assert {r.i: r.n for r in calls.select("i", F.size(dataflow.tool_calls(F.parse_json("j"))).alias("n")).collect()} == {1: 1, 2: 2, 3: 0, 4: 0}


def event(run, seq, kind, **more):
    return {"run_id": run, "seq": seq, "event_type": kind, **more}


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        event("r1", 0, "run_started", flow_id="f", version_id="v1", inputs="{}"),
        event("r1", 1, "node_completed", node_id="n", outputs="early", duration_ms=1),
        event("r1", 2, "node_started", node_id="n", attempt=1, inputs="i1"),
        event("r1", 3, "node_failed", node_id="n", error="e1", will_retry=True, attempt=1),
        event("r1", 4, "node_started", node_id="n", attempt=2, inputs="i2"),
        event("r1", 5, "node_completed", node_id="n", outputs="o2", duration_ms=7),
        event("r1", 6, "node_started", node_id="m", attempt=1, inputs="i3", fan_out_index=0),
        event("r1", 7, "node_started", node_id="m", attempt=1, inputs="i4", fan_out_index=1),
        event("r1", 8, "node_completed", node_id="m", outputs="o0", fan_out_index=0, duration_ms=2),
        event("r1", 9, "node_failed", node_id="m", error="bad", will_retry=False, fan_out_index=1),
        event("r1", 10, "llm_invocation", node_id="n", model="b", input_tokens=3, output_tokens=1, tool_names=["z", "y"]),
        event("r1", 11, "llm_invocation", node_id="n", model="a", input_tokens=None, output_tokens=2, cost=0.5),
        event("r1", 12, "custom", name="x", data="d"),
        event("r1", 13, "run_completed", status="completed", duration_ms=99),
        event("r2", 0, "run_started", flow_id="f", version_id="v2"),
        event("r3", 0, "custom", name="y", data="d"),
        event("r4", 1, "run_completed", status="failed", duration_ms=1),
        event("r4", 2, "run_started", flow_id="g", version_id="v1"),
    ]
    return spark.createDataFrame([{c.split()[0]: r.get(c.split()[0]) for c in eventlog.EVENT.split(", ")} for r in rows], eventlog.EVENT)


def test_runs(log):
    got = {r.run_id: (r.status, r.flow_id, r.duration_ms) for r in eventlog.runs(log).collect()}
    assert got == {"r1": ("completed", "f", 99), "r2": ("running", "f", None), "r3": ("pending", None, None), "r4": ("running", "g", 1)}
    page, total = eventlog.filtered_runs(log, flow_id="f", offset=1, limit=5)
    assert [r.run_id for r in page.collect()] == ["r2"] and total.first().total == 2
    assert {r.version_id: r.n_runs for r in eventlog.runs_by_version(log, "f").collect()} == {"v1": 1, "v2": 1}


def test_crash_marks_sort_last(log):
    marks = eventlog.interrupted(log)
    assert {r.run_id for r in marks.collect()} == {"r2", "r4"}
    after = eventlog.runs(log.unionByName(marks, allowMissingColumns=True))
    assert {r.run_id: r.status for r in after.collect()}["r2"] == "interrupted"


def test_nodes(log):
    rows = {r.node_id: r for r in eventlog.node_results(log).collect()}
    n, m = rows["n"], rows["m"]
    assert (n.status, n.inputs, n.outputs, n.error, n.duration_ms, n.attempts) == ("completed", "i2", "o2", None, 7, 2)
    assert (m.status, m.inputs, m.outputs, m.error) == ("failed", "i4", "o0", "bad")
    detail = [tuple(r)[1:] for r in eventlog.node_details(log).orderBy("node_id", "ordinal").collect()]
    assert detail == [("m", 0, 1, 0, "i3", "o0", None, 2), ("m", 1, 1, 1, "i4", None, "bad", None), ("n", 0, 1, None, "i1", None, "e1", None), ("n", 1, 2, None, "i2", "o2", None, 7)]
    assert eventlog.node_details(log.where("false")).count() == 0


def test_model_use_and_custom_events(log):
    s = eventlog.llm_summary(log).first()
    assert (s.n_calls, s.input_tokens, s.output_tokens, s.cost, s.models, s.tools) == (2, 3, 3, 0.5, ["a", "b"], ["y", "z"])
    assert [r.run_id for r in eventlog.custom_events(log, "y").collect()] == ["r3"]
    assert eventlog.llm_invocations(log, "none").count() == 0


def test_topology(spark, log):
    assert [tuple(r) for r in eventlog.topology_chain(log).collect()] == [("r1", "m", "n")]
    steps = spark.createDataFrame([("r", 2, "b", "a"), ("r", 1, "a", "b"), ("r", 3, "a", "b")], "run_id string, ord int, from_node string, to_node string")
    row = eventlog.topology_from_transitions(steps).first()
    assert [tuple(e) for e in row.edges] == [("a", "b"), ("b", "a"), ("a", "b")] and row.nodes == ["a", "b"]


def test_pairing(spark):
    rows = [("r", "n", "llm", 0, "end", "e0"), ("r", "n", "llm", 1, "start", "s1"), ("r", "n", "llm", 2, "start", "s2"), ("r", "n", "tool", 3, "start", "t"), ("r", "n", "llm", 4, "end", "e4"), ("r", "n", "llm", 5, "end", "e5")]
    got = eventlog.paired(spark.createDataFrame(rows, "run_id string, node_id string, kind string, ord int, phase string, payload string")).orderBy("ord").collect()
    assert [(r.request, r.response) for r in got] == [("{}", "e0"), ("s2", "e4"), ("{}", "e5")]


def test_stream_chunks(spark):
    names = "call_id string, ord int, kind string, text string, tool_index int, tool_id string, tool_name string, input_tokens long, output_tokens long, finish_reason string"
    rows = [("c", 1, "text_delta", "lo", None, None, None, None, None, None), ("c", 0, "text_delta", "Hel", None, None, None, None, None, None), ("c", 2, "tool_call_delta", '{"a":', 1, "id1", "t1", None, None, None), ("c", 3, "tool_call_delta", "1}", 1, None, None, None, None, None), ("c", 4, "tool_call_delta", "broken", 0, "id0", "t0", None, None, None), ("c", 5, "done", None, None, None, None, 4, 6, "tool_calls"), ("d", 0, "text_delta", "x", None, None, None, None, None, None)]
    got = {r.call_id: r for r in eventlog.stream_chunks_folded(spark.createDataFrame(rows, names)).collect()}
    assert got["c"].content == "Hello" and [tuple(x) for x in got["c"].tool_calls] == [("id0", "t0", "{}"), ("id1", "t1", '{"a":1}')]
    assert (got["c"].total_tokens, got["c"].finish_reason) == (10, "tool_calls")
    assert (got["d"].content, got["d"].total_tokens, got["d"].finish_reason) == ("x", None, "stop")


def test_redacted_log(spark, log):
    policy = spark.createDataFrame([("n", "secret", "masked")], "node_id string, inputs_sensitivity string, outputs_sensitivity string")
    rows = {r.seq: r for r in eventlog.redacted(log.where("run_id = 'r1'"), policy).collect()}
    assert rows[4].inputs == "[REDACTED]" and rows[5].outputs == "[MASKED]" and rows[6].inputs == "i3" and rows[3].inputs is None


def test_stores(spark):
    stored = spark.createDataFrame([("r", 1)], "run_id string, seq int")
    batch = spark.createDataFrame([("r", 1), ("r", 2), ("r", 2)], "run_id string, seq int")
    keys = ["run_id", "seq"]
    assert stores.new_rows(stored, batch, keys).count() == 1 and stores.new_rows(stored, batch, keys, within=False).count() == 2
    assert stores.insert_ignore(stored, batch, keys).count() == 2
    changes = spark.createDataFrame([("f", "t", "v1", 1, False), ("f", "t", "v2", 2, False), ("f", "u", "v1", 1, False), ("f", "u", None, 3, True), ("f", "w", None, 1, True)], "flow_id string, tag string, version_id string, updated_at int, deleted boolean")
    assert [tuple(r) for r in stores.tags(changes).select("tag", "version_id").collect()] == [("t", "v2")]
    assert {r.tag: r.existed for r in stores.tag_deletions(changes).collect()} == {"u": True, "w": False}


def test_saved_versions(spark):
    heads = spark.createDataFrame([("f", "F", "h0", 0)], "flow_id string, name string, current_version_id string, updated_at int")
    versions = spark.createDataFrame([], "version_id string, flow_id string, graph string, created_at int")
    h1, v1 = stores.saved_versions(heads, versions, spark.createDataFrame([("f", "F", "g1", 1), ("f", "F", "g2", 2)], "flow_id string, name string, graph string, created_at int"))
    h2, v2 = stores.saved_versions(h1, v1, spark.createDataFrame([("f", "F", "g1", 3), ("o", "O", "g2", 4)], "flow_id string, name string, graph string, created_at int"))
    assert v2.count() == 2 and [r.graph for r in stores.current_versions(h2, v2).collect()] == ["g2"]
    assert [r.graph for r in stores.version_history(v2, "f").collect()] == ["g2", "g1"]
    a, b = (r.version_id for r in v2.orderBy("created_at").collect())
    assert tuple(stores.version_pair(v2, a, b).first()) == ("g1", "g2")
    with pytest.raises(Exception, match="version not found: none"):
        stores.version_pair(v2, a, "none").collect()


def test_triggers(spark):
    rows = spark.createDataFrame([("f", None, "{}", "s", "k", 2), ("f", None, "{}", "first", "k", 1), ("f", "v9", "{}", "s", None, 3), ("f", "gone", "{}", "s", None, 4), ("x", None, "{}", "s", None, 5)], "flow_id string, version_id string, inputs string, source string, idempotency_key string, ts int")
    kept = triggers.once(rows)
    assert kept.count() == 4 and kept.where("idempotency_key = 'k'").first().source == "first"
    heads = spark.createDataFrame([("f", "v1")], "flow_id string, current_version_id string")
    versions = spark.createDataFrame([("v1",), ("v9",)], "version_id string")
    assert sorted(r.version_id for r in triggers.resolved(kept, heads, versions).collect()) == ["v1", "v9"]
    assert triggers.http_route("/a", "put") == ("/a", "PUT")
    with pytest.raises(ValueError):
        triggers.http_route("a")


def raw(spark, *payloads):
    return spark.createDataFrame([("run", i, json.dumps(p)) for i, p in enumerate(payloads)], "run_id string, ord int, raw string")


def test_langchain(spark):
    rows = raw(
        spark,
        {"callback": "on_llm_start", "run_id": "a", "prompts": ["p"], "serialized": {"id": ["langchain_ollama", "ChatOllama"], "repr": "ChatOllama(model='m3')"}},
        {"callback": "on_llm_start", "run_id": "a", "model": "given", "provider": "own", "serialized": {"kwargs": {"model_name": "k"}}},
        {"callback": "on_llm_start", "serialized": {"kwargs": {"kwargs": {"model": "deep"}}}},
        {"callback": "on_llm_end", "run_id": "a", "duration_ms": 12, "response": {"generations": [[{"text": "hi", "generation_info": {"model": "g"}}]], "llm_output": {"token_usage": {"prompt_tokens": 1}}}},
        {"callback": "on_tool_start", "run_id": "t", "serialized": {"name": "calc"}, "input_str": "1+1"},
        {"callback": "on_tool_end", "run_id": "t", "output": {"v": 2}},
        {"callback": "on_chain_end", "serialized": {"id": ["x", "Seq"]}, "outputs": {"o": 1}},
        {"callback": "other"},
        {"no": 1},
    )
    got = {r.ord: r for r in adapters.translated(rows, "langchain").collect()}
    assert set(got) == set(range(7))
    request = json.loads(got[0].payload)
    assert request == {"messages": ["p"], "model": "m3", "provider": "ollama"} and got[0].node_id == "a"
    assert json.loads(got[1].payload)["model"] == "given" and json.loads(got[1].payload)["provider"] == "own"
    assert json.loads(got[2].payload)["model"] == "deep" and got[2].node_id == "unknown"
    end = json.loads(got[3].payload)
    assert (end["content"], end["model"], end["usage"]["prompt_tokens"], end["usage"]["total_tokens"]) == ("hi", "g", 1, None) and got[3].duration_ms == 12
    assert (got[4].name, got[4].payload) == ("calc", '"1+1"') and (got[5].name, got[5].payload) == ("unknown", '{"v":2}')
    assert (got[6].type, got[6].name) == ("step_end", "Seq")
    log = {r.ord: r for r in adapters.recorded(adapters.translated(rows, "langchain")).collect()}
    assert log[5].name == "calc" and log[5].inputs == '"1+1"' and log[6].name == "Seq_end"


def test_other_frameworks(spark):
    rows = raw(spark, {"callback": "node_start", "node": "n", "state": {"a": 1}}, {"callback": "edge", "from": "a"}, {"callback": "state_update", "updates": {}}, {"callback": "on_llm_end", "node": "n", "response": {"x": 1}, "duration_ms": 3})
    got = {r.ord: r for r in adapters.translated(rows, "langgraph").collect()}
    assert (got[0].type, got[0].name, got[0].payload) == ("step_start", "n", '{"a":1}')
    assert (got[1].from_node, got[1].to_node) == ("a", "unknown") and got[2].name == "state_state_update" and got[3].duration_ms == 3
    rows = raw(spark, {"callback": "function_invoked", "plugin_name": "p", "function_name": "f", "result": 4}, {"callback": "prompt_rendered", "rendered_prompt": "t"}, {"callback": "on_llm_start", "request": {"q": 1}})
    got = {r.ord: r for r in adapters.translated(rows, "semantic_kernel").collect()}
    assert (got[0].type, got[0].node_id, got[0].name, got[0].payload) == ("tool_end", "p.f", "f", "4")
    assert (got[1].type, got[1].name) == ("step_end", "prompt_rendering") and got[2].node_id == "llm"
    visits = spark.createDataFrame([("r", 0, "a"), ("r", 1, "a"), ("r", 2, "b")], "run_id string, ord int, node string")
    assert [tuple(r) for r in adapters.node_changes(visits).collect()] == [("r", 2, "a", "b")]


def test_numbering_and_abandoned_runs(spark, log):
    fresh = spark.createDataFrame([("r1", 5), ("r1", 4), ("new", 1)], "run_id string, arrival int")
    assert {(r.run_id, r.arrival): r.seq for r in eventlog.numbered(fresh, log).collect()} == {("r1", 4): 14, ("r1", 5): 15, ("new", 1): 0}
    timed = log.withColumn("ts", F.timestamp_seconds(F.col("seq") + F.when(F.col("run_id") == "r2", 1000).otherwise(0)))
    marks = eventlog.abandoned(timed, F.timestamp_seconds(F.lit(100))).collect()
    assert [(r.run_id, r.seq, r.status, r.duration_ms) for r in marks] == [("r4", 3, "failed", 0)]


def test_model_calls(spark):
    rows = spark.createDataFrame([(1, '"hi"'), (2, '[{"role": "user", "content": "a"}, {"content": 5}]'), (3, '{"role": "tool", "content": "t"}'), (4, '{"q": 1}')], "i int, j string")
    made = rows.withColumn("m", models.input_messages(F.parse_json("j"), system="s"))
    got = {r.i: [tuple(m) for m in r.m] for r in made.collect()}
    assert got == {1: [("system", "s"), ("user", "hi")], 2: [("system", "s"), ("user", "a"), ("user", "5")], 3: [("system", "s"), ("tool", "t")], 4: [("system", "s"), ("user", '{"q":1}')]}

    def echo(requests):
        return [(None, "down") if "hi" in r else (json.dumps({"content": json.loads(r)["model"], "tool_calls": [{"id": 1}]}), None) for r in requests]

    asked = made.select("i", models.request("p", "m1", F.col("m"), temperature=0.5).alias("request"))
    done = {r.i: r for r in models.called(asked, echo, batch=2).withColumn("out", models.outputs(F.col("answer"))).collect()}
    assert done[1].error == "down" and done[1].answer is None
    assert json.loads(done[2].out) == {"content": "m1", "finish_reason": "stop", "tool_calls": [{"id": 1}]}
    assert json.loads(done[2].request)["temperature"] == 0.5
    tools = spark.createDataFrame([("a",), ("b",)], "name string")
    assert models.chosen_tools(tools, ["b"]).count() == 1 and models.chosen_tools(tools, enabled=False).count() == 0


def test_http_outcomes(spark):
    rows = spark.createDataFrame([(1, 200, '{"a": 1}'), (2, 204, 'plain "x"'), (3, 500, "x"), (4, None, None), (5, 404, "x")], "i int, status int, body string")
    got = {r.i: tuple(r.o) for r in rows.select("i", models.http_outcome(F.col("status"), F.col("body")).alias("o")).collect()}
    assert got == {1: ("ok", '{"a": 1}'), 2: ("ok", '"plain \\"x\\""'), 3: ("retryable", None), 4: ("retryable", None), 5: ("fatal", None)}
