from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from dagframe.functions import variants
from dagframe.operators.eventlog import EVENT, runs, stream_chunks_folded
from dagframe.plans.graph import Edge, Graph, Node, back_edges, config_hash, entry_nodes, problems, version_id
from dagframe.plans.flow import Flow, scalar
from dagframe.sources import files, model_streams
from dagframe.streaming import log as streams


def nodes(*names):
    return tuple(Node(n, "conditional") for n in names)


def test_csv(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text('a,b,c\n1,,"x ""q"" y"\n2,"two\nlines",\\z\n')
    assert [tuple(r) for r in files.csv_table(spark, str(good), multi_line=True).collect()] == [("1", "", 'x "q" y'), ("2", "two\nlines", "\\z")]
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b\n1,2\n3\n4,5,6\n")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
        files.csv_table(spark, str(bad)).select("a").collect()
    assert files.csv_table(spark, str(bad), strict=False).count() == 3
    assert spark.conf.get("spark.sql.csv.parser.columnPruning.enabled") == "true"


def test_appends_read_only_the_folders_of_their_runs(spark, tmp_path):
    path = str(tmp_path / "log")
    batch = lambda runs, seqs: spark.createDataFrame([(f"r{r}", s) for r in runs for s in seqs], "run_id string, seq long")
    files.append_events(spark, batch(range(40), [0, 1]), path)
    folders = {p.name for p in (tmp_path / "log").iterdir() if p.is_dir()}
    assert len(folders) > 20
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "log").rglob("*.parquet")}
    files.append_events(spark, batch([3, 3], [1, 2]), path)
    fresh = [p for p in (tmp_path / "log").rglob("*.parquet") if p not in before]
    assert len({p.parent.name for p in fresh}) == 1
    rows = files.log_table(spark, path)
    assert rows.count() == 81 and [r.seq for r in files.log_table(spark, path, "r3").collect()] == [0, 1, 2]
    plan = files.log_table(spark, path, "r3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_two_back_edges_have_limits_of_their_own(spark):
    """y leads back to x while n is below the run's limit, x to itself while n is 1."""
    from dagframe import catalog_more

    inputs = spark.createDataFrame([(str(k), f'{{"n": 2, "limit": {k}}}') for k in range(30)], "run_id string, value string")
    outputs, _ = Flow(catalog_more._TWO_LOOPS, {"add": scalar(catalog_more._add)}, max_traversals=5).run(inputs)
    got = {int(r.run_id): r.n for r in outputs["y"].selectExpr("run_id", "cast(get_json_object(value, '$.n') as long) AS n").collect()}
    # from 2 on b2 never passes: y ends at 4, then 2 more each time it goes back, 5 times at most
    assert got == {k: 4 + 2 * min(5, max(0, -(-(k - 4) // 2))) for k in range(30)}
    first = spark.createDataFrame([("r", '{"n": 0, "limit": 100}')], "run_id string, value string")
    ended = Flow(catalog_more._TWO_LOOPS, {"add": scalar(catalog_more._add)}, max_traversals=5).run(first)[0]["y"].first().value
    # b2 wins x's port the first time, when both lead there; y goes back four times more
    assert json.loads(ended)["n"] == 3 + 2 * 4


def test_json_files(spark, tmp_path):
    (tmp_path / "array.json").write_text(json.dumps([{"sku": "a", "price": 1.5}, {"sku": "b"}], indent=1))
    assert [tuple(r) for r in files.json_array(spark, str(tmp_path / "array.json"), "sku string, price double").collect()] == [("a", 1.5), ("b", None)]
    (tmp_path / "lines.jsonl").write_text('{"run_id": "r", "seq": 2}\n\n{"run_id": "r", "seq": 1}\n')
    assert [r.seq for r in files.event_log(spark, str(tmp_path / "lines.jsonl"), "r").collect()] == [1, 2]
    (tmp_path / "broken.jsonl").write_text('{"run_id": "r", "seq": 2}\n{oops\n')
    with pytest.raises(Exception):
        files.event_log(spark, str(tmp_path / "broken.jsonl")).collect()
    folder = tmp_path / "flows" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text('{"id": "a"}')
    (folder / "b.json").write_text("{oops")
    assert [r.id for r in files.records(spark, str(tmp_path / "flows"), "id string").where("id is not null").collect()] == ["a"]


def test_appending_twice_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    batch = spark.createDataFrame([("r", 1, "custom"), ("r", 1, "custom"), ("r", 2, "custom")], "run_id string, seq long, event_type string")
    for _ in range(2):
        files.append_events(spark, batch, path)
    assert files.log_table(spark, path).count() == 2
    plan = files.log_table(spark, path, "r")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(run_id,r)" in plan


def test_streamed_log_is_the_batch_log(spark, tmp_path):
    source, path, checkpoint = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "cp")
    source.mkdir()
    rows = [{"run_id": "r1", "seq": 0, "event_type": "run_started", "flow_id": "f"}, {"run_id": "r1", "seq": 1, "event_type": "run_completed", "status": "completed", "duration_ms": 4}, {"run_id": "r2", "seq": 0, "event_type": "run_started", "flow_id": "f"}]
    (source / "1.json").write_text("\n".join(map(json.dumps, rows[:2])))
    stream = lambda: streams.append_stream(streams.once(streams.log_stream(spark, str(source))), path, checkpoint, available_now=True)
    stream().awaitTermination()
    (source / "2.json").write_text("\n".join(map(json.dumps, [rows[2], rows[0]])))
    stream().awaitTermination()
    stored = files.log_table(spark, path)
    assert stored.count() == 3
    assert {r.run_id: r.status for r in runs(stored).collect()} == {"r1": "completed", "r2": "running"}
    live = streams.live_runs(streams.log_stream(spark, str(source))).writeStream.outputMode("complete").format("memory").queryName("live_view").trigger(availableNow=True).start()
    live.awaitTermination()
    assert {r.run_id: r.status for r in spark.table("live_view").collect()} == {"r1": "completed", "r2": "running"}


def test_streamed_triggers(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [{"flow_id": "f", "idempotency_key": "k"}, {"flow_id": "f", "idempotency_key": "k"}, {"flow_id": "f"}, {"flow_id": "f"}]
    (source / "1.json").write_text("\n".join(map(json.dumps, rows)))
    df = spark.readStream.schema("flow_id string, idempotency_key string").json(str(source))
    q = streams.trigger_stream(df).writeStream.format("memory").queryName("trigger_view").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("trigger_view").count() == 3


def lines(spark, *texts):
    return spark.createDataFrame([("c", i, t) for i, t in enumerate(texts)], "call_id string, ord int, line string")


def test_model_streams(spark):
    folded = lambda df: stream_chunks_folded(df).first()
    data = lambda *xs: [f"data: {json.dumps(x)}" for x in xs]
    a = folded(model_streams.openai_chunks(lines(spark, ": ping", *data({"choices": [{"delta": {"content": "He"}}]}, {"choices": [{"delta": {"content": "y", "tool_calls": [{"index": 0, "id": "t", "function": {"name": "f", "arguments": "{}"}}]}, "finish_reason": "stop"}]}, {"choices": [], "usage": {"prompt_tokens": 2, "completion_tokens": 3}}), "data: [DONE]", *data({"choices": [{"delta": {"content": "late"}}]}))))
    assert (a.content, a.total_tokens, a.finish_reason, a.tool_calls[0].tool_name) == ("Hey", 5, "stop", "f")
    b = folded(model_streams.anthropic_chunks(lines(spark, "event: x", *data({"type": "message_start", "message": {"usage": {"input_tokens": 7}}}, {"type": "content_block_delta", "delta": {"text": "Hi"}}, {"type": "message_delta", "delta": {"stop_reason": "end_turn"}, "usage": {"output_tokens": 2}}, {"type": "message_stop"}, {"type": "content_block_delta", "delta": {"text": "late"}}))))
    assert (b.content, b.input_tokens, b.output_tokens, b.finish_reason) == ("Hi", 7, 2, "end_turn")
    c = folded(model_streams.gemini_chunks(lines(spark, *data({"candidates": [{"content": {"parts": [{"text": "a"}, {"text": "b"}]}}]}, {"candidates": [{"content": {"parts": []}, "finishReason": "STOP"}], "usageMetadata": {"promptTokenCount": 1, "candidatesTokenCount": 2}}))))
    assert (c.content, c.total_tokens, c.finish_reason) == ("ab", 3, "stop")
    d = folded(model_streams.ollama_chunks(lines(spark, json.dumps({"message": {"content": "x"}, "done": False}), "", json.dumps({"done": True, "prompt_eval_count": 4, "eval_count": 1}), json.dumps({"message": {"content": "late"}}))))
    assert (d.content, d.total_tokens, d.finish_reason) == ("x", 5, "stop")
    with pytest.raises(Exception):
        model_streams.openai_chunks(lines(spark, "data: {oops")).collect()
    calls = spark.createDataFrame([("c", "abcdefgh", 3, 4)], "call_id string, text string, prompt_tokens int, completion_tokens int")
    cut = model_streams.simulated_chunks(calls, 3).orderBy("ord").collect()
    assert [r.text for r in cut] == ["ab", "cd", "efgh"] and [r.input_tokens for r in cut] == [None, None, 3]
    assert stream_chunks_folded(model_streams.simulated_chunks(calls, 3)).first().content == "abcdefgh"


def test_response_files(spark, tmp_path):
    (tmp_path / "one").write_text("data: a\r\ndata: b\nunfinished", newline="")
    assert [r.line for r in model_streams.response_lines(spark, str(tmp_path)).orderBy("ord").collect()] == ["data: a", "data: b"]


def test_graph_analysis():
    diamond = Graph("g", nodes("a", "b", "c", "d"), (Edge("1", "a", "b"), Edge("2", "a", "c"), Edge("3", "b", "d"), Edge("4", "c", "d")))
    assert problems(diamond) == [] and entry_nodes(diamond) == ["a"] and back_edges(diamond) == set()
    loop = Graph("g", nodes("a", "b", "c"), (Edge("1", "a", "b"), Edge("2", "b", "c"), Edge("3", "c", "a")))
    assert back_edges(loop) == {"3"} and entry_nodes(loop) == ["a"]
    own = Graph("g", nodes("a", "b"), (Edge("1", "a", "a"), Edge("2", "a", "b")))
    assert back_edges(own) == {"1"} and entry_nodes(own) == ["a"]
    broken = Graph("g", (*nodes("a", "a"),), (Edge("1", "a", "x"), Edge("1", "a", "a")))
    assert len(problems(broken)) == 3 and problems(Graph("g", ())) == ["graph has no nodes"]


def test_hashes():
    a, b = Node("a", "t", {"model": "m", "api_key": "s1"}), Node("b", "t", {"nested": [{"PASSWORD_X": 1, "v": 2}]})
    one, other = Graph("g", (a, b)), Graph("g", (b, a))
    assert version_id(one) != version_id(other) and config_hash(one) == config_hash(other)
    rotated = Graph("g", (Node("a", "t", {"model": "m", "api_key": "s2"}), b))
    assert version_id(rotated) != version_id(one) and config_hash(rotated) == config_hash(one)
    assert config_hash(Graph("g", (Node("a", "t", {"model": "n", "api_key": "s1"}), b))) != config_hash(one)
    assert Graph.from_json(one.to_json()) == one


@pytest.fixture(scope="module")
def inputs(spark):
    return spark.createDataFrame([("r1", '{"n": 1}'), ("r2", '{"n": 5}')], "run_id string, value string")


def values(df):
    return {r.run_id: json.loads(r.value) for r in df.collect()}


def plus(value, config):
    v = F.parse_json(value)
    return F.to_json(F.struct((variants.as_double(variants.field(v, "n")) + F.lit((config or {}).get("by", 1))).cast("long").alias("n")))


def test_linear_branch_and_merge(spark, inputs):
    graph = Graph("g", (Node("in", "conditional"), Node("up", "plus", {"by": 10}), Node("down", "plus", {"by": -10}), Node("out", "conditional")), (Edge("1", "in", "up", condition="n < 3"), Edge("2", "in", "down", condition="n >= 3"), Edge("3", "up", "out", to_port="x"), Edge("4", "down", "out", to_port="x")))
    outputs, status = Flow(graph, {"plus": scalar(plus)}).run(inputs)
    assert values(outputs["up"]) == {"r1": {"n": 11}} and values(outputs["out"]) == {"r1": {"n": 11}, "r2": {"n": -5}}
    assert {r.run_id: r.status for r in status.collect()} == {"r1": "failed", "r2": "failed"}
    both = Graph("g", (Node("in", "conditional"), Node("a", "plus", {"by": 1}), Node("b", "plus", {"by": 2}), Node("out", "conditional")), (Edge("1", "in", "a"), Edge("2", "in", "b"), Edge("3", "a", "out", to_port="left"), Edge("4", "b", "out", to_port="right")))
    outputs, status = Flow(both, {"plus": scalar(plus)}).run(inputs)
    assert values(outputs["out"])["r1"] == {"left": {"n": 2}, "right": {"n": 3}}
    assert {r.status for r in status.collect()} == {"completed"}
    last = Graph("g", both.nodes, (*both.edges[:2], Edge("3", "a", "out", to_port="p"), Edge("4", "b", "out", to_port="p")))
    assert values(Flow(last, {"plus": scalar(plus)}).run(inputs)[0]["out"])["r1"] == {"n": 3}


def test_fan_out_and_ports(spark):
    inputs = spark.createDataFrame([("r1", '{"items": [{"n": 1}, {"n": 2}], "other": 5}'), ("r2", '{"items": []}')], "run_id string, value string")
    graph = Graph("g", (Node("in", "conditional"), Node("each", "plus", {"fan_out": True})), (Edge("1", "in", "each", from_port="items"),))
    outputs, _ = Flow(graph, {"plus": scalar(lambda v, c: F.when(F.get_json_object(v, "$.n").isNull(), v).otherwise(plus(v, c)))}).run(inputs)
    assert values(outputs["each"]) == {"r1": [{"n": 2}, {"n": 3}], "r2": []}


def test_cycles_stop_at_their_condition_or_cap(spark, inputs):
    graph = Graph("g", (Node("in", "conditional"), Node("step", "plus"), Node("out", "conditional")), (Edge("1", "in", "step"), Edge("2", "step", "step", condition="n < 4"), Edge("3", "step", "out", condition="n >= 4")))
    outputs, status = Flow(graph, {"plus": scalar(plus)}).run(inputs)
    assert values(outputs["out"]) == {"r1": {"n": 4}, "r2": {"n": 6}} and {r.status for r in status.collect()} == {"completed"}
    capped, _ = Flow(graph, {"plus": scalar(plus)}, max_traversals=1).run(inputs)
    assert values(capped["step"]) == {"r1": {"n": 3}, "r2": {"n": 6}}


def test_tool_router_and_unknown_types(spark):
    graph = Graph("g", (Node("r", "tool_router"),))
    rows = spark.createDataFrame([("a", '{"tool_calls": [{"id": 1}]}'), ("b", "[2]"), ("c", "{}")], "run_id string, value string")
    assert values(Flow(graph).run(rows)[0]["r"]) == {"a": [{"id": 1}], "b": [2], "c": []}
    with pytest.raises(ValueError, match="unknown node types"):
        Flow(Graph("g", (Node("x", "nope"),)))
    with pytest.raises(ValueError, match="no nodes"):
        Flow(Graph("g", ()))


def test_event_schema_has_the_log_columns():
    assert [c.split()[0] for c in EVENT.split(", ")][:4] == ["run_id", "seq", "event_type", "ts"]


def test_topics(spark, tmp_path):
    from dagframe.streaming import queues

    root = str(tmp_path)
    queues.publish(spark.createDataFrame([("a", 1)], "k string, v int"), root, "t1")
    queues.publish(spark.createDataFrame([("b", 2)], "k string, v int"), root, "t1")
    q = queues.subscribe(spark, root, "t1", "k string, v int").writeStream.format("memory").queryName("topic_view").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.k for r in spark.table("topic_view").collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        queues.publish(spark.range(1), root, "../x")


def test_human_answers_meet_their_nodes(spark, tmp_path):
    rows = {"asked": [{"run_id": "r", "node_id": "n", "ts": "2024-01-01T00:00:00"}, {"run_id": "r", "node_id": "late", "ts": "2024-01-01T00:00:00"}], "answers": [{"run_id": "r", "node_id": "n", "ts": "2024-01-01T00:10:00", "value": "yes"}, {"run_id": "r", "node_id": "late", "ts": "2024-01-01T02:00:00", "value": "no"}, {"run_id": "x", "node_id": "n", "ts": "2024-01-01T00:10:00", "value": "other"}]}
    for name, lines_ in rows.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "1.json").write_text("\n".join(map(json.dumps, lines_)))
    stream = lambda name: spark.readStream.schema("run_id string, node_id string, ts timestamp, value string").json(str(tmp_path / name))
    q = streams.awaited(stream("asked"), stream("answers")).writeStream.format("memory").queryName("answer_view").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.run_id, r.node_id, r.value) for r in spark.table("answer_view").collect()] == [("r", "n", "yes")]


def test_chains_and_ticks_have_their_shape(spark, tmp_path):
    events = streams.log_stream(spark, str(tmp_path))
    assert streams.chain_stream(events, "a", "b").isStreaming
    assert streams.cron_stream(spark, "f", 60).columns == ["flow_id", "inputs", "idempotency_key", "ts"]
