"""Views of the event log: runs, nodes, edges, model use, topology.

A log row has run_id, seq, event_type, ts and the columns of EVENT that its type uses. Rows of a
run are in order by seq; a synthetic ``interrupted`` completion has the largest seq there is.
Every view groups by run (or run and node) with partial aggregation, and filters on run_id,
flow_id or event_type reach the scan.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a log; payload columns are JSON texts.
EVENT = (
    "run_id string, seq long, event_type string, ts timestamp, node_id string, edge_id string, attempt int, fan_out_index int, duration_ms long, status string, flow_id string, version_id string, parent_run_id string, "
    "inputs string, outputs string, error string, will_retry boolean, condition string, result boolean, name string, data string, model string, input_tokens long, output_tokens long, cost double, tool_names array<string>"
)
LAST = 2**63 - 1
#: Event types that may be dropped under pressure.
ADVISORY = ("llm_stream_chunk", "custom", "topology_hint")


def is_critical(event_type: Column) -> Column:
    return ~event_type.isin(*ADVISORY)


def of_type(log: DataFrame, *types: str) -> DataFrame:
    return log.where(F.col("event_type").isin(*types))


def deduplicated(log: DataFrame) -> DataFrame:
    """One row for each run and seq."""
    return log.dropDuplicates(["run_id", "seq"])


def runs(log: DataFrame) -> DataFrame:
    """One row for each run: identity from the last start, outcome from the last completion, status from the later of the two; ``pending`` without either."""
    start, end = F.col("event_type") == "run_started", F.col("event_type") == "run_completed"
    first = F.max(F.when(start, F.struct("seq", "flow_id", "version_id", "parent_run_id", "inputs", "ts")))
    last = F.max(F.when(end, F.struct("seq", "status", "duration_ms", "ts")))
    folded = log.groupBy("run_id").agg(first.alias("s"), last.alias("e"), F.count(F.lit(1)).alias("n_events"))
    status = F.when(F.col("s").isNull() & F.col("e").isNull(), "pending").when(F.col("e").isNotNull() & (F.col("s").isNull() | (F.col("e.seq") > F.col("s.seq"))), F.col("e.status")).otherwise("running")
    return folded.select("run_id", "s.flow_id", "s.version_id", "s.parent_run_id", "s.inputs", F.col("s.ts").alias("started_at"), F.col("e.ts").alias("completed_at"), F.col("e.duration_ms").alias("duration_ms"), status.alias("status"), "n_events")


def filtered_runs(log: DataFrame, flow_id: str | None = None, status: str | None = None, version_id: str | None = None, parent_run_id: str | None = None, offset: int = 0, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(a page of runs by run_id, one row with total before paging)."""
    found = runs(log)
    for column, value in (("flow_id", flow_id), ("status", status), ("version_id", version_id), ("parent_run_id", parent_run_id)):
        if value is not None:
            found = found.where(F.col(column) == value)
    page = found.orderBy("run_id").offset(offset)
    return (page if limit is None else page.limit(limit)), found.agg(F.count(F.lit(1)).alias("total"))


def node_results(log: DataFrame) -> DataFrame:
    """For each run and node: status, inputs of the last start, highest attempt, last outputs and duration, last final error.

    What ends before the first start is ignored; a new start neither resets the status nor clears an error.
    """
    kind = F.col("event_type")
    nodes = of_type(log, "node_started", "node_completed", "node_failed")
    ends = F.when((kind == "node_completed") | ((kind == "node_failed") & ~F.coalesce("will_retry", F.lit(False))), F.struct("seq", kind.alias("kind")))
    folded = nodes.groupBy("run_id", "node_id").agg(
        F.min(F.when(kind == "node_started", F.col("seq"))).alias("first"),
        F.max(F.when(kind == "node_started", F.struct("seq", "inputs"))).alias("start"),
        F.max(F.when(kind == "node_started", F.col("attempt"))).alias("attempts"),
        F.max(ends).alias("end"),
        F.max(F.when(kind == "node_completed", F.struct("seq", "outputs", "duration_ms"))).alias("done"),
        F.max(F.when((kind == "node_failed") & ~F.coalesce("will_retry", F.lit(False)), F.struct("seq", "error"))).alias("fail"),
    )
    later = lambda c: F.col(f"{c}.seq") > F.col("first")
    status = F.when(later("end"), F.when(F.col("end.kind") == "node_completed", "completed").otherwise("failed")).otherwise("running")
    return folded.where("first is not null").select("run_id", "node_id", status.alias("status"), "start.inputs", F.when(later("done"), F.col("done.outputs")).alias("outputs"), F.when(later("fail"), F.col("fail.error")).alias("error"), F.when(later("done"), F.col("done.duration_ms")).alias("duration_ms"), "attempts")


NODE_DETAIL = "run_id string, node_id string, ordinal int, attempt int, fan_out_index int, inputs string, outputs string, error string, duration_ms long"


def node_details(log: DataFrame) -> DataFrame:
    """Every attempt of every node; ordinal is its place in order of start.

    A completion ends the latest open attempt with its fan-out index, a failure the latest open
    one of any index. Rows are dealt by run and node and sorted, and each task goes through them
    once, with the open attempts of one node in hand.
    """
    names = [c.split()[0] for c in NODE_DETAIL.split(", ")]
    kinds = {"ordinal": "int32", "attempt": "Int32", "fan_out_index": "Int32", "duration_ms": "Int64"}
    columns = ("run_id", "node_id", "event_type", "attempt", "fan_out_index", "inputs", "outputs", "error", "duration_ms")

    def frame(rows: list[list]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype(kinds)

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, started, latest = None, 0, itertools.count()
        # open attempts by fan-out index, in order of start, each with a number that grows
        open_: dict[int | None, list[tuple[int, list]]] = {}
        for batch in batches:
            done: list[list] = []
            plain = batch.astype(object).where(batch.notna(), None)
            for run, node, kind, attempt, index, inputs, outputs, error, took in zip(*(plain[c] for c in columns), strict=True):
                if (run, node) != key:
                    done += [a for held in open_.values() for _, a in held]
                    key, started, open_ = (run, node), 0, {}
                if kind == "node_started":
                    open_.setdefault(index, []).append((next(latest), [run, node, started, attempt, index, inputs, None, None, None]))
                    started += 1
                    continue
                ended = kind == "node_completed"
                at = index if ended else max(open_, key=lambda i: open_[i][-1][0], default=None)
                if at not in open_:
                    continue
                _, hit = open_[at].pop()
                if not open_[at]:
                    del open_[at]
                if ended:
                    hit[6], hit[8] = outputs, took
                else:
                    hit[7] = error
                done.append(hit)
            yield frame(done)
        yield frame([a for held in open_.values() for _, a in held])

    rows = of_type(log, "node_started", "node_completed", "node_failed").select("run_id", "node_id", "seq", "event_type", "attempt", "fan_out_index", "inputs", "outputs", "error", "duration_ms")
    return rows.repartition("run_id", "node_id").sortWithinPartitions("run_id", "node_id", "seq").mapInPandas(pair, NODE_DETAIL)


def edge_results(log: DataFrame) -> DataFrame:
    return of_type(log, "edge_evaluated").select("run_id", "seq", "edge_id", "condition", "result", "data")


def custom_events(log: DataFrame, name: str | None = None) -> DataFrame:
    found = of_type(log, "custom").select("run_id", "seq", "node_id", "name", "data")
    return found if name is None else found.where(F.col("name") == name)


def llm_invocations(log: DataFrame, node_id: str | None = None) -> DataFrame:
    found = of_type(log, "llm_invocation").select("run_id", "seq", "node_id", "model", "input_tokens", "output_tokens", "cost", "inputs", "outputs", "ts")
    return found if node_id is None else found.where(F.col("node_id") == node_id)


def llm_summary(log: DataFrame) -> DataFrame:
    """Model use of each run: calls, tokens, cost (null if no call had one), sorted distinct models and tools."""
    calls = of_type(log, "llm_invocation")
    tools = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("tool_names", F.array().cast("array<string>"))))))
    return calls.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_calls"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"), F.sum("cost").alias("cost"), F.array_sort(F.collect_set("model")).alias("models"), tools.alias("tools"))


def runs_by_version(log: DataFrame, flow_id: str) -> DataFrame:
    return runs(log).where(F.col("flow_id") == flow_id).groupBy("version_id").agg(F.count(F.lit(1)).alias("n_runs"))


def run_ids(log: DataFrame) -> DataFrame:
    return log.select("run_id").distinct()


def topology_chain(log: DataFrame) -> DataFrame:
    """(run_id, from_node, to_node): neighbours of the sorted distinct node names."""
    names = log.where("node_id is not null").select("run_id", "node_id").distinct()
    after = F.lead("node_id").over(Window.partitionBy("run_id").orderBy("node_id"))
    return names.select("run_id", F.col("node_id").alias("from_node"), after.alias("to_node")).where("to_node is not null")


def topology_from_transitions(transitions: DataFrame) -> DataFrame:
    """For each run of (run_id, ord, from_node, to_node): edges in order, repeated ones kept, and sorted distinct nodes."""
    edges = F.array_sort(F.collect_list(F.struct("ord", "from_node", "to_node")))
    nodes = F.array_sort(F.array_distinct(F.concat(F.collect_set("from_node"), F.collect_set("to_node"))))
    return transitions.groupBy("run_id").agg(F.transform(edges, lambda e: F.struct(e["from_node"].alias("from"), e["to_node"].alias("to"))).alias("edges"), nodes.alias("nodes"))


def paired(events: DataFrame, keys: tuple[str, ...] = ("run_id", "node_id", "kind"), order: str = "ord", phase: str = "phase", payload: str = "payload", default: str = "{}") -> DataFrame:
    """Each ``end`` with the payload of the start right before it among its key's events, else default.

    A start that another follows is overwritten, and an end uses its start up, so the event just
    before decides.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(F.struct(phase, payload)).over(w)
    marked = events.withColumn("_before", before)
    request = F.when(F.col(f"_before.{phase}") == "start", F.col(f"_before.{payload}")).otherwise(default)
    return marked.where(F.col(phase) == "end").select(*keys, order, request.alias("request"), F.col(payload).alias("response"))


def interrupted(log: DataFrame, now: Column | None = None) -> DataFrame:
    """Completions for the runs that a crash left running, to be appended to the log."""
    open_ = runs(log).where("status = 'running'")
    return open_.select("run_id", F.lit(LAST).alias("seq"), F.lit("run_completed").alias("event_type"), (now if now is not None else F.current_timestamp()).alias("ts"), F.lit("interrupted").alias("status"), F.lit(0).cast("long").alias("duration_ms"))


def numbered(events: DataFrame, log: DataFrame | None = None, order: str = "arrival") -> DataFrame:
    """Events with a seq of their own in each run, in order of arrival, behind what the log holds."""
    out = events.withColumn("seq", F.row_number().over(Window.partitionBy("run_id").orderBy(order)).cast("long") - 1)
    if log is None:
        return out
    last = log.where(F.col("seq") < LAST).groupBy("run_id").agg(F.max("seq").alias("_last"))
    return out.join(last, "run_id", "left").withColumn("seq", F.col("seq") + F.coalesce(F.col("_last") + 1, F.lit(0))).drop("_last")


def abandoned(log: DataFrame, before: Column) -> DataFrame:
    """Failed completions for running runs whose last event is older than a time, to be appended to the log."""
    quiet = log.groupBy("run_id").agg(F.max("ts").alias("_ts"), F.max("seq").alias("_seq")).where(F.col("_ts") < before)
    open_ = runs(log).where("status = 'running'").select("run_id", "started_at")
    took = F.greatest(F.unix_millis(F.col("_ts").cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp")), F.lit(0).cast("long"))
    return open_.join(quiet, "run_id").select("run_id", (F.col("_seq") + 1).alias("seq"), F.lit("run_completed").alias("event_type"), F.col("_ts").alias("ts"), F.lit("failed").alias("status"), took.alias("duration_ms"))


def stream_chunks_folded(chunks: DataFrame) -> DataFrame:
    """Answers from chunks (call_id, ord, kind, text, tool_index, tool_id, tool_name, input_tokens, output_tokens, finish_reason).

    Texts are joined in order; a tool call's id and name are the last ones seen, its arguments
    joined; usage is the last seen; without a finish reason it is ``stop``.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord")))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", c))), lambda x: F.coalesce(x[c], F.lit(""))), "")
    text = chunks.where("kind = 'text_delta'").groupBy("call_id").agg(joined("text").alias("content"))
    calls = chunks.where("kind = 'tool_call_delta'").groupBy("call_id", "tool_index").agg(last("tool_id").alias("id"), last("tool_name").alias("tool_name"), joined("text").alias("arguments"))
    valid = F.when(F.try_parse_json("arguments").isNotNull(), F.col("arguments")).otherwise("{}")
    calls = calls.groupBy("call_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("tool_index", "id", "tool_name", valid.alias("arguments")))), lambda x: F.struct(x["id"].alias("id"), x["tool_name"].alias("tool_name"), x["arguments"].alias("arguments"))).alias("tool_calls"))
    rest = chunks.groupBy("call_id").agg(last("input_tokens").alias("input_tokens"), last("output_tokens").alias("output_tokens"), F.coalesce(last("finish_reason"), F.lit("stop")).alias("finish_reason"))
    out = rest.join(text, "call_id", "left").join(calls, "call_id", "left")
    return out.select("call_id", F.coalesce("content", F.lit("")).alias("content"), "tool_calls", "input_tokens", "output_tokens", (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), "finish_reason")


def redacted(log: DataFrame, policy: DataFrame) -> DataFrame:
    """inputs, outputs and data by the sensitivity of a node's ports: policy (node_id, inputs_sensitivity, outputs_sensitivity) is one row a node."""
    from dagframe.functions.scalars import PII, redact

    out = log.join(policy, "node_id", "left")
    rule = lambda c, s: F.when(F.col(c).isNull(), None).otherwise(redact(F.col(c), F.coalesce(s, F.lit("none"))))
    data = F.when((F.col("event_type") == "custom") & (F.coalesce("outputs_sensitivity", F.lit("none")) != "none"), F.lit(PII)).otherwise(F.col("data"))
    return out.withColumns({"inputs": rule("inputs", F.col("inputs_sensitivity")), "outputs": rule("outputs", F.col("outputs_sensitivity")), "data": data}).select(*log.columns)
